"""Settings from text: a key and a value on each line; # begins a comment; unknown keys are left alone."""

from __future__ import annotations

from dataclasses import dataclass, replace

from keyfold.functions.command_line import tokens


@dataclass(frozen=True)
class Settings:
    bind: str = "0.0.0.0"
    port: int = 6379
    appendonly: bool = False
    appendfsync: str = "no"
    leader: tuple[str, int] | None = None

    @staticmethod
    def parse(text: str) -> Settings:
        out = Settings()
        for line in text.splitlines():
            key, *values = tokens(line.split("#", 1)[0]) or [""]
            if key == "bind" and values:
                out = replace(out, bind=values[0])
            elif key == "port" and values:
                out = replace(out, port=int(values[0]))
            elif key == "appendonly" and values:
                out = replace(out, appendonly=values[0] == "yes")
            elif key == "appendfsync" and values:
                out = replace(out, appendfsync=values[0])
            elif key == "slaveof" and len(values) == 2:
                out = replace(out, leader=(values[0], int(values[1])))
        return out
