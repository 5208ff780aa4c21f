import pytest
from hypothesis import given
from hypothesis import strategies as st

from keyfold.config import Settings
from keyfold.functions.command_line import frame, tokens
from keyfold.sources.command_log import frames


def test_tokens():
    assert tokens(r"""SET  k "a b\n\"c\"" 'd\'e' f\ g""") == ["SET", "k", 'a b\n"c"', "d'e", "f g"]
    assert tokens("  ") == [] and tokens('GET ""') == ["GET", ""]
    with pytest.raises(ValueError):
        tokens('SET k "open')


@given(st.lists(st.text(max_size=8), min_size=1, max_size=4))
def test_typed_commands_round_trip(args):
    quoted = " ".join('"' + a.replace("\\", "\\\\").replace('"', '\\"') + '"' for a in args)
    assert tokens(quoted) == args
    assert [[a.decode() for a in x] for x in frames(frame(args))] == [args]


def test_settings():
    text = "bind 10.0.0.1 # here\n port  7001\nappendonly yes\nappendfsync always\nslaveof 10.0.0.2 7000\nother x\n\n"
    assert Settings.parse(text) == Settings("10.0.0.1", 7001, True, "always", ("10.0.0.2", 7000))
    assert Settings.parse("") == Settings()
