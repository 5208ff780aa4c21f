"""Row types and the closed command table."""

from __future__ import annotations

ENGINES = ("array", "rbtree", "hash", "skiplist")

KV = "engine string, key string, value string, expire_ms long"
VECTOR = "question string, answer string, dim int, vector array<float>, norm double, seq long"
COMMAND = "seq long, ts_ms long, engine string, op string, key string, value string, ttl_ms long"
REPLY = "seq long, op string, key string, reply string"

#: Prefix of a verb for each keyspace.
PREFIX = {"array": "", "rbtree": "R", "hash": "H", "skiplist": "SK"}

#: Base verb, fewest and most arguments (the verb counts), whether it writes.
KV_VERBS = (
    ("SET", 3, 3, True),
    ("GET", 2, 2, False),
    ("DEL", 2, 2, True),
    ("MOD", 3, 3, True),
    ("EXIST", 2, 2, False),
    ("EXPIRE", 3, 3, True),
    ("TTL", 2, 2, False),
    ("SETEX", 4, 4, True),
)
OTHER_VERBS = (
    ("BGSAVE", 1, 1, False),
    ("SYNC", 1, 1, False),
    ("FINSYNC", 1, 1, False),
    ("VSET", 5, 5, True),
    ("VGET", 2, 4, False),
    ("VSEARCH", 5, 5, False),
    ("PING", 1, 1, False),
)


def commands() -> list[tuple[str, int, int, bool]]:
    """(verb, fewest, most, writes) of all 39 commands."""
    return [(p + v, a, b, w) for p in PREFIX.values() for v, a, b, w in KV_VERBS] + list(OTHER_VERBS)


#: Which operations take an expired key away when they meet it, for each keyspace; ``logical`` hides expired keys from every operation.
REMOVES = {
    "array": ("GET",),
    "rbtree": ("GET", "EXIST"),
    "hash": ("GET", "MOD"),
    "skiplist": ("GET", "EXIST"),
    "logical": ("GET", "EXIST", "MOD", "TTL", "EXPIRE"),
}
#: Where MOD needs a live key, not just a present one.
MOD_NEEDS_LIVE = ("hash", "logical")
