"""Secret scan through a trigram inverted index.

Every rule's regular expression is compiled to a Boolean query over trigrams that any match must
contain. Each slice of an Arrow batch is an index segment: one pass over its bytes finds where any trigram stands that
a rule asks for, and gives each such trigram its posting list (the sorted documents of the segment that hold it). The
queries intersect and unite posting lists, and only the candidates left are verified with the expression. A rule
without a mandatory trigram scans the whole segment. Segments are independent, so the scan needs no shuffle, its
memory is bounded by a batch, and a lost task is simply run again.

Trigrams are three bytes in ASCII, A-Z lower-cased; what a rule asks for outside ASCII is left to the verification.

Defined results: a null text counts as empty; an empty text has no findings; repeated rows give a row
each; a null id is kept; an empty table gives an empty result; other columns are ignored. Offsets
are code points of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from keyfold.llm.shared import map_slices

#: Above so many alternatives a run of literals is cut; the query only gets weaker, never wrong.
MAX_ALTERNATIVES = 64
#: Bytes of a segment that are looked at in one step.
PASS = 1 << 19


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; ``keep`` drops failing matches."""

    name: str
    pattern: str
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)
    flags: int = re.ASCII


#: The three base kinds.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: m.end(2) - m.start(2) >= 12,
        re.ASCII | re.IGNORECASE,
    ),
    # matches of AKIA[A-Z0-9]+ and [0-9a-f]+ reach as far as they can, so a least length may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

#: Further well-known credential shapes; all have mandatory trigrams.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{24,}=*"),
)


@dataclass(frozen=True)
class Query:
    """A Boolean trigram query: ``op`` is 'all' (no constraint), 'and', 'or' or 'tri'."""

    op: str
    args: tuple = ()

    def trigrams(self) -> set[str]:
        if self.op == "tri":
            return {self.args[0]}
        return set().union(*(a.trigrams() for a in self.args)) if self.args else set()


ALL = Query("all")


def _and(parts: Iterable[Query]) -> Query:
    parts = tuple(dict.fromkeys(p for p in parts if p.op != "all"))
    return ALL if not parts else parts[0] if len(parts) == 1 else Query("and", parts)


def _or(parts: Iterable[Query]) -> Query:
    """Unite; a conjunction that asks for more than another one is absorbed by it."""
    parts = sorted(set(parts), key=lambda q: (len(q.trigrams()), str(q)))
    if not parts or any(p.op == "all" for p in parts):
        return ALL
    plain = {p: p.trigrams() for p in parts if p.op == "tri" or p.op == "and" and all(a.op == "tri" for a in p.args)}
    parts = tuple(p for i, p in enumerate(parts) if not (p in plain and any(q in plain and plain[q] <= plain[p] for q in parts[:i])))
    return parts[0] if len(parts) == 1 else Query("or", parts)


def _of_string(s: str) -> Query:
    grams = (s.lower()[i : i + 3] for i in range(len(s) - 2))
    return _and(Query("tri", (g,)) for g in grams if g.isascii())


def _finite(node) -> set[str] | None:
    """All strings that a parsed item matches, if they are few; else None."""
    op, arg = node
    op = str(op)
    if op == "LITERAL":
        return {chr(arg)}
    if op == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < 4:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None
    if op == "SUBPATTERN":
        return _finite_sequence(arg[-1])
    if op == "BRANCH":
        parts = [_finite_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = arg
        if int(most) > 8:
            return None
        one = _finite_sequence(inner)
        if one is None:
            return None
        out = set()
        for n in range(int(least), int(most) + 1):
            if len(one) ** n > MAX_ALTERNATIVES:
                return None
            out |= {"".join(x) for x in product(one, repeat=n)}
        return out
    if op == "AT":
        return {""}
    return None


def _finite_sequence(items) -> set[str] | None:
    out = {""}
    for node in items:
        some = _finite(node)
        if some is None or len(out) * len(some) > MAX_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in some}
    return out


def _of_sequence(items) -> Query:
    parts, run = [], {""}

    def flush() -> None:
        nonlocal run
        parts.append(_or(_of_string(s) for s in run))
        run = {""}

    for node in items:
        some = _finite(node)
        if some is not None:
            if len(run) * len(some) > MAX_ALTERNATIVES:
                flush()
            run = {a + b for a in run for b in some}
            continue
        flush()
        op, arg = str(node[0]), node[1]
        if op == "SUBPATTERN":
            parts.append(_of_sequence(arg[-1]))
        elif op == "BRANCH":
            parts.append(_or(_of_sequence(x) for x in arg[1]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and int(arg[0]) > 0:
            parts.append(_of_sequence(arg[2]))
    flush()
    return _and(parts)


def trigram_query(pattern: str, flags: int = re.ASCII) -> Query:
    """What any match of ``pattern`` must contain, over text with A-Z lower-cased.

    Without the ASCII flag, letters that ignore case may stand for letters outside ASCII; such a rule asks for nothing.
    """
    from re import _parser  # the standard library's own parser of expressions

    if flags & re.IGNORECASE and not flags & re.ASCII:
        return ALL
    return _of_sequence(_parser.parse(pattern))


def numbered(grams: list[str]) -> np.ndarray:
    """Numbers from 1 on for trigrams, by their three bytes; 0 for all others."""
    out = np.zeros(1 << 24, np.uint16)
    for i, gram in enumerate(grams):
        out[int.from_bytes(gram.encode(), "big")] = i + 1
    return out


class Segment:
    """Inverted index of one block of texts: posting lists of the trigrams that were asked for."""

    def __init__(self, texts: list[str]):
        folded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        #: All texts with a byte between them that no trigram holds, and where each ends.
        self.bytes = np.frombuffer(b"\xff".join(folded), np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in folded])
        self.every = np.arange(len(texts))
        self.postings: dict[str, np.ndarray] = {}

    def _index(self, grams: Iterable[str]) -> None:
        """Posting lists of new trigrams, in one pass over the bytes."""
        new = [g for g in dict.fromkeys(grams) if g not in self.postings]
        if not new:
            return
        self.fill(new, numbered(new))

    def fill(self, grams: list[str], asked: np.ndarray) -> None:
        """The pass: ``asked`` has the number of each trigram, counted from 1."""
        found = []
        for at in range(0, len(self.bytes) - 2, PASS):
            x = self.bytes[at : at + PASS + 2].astype(np.uint32)
            which = asked[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
            places = np.flatnonzero(which)
            found.append(np.unique(which[places].astype(np.int64) << 32 | np.searchsorted(self.ends, at + places, "right")))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        begins = np.searchsorted(pairs, np.arange(1, len(grams) + 2) << 32)
        for i, gram in enumerate(grams):
            self.postings[gram] = pairs[begins[i] : begins[i + 1]] & 0xFFFFFFFF

    def select(self, query: Query) -> np.ndarray:
        """Ascending places of the documents that satisfy the query."""
        self._index(query.trigrams())
        return self._answer(query)

    def _answer(self, query: Query) -> np.ndarray:
        if query.op == "all":
            return self.every
        if query.op == "tri":
            return self.postings[query.args[0]]
        lists = sorted(map(self._answer, query.args), key=len)
        if query.op == "or":
            return np.unique(np.concatenate(lists))
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True)
        return out


class Scanner:
    """The rules with their trigram queries; ``scan`` finds the spans of a block of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        self.grams = sorted(set().union(*(q.trigrams() for _, _, q in self.rules)))
        self.asked = numbered(self.grams)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, place of the rule, end), sorted."""
        segment = Segment(texts)
        segment.fill(self.grams, self.asked)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for place, (rule, compiled, query) in enumerate(self.rules):
            for i in segment.select(query):
                found[i] += [(m.start(), place, m.end()) for m in compiled.finditer(texts[i]) if rule.keep(m)]
        for spans in found:
            spans.sort()
        return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Rule, ...] = EXTRA_RULES) -> DataFrame:
    """A row per document: counts of the base kinds, digest of the base spans and all spans."""
    base, rules = len(BASE_RULES), BASE_RULES + tuple(extra)
    names = [r.name for r in rules]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"n_{n} long" for n in names[:base]) + ", base_sha256 string, spans string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for batch in batches:
            found = scanner.scan([t if t is not None else "" for t in batch.iloc[:, 1]])
            told = [[f"{names[k]}:{s}:{e}" for s, k, e in f] for f in found]
            basic = [",".join(x for x, (_, k, _) in zip(t, f) if k < base) for t, f in zip(told, found)]
            out = {id_col: batch.iloc[:, 0]}
            for k in range(base):
                out[f"n_{names[k]}"] = [sum(x[1] == k for x in f) for f in found]
            out["base_sha256"] = [sha256(b.encode()).hexdigest() for b in basic]
            out["spans"] = [",".join(t) for t in told]
            yield pd.DataFrame(out)

    return map_slices(docs.select(id_col, text_col), run, schema)
