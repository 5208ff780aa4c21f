"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding. A piece (a run that the tokenizer's split expression yields) is a string of symbols, the last
of which carries the end-of-word mark. A sequence of tokens is the merge list's encoding of its text
exactly if each token encodes to itself and each neighbouring pair encodes to itself, so every
prefix has one last token. An automaton over the symbols (its state is the longest suffix read that begins a token) lists
the tokens that may end at a place, and the last token is the one that stands beside the last token of the prefix before it.

Lookahead. Text that is added to a prefix changes its tokens near the end only. Each merge that happens in one of the two
encodings alone does so because of another such merge of smaller rank, whose left part begins the right part of this one, so
the ranks along such a chain grow, and the chain reaches as far to the left as the lengths of its left parts add up to.
``Merges.lookahead`` is the greatest such sum, by dynamic programming over the merge list from its end. Tokens that end
so many symbols before the last one read are emitted; memory is a small multiple of the lookahead, however long the piece.

Decoding is a state machine over id bytes: it keeps the bytes of an incomplete id (and, for text, of
an incomplete UTF-8 character) and emits the rest.

Character classes, case and composition of characters outside ASCII are those of the tokenizers library, which follows a
Unicode version of its own. Words repeat, so the encoding of a white-space delimited chunk is remembered in a table of bounded
size, of which the older half is forgotten when it is full. This changes the time taken, never the result.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows give a row each;
a null id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from keyfold.llm.shared import map_slices

#: The White_Space property of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space for str.split() and not for Unicode; texts with these take the slower split.
ODD_SPACE = re.compile("[\x1c-\x1f]")
CHUNKS = re.compile(f"[^{SPACE}]+")
#: Bounds on remembered chunks of a generation (two are kept), pairs and beginnings of pieces.
REMEMBERED, PAIRS, BEGINNINGS = 200_000, 400_000, 60_000
#: Longer chunks and pieces are not remembered.
LONGEST = 64
#: Chunks that are hashed and decoded at a time.
BLOCK = 8192
#: Symbols at the beginning of pieces that are read once for all.
HEAD = 6
MARK = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return [c for _, c in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + i)) for i, b in enumerate(rest)])]


class Merges:
    """The merge list: ranks, vocabulary, sufficient lookahead, automaton and stable pairs.

    Tokens are told by codes: their id and one, 0 being the beginning of a piece.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != MARK:
            raise ValueError("a BPE model with the end-of-word suffix </w> is expected")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {a + b: (a, b) for a, b in pairs}
        made = {a + b: i for i, (a, b) in enumerate(pairs)}
        if len(made) < len(pairs) or any(made.get(x, -1) >= i for i, p in enumerate(pairs) for x in p):
            raise ValueError("each token must have one merge, after those of its parts")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: list[str] = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = token
        self.longest = max((self.length(a + b) for a, b in pairs), default=1)
        self.lookahead = max(self.longest, self._reach(pairs))
        self.begins = {t[:n] for t in map(self.body, self.vocab) for n in range(len(t) + 1)}
        #: Automaton, filled as it is used: state and symbol to (state, tokens that end here, marked tokens that end here), longest first.
        self.steps: dict[str, tuple[str, list, list]] = {}
        self.known: dict[int, bool] = {}
        self.heads: dict[str, tuple[str, list[int], list[int]]] = {}

    @staticmethod
    def length(token: str) -> int:
        return len(Merges.body(token))

    @staticmethod
    def body(token: str) -> str:
        return token[: -len(MARK)] if token.endswith(MARK) and len(token) > len(MARK) else token

    def _reach(self, pairs: list[tuple[str, str]]) -> int:
        """How many symbols before the end of a prefix the end of its final tokens lies at most."""
        most, reach = 0, {}  # token: greatest reach of a chain whose next merge has a right part that begins with it
        for left, right in reversed(pairs):
            here = self.length(left) + reach.get(left, 0)
            most = max(most, here)
            while right:
                reach[right] = max(reach.get(right, 0), here)
                right = self.parts.get(right, ("",))[0]
        return most

    def symbols(self, token: str) -> list[str]:
        body = self.body(token)
        return [*body[:-1], token[len(body) - 1 :]]

    def merged(self, symbols: list[str]) -> list[str]:
        """Apply the merge list: the lowest rank first, the leftmost of equals."""
        rank, never = self.rank.get, len(self.rank)
        while len(symbols) > 1:
            ranks = [rank(p, never) for p in zip(symbols, symbols[1:])]
            if (least := min(ranks)) == never:
                break
            at = ranks.index(least)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @lru_cache(maxsize=1 << 17)
    def edge(self, token: str, side: int) -> list[tuple[int, str]]:
        """The tokens at the right (1) or left (0) edge while the token is built, each with the rank of the merge that ends it."""
        out, upper = [], len(self.rank)
        while True:
            out.append((upper, token))
            if token not in self.parts:
                return out[::-1]
            upper, token = self.rank[self.parts[token]], self.parts[token][side]

    @lru_cache(maxsize=1 << 17)
    def whole(self, token: str) -> bool:
        """Does the token encode to itself?"""
        return self.merged(self.symbols(token)) == [token]

    def apart(self, left: str, right: str) -> bool:
        """Do two tokens that are whole stay apart? No merge across may come before the next merge on either side."""
        a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        never = len(self.rank)
        while True:
            (end_a, x), (end_b, y) = a[i], b[j]
            across = self.rank.get((x, y), never)
            if across < end_a and (across < end_b or across == end_b < never):
                return False
            if end_a == end_b == never:
                return True
            if end_a <= end_b:
                i += 1
            else:
                j += 1

    def stable(self, key: int) -> bool:
        """Do the two tokens of the key stay apart, and each whole, when their text is encoded?"""
        if len(self.known) > PAIRS:
            self.known.clear()
        left, right = divmod(key, len(self.names) + 1)
        token = self.names[right - 1]
        known = self.known[key] = self.whole(token) and (not left or self.apart(self.names[left - 1], token))
        return known

    def step(self, read: str) -> tuple[str, list, list]:
        """The automaton's move by the last symbol of ``read`` from the state that comes before it."""
        state = read
        while state not in self.begins:
            state = state[1:]
        ends = [state[i:] for i in range(len(state))]
        plain, marked = ([(len(x), self.vocab[x + mark] + 1) for x in ends if x + mark in self.vocab] for mark in ("", MARK))
        if len(self.steps) > REMEMBERED:
            self.steps.clear()
        out = self.steps[read] = (state, plain, marked)
        return out


class PieceEncoder:
    """Streaming transducer over the symbols of one piece: ``feed`` any number of times, then ``finish``; both give ids."""

    def __init__(self, merges: Merges, read: tuple[str, list[int], list[int]] = ("", [0], [0])):
        self.merges = merges
        self.state = read[0]
        self.last = read[1][:]  # for each place since the last token that was emitted: the code of the last token before it
        self.sizes = read[2][:]  # and its length
        self.held = ""  # one symbol, as the last of a piece carries the mark

    def _advance(self, symbols: str, kind: int) -> None:
        """Read symbols; ``kind`` is 1, or 2 if the last of the piece is read."""
        merges, state, last, sizes = self.merges, self.state, self.last, self.sizes
        steps, known, n = merges.steps, merges.known, len(merges.names) + 1
        for symbol in symbols:
            read = state + symbol
            step = steps.get(read) or merges.step(read)
            state = step[0]
            for size, token in step[kind]:
                key = last[-size] * n + token
                fits = known.get(key)
                if merges.stable(key) if fits is None else fits:
                    break
            last.append(token)
            sizes.append(size)
        self.state = state

    def _emit(self, end: int) -> list[int]:
        """The ids of the tokens that end at ``end`` or before."""
        out, last, sizes = [], self.last, self.sizes
        while end:
            out.append(last[end] - 1)
            end -= sizes[end]
        return out[::-1]

    def feed(self, symbols: str) -> list[int]:
        """Read more of the piece; give the ids that have become stable."""
        out: list[int] = []
        symbols = self.held + symbols
        self.held = symbols[-1:]
        for at in range(0, len(symbols) - 1, self.merges.lookahead):
            self._advance(symbols[at : min(at + self.merges.lookahead, len(symbols) - 1)], 1)
            if len(self.last) > 2 * self.merges.lookahead:
                end, stable = len(self.last) - 1, len(self.last) - 1 - self.merges.lookahead
                while end > stable:
                    end -= self.sizes[end]
                out += self._emit(end)
                del self.last[:end], self.sizes[:end]
        return out

    def finish(self) -> list[int]:
        if not self.held:
            return []
        self._advance(self.held, 2)
        return self._emit(len(self.last) - 1)

    @staticmethod
    def whole(merges: Merges, symbols: str) -> list[int]:
        """The ids of a piece; how pieces begin is remembered."""
        head = symbols[: min(HEAD, len(symbols) - 1)]
        read = merges.heads.get(head)
        if read is None:
            coder = PieceEncoder(merges)
            coder._advance(head, 1)
            if len(merges.heads) > BEGINNINGS:
                merges.heads.clear()
            read = merges.heads[head] = (coder.state, coder.last, coder.sizes)
        coder = PieceEncoder(merges, read)
        if len(symbols) > merges.lookahead:
            return coder.feed(symbols[len(head) :]) + coder.finish()
        if len(symbols) > len(head) + 1:
            coder._advance(symbols[len(head) : -1], 1)
        coder._advance(symbols[-1], 2)
        return coder._emit(len(coder.last) - 1)


class Encoder:
    """Encodes texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        spec = json.load(open(path, encoding="utf-8"))
        self.merges = Merges(spec)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("texts are expected to be composed, their white space replaced and their case lowered")
        expression = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(expression, regex.ASCII).findall
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.split = pre_tokenizers.Split(Regex(expression), "removed", invert=True).pre_tokenize_str
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")
        self.marks = {s[:2] for s in self.merges.special}
        self.symbols = dict(enumerate(byte_symbols()))
        #: Ids of chunks and pieces, the newer ones and those before them.
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Ids of a piece; a space before it does not count."""
        piece = piece.lstrip(" ")
        plain = piece.isascii() and piece.isprintable()
        symbols = piece if plain else piece.encode().decode("latin-1").translate(self.symbols)
        return array("I", PieceEncoder.whole(self.merges, symbols)).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        if chunk.isascii():
            text = chunk.lower()
            pieces = [text] if text.isalpha() else self.pieces(text)
        else:
            text = self.normal(chunk)
            pieces = [text] if text.isascii() and text.isalpha() else [p for p, _ in self.split(text)]
        if pieces == [chunk]:
            return self.piece(chunk)
        out = []
        for piece in pieces:
            # a piece in ASCII is a chunk with the same ids; others might be composed anew, so they have keys that are no chunks
            out.append(self.ids(piece if piece.isascii() else " " + piece, self.piece))
        return b"".join(out)

    def ids(self, key: str, work_out: Callable[[str], bytes]) -> bytes:
        """What is remembered for a key, or else worked out."""
        ids = self.table.get(key)
        if ids is None:
            ids = self.older.get(key)
            if ids is None:
                ids = work_out(key)
            if len(self.table) >= self.remembered:
                self.table, self.older = {}, self.table
            if len(key) <= LONGEST:
                self.table[key] = ids
        return ids

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids of a text, block by block."""
        parts = self.special.split(text) if any(m in text for m in self.marks) else [text]
        for part in parts:
            if part in self.merges.special:
                yield array("I", [self.merges.special[part]]).tobytes()
                continue
            chunks = CHUNKS.findall(part) if ODD_SPACE.search(part) else part.split()
            for at in range(0, len(chunks), BLOCK):
                block = chunks[at : at + BLOCK]
                ids = list(map(self.table.get, block))
                if None in ids:
                    ids = [self.ids(chunk, self.chunk) if found is None else found for chunk, found in zip(block, ids)]
                yield b"".join(ids)


class IdDecoder:
    """Id bytes to token names joined by spaces (a vocabulary without a decoder), in any portions."""

    def __init__(self, names: list[str]):
        self.names, self.left, self.begun = names, b"", False

    def feed(self, data: bytes) -> str:
        if self.left:
            data = self.left + data
        whole = len(data) & ~3
        self.left = data[whole:]
        if not whole:
            return ""
        ids = array("I")
        ids.frombytes(data[:whole] if self.left else data)
        text = " ".join([self.names[i] for i in ids])
        text, self.begun = (" " + text if self.begun else text), True
        return text


class TextDecoder:
    """Id bytes to readable text: token names to bytes, bytes to characters, the mark to a space."""

    def __init__(self, names: list[str]):
        self.names, self.left = names, b""
        self.bytes = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.left + data
        whole = len(data) & ~3
        self.left = data[whole:]
        ids = array("I")
        ids.frombytes(data[:whole])
        out = bytearray()
        for i in ids:
            name = self.names[i]
            ends = name.endswith(MARK)
            for s in name[: -len(MARK)] if ends else name:
                out += self.bytes.get(s) or s.encode()
            if ends:
                out += b" "
        return self.utf8.decode(bytes(out), final)


def public_vocabulary() -> str:
    """Where this machine has the public vocabulary of words."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def encoder(path: str | Callable[[], str], remembered: int = REMEMBERED) -> Encoder:
    """The encoder of a vocabulary file; a function is asked for the path where the encoder is used."""
    return Encoder(path if isinstance(path, str) else path(), remembered)


def encode_decode(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """A row per document: number of tokens, digest of the ids and digest of the decoded text.

    ``remembered`` chunks of a generation take a worker about 0.3 MB for each thousand; more of them save time, never change a result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, remembered)
        for batch in batches:
            rows = []
            for text in batch.iloc[:, 1]:
                n, ids, decoded, back = 0, sha256(), sha256(), IdDecoder(coder.merges.names)
                for block in coder.stream(text if text is not None else ""):
                    n += len(block) // 4
                    ids.update(block)
                    decoded.update(back.feed(block).encode())
                rows.append((n, ids.hexdigest(), decoded.hexdigest()))
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({id_col: batch.iloc[:, 0], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})

    return map_slices(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for batch in batches:
            ids = [array("I", b"".join(coder.stream(t if t is not None else ""))).tolist() for t in batch.iloc[:, 1]]
            yield pd.DataFrame({id_col: batch.iloc[:, 0], "ids": ids})

    return map_slices(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, ids array<long>")


def decode(encoded: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row per document with the readable text of its ids."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = encoder(path).merges.names
        for batch in batches:
            texts = [TextDecoder(names).feed(array("I", [] if ids is None else list(ids)).tobytes(), True) for ids in batch.iloc[:, 1]]
            yield pd.DataFrame({id_col: batch.iloc[:, 0], "text": texts})

    return map_slices(encoded.select(id_col, ids_col), run, f"`{id_col}` {id_type}, text string")
