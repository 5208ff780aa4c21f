"""Operators that work text by text: secrets, BPE, licenses, PII."""

import random
import re
from array import array
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyfold.llm import bpe, license_scan, pii, secret_scan

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
DOCS = "doc_id long, text string, spans int, source string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0, None) for i, t in enumerate(texts)], DOCS)


# ---- secrets


def plain_scan(text):
    """The base rules as they are worded."""
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


PARTS = ["password", "PassWd", "token", "apikey", "API_KEY", "api-key", "secret", "toKen", "ſecret", "=", ":", " ", "  ", '"', "'", "AKIA", "AKI", "ABCDEFGHIJKLMNOPQR", "0123456789abcdef", "abc", "x.y/z=+", "é😀", "\n", "short", "deadbeef"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_secrets_equal_plain_scan(parts):
    text = "".join(parts)
    assert secret_scan.Scanner(secret_scan.BASE_RULES).scan([text])[0] == plain_scan(text)


def test_trigram_query_never_misses():
    for rule, sample in ((r"(ab|cd)?efg[hi]+jkl", "efghijkl"), (r"x{2,3}yz", "XXyz"), (r"a.c", "abc"), (r"(?:foo|bar)baz", "barbaz")):
        query = secret_scan.trigram_query(rule)
        assert all(g in sample.lower() for g in query.trigrams()) or query.op == "or" or any(p.op == "or" for p in query.args)
        assert secret_scan.Segment([sample, ""]).select(query)[0] == 0
    assert secret_scan.trigram_query("[0-9a-f]{16,}").op == "all"


def test_posting_lists_hold_what_texts_hold():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abAB\u00e9\u212a ") for _ in range(rng.choice((0, 1, 2, 3, 50, 3000)))) for _ in range(300)]
    grams = ["aba", "bbb", "a b", "   ", "xyz"]
    query = secret_scan.Query("and", (secret_scan.Query("or", tuple(secret_scan.Query("tri", (g,)) for g in grams[:3])), secret_scan.Query("tri", (grams[3],))))
    segment = secret_scan.Segment(texts)
    got = segment.select(query).tolist()
    fold = [t.encode().lower().decode() for t in texts]
    assert got == [i for i, t in enumerate(fold) if any(g in t for g in grams[:3]) and grams[3] in t] and 0 < len(got) < 250
    for g in grams:
        assert segment.select(secret_scan.Query("tri", (g,))).tolist() == [i for i, t in enumerate(fold) if g in t]
    assert secret_scan.Segment([]).select(query).tolist() == [] and secret_scan.Segment(["", ""]).select(secret_scan.ALL).tolist() == [0, 1]


def test_only_candidates_are_verified(monkeypatch):
    scanner, read = secret_scan.Scanner(secret_scan.BASE_RULES[:2]), []

    class Watched:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, text):
            read.append(text)
            return self.pattern.finditer(text)

    scanner.rules = [(r, Watched(p), q) for r, p, q in scanner.rules]
    texts = ["nothing here", "akia", "PASSWORD: abcdefghijkl", "pass word", "AKIA" + "0" * 20, "x" * 100_000]
    found = scanner.scan(texts)
    assert read == [texts[2], texts[1], texts[4]] and [len(f) for f in found] == [0, 0, 1, 0, 1, 0]


def test_secret_rows_of_odd_tables(spark):
    rows = [(None, "AKIA" + "Z" * 14, "a"), (None, "AKIA" + "Z" * 14, "a"), (1, "token=" + "q" * 500_000, "b"), (2, "ab" * 400_000, "c")]
    table = spark.createDataFrame(rows, "spans long, text string, n_hex string")
    out = {(r.spans, r.n_assign, r.n_access, r.n_hex, r[5]) for r in secret_scan.scan_secrets(table.withColumnRenamed("spans", "id"), id_col="id").select("id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").withColumnRenamed("id", "key").selectExpr("key as spans", "n_assign", "n_access", "n_hex", "base_sha256", "spans as told").collect()}
    assert out == {(None, 0, 1, 0, "access:0:18"), (1, 1, 0, 0, "assign:0:500006"), (2, 0, 0, 1, "hex:0:800000")}


def test_secret_rows(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    texts = ["", None, "token = 'abcdefghijkl' " + key, "é AKIA" + "Z" * 14]
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(frame(spark, texts)).collect()}
    assert rows[0].spans == "" and rows[1].base_sha256 == sha256(b"").hexdigest()
    assert rows[2].spans == "assign:0:21,private_key:23:54" and rows[2].base_sha256 == sha256(b"assign:0:21").hexdigest()
    assert (rows[3].n_access, rows[3].spans) == (1, "access:2:20")
    assert secret_scan.scan_secrets(frame(spark, [])).count() == 0


# ---- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aeiouthn", "ab", "İΣσςßéÈ́̈中文한글𝟘½²Ⅷ ", "\x1c\x1f\x85\xa0 　 ​﻿\0\x7f'`’", "'stredlm !?.,0123456789", "ſKẞİǅͅΑΣ.Σ Σα"]


def test_bpe_equals_library(library):
    coder, rng = bpe.encoder(VOCABULARY), random.Random(1)
    for k in range(4000):
        text = "".join(rng.choice(rng.choice(ALPHABETS) if rng.random() < 0.5 else ALPHABETS[k % len(ALPHABETS)]) for _ in range(rng.choice((1, 3, 8, 20, 60, 300))))
        if k % 40 == 0:
            text += rng.choice(("<|endoftext|>", "<|startoftext|>", "<|", "|>")) + text
        ids = b"".join(coder.stream(text))
        expected = library.encode(text, add_special_tokens=False).ids
        assert array("I", ids).tolist() == expected, repr(text)
        decoder = bpe.IdDecoder(coder.merges.names)
        cut = rng.randrange(len(ids) + 1)
        assert decoder.feed(ids[:cut]) + decoder.feed(ids[cut:]) == library.decode(expected, skip_special_tokens=False)


def test_bpe_equals_library_on_every_code_point(library):
    """Each as a letter's neighbour, inside a word and by itself; private and surrogate ones are sampled and left out."""
    coder = bpe.encoder(VOCABULARY)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x40000 or c % 61 == 0)]
    for at in range(0, len(points), 2000):
        text = " ".join(f"a{chr(c)}b {chr(c)} x{chr(c)}" for c in points[at : at + 2000])
        ids = array("I", b"".join(coder.stream(text))).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, hex(points[at])


def test_tokens_stay_apart_as_the_merge_list_has_it():
    merges, rng = bpe.encoder(VOCABULARY).merges, random.Random(5)
    plain = [t for t in merges.vocab if not t.endswith(bpe.MARK) and merges.whole(t)]
    ends = [t for t in merges.vocab if t.endswith(bpe.MARK) and merges.whole(t)]
    both = {True: 0, False: 0}
    for _ in range(30_000):
        left, right = rng.choice(plain[: rng.choice((400, 20_000))]), rng.choice(rng.choice((plain, ends))[: rng.choice((400, 20_000))])
        apart = merges.merged(merges.symbols(left)[:-1] + [left[-1]] + merges.symbols(right)) == [left, right]
        assert merges.apart(left, right) == apart, (left, right)
        both[apart] += 1
    assert min(both.values()) > 1000


def long_pieces(rng):
    yield "".join(rng.choice("thaneriou") for _ in range(30_000))
    for unit in ("a", "ab", "an", "ing", "the", "tion", "ha", "ana", "!", "=-", "0o", "éè"):
        yield unit * (6_000 // len(unit))


def test_bpe_streams_long_pieces_in_constant_memory(library):
    coder, rng = bpe.encoder(VOCABULARY), random.Random(2)
    merges = coder.merges
    for piece in long_pieces(rng):
        pieces = [p for p, _ in coder.split(coder.normal(piece))]
        got, most = [], 0
        for part in pieces:
            symbols = part.encode().decode("latin-1").translate(coder.symbols)
            stream = bpe.PieceEncoder(merges)
            for at in range(0, len(symbols), 37):
                got += stream.feed(symbols[at : at + 37])
                most = max(most, len(stream.last))
            got += stream.finish()
        assert got == library.encode(piece, add_special_tokens=False).ids
        assert most <= 3 * merges.lookahead + 1


def test_lookahead_bounds_what_text_to_come_changes():
    """The tokens of a text that end ``lookahead`` symbols before its end stay when text is added; in small merge lists chains are common."""
    rng, reached = random.Random(6), 0
    for _ in range(300):
        tokens, pairs = list("abc"), []
        for _ in range(rng.randrange(2, 14)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens:
                pairs.append(pair)
                tokens.append("".join(pair))
        marked = [s + bpe.MARK for s in "abc"]
        spec = {"model": {"type": "BPE", "end_of_word_suffix": bpe.MARK, "vocab": {t: i for i, t in enumerate(tokens + marked)}, "merges": pairs}, "added_tokens": []}
        merges = bpe.Merges(spec)
        for _ in range(60):
            text = "".join(rng.choice("abc"[: rng.choice((1, 2, 3))]) for _ in range(rng.randrange(2, 40)))
            n = rng.randrange(1, len(text))
            whole, part = (merges.merged(merges.symbols(t + "c" + bpe.MARK)[:-1] if t else []) for t in (text, text[:n]))
            same = 0
            while same < min(len(whole), len(part)) and whole[same] == part[same]:
                same += 1
            if same < len(part):
                changed = n - sum(map(len, part[: same + 1]))  # symbols after the first token that does not stay
                assert changed < merges.lookahead
                reached = max(reached, changed)
            coder = bpe.PieceEncoder(merges)
            ids = [i for s in text for i in coder.feed(s)] + coder.finish()
            assert [merges.names[i] for i in ids] == merges.merged(merges.symbols(text + bpe.MARK))
    assert reached >= 4


def test_bpe_rows(spark, library):
    texts = ["Hello, world", "", None, "naïve <|endoftext|> café"]
    rows = {r.doc_id: r for r in bpe.encode_decode(frame(spark, texts), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == sha256(array("I", ids).tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(frame(spark, texts), VOCABULARY)
    text = {r.doc_id: r.text for r in bpe.decode(encoded, VOCABULARY).collect()}
    assert text == {0: "hello , world ", 1: "", 2: "", 3: "naïve <|endoftext|>café "}
    assert bpe.encode_decode(frame(spark, []), VOCABULARY).count() == 0


# ---- licenses


def test_alignment_is_increasing_and_equal():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in "ab")
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    words = license_scan.words_of(license_scan.TEMPLATES["mit-text"])
    assert license_scan.align(words, words) == [(i, i) for i in range(len(words))]


def test_prefix_words_leave_nothing_out():
    """Every stretch of a template's length that reaches the coverage is met, whichever words are missing."""
    rng = random.Random(4)
    for name, text in license_scan.TEMPLATES.items():
        template = license_scan.Template(name, text, 0.85)
        for _ in range(20):
            drop = set(rng.sample(range(len(template.words)), len(template.words) - template.need))
            kept = [w for i, w in enumerate(template.words) if i not in drop]
            assert template.marks & set(kept)


def test_license_rows(spark):
    mit = license_scan.TEMPLATES["mit-text"]
    changed = mit.replace("free of charge", "without any charge")
    filler = "the of and to in for with under license software " * 200
    texts = [f"x\n{license_scan.TEMPLATES['mit']}\ny Released under the MIT License", filler + changed + filler, "", None, "Released under the BSD License.", mit + "\n" + mit]
    rows = license_scan.scan_licenses(frame(spark, texts)).collect()
    found = sorted((r.doc_id, r.license) for r in rows)
    assert found == [(0, "mit"), (0, "mit"), (1, "mit-text"), (5, "mit-text"), (5, "mit-text")]
    spans = [texts[0][r.span_begin : r.span_end] for r in rows if r.doc_id == 0]
    assert spans == ["Released under the MIT License"] * 2
    assert all(0.85 <= r.coverage <= 1 for r in rows)


# ---- PII


def test_feistel_is_a_permutation(spark):
    for a, b in ((7, 5), (10, 10), (16, 3)):
        got = spark.range(a * b).select(pii.feistel(F.col("id"), a, b, "k", "t").alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(a * b))
    got = spark.range(1000).select(pii.digits(F.lpad(F.col("id").cast("string"), 3, "0"), 3, "k", "t").alias("x")).collect()
    assert sorted(r.x for r in got) == [f"{i:03d}" for i in range(1000)]


def plain_rounds(left, right, a, b, key, kind):
    for i in range(pii.ROUNDS):
        half, size = (right, a) if i % 2 == 0 else (left, b)
        moved = int(sha256(f"{key}:{kind}:{i}:{half}".encode()).hexdigest()[:15], 16) % size
        left, right = ((left + moved) % a, right) if i % 2 == 0 else (left, (right + moved) % b)
    return left, right


def plain_digits(text, key, kind):
    n, half = len(text), (len(text) + 1) // 2
    left, right = plain_rounds(int(text[:half]), int(text[half:]), 10**half, 10 ** (n - half), key, f"{kind}{n}")
    return f"{left:0{half}d}{right:0{n - half}d}"


def luhn(number):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10


def test_pii_rows(spark):
    phone, card = "+1 (743) 555-3824", "4111111111111111"
    texts = [f"call {phone}, or {phone}.", f"{card} 4111-1111-1111-1111 4111111111111112", "8.196.197.208 1.2.3.4.5 300.1.1.1", "2024-02-29 2023-02-30 31/12/1999 1899-12-31", "a.b@mail.example.com A.B@mail.example.com", "078-05-1120 x078-05-1120 e9b9ed9cc9", None, "", "no digits"]
    rows = {r.doc_id: r for r in pii.pseudonymize(frame(spark, texts), "key").collect()}
    d = plain_digits("7435553824", "key", "phone")
    new = f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"
    assert rows[0].text == f"call {new}, or {new}." and rows[0].n_phone == 2
    a, b, c = rows[1].text.split(" ")
    assert a == b.replace("-", "") and luhn(a) == 0 and a[:15] == plain_digits(card[:15], "key", "card") and c == "4111111111111112"
    parts = rows[2].text.split(" ")
    whole = 8 << 24 | 196 << 16 | 197 << 8 | 208
    left, right = plain_rounds(whole >> 16, whole & 65535, 65536, 65536, "key", "address")
    assert parts == [".".join(str((left << 16 | right) >> s & 255) for s in (24, 16, 8, 0)), "1.2.3.4.5", "300.1.1.1"]
    days = rows[3].text.split(" ")
    assert rows[3].n_date == 2 and re.fullmatch(r"\d{4}-\d\d-\d\d", days[0]) and re.fullmatch(r"\d\d/\d\d/\d{4}", days[2]) and days[1] == "2023-02-30" and days[3] == "1899-12-31"
    one, two = rows[4].text.split(" ")
    assert one == two and one.endswith("@mail.example.com") and rows[4].n_mail == 2
    d = plain_digits("078051120", "key", "social")
    assert rows[5].text == f"{d[:3]}-{d[3:5]}-{d[5:]} x078-05-1120 e9b9ed9cc9"
    assert rows[6].text is None and rows[7].text == "" and rows[8].text == "no digits"
    other = {r.doc_id: r.text for r in pii.pseudonymize(frame(spark, texts), "other").collect()}
    assert other[0] != rows[0].text
    nodes = pii.pseudonymize(frame(spark, texts), "key")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Exchange" not in nodes


def test_pii_shapes(spark):
    same = ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "743.555.3824", "+1-743-555-3824", "+1 743 555 3824", "+17435553824"]
    texts = [f"tel {p}, x" for p in same] + ["+442071838750", "3782 822463 10005 378282246310005 3782-822463-10005", "http://10.0.0.1/path 10.0.0.1", "at 2024-01-02T10:00:00Z, 2024-01-02", "000-12-3456 666-12-3456 901-12-3456 123-00-4567 123-45-0000 123-45-6789", "743-555-3824-1 1743-555-3824 v743-555-3824"]
    rows = [r for r in sorted(pii.pseudonymize(frame(spark, texts), "key").collect())]
    d = plain_digits("7435553824", "key", "phone")
    for p, r in zip(same, rows):
        new = r.text[4:-3]
        assert r.n_phone == 1 and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", p) and re.sub("[^0-9]", "", new)[-10:] == d
    rows = rows[len(same) :]
    assert rows[0].text == "+44207" + plain_digits("1838750", "key", "phone")[:0] + rows[0].text[6:] and rows[0].text == "+44207"[:6] + plain_digits("2071838750"[3:], "key", "phone")
    one, two, three = rows[1].text[:17], rows[1].text[18:33], rows[1].text[34:]
    assert one.replace(" ", "") == two == three.replace("-", "") != "378282246310005" and luhn(two) == 0 and re.fullmatch(r"\d{4} \d{6} \d{5}", one)
    inner, plain = re.fullmatch(r"http://(\S+)/path (\S+)", rows[2].text).groups()
    assert inner == plain != "10.0.0.1" and rows[2].n_address == 2
    inner, plain = re.fullmatch(r"at (\S+)T10:00:00Z, (\S+)", rows[3].text).groups()
    assert inner == plain != "2024-01-02" and rows[3].n_date == 2
    assert rows[4].n_social == 1 and rows[4].text.startswith(texts[len(same) + 4][:-11])
    assert rows[5].text == texts[-1]


def test_social_numbers_stay_possible(spark):
    numbers = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 57, 99) for s in range(1, 9999, 97)]
    rows = pii.pseudonymize(frame(spark, numbers), "key").collect()
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", r.text) for r in rows)
    assert len({r.text for r in rows}) == len(numbers)


def test_long_and_odd_texts_of_personal_data(spark):
    labels = "a@" + "b.cc." * 40_000 + "com"
    texts = [labels, "x" * 1_000_000, "1." * 200_000 + "1", "1-" * 200_000, "9" * 1_000_000, "a@" * 200_000, "+1 (" * 100_000, "@" * 300_000, "a.b@c.de " * 50_000]
    rows = sorted(pii.pseudonymize(frame(spark, texts), "key").collect())
    assert rows[0].n_mail == 1 and rows[0].text.endswith(".cc.com") and len(rows[0].text) > 100_000
    assert [r.text for r in rows[1:8]] == texts[1:8] and rows[8].n_mail == 50_000
    table = spark.createDataFrame([(None, "a@b.com", 1), (None, "a@b.com", 1), (7, None, 1)], "_text long, _found string, _kinds int")
    out = pii.pseudonymize(table, "key", id_col="_text", text_col="_found").collect()
    assert len(out) == 3 and sum(r.n_mail for r in out) == 2 and len({r.text for r in out if r.text}) == 1
    assert pii.pseudonymize(table.limit(0), "key", id_col="_text", text_col="_found").count() == 0
