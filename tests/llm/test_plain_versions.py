"""License scan, training and pseudonyms against versions written as plainly as they can be; odd tables."""

import math
import random
import re
from datetime import date, timedelta
from hashlib import sha256

import numpy as np
import regex

from keyfold.llm import license_scan, pii, toxicity
from tests.llm.test_texts import luhn, plain_digits, plain_rounds

# ---- licenses


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_scan(text, templates, least):
    """Around every word that a sufficient match cannot lack, whatever else the text holds, the stretch is aligned."""
    spans = [m.span() for m in re.finditer("[A-Za-z0-9]+", text)]
    words, out = [text[a:b].lower() for a, b in spans], []
    for name, template in templates.items():
        own = re.findall("[a-z0-9]+", template.lower())
        need = max(1, math.ceil(least * len(own) - 1e-9))
        marks = sorted(own, key=lambda w: (-len(w), w))[: len(own) - need + 1]
        after = 0
        for at, word in enumerate(words):
            low = max(after, at - len(own))
            if at >= after and word in marks:
                stretch = words[low : at + len(own) + 1]
                pairs = license_scan.align(stretch, own)
                assert len(pairs) <= common_subsequence(stretch, own)
                if len(pairs) >= need:
                    after = low + pairs[-1][0] + 1
                    out.append((name, spans[low + pairs[0][0]][0], spans[after - 1][1], round(len(pairs) / len(own), 4)))
    return out


def test_license_scan_equals_plain_version(spark):
    rng = random.Random(8)
    templates = {"short": "released under the small terms of use", "long": " ".join(f"w{i % 23}" + "x" * (i % 5) for i in range(60)), "one": "copyleft"}
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(6)):
            words = rng.choice(list(templates.values())).split()
            kept = [w for w in words if rng.random() > rng.choice((0, 0.1, 0.3))]
            parts.append(rng.choice((" ", "\n// ", "; ")).join(w.upper() if rng.random() < 0.1 else w for w in kept))
            parts.append(" ".join(rng.choice(("the", "use", "w3xxx", "filler", "é", "W1x")) for _ in range(rng.randrange(8))))
        texts.append(" ".join(parts))
    texts += ["", "w1 " * 3000, "released under the small terms of use " * 40]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2 + [(None, "copyleft"), (None, None)], "id long, text string")
    got = sorted((r.id, r.license, r.span_begin, r.span_end, r.coverage) for r in license_scan.scan_licenses(table, templates, id_col="id").collect() if r.id is not None)
    expected = sorted([(i, *f) for i, t in enumerate(texts) for f in plain_scan(t, templates, 0.85)] * 2)
    assert got == expected and len(got) > 200
    assert license_scan.scan_licenses(table, templates, id_col="id").filter("id IS NULL").count() == 1
    assert license_scan.scan_licenses(table.limit(0), templates, id_col="id").count() == 0


# ---- toxicity


def plain_ftrl(model, examples, labels, epochs):
    """One coordinate after the other."""
    z, n = {}, {}
    for _ in range(epochs):
        for x, y in zip(examples, labels):
            w = {}
            for i in x:
                zi, ni = z.get(i, 0.0), n.get(i, 0.0)
                w[i] = 0.0 if abs(zi) <= model.l1 else -(zi - math.copysign(model.l1, zi)) / ((model.beta + math.sqrt(ni)) / model.alpha + model.l2)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = (p - y) * (model.positive if y else 1.0)
            for i in x:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / model.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    out = {}
    for i, zi in z.items():
        if abs(zi) > model.l1:
            out[i] = -(zi - math.copysign(model.l1, zi)) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)
    return out


def test_training_equals_plain_version():
    rng = random.Random(9)
    for l1, l2, positive in ((0.5, 0.0, 3.0), (2.0, 0.3, 1.0)):
        model = toxicity.Ftrl(alpha=0.7, l1=l1, l2=l2, positive=positive, updates=400)
        labels = [int(rng.random() < 0.4) for _ in range(80)]
        examples = [np.array(sorted({rng.randrange(60) + 40 * y for _ in range(8)} | {1 << toxicity.BITS}), np.int32) for y in labels]
        places, weights = model.fit(examples, labels)
        plain = plain_ftrl(model, [x.tolist() for x in examples], labels, 5)
        assert sorted(plain) == places.tolist() and 5 < len(plain) < 101
        assert np.allclose([plain[i] for i in places.tolist()], weights, rtol=1e-9)


# ---- personal data


def plain_kind(x):
    whole = lambda p: re.fullmatch(p, x) is not None
    day = None
    for pattern, order in ((r"(\d{4})-(\d\d)-(\d\d)", (1, 2, 3)), (r"(\d\d)/(\d\d)/(\d{4})", (3, 2, 1))):
        if m := re.fullmatch(pattern, x, re.ASCII):
            try:
                day = date(*(int(m[i]) for i in order))
            except ValueError:
                pass
    if "@" in x:
        return "mail", None
    if whole(r"(\+1[ .-]?)?(\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}|\+1 [0-9]{3} [0-9]{3} [0-9]{4}|\+[1-9][0-9]{7,14}"):
        return "phone", None
    if whole(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}") and luhn(re.sub("[ -]", "", x)) == 0:
        return "card", None
    if whole(r"[0-9]{1,3}(\.[0-9]{1,3}){3}") and all(int(o) < 256 and str(int(o)) == o for o in x.split(".")):
        return "address", None
    if whole(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"):
        return "social", None
    if day is not None and 0 <= (day - date(1900, 1, 1)).days < 270 * 271:
        return "date", day
    return None, None


def put(x, digits):
    """The last digits of x replaced, in place."""
    out, left = [], list(digits)
    for c in reversed(x):
        out.append(left.pop() if c.isdigit() and left else c)
    return "".join(reversed(out))


def plain_pseudonym(x, key):
    kind, day = plain_kind(x)
    plain = re.sub("[^0-9]", "", x)
    if kind == "mail":
        return kind, "u" + sha256(f"{key}:mail:{x.lower()}".encode()).hexdigest()[:16] + "@" + x.rsplit("@", 1)[1]
    if kind == "phone":
        national = (not x.startswith("+") or x.startswith("+1")) and len(plain) in (10, 11)
        return kind, put(x, plain_digits(plain[-10:] if national else plain[-7:], key, "phone"))
    if kind == "card":
        body = plain_digits(plain[:-1], key, "card")
        return kind, put(x, body + next(c for c in "0123456789" if luhn(body + c) == 0))
    if kind == "address":
        a, b, c, d = map(int, x.split("."))
        left, right = plain_rounds(a << 8 | b, c << 8 | d, 65536, 65536, key, "address")
        return kind, f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"
    if kind == "social":
        while True:
            plain = plain_digits(plain, key, "social")
            if plain_kind(f"{plain[:3]}-{plain[3:5]}-{plain[5:]}")[0] == "social":
                return kind, put(x, plain)
    if kind == "date":
        left, right = plain_rounds(*divmod((day - date(1900, 1, 1)).days, 271), 270, 271, key, "date")
        moved = date(1900, 1, 1) + timedelta(left * 271 + right)
        return kind, moved.strftime("%Y-%m-%d" if x[4] == "-" else "%d/%m/%Y")
    return None, x


def test_pseudonyms_equal_plain_version(spark):
    rng = random.Random(10)
    parts = ["a.b@mail.example.com", "X_1@é.de", "me@host", "q@a.b.c1", "+1 (743) 555-3824", "(212) 555-0100", "212.555.0100", "+442071838750", "+1 212 555 0100", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "4111111111111112", "8.8.4.4", "10.0.0.256", "01.2.3.4", "192.168.0.1/24"]
    parts += ["078-05-1120", "666-12-1234", "2024-02-29", "2023-02-29", "29/02/2000", "1899-12-31", "2024-01-02T10:00", "2200-01-01", " ", " ", " ", ", ", "\n", "-", ".", "/", "x", "7", "é", "(", ")", "+", "@", ":"]
    texts = ["".join(rng.choice(parts) + rng.choice(("", " ", " ")) for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = sorted(pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect())
    find, seen = regex.compile(pii.candidates(), regex.ASCII), set()
    for text, row in zip(texts, rows):
        counts = dict.fromkeys(pii.KINDS, 0)

        def changed(m):
            kind, new = plain_pseudonym(m[0], "key")
            if kind:
                counts[kind] += 1
                seen.add(kind)
            return new

        assert row.text == find.sub(changed, text), text
        assert all(row[f"n_{k}"] == n for k, n in counts.items())
    assert seen == set(pii.KINDS)
