"""Operators that join or group: rollups, toxicity, near duplicates, lines, decontamination, components."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keyfold.llm import components, decontaminate, line_dedup, rollup, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, host string, fp int"


def docs(spark, rows):
    """rows: (doc_id, text[, source])"""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "h", 1) for r in rows], DOCS)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7), (7, None)]
    union = Union()
    for a, b in edges:
        if b is not None and a != b:
            union.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.find(x) for x in union.up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- rollups


def test_rollup_commits_are_idempotent_and_compaction_changes_nothing(spark, tmp_path):
    table = rollup.Rollup(spark, "file://" + str(tmp_path / "r"))
    assert table.totals().count() == 0
    counts = rollup.by_version(rollup.counted(docs(spark, [(1, "a b, c"), (2, None, None), (3, "d\n\te", "t")])))
    assert {(r.id, r.version, r.tokens) for r in counts.collect()} == {(1, "words-1", 3), (1, "wordpunct-1", 4), (2, "words-1", 0), (2, "wordpunct-1", 0), (3, "words-1", 2), (3, "wordpunct-1", 2)}
    assert table.commit("1", rollup.inserted(counts)) and not table.commit("1", rollup.inserted(counts))
    before = sorted(map(str, table.totals().collect()))
    table.compact()
    assert sorted(map(str, table.totals().collect())) == before and not table.commit("1", rollup.inserted(counts))
    table.commit("2", rollup.deleted(counts.filter("id = 3")))
    table.commit("3", rollup.revised(counts.filter("id = 1").withColumn("new_tokens", F.lit(10))))
    table.compact()
    table.compact()
    got = {(r.source, r.version): (r.docs, r.tokens) for r in table.totals().collect()}
    assert got == {("s", "words-1"): (1, 10), ("s", "wordpunct-1"): (1, 10), (None, "words-1"): (1, 0), (None, "wordpunct-1"): (1, 0)}


def test_unfinished_commit_does_not_count(spark, tmp_path):
    table = rollup.Rollup(spark, "file://" + str(tmp_path / "r"))
    rows = rollup.inserted(rollup.by_version(rollup.counted(docs(spark, [(1, "a b")]))))
    table.commit("1", rows)
    (tmp_path / "r/batch-1/_SUCCESS").unlink()  # as after the loss of the driver in the middle
    assert table.totals().count() == 0 and table.commit("1", rows) and table.totals().count() == 2


# ---- toxicity


def test_toxicity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(60), rng.choice(("stupid", "moron", "trash")))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic), "x"))
    rows += [(None, "stupid moron trash"), (9000, None), (9001, ""), (9002, "stupid moron trash " * 5000)]
    labels += [(9000, None, None, None), (77777, 1, 1, None), (None, 1, 1, None)]
    table, marks = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(table, marks).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(600) if crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert sum((got[i].predicted == 1) == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[9000].score == got[9001].score < 0.7 and got[9002].predicted == 1 and got[None].held_out is False
    # held-out labels are never learned from: turning them round changes nothing
    turned = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(table.repartition(7), turned).collect()}
    assert again == {i: r.score for i, r in got.items()}
    kept = toxicity.drop_toxic(table, marks)
    assert kept.columns == table.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, r in got.items() if not r.predicted)
    assert toxicity.toxicity(table.limit(0), marks.limit(0)).count() == 0
    assert {r.score for r in toxicity.toxicity(table, marks.limit(0)).collect()} == {0.0}


def test_features_are_distinct_hashes():
    f = toxicity.Features()
    assert len(f("")) == 0 and (f("a b a") == f("a b a")).all()
    one = np.array([1, 5, 7], np.int64)
    places, weights = toxicity.Ftrl().fit([one, np.array([2, 7])] * 50, [1, 0] * 50)
    model = dict(zip(places.tolist(), weights.tolist()))
    assert model.get(1, 0) > 0 and model.get(2, 0) < 0


# ---- near duplicates


def plain_print(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghÉß") for _ in range(6)) for _ in range(500)]
    texts = [None, "", " \t\n", "\xa0", "One", "one", "two words", "a " * 3000]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 200, 600)))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 1, 5))):
            changed = base[:]
            for _ in range(rng.choice((0, 1, 2, 8))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(" ".join(changed).upper() if rng.random() < 0.2 else "\n".join(changed))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    prints = [plain_print(t, 3) for t in texts]
    union = Union()
    for i in range(len(rows)):
        for j in range(i + 1):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                union.join(rows[i][0], rows[j][0])
    expected = {(i, f"{p:016x}", union.find(i)) for (i, _), p in zip(rows, prints)}
    table = docs(spark, rows + [rows[5]])  # a row twice
    for hot in (simhash.HOT_ROWS, 3):  # also with subtrees cut into chunks
        got = simhash.near_duplicates(table, 3, 2, 1, hot_rows=hot).collect()
        assert len(got) == len(rows) + 1 and {tuple(r) for r in got} == expected
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    nulls = simhash.near_duplicates(docs(spark, [(None, "a b c"), (None, "x y z"), (4, "a b c")])).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in nulls))) == ["(4, 4)", "(None, 4)", "(None, None)"]


def test_trie_join_with_wide_budgets():
    rng = np.random.default_rng(1)
    for budget, agree in ((2, 1), (3, 2), (7, 2)):
        values = {0, 1, 3, 7}
        for x in rng.integers(0, 2**63, 20):
            for _ in range(40):
                y = int(x)
                for b in rng.choice(64, rng.integers(0, 6 + budget), replace=False):
                    y ^= 1 << int(b)
                values.add(y)
        v = np.unique(np.array(sorted(values), np.uint64))
        union = Union()
        for i in range(len(v)):
            for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= budget):
                union.join(i, int(j))
        masks = simhash.block_masks(budget, agree)
        a, b = simhash.joined(np.repeat(np.arange(len(masks)), len(v)), np.tile(v, len(masks)), np.zeros(len(v) * len(masks), int), masks, budget)
        got = Union()
        place = {int(x): i for i, x in enumerate(v)}
        for x, y in zip(a.tolist(), b.tolist()):
            got.join(place[x], place[y])
        assert [got.find(i) for i in range(len(v))] == [union.find(i) for i in range(len(v))]


def plain_similarity(a, b, k=5):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_similar_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    texts = near_texts()
    base = [f"x{i}" for i in range(400)]
    for _ in range(25):  # one group in which some pairs are similar and many are not
        changed = base[:]
        for at in rng.sample(range(400), rng.choice((4, 10, 14))):
            changed[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    texts += [texts[-1].upper(), texts[20], None]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    prints = [plain_print(t, 5) for t in texts]
    union, within, far = Union(), 0, 0
    for i in range(len(rows)):
        union.find(rows[i][0])
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 7:
                if plain_similarity(texts[i], texts[j]) >= 0.8:
                    union.join(rows[i][0], rows[j][0])
                    within += 1
                else:
                    far += 1
    assert within > 60 and far > 15  # the fixture has both kinds
    expected = {(i, union.find(i)) for i, _ in rows}
    table = docs(spark, rows + [rows[20], (None, texts[20])])
    for hot, listed in ((simhash.HOT_ROWS, simhash.LISTED), (4, 1)):  # also with chunks, and with forests to the end
        monkeypatch.setattr(simhash, "LISTED", listed)
        assert {tuple(r) for r in simhash.similar_groups(table, hot_rows=hot).collect()} == expected
    assert simhash.similar_groups(docs(spark, [])).count() == 0
    assert simhash.similar_groups(docs(spark, [(1, "a b c")])).collect() == [(1, 1)]


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base.replace("w7 ", "w8 ")), (4, "something else entirely " * 9), (None, base), (4, "something else entirely " * 9)]
    table = docs(spark, rows)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "4", "None"]


# ---- lines


def plain_lines(rows, ratio, least):
    pages, holds = Counter(h for h, _ in rows if h), defaultdict(set)
    for n, (h, lines) in enumerate(rows):
        for x in lines:
            if h and x.strip(line_dedup.SPACE):
                holds[h, x.strip(line_dedup.SPACE)].add(n)
    common = {k for k, v in holds.items() if len(v) >= least and len(v) > ratio * pages[k[0]]}
    return [[x for x in lines if (h, x.strip(line_dedup.SPACE)) not in common] for h, lines in rows]


def test_documents_lose_their_sources_lines(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        source = rng.choice(("a", "a", "b", "c", None, ""))
        lines = [f"line {rng.randrange(2000)}" for _ in range(rng.randrange(6))]
        if rng.random() < 0.3:
            lines.insert(0, " shared footer\t" if rng.random() < 0.5 else "shared footer")
        lines += ["", "rare"] if rng.random() < 0.02 else []
        rows.append((i, "\n".join(lines), source))
    rows += [(900, None, "a"), (901, "", "a"), (902, "shared footer", "a"), (902, "shared footer", "a")]
    expected = plain_lines([(s, (t or "").split("\n")) for _, t, s in rows], 0.1, 3)
    table = docs(spark, rows)
    out = line_dedup.dedup_documents(table)
    assert out.columns == table.columns
    got = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert got == sorted((i, "\n".join(x)) for (i, _, _), x in zip(rows, expected))
    assert [r.text for r in out.filter("doc_id = 900").collect()] == [None]
    assert line_dedup.dedup_documents(table.limit(0)).count() == 0


def test_pages(spark):
    html = "<html><script>var t='</p>';</script><nav>Menu</nav><p>Story {}</p><br>\nFooter </html>"
    rows = [(i, f"https://A.example.com:80/{i}", html.format(i)) for i in range(4)] + [(4, None, html), (5, "https://b.example.com", html), (6, "https://b.example.com", None), (None, "nonsense", "")]
    out = line_dedup.dedup_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: (r.host, r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    assert got[2] == ("a.example.com", 3, 2, "Story 2") and got[4] == ("", 3, 0, "Menu\nStory {}\nFooter")
    assert got[5][2] == 0 and got[6] == ("b.example.com", 0, 0, "") and got[None] == ("", 0, 0, "")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


# ---- decontamination


def plain_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_contamination(texts, items, width=13):
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for b in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[b : b + width])].add(str(i))
    out = []
    for i, t in texts:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for b in range(len(w) - n + 1):
                if tuple(w[b : b + n]) in windows:
                    hit |= set(range(b, b + n))
                    found |= windows[tuple(w[b : b + n])]
        out.append((i, len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def test_contamination_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["the", "of", "a", "É", "é", "İx", "straße", "k9", "Kelvin"] + [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice((0, 3, 13, 14, 40))))) for i in range(30)] + [(30, None), (31, "the"), (32, "the the the"), (2, "again, " * 20)]
    texts = [(900, None), (901, ""), (902, "..."), (903, "the " * 400)]
    for i in range(120):
        words = say(rng.choice((0, 5, 60, 400)))
        for _ in range(rng.randrange(3)):
            at, passage = rng.randrange(len(words) + 1), plain_words(rng.choice(items)[1])
            words[at:at] = [w.upper() if w.isascii() else w for w in passage[rng.randrange(3) :]]
        texts.append((i, rng.choice((" ", ", ", "\n")).join(words)))
    texts += [texts[10], (10, "other text"), (None, texts[20][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    expected = plain_contamination(texts, items)
    for limit in (decontaminate.BROADCAST_BYTES, 0):  # also by shuffle
        got = decontaminate.contamination(docs(spark, texts), bench, broadcast_bytes=limit).collect()
        assert sorted(str(tuple(r)) for r in got) == expected
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((i, t)) for (i, t), e in zip(texts, (plain_contamination([x], items)[0] for x in texts)) if e.endswith("False)"))
    assert decontaminate.contamination(docs(spark, texts), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def test_pages_of_any_length(spark):
    """Long runs of line ends and tags, tags and scripts that never end; extra columns with the names used inside."""
    n = 1_000_000
    htmls = ["a" + "\n" * n + "b", "a" + "<br>" * 300_000 + "b", "a" + "<" * n, "<script>" * 100_000 + "b", "a>b<c>d", "x <SCRIPT>y</script> z <style>q</STYLE><script>w", "", None]
    rows = sorted((r.i, r.lines) for r in spark.createDataFrame(list(enumerate(htmls)), "i int, html string").select("i", line_dedup.html_lines(F.col("html")).alias("lines")).collect())
    assert [x for _, x in rows] == [["a", "b"], ["a", "b"], ["a" + "<" * n], ["b"], ["a>b", "d"], ["x", "z", "w"], [], []]
    table = spark.createDataFrame([("h", ["l", str(i)], i, "c") for i in range(5)] * 2, "host string, lines array<string>, _host int, common string")
    out = line_dedup.drop_boilerplate(table, 0.5, 3).collect()
    assert len(out) == 10 and all(r.common == "c" and r.n_lines == 2 and r.lines == [str(r["_host"])] for r in out)
    pages = spark.createDataFrame([(None, "http://a/x", "p<br>q")] * 2, "lines long, host string, html string")
    out = line_dedup.dedup_pages(pages, id_col="lines", url_col="host").collect()
    assert [(r.lines, r.host, r.text) for r in out] == [(None, "a", "p\nq")] * 2
