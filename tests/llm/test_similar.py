import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from keyfold.llm import similar, simhash
from keyfold.llm.shared import written
from tests.llm.test_tables import Union, docs, near_texts, plain_print, plain_similarity


def copies():
    """Texts with word changes, so that similarities lie on both sides of 0.8, some in one large group; repetitive and very short ones."""
    rng = random.Random(31)
    texts = near_texts()
    for n, times in ((60, 6), (150, 12), (400, 40)):
        base = [f"x{n}_{i}" for i in range(n)]
        for _ in range(times):
            changed = base[:]
            for at in rng.sample(range(n), max(1, n * rng.choice((1, 2, 3)) // 100)):
                changed[at] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
    return texts + ["a " * 6, "a " * 9, "one two", "One  TWO", "one two three", "", None, texts[-1].upper()]


def test_all_similar_pairs_count_however_far_their_fingerprints_are(spark):
    texts = copies()
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    union, beyond = Union(), 0
    for i in range(len(rows)):
        union.find(rows[i][0])
        for j in range(i):
            if plain_similarity(texts[i], texts[j]) >= 0.8:
                union.join(rows[i][0], rows[j][0])
                beyond += (plain_print(texts[i], 5) ^ plain_print(texts[j], 5)).bit_count() > 7
    assert beyond > 20  # pairs that fingerprints within 7 bits miss
    expected = {(i, union.find(i)) for i, _ in rows}
    table = docs(spark, rows + [rows[20], (None, texts[20])])
    for listed in (similar.LISTED, 3):  # also with rounds
        assert {tuple(r) for r in similar.similar_texts(table, listed=listed).collect()} == expected
    kept = {r.doc_id for r in simhash.keep_one(table).collect()}
    assert kept == {c for _, c in expected} | {None}
    assert similar.similar_texts(docs(spark, [])).count() == 0
    assert similar.similar_texts(docs(spark, [(1, "a b c")])).collect() == [(1, 1)]


@pytest.mark.parametrize("common", [set(), set(range(0, 400, 3))])
def test_candidates_are_complete(common):
    rng = random.Random(4)
    sets = []
    for _ in range(12):
        base = rng.sample(range(400), rng.choice((1, 4, 5, 10, 35, 60)))
        for _ in range(8):
            sets.append({x if rng.random() < 0.95 else rng.randrange(400) for x in base})
    rows = [(n, len(s), at, t) for n, s in enumerate(sets) for at, t in enumerate(similar.prefix(np.array(sorted(s, key=lambda x: (x in common, x))), 0.8))]
    table = pd.DataFrame(rows, columns=["node", "size", "at", "token"])
    wanted = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    assert len(wanted) > 20
    a, b, long = similar.first_pairs(table, 0.8, 10**6)
    assert wanted <= set(zip(a.tolist(), b.tolist())) and not len(long)
    a, b, long = similar.first_pairs(table, 0.8, 1)
    found, low, more = set(zip(a.tolist(), b.tolist())), 2, True
    while more:  # nothing is connected, so the rounds list all
        a, b, more = similar.wider_pairs(long.assign(root=long["node"]), 0.8, low, 2 * low)
        found |= set(zip(a.tolist(), b.tolist()))
        low *= 2
    assert wanted <= found


def test_texts_of_one_id_are_judged_apart(spark):
    base, other, third = (" ".join(f"{x}{i}" for i in range(200)) for x in "bot")
    near = base.replace("b7 ", "b8 ")
    rows = [(1, base), (2, near), (2, other), (3, third), (3, other.upper()), (3, third), (None, base)]
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(docs(spark, rows)).collect()))
    assert kept == sorted([(0, base), (1, base), (2, other), (3, third)])


def test_long_lists_are_cut_and_lose_no_pair(spark, monkeypatch):
    texts = copies()
    # texts that share many shingles with a large group but are not similar to it, and two groups in one list
    base = [f"x400_{i}" for i in range(400)]
    texts += [" ".join(base[:40] + [f"z{k}_{i}" for i in range(12 + k % 3)] + base[200 : 200 + 9 * k]) for k in range(8)]
    texts += [" ".join(base[:150] + [f"w{i}" for i in range(100)] + [f"v{k}"]) for k in range(9)]
    union = Union()
    for i in range(len(texts)):
        union.find(i)
        for j in range(i):
            if plain_similarity(texts[i], texts[j]) >= 0.8:
                union.join(i, j)
    expected = {(i, union.find(i)) for i in range(len(texts))}
    names = []
    monkeypatch.setattr(similar, "written", lambda df, name: names.append(name) or written(df, name))
    monkeypatch.setattr(similar, "SAMPLE", 2)
    table = docs(spark, list(enumerate(texts)))
    assert {tuple(r) for r in similar.similar_texts(table, listed=2, chunk=4).collect()} == expected
    assert "cut" in names and "blocks" in names
    assert similar.similar_texts(docs(spark, []), chunk=2).count() == 0


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_crossing_meets_every_pair_and_portions_keep_lists_whole(most):
    rng = random.Random(8)
    rows = pd.DataFrame([(n, 50, 0, rng.randrange(4), rng.randrange(3), rng.random() < 0.4) for n in range(60)], columns=["node", "size", "at", "token", "root", "asks"])
    wanted = {(min(x.node, y.node), max(x.node, y.node)) for x in rows.itertuples() for y in rows.itertuples() if x.asks and not y.asks and x.token == y.token and x.root != y.root}
    found = [p for a, b in similar.crossed_pairs(rows, 0.8, most) for p in zip(a.tolist(), b.tolist())]
    assert set(found) == wanted
    parts = list(similar.portions(rows, most))
    assert sum(map(len, parts)) == 60 and sum(p["token"].nunique() for p in parts) == 4
    assert list(similar.portions(rows[:0], most)) == []


def test_the_stage_goes_through_the_tries_and_the_set_join_does_the_rest(spark, monkeypatch):
    texts = copies()
    tables = []
    monkeypatch.setattr(similar, "written", lambda df, name: tables.append((name, written(df, name))) or tables[-1][1])
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, list(enumerate(texts))), "").collect()}
    node = [similar.node_of(t)[1] for t in texts]
    words, prints = dict(zip(node, texts)), dict(zip(node, (plain_print(t, 5) for t in texts)))
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    close, alike, proposed, first = Union(), Union(), Union(), Union()
    for i in range(len(texts)):
        for j in range(i):
            if apart(node[i], node[j]) <= 7:
                close.join(node[i], node[j])
            if plain_similarity(texts[i], texts[j]) >= 0.8:
                alike.join(i, j)
    assert kept == {alike.find(i) for i in range(len(texts))}
    names = [name for name, _ in tables]
    assert names.index("near") < names.index("passed") < names.index("found")
    near = [(r.a, r.b) for r in dict(tables)["near"].collect()]
    assert len(near) > 20 and all(apart(a, b) <= 7 for a, b in near)
    for a, b in near:
        proposed.join(a, b)
        if plain_similarity(words[a], words[b]) >= 0.8:
            first.join(a, b)
    assert {n: close.find(n) for n in node} == {n: proposed.find(n) for n in node}  # the forests connect all within the budget
    later = [(r.a, r.b) for name, table in tables if name == "pairs" for r in table.collect()]
    assert later and all(first.find(a) != first.find(b) for a, b in later) and not set(later) & set(near)
