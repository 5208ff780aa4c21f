"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of 64 bits are taken from hashed word shingles. Equal fingerprints become one node. Nodes within a
Hamming budget are found by a self-join of a binary trie: node pairs are descended together, differing
bits are added up, and a pair of subtrees is dropped once its sum exceeds the budget.

The trie is spread over tasks by its first levels. The 64 bits are cut into ``budget + agree`` blocks; two
fingerprints within the budget differ in at most ``budget`` blocks, so they agree on ``agree`` whole blocks.
For each choice of that many blocks there is one trie whose first levels hold these blocks, and there the two
lie below the same node. Each subtree below these levels is joined with itself in one task, over
the remaining bits. A subtree of more than ``hot_rows`` fingerprints is cut into chunks, and each pair of
chunks is a task of its own, so no task grows with a group of near copies.

A task does not list all pairs of a dense group: it unites what it finds and gives one edge from each
fingerprint to the smallest of its group in this task, which keeps every link's effect on the
components. The components of all edges are then found without collecting them.

Defined results: a null text counts as empty; a text without words has the fingerprint zero, which links
like any other; repeated rows give a row each; rows with a null id take part, and a component's id is the
smallest id in it that is not null (null if there is none); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.components import components
from keyfold.llm.shared import written
from keyfold.llm.similar import Near, all_hashes, digest_of, node_of, similar_rows, similarity

#: Node pairs of the trie that are descended at a time, and the pairs of values below which a node pair is compared outright.
FRONTIER, LEAF = 16_384, 64
#: After a first round of forests, a task lists all pairs that are left if they are so many for a node at most.
LISTED = 16
#: Fingerprints of a subtree above which it is cut into chunks.
HOT_ROWS = 20_000
#: For each byte a word of eight bytes, of which the i-th holds the byte's i-th bit.
SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of a text: bit set if set in over half of the hashes of its word shingles."""
    words = b" ".join((text or "").encode().lower().split())  # of bytes: A-Z only, and \x20 \x09-\x0D only
    return print_of(words, all_hashes(words, shingle))


def print_of(words: bytes, hashes: np.ndarray) -> int:
    """The fingerprint of words with these shingle hashes; zero without words."""
    if not words:
        return 0
    spread = SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint's bits as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.iloc[:, 1]], np.uint64).view(np.int64)
            yield pd.DataFrame({id_col: batch.iloc[:, 0], "fp": found})

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, fp long")


def block_masks(budget: int, agree: int) -> list[int]:
    """For each choice of ``agree`` blocks the mask of their bits."""
    n = budget + agree
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(blocks, agree)]


def _compare(values, al, ah, bl, bh, budget):
    """All pairs of the node pairs' values that are within the budget."""
    wide = bh - bl
    area = (ah - al) * wide
    which = np.repeat(np.arange(len(al)), area)
    place = np.arange(len(which)) - np.repeat(np.cumsum(area) - area, area)
    i, j = al[which] + place // wide[which], bl[which] + place % wide[which]
    good = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
    return i[good], j[good]


def trie_self_join(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: list[int], budget: int, group_of=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i < j) whose values differ in ``budget`` bits at most, within each subtree.

    A subtree is a range [start, end) of values, sorted by the bits listed (most significant first), in which they
    may differ. A node is a range; a pair of nodes is held as two ranges and the bits that differ so far. Ranges
    of equal values are halved by place. ``group_of()`` gives the groups that values are in by now: pairs of nodes
    that hold one group only are dropped, as they have nothing to add.
    """
    ones: dict[int, np.ndarray] = {}
    several = ends - starts > 1
    starts, ends = starts[several], ends[several]
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int64))]
    while stack:
        depth, *pair = stack.pop()
        if len(pair[0]) > FRONTIER:
            half = len(pair[0]) // 2
            stack += [(depth, *(x[:half] for x in pair)), (depth, *(x[half:] for x in pair))]
            continue
        if group_of is not None and ((pair[1] - pair[0]) * (pair[3] - pair[2])).sum() > LEAF * FRONTIER:
            al, ah, bl, bh, _ = pair
            group = group_of()
            turns = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
            mixed = (turns[ah - 1] != turns[al]) | (turns[bh - 1] != turns[bl]) | (group[al] != group[bl])
            pair = [x[mixed] for x in pair]
        al, ah, bl, bh, differ = pair
        small = (ah - al) * (bh - bl) <= LEAF
        if small.any():
            yield _compare(values, al[small], ah[small], bl[small], bh[small], budget)
        al, ah, bl, bh, differ = (x[~small] for x in pair)
        if not len(al):
            continue
        if depth < len(bits) and depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(bits[depth])) & np.uint64(1), dtype=np.int64)])
        own, more = al == bl, int(depth < len(bits))
        if more:
            at = ones[depth]
            am, bm = ah - (at[ah] - at[al]), bh - (at[bh] - at[bl])
        else:
            am, bm = (al + ah) // 2, (bl + bh) // 2
        children = [(al, am, bl, bm, differ), (am, ah, bm, bh, differ), (al, am, bm, bh, differ + more), *[tuple(x[~own] for x in (am, ah, bl, bm, differ + more))]]
        al, ah, bl, bh, differ = (np.concatenate(x) for x in zip(*children))
        left = (differ <= budget) & (ah > al) & (bh > bl) & ((al != bl) | (ah - al > 1))
        stack.append((depth + 1, *(x[left] for x in (al, ah, bl, bh, differ))))


class Groups:
    """Groups of places, united pair by pair; a group's label is its smallest place. ``used`` are the pairs that united groups."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.used: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            self.used.append((i[first], j[first]))
            self.label[high[first]] = low[first]
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


class TooMany(Exception):
    """More pairs than may be listed."""


class Listed(Groups):
    """Unites nothing: all pairs of places in different groups are used, up to ``most``."""

    def __init__(self, label: np.ndarray, most: int):
        super().__init__(label)
        self.room = most

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.label[i] != self.label[j]
        self.used.append((i[apart], j[apart]))
        self.room -= int(apart.sum())
        if self.room < 0:
            raise TooMany


def _descend(choice: np.ndarray, fp: np.ndarray, place: np.ndarray, part: np.ndarray, masks: list[int], budget: int, groups: Groups, barred: np.ndarray | None = None) -> None:
    """Join the subtrees of one task and unite what is found; rows are (choice of blocks, fingerprint, place of the node, chunk pair). ``barred``: sorted codes of pairs that do not count; with it, a pair that agrees on several choices counts in the first only."""
    n = len(groups.label)
    for c in np.unique(choice):
        rows = np.flatnonzero(choice == c)
        mask = np.uint64(masks[c])
        key, rest = fp[rows] & mask, fp[rows] & ~mask
        order = np.lexsort((rest, key, part[rows]))
        rows, key, rest, chunk = rows[order], key[order], rest[order], part[rows][order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
        bits = [b for b in range(63, -1, -1) if not masks[c] >> b & 1]
        at = place[rows]
        for i, j in trie_self_join(rest, new, np.r_[new[1:], len(rows)], bits, budget, lambda at=at: groups.label[at]):
            if barred is not None:
                differ = fp[rows[i]] ^ fp[rows[j]]
                first = np.ones(len(i), bool)
                for m in masks[:c]:
                    first &= (differ & np.uint64(m)) != 0
                i, j = i[first], j[first]
            i, j = at[i], at[j]
            if barred is not None:
                free = ~np.isin(np.minimum(i, j) * n + np.maximum(i, j), barred)
                i, j = i[free], j[free]
            groups.take(i, j)


def joined(choice: np.ndarray, fp: np.ndarray, part: np.ndarray, masks: list[int], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtrees of one task, joined: an edge from each fingerprint to the smallest of its group."""
    nodes, place = np.unique(fp, return_inverse=True)
    groups = Groups(np.arange(len(nodes)))
    _descend(choice, fp, place, part, masks, budget, groups)
    linked = np.flatnonzero(groups.label != np.arange(len(nodes)))
    return nodes[linked], nodes[groups.label[linked]]


def proposed(node: np.ndarray, fp: np.ndarray, root: np.ndarray, choice: np.ndarray, part: np.ndarray, barred: np.ndarray, masks: list[int], budget: int, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtrees of one task, joined: pairs of nodes within the budget that connect what is not connected yet. ``root`` tells what is, ``barred`` (pairs of nodes) what has been compared in vain. All such pairs are given if they are no more than ``listed`` a node, else a forest of them."""
    nodes, first, place = np.unique(node, return_index=True, return_inverse=True)
    _, label = np.unique(root[first], return_inverse=True)
    smallest = np.full(len(nodes), len(nodes))
    np.minimum.at(smallest, label, np.arange(len(nodes)))
    label = smallest[label]
    if len(barred):
        ends = np.searchsorted(nodes, barred)
        here = (ends < len(nodes)).all(1)
        ends = ends[here]
        ends = ends[(nodes[ends] == barred[here]).all(1)]
        barred = np.unique(ends.min(1) * len(nodes) + ends.max(1)) if len(ends) else ends[:, 0]
    groups = Listed(label, listed * len(nodes)) if listed else Groups(label)
    try:
        _descend(choice, fp, place, part, masks, budget, groups, barred)
    except TooMany:
        groups = Groups(label)
        _descend(choice, fp, place, part, masks, budget, groups, barred)
    if not groups.used:
        return nodes[:0], nodes[:0]
    i, j = (np.concatenate(x) for x in zip(*groups.used))
    return nodes[i], nodes[j]


def _keys(masks: list[int], fp: Column) -> Column:
    """(c, key): each choice of blocks with the fingerprint's bits in them."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.explode(F.array(*(F.struct(F.lit(c).alias("c"), fp.bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(signed))))


def _dealt(nodes: DataFrame, masks: list[int], hot_rows: int, node: Column) -> tuple[DataFrame, DataFrame | None]:
    """Nodes by subtree (c, key) and, where that is hot, by pair of chunks (part); and the hot subtrees, if any, with their number of chunks."""
    rows = nodes.withColumn("t", _keys(masks, F.col("fp"))).select(*nodes.columns, "t.c", "t.key")
    hot = written(rows.groupBy("c", "key").count().filter(F.col("count") > hot_rows).select("c", "key", F.ceil(F.col("count") / hot_rows).alias("chunks")), "hot")
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long")), None
    n = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64(node), n)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda x: (F.greatest(x, own) * (F.greatest(x, own) + 1) / 2 + F.least(x, own)).cast("long"))
    return rows.join(hot, ["c", "key"], "left").select(*rows.columns, F.explode(pairs).alias("part")), hot


def links(nodes: DataFrame, budget: int, agree: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp`` that connect all that differ in ``budget`` bits at most."""
    spark = nodes.sparkSession
    masks = block_masks(budget, agree)
    rows, _ = _dealt(nodes.select("fp"), masks, hot_rows, F.col("fp"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(nodes.count() * len(masks) / 500_000))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if whole:
            rows = pd.concat(whole)
            a, b = joined(rows["c"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["part"].to_numpy(), masks, budget)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.repartition(parts, "c", "key", "part").select("c", "fp", "part").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, agree: int = 1, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """A row per document: id, fingerprint (16 lowercase hex digits) and component_id."""
    prints = written(fingerprints(docs, shingle, id_col, text_col).toDF("id", "fp"), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "nodes")
    roots = components(links(nodes, budget, agree, hot_rows)).select(F.col("node").alias("fp"), "root")
    roots = written(nodes.join(roots, "fp").select("fp", "root", "first_id"), "members")
    names = written(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = roots.join(names, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    named = written(nodes.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id")), "named")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def _proposals(active: DataFrame, failed: DataFrame | None, listed: int, masks: list[int], budget: int, hot_rows: int) -> DataFrame:
    """Pairs (a, b) of active nodes (node, fp, root), within the budget, to be compared."""
    spark = active.sparkSession
    rows, hot = _dealt(active, masks, hot_rows, F.col("node"))
    rows = rows.select("c", "key", "part", "node", "fp", "root", F.lit(False).alias("barred"))
    if failed is not None:
        # a pair that failed goes to the task where the two count: that of the first choice on which they agree
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        agrees = F.array(*(F.col("fp_a").bitwiseXOR(F.col("fp_b")).bitwiseAND(F.lit(m)) == 0 for m in signed))
        both = failed.withColumn("c", F.array_position(agrees, True).cast("int") - 1)
        both = both.withColumn("key", F.col("fp_a").bitwiseAND(F.element_at(F.array(*map(F.lit, signed)), F.col("c") + 1)))
        if hot is None:
            both = both.withColumn("part", F.lit(0).cast("long"))
        else:
            n = F.coalesce("chunks", F.lit(1))
            both = both.join(hot, ["c", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (n * (n + 1) / 2 - 1).cast("long"))))
        rows = rows.unionByName(both.select("c", "key", "part", F.col("a").alias("node"), F.col("fp_a").alias("fp"), F.col("b").alias("root"), F.lit(True).alias("barred")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(active.count() * len(masks) / 500_000))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if whole:
            rows = pd.concat(whole)
            barred = rows[rows["barred"]][["node", "root"]].to_numpy()
            rows = rows[~rows["barred"]]
            if len(rows):
                a, b = proposed(rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["root"].to_numpy(), rows["c"].to_numpy(), rows["part"].to_numpy(), barred, masks, budget, listed)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.repartition(parts, "c", "key", "part").mapInPandas(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, budget: int = 7, agree: int = 2, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, component_id): documents connected by pairs within the budget whose shingles' Jaccard similarity is ``least`` or more.

    Texts of the same words are one node. In each round the tries propose, per task, a forest of pairs within the
    budget that would connect what is not connected yet; their shingles are compared; pairs that are similar
    connect, the others are barred. Nodes whose surroundings held a barred pair take part in the next
    round, as a pair that was left out may connect them; from then on a task lists all pairs that are left, if they
    are few for its nodes (``LISTED``). The rounds end when nothing new is proposed or all that was proposed
    is similar. So no similar pair within the budget is lost, and never are all pairs of a large
    group listed.
    """
    masks = block_masks(budget, agree)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    id_type = docs.schema["id"].dataType.simpleString()

    def printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "fp": found, "node": [node_of(t)[1] for t in batch["text"]]})

    def worded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, nodes = zip(*map(node_of, batch["text"])) if len(batch) else ((), ())
            yield pd.DataFrame({"node": nodes, "words": words})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similarity(x, y, shingle) >= least for x, y in zip(batch["words_a"], batch["words_b"])]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "fp_a": batch["fp_a"], "fp_b": batch["fp_b"], "similar": good})

    prints = written(docs.mapInPandas(printed, f"id {id_type}, fp long, node long"), "prints")
    nodes = written(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("id").alias("first_id")), "nodes")
    active, failed, good, texts, labels = nodes.select("node", "fp", F.col("node").alias("root")), None, None, None, None
    while True:
        pairs = written(_proposals(active, failed, LISTED if failed is not None else 0, masks, budget, hot_rows), "pairs")
        if pairs.isEmpty():
            break
        if texts is None:  # later rounds are about the same nodes
            ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
            of = written(nodes.join(ends, "node"), "of")
            wanted = docs.join(of.select(F.col("first_id").alias("id")).distinct(), "id", "left_semi")
            texts = wanted.mapInPandas(worded, "node long, words binary").dropDuplicates(["node"])
            texts = written(of.select("node", "fp").join(texts, "node"), "texts")
        one, two = (texts.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
        checked = written(pairs.join(one, "a").join(two, "b").mapInPandas(compared, "a long, b long, fp_a long, fp_b long, similar boolean"), "checked")
        passed, barred = checked.filter("similar").select("a", "b"), checked.filter("NOT similar").drop("similar")
        good = passed if good is None else good.unionByName(passed)
        labels = components(good)
        if barred.isEmpty():
            break
        failed = barred if failed is None else failed.unionByName(barred)
        # the surroundings of a barred pair: all that this round's pairs and what is connected already reach
        around = components(pairs.unionByName(active.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
        shaken = written(barred.join(around, barred["a"] == around["node"]).select("root").distinct(), "shaken")
        again = around.join(shaken, "root", "left_semi").select("node")
        again = nodes.join(again, "node").select("node", "fp").join(labels.withColumnRenamed("root", "r"), "node", "left")
        active = written(again.select("node", "fp", F.coalesce("r", "node").alias("root")), "active")
    if labels is None:
        labels = spark.createDataFrame([], "node long, root long")
    members = written(nodes.join(labels, "node").select("node", "root", "first_id"), "members")
    names = written(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = members.join(names, "root").select("node", F.col("component_id").alias("named"))
    named = written(nodes.join(named, "node", "left").select("node", F.coalesce("named", "first_id").alias("component_id")), "named")
    return prints.join(named, "node").select(F.col("id"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", budget: int = 7, agree: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents without near duplicates: of each group of similar ones the row with the smallest id stays.

    The tries propose, per task, a forest of the pairs of fingerprints within the budget; their words are compared, and what
    is similar is connected. As pairs of a Jaccard similarity of ``least`` or more may have fingerprints farther apart, and a
    forest leaves pairs out, an exact set join follows for all that is not connected: no pair that similar is lost.
    Rows without an id cannot be told apart and all stay. Rows of one id are told apart by the digests of their
    texts: each is judged by its own text, and rows of one id and one text leave one.
    """
    masks = block_masks(budget, agree)
    tries = Near(print_of, lambda nodes: _proposals(nodes.withColumn("root", F.col("node")), None, 0, masks, budget, hot_rows))
    found = written(similar_rows(docs, shingle, least, id_col, text_col, near=tries), "found")
    first = (F.col("id") == F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    gone = written(found.filter(~first).select(F.col("id").alias("__keyfold_id"), F.col("digest").alias("__keyfold_digest")).distinct(), "gone")
    digest = digest_of(docs[text_col])
    kept = docs.join(gone, (docs[id_col] == gone["__keyfold_id"]) & (digest == gone["__keyfold_digest"]), "left_anti")
    again = found.filter(first).groupBy("id", "digest").count().filter("count > 1")
    if again.isEmpty():
        return kept
    without = kept.filter(F.col(id_col).isNull())
    kept = kept.filter(F.col(id_col).isNotNull()).withColumn("__keyfold_digest", digest_of(F.col(text_col)))
    return kept.dropDuplicates([id_col, "__keyfold_digest"]).drop("__keyfold_digest").unionByName(without)
