"""Groups of texts with similar word shingles, by a prefix-filtered set join that loses no pair.

A text is its set of hashed shingles, put in one order that is the same for all texts. Two sets whose Jaccard
similarity is ``least`` or more have one of the first ``n - ceil(least * n) + 1`` of their shingles in common
(n: size of each), so texts are looked up by these alone. At the first shingle in common, the sizes and what is left of
both sets must still allow the similarity. What is left over are candidates, whose words are then compared.

The order puts shingles last that are common in a sample of the texts, and is by hash otherwise. The sample decides
how many candidates there are, never which pairs are found.

A shingle that a few texts share gives all their pairs. Where it is shared by many, neighbours by size are compared
first; then, in rounds, ever more distant ones, but only those that are not connected yet. So a large group of
near copies never has all its pairs listed, and no similar pair is left out unless its two ends are connected already.

No list is held whole by one task where it is long. A shingle that a sample of the texts says to be shared by more than
``CHUNK`` is cut into chunks by a hash of text and shingle, so the same texts meet in other chunks of their other shingles.
The rounds stay within chunks. What is not connected with a list's largest group then asks all chunks of the list, in blocks
of bounded size. The sample decides how long chunks are, never which pairs are found.

Another search may come first (``near``, the tries of ``simhash``): what it proposes is compared first, and this join then
only compares pairs that are not connected by that.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from keyfold.llm.components import components
from keyfold.llm.shared import map_slices, written

SEED = 42
#: Texts that share a shingle: up to so many are compared in all pairs at once.
LISTED = 16
#: How the distance of the neighbours that are compared grows from round to round.
WIDER = 8
#: Texts of one shingle that a task takes at once; longer lists are cut into chunks of about so many. All pairs of a chunk
#: take 270 MB at most, if none are connected.
CHUNK = 4096
#: Rows, or pairs, that a task works on at once.
PORTION = 1 << 18
#: One text in so many is in the sample; a shingle of so many of its texts is common, the most common ones count.
SAMPLE, COMMON, MOST = 16, 3, 1 << 18
#: Rounding that a comparison of sizes forgives.
SLACK = 1e-9


def node_of(text: str | None) -> tuple[bytes, int]:
    """A text's words, lower-cased (A-Z) and joined by single spaces, and their digest."""
    words = b" ".join((text or "").encode().lower().split())
    return words, int(np.array(xxh64_intdigest(words, SEED + 1), np.uint64).view(np.int64))


def similarity(a: bytes, b: bytes, shingle: int) -> float:
    """Jaccard similarity of the sets of word shingles; fewer words are one shingle."""

    def shingles(text: bytes) -> set:
        words = text.split(b" ")
        return set(zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else {tuple(words)}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


class Near(NamedTuple):
    """A search for candidates that comes first: the fingerprint of words with these shingle hashes, and pairs (a, b) from nodes (node, fp)."""

    print_of: Callable[[bytes, np.ndarray], int]
    pairs: Callable[[DataFrame], DataFrame]


def all_hashes(words: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; fewer words are one shingle."""
    parts = words.split(b" ")
    if len(parts) < shingle:
        return np.array([xxh64_intdigest(words, SEED)], np.uint64)
    return np.array([xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(parts[i:] for i in range(shingle)))], np.uint64)


def hashes(words: bytes, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; fewer words are one shingle."""
    return np.unique(all_hashes(words, shingle).view(np.int64))


def prefix(ordered: np.ndarray, least: float) -> np.ndarray:
    """The part of which two similar sets share an element."""
    return ordered[: len(ordered) - ceil(least * len(ordered) - SLACK) + 1]


def _able(size_a, at_a, size_b, at_b, least):
    """Whether sets of these sizes can be similar if these are the places of the first element in common."""
    fits = np.minimum(size_a, size_b) >= least * np.maximum(size_a, size_b) - SLACK
    return fits & (np.minimum(size_a - at_a, size_b - at_b) >= least / (1 + least) * (size_a + size_b) - SLACK)


def _runs(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by (token, size, node), and where each token begins and ends."""
    rows = rows.iloc[np.lexsort((rows["node"], rows["size"], rows["token"]))]
    token = rows["token"].to_numpy()
    begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    return rows, begins, np.r_[begins[1:], len(rows)]


def first_pairs(rows: pd.DataFrame, least: float, listed: int) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Pairs of nodes (a < b) of short lists, next neighbours and pairs with the smallest node of long ones; and the long lists."""
    rows, begins, ends = _runs(rows)
    length = ends - begins
    node, size, at = (rows[c].to_numpy() for c in ("node", "size", "at"))
    end, long = np.repeat(ends, length), np.repeat(length > listed, length)
    one, other = [], []
    for shift in range(1, max(2, min(listed, length.max()))):
        i = np.arange(len(rows) - shift) if shift < len(rows) else np.arange(0)
        i = i[(i + shift < end[i]) & ~(long[i] & (shift > 1))]
        one.append(i)
        other.append(i + shift)
    for b, e in zip(begins[length > listed], ends[length > listed]):
        own = np.arange(b, e)
        one.append(np.full(e - b, b + node[b:e].argmin()))
        other.append(own)
    i, j = np.concatenate(one), np.concatenate(other)
    good = (node[i] != node[j]) & _able(size[i], at[i], size[j], at[j], least)
    a, b = node[i[good]], node[j[good]]
    return np.minimum(a, b), np.maximum(a, b), rows[long]


def wider_pairs(rows: pd.DataFrame, least: float, low: int, high: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of nodes (a < b) of different roots that are ``low`` or more and less than ``high`` places apart; and whether there are more distant ones."""
    rows, begins, ends = _runs(rows)
    node, size, at, root = (rows[c].to_numpy() for c in ("node", "size", "at", "root"))
    found, more = [np.empty((0, 2), np.int64)], False
    for b, e in zip(begins, ends):
        roots, group, count = np.unique(root[b:e], return_inverse=True, return_counts=True)
        if len(roots) == 1 or e - b <= low:
            continue
        more |= e - b > high
        for i in b + np.flatnonzero(group != count.argmax()):
            j = np.r_[np.arange(max(b, i - high + 1), i - low + 1), np.arange(i + low, min(e, i + high))]
            j = j[(root[j] != root[i]) & _able(size[i], at[i], size[j], at[j], least)]
            found.append(np.column_stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1], more


def portions(rows: pd.DataFrame, most: int = PORTION) -> Iterator[pd.DataFrame]:
    """The rows in frames of whole lists, of ``most`` rows or fewer but where one list is longer."""
    if not len(rows):
        return
    rows, _, ends = _runs(rows)
    begin = last = 0
    for end in ends:
        if end - begin > most and last > begin:
            yield rows.iloc[begin:last]
            begin = last
        last = end
    yield rows.iloc[begin:]


def crossed_pairs(rows: pd.DataFrame, least: float, most: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes (a < b) of different roots, of a row that asks and one of the same list that does not, ``most`` comparisons at a time."""
    for _, own in rows.groupby("token", sort=False):
        asks = own["asks"].to_numpy(bool)
        node, size, at, root = (own[c].to_numpy() for c in ("node", "size", "at", "root"))
        asked = np.flatnonzero(~asks)[None, :]
        asking = np.flatnonzero(asks)[:, None]
        step = max(1, most // max(1, asked.size))
        for begin in range(0, len(asking), step):
            i = asking[begin : begin + step]
            x, y = np.nonzero((root[i] != root[asked]) & _able(size[i], at[i], size[asked], at[asked], least))
            a, b = node[i[x, 0]], node[asked[0, y]]
            pairs = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0)
            yield pairs[:, 0], pairs[:, 1]


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that are common in the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [node_of(t) for t in batch["text"]]
            yield pd.DataFrame({"node": [n for _, n in found], "tokens": [hashes(w, shingle) for w, _ in found]})

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    tokens = map_slices(sample, run, "node long, tokens array<long>").dropDuplicates(["node"]).select(F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(counts.orderBy(F.desc("n"), "token").limit(MOST).select("token").toPandas()["token"].to_numpy(np.int64))


def similar_texts(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", listed: int | None = None, chunk: int | None = None) -> DataFrame:
    """(id, component_id): documents connected by pairs whose shingles' Jaccard similarity is ``least`` or more; rows without an id are left out."""
    return similar_rows(docs, shingle, least, id_col, text_col, listed, chunk).select("id", F.col("first.id").alias("component_id"))


def digest_of(text: Column) -> Column:
    """Tells apart texts of one id."""
    return F.xxhash64(text)


def similar_rows(docs: DataFrame, shingle: int, least: float, id_col: str, text_col: str, listed: int | None = None, chunk: int | None = None, near: Near | None = None) -> DataFrame:
    """(id, digest, first): a row's id and the digest of its text, and those of the smallest row that it is connected with."""
    listed, chunk = LISTED if listed is None else listed, CHUNK if chunk is None else chunk
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest_of(F.col(text_col)).alias("digest")).filter("id IS NOT NULL")
    id_type = docs.schema["id"].dataType.simpleString()
    common = spark.sparkContext.broadcast(_common(docs, shingle))

    def printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = common.value
        for batch in batches:
            nodes, sizes, firsts, fps = [], [], [], []
            for text in batch["text"]:
                words, node = node_of(text)
                own = all_hashes(words, shingle)
                fps.append(near.print_of(words, own) if near else 0)
                own = np.unique(own.view(np.int64))
                late = np.isin(own, last) if len(last) < len(own) else (last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own)
                nodes.append(node)
                sizes.append(len(own))
                firsts.append(prefix(np.r_[own[~late], own[late]], least))
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "digest": batch["digest"], "node": nodes, "fp": fps, "size": sizes, "first": firsts})

    def proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if whole:
            a, b, long = first_pairs(pd.concat(whole), least, listed)
            pairs = np.unique(np.column_stack((a, b)), axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "token": 0, "size": -1, "at": 0})
            yield pd.DataFrame({"a": long["node"], "b": long["node"], "token": long["token"], "size": long["size"], "at": long["at"]})

    def worded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, nodes = zip(*map(node_of, batch["text"])) if len(batch) else ((), ())
            yield pd.DataFrame({"node": nodes, "words": [zlib.compress(w, 1) for w in words]})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similarity(zlib.decompress(x), zlib.decompress(y), shingle) >= least for x, y in zip(batch["words_a"], batch["words_b"])]
            yield batch[["a", "b"]][np.array(good, bool)]

    def widened(low: int, high: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole = [b for b in batches if len(b)]
            for rows in portions(pd.concat(whole), chunk) if whole else ():
                a, b, left = wider_pairs(rows, least, low, high)
                yield pd.DataFrame({"a": a, "b": b, "more": False})
                if left:
                    yield pd.DataFrame({"a": [0], "b": [0], "more": [True]})

        return run

    def crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        for a, b in crossed_pairs(pd.concat(whole), least) if whole else ():
            yield pd.DataFrame({"a": a, "b": b})

    prints = written(map_slices(docs, printed, f"id {id_type}, digest long, node long, fp long, size int, first array<long>"), "prints")
    nodes = written(prints.groupBy("node").agg(F.min(F.struct("id", "digest")).alias("first_one"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("rows")), "nodes")
    pairs = good = tried = labels = None

    def judge() -> None:
        """Compare the words of ``pairs``; what is similar connects."""
        nonlocal good, labels
        if pairs.isEmpty():
            return
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        of = nodes.join(ends, "node").select("node", F.col("first_one.id").alias("id"))
        # an id may stand for several texts; those that were not asked for find no pair
        wanted = docs.join(of.select("id").distinct(), "id", "left_semi")
        texts = written(map_slices(wanted, worded, "node long, words binary").dropDuplicates(["node"]), "texts")
        one, two = (texts.select(F.col("node").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
        passed = written(map_slices(pairs.join(one, "a").join(two, "b"), compared, "a long, b long"), "passed")
        good = passed if good is None else good.unionByName(passed)
        labels = components(good)

    def rooted(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def untried(rows: DataFrame) -> DataFrame:
        rows = rows.select("a", "b").distinct()
        return written(rows if tried is None else rows.join(tried, ["a", "b"], "left_anti"), "pairs")

    def unconnected(rows: DataFrame) -> DataFrame:
        """Pairs that were not compared yet and whose ends are not connected."""
        if labels is None:
            return untried(rows)
        one, two = (labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        rows = rows.select("a", "b").join(one, "a", "left").join(two, "b", "left")
        return untried(rows.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")))

    if near:
        pairs = tried = written(near.pairs(nodes.select("node", "fp")), "near")
        judge()
    # only what occurs again is sent to be told apart
    again = written(nodes.filter("rows > 1").select("node"), "again")
    sets = prints.select("node", "size", "first")
    distinct = sets.join(again, "node", "left_anti").unionByName(sets.join(again, "node", "left_semi").dropDuplicates(["node"]))
    postings = distinct.select("node", "size", F.posexplode("first").alias("at", "token"))
    sampled = prints.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("node", "first").dropDuplicates(["node"]).select(F.explode("first").alias("token"))
    chunks = F.ceil(F.count(F.lit(1)) * SAMPLE / chunk).cast("int")
    hot = written(sampled.groupBy("token").agg(chunks.alias("chunks")).filter("chunks > 1"), "hot")
    cut, lists = None, postings
    if not hot.isEmpty():
        # a list of its own for each chunk; two lists of one name would only add candidates
        own = F.pmod(F.xxhash64("node", "token"), F.col("chunks")).cast("int")
        cut = written(postings.join(hot, "token").select("token", "node", "size", "at", own.alias("chunk"), "chunks"), "cut")
        lists = postings.join(hot, "token", "left").select("node", "size", "at", F.when(F.col("chunks").isNull(), F.col("token")).otherwise(F.xxhash64("token", own)).alias("token"))
    rows = prints.agg(F.sum(F.size("first"))).first()[0] or 0
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least_parts, ceil(rows / 500_000))
    found = written(lists.repartition(parts, "token").mapInPandas(proposed, "a long, b long, token long, size int, at int"), "found")
    long = written(found.filter("size >= 0").select(F.col("a").alias("node"), "token", "size", "at"), "long")

    pairs = unconnected(found.filter("size < 0"))
    judge()
    tried, low, more = pairs if tried is None else tried.unionByName(pairs), 2, not long.isEmpty()
    while more:
        high = low * WIDER
        asked = rooted(long).select("token", "node", "size", "at", "root").repartition(parts, "token")
        next_ones = written(asked.mapInPandas(widened(low, high), "a long, b long, more boolean"), "wider")
        more = not next_ones.filter("more").isEmpty()
        pairs = untried(next_ones.filter("NOT more"))
        judge()
        tried, low = tried.unionByName(pairs), high

    if cut is not None:
        # the largest group of a list is named once by one of its nodes, so that two nodes that never ask are always in one group
        counts = rooted(cut).groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
        hubs = written(counts.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("node"), F.sum("n").alias("total")), "hubs")
        low, high, last = 0, 1, cut.agg(F.max("chunks")).first()[0] or 0
        while low < last:
            hub = rooted(hubs).select("token", "total", F.col("root").alias("hub"))
            members = written(rooted(cut).join(hub, "token"), "rooted")
            apart = members.filter(F.col("root") != F.col("hub"))
            if apart.filter(F.col("chunk") >= low).isEmpty():
                break
            asking = apart.filter((F.col("chunk") >= low) & (F.col("chunk") < high))
            per_list = asking.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("chunks").alias("of"), F.max("total").alias("total"))
            blocks = written(per_list.withColumn("blocks", F.ceil(F.col("n") / chunk).cast("int")), "blocks")
            sent = blocks.agg(F.sum(F.col("n") * F.col("of") + F.col("total") * F.col("blocks"))).first()[0] or 0
            in_blocks = blocks.select("token", "blocks")
            block = F.pmod(F.xxhash64("token", F.lit(1), "node"), F.col("blocks")).cast("int").alias("block")
            ones = asking.join(in_blocks, "token").select("token", "node", "size", "at", "root", block, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("asks"))
            others = members.join(in_blocks, "token").select("token", "node", "size", "at", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", F.lit(False).alias("asks"))
            met = ones.unionByName(others).select(F.xxhash64("token", "chunk", "block").alias("token"), "node", "size", "at", "root", "asks")
            met = met.repartition(max(least_parts, ceil(sent / 500_000)), "token")
            pairs = untried(met.mapInPandas(crossed, "a long, b long"))
            judge()
            tried, low, high = tried.unionByName(pairs), high, high * WIDER
    if labels is None:
        labels = spark.createDataFrame([], "node long, root long")
    members = written(nodes.join(labels, "node").select("node", "root", "first_one"), "members")
    names = written(members.groupBy("root").agg(F.min("first_one").alias("named")), "names")
    named = members.join(names, "root").select("node", "named")
    named = written(nodes.join(named, "node", "left").select("node", F.coalesce("named", "first_one").alias("first")), "named")
    return prints.select("id", "digest", "node").join(named, "node").select("id", "digest", "first")
