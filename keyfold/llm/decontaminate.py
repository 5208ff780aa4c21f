"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window). A document holds a
window if the window's words stand in it side by side. As a set join: the words of each window are
ordered by rarity in the documents, and as containment must be whole, the prefix that has to be shared is one
word, the rarest. Document words are matched against these words alone; the place of the match and of the
word in the window give where the window would begin, the bounds 0 <= begin and begin + length <= words of the
document are applied, and only then the words of that stretch are compared with the window.

The windows' words and their rarest words are broadcast while their size, which is measured first, is within
``broadcast_bytes``; then one pass over the documents finds all hits without moving any text. Beyond it the
words' positions are joined by shuffle, and texts only meet the candidates left.

Defined results: null texts have no words; documents without words have zero counts and are clean; repeated rows
give a row each; null ids are kept; an empty benchmark leaves all clean; other columns are
ignored. Words: A-Z lower-cased, then runs of digits, a-z and all beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, when A-Z is not yet lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def lowered(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words, in their own case (lower-casing does not change where they end)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def windows_of(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, win): distinct windows of each item, as their words joined by spaces."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(lowered(F.col(text_col))).alias("w")).filter("size(w) > 0")
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return words.select("item", "w", F.explode(begins).alias("b")).select("item", F.array_join(F.slice("w", F.col("b") + 1, width), " ").alias("win")).distinct()


def _anchors(words: DataFrame, windows: DataFrame, fits: bool) -> DataFrame:
    """For each distinct window its rarest word in the documents and where in the window it first stands."""
    parts = windows.select("win").distinct().select("win", F.split("win", " ").alias("ww"))
    vocabulary = parts.select(F.explode("ww").alias("word")).select(F.lower("word").alias("key")).distinct()
    spread = words.select(F.explode("w").alias("word")).select(F.lower("word").alias("key"))
    counts = written(spread.join(F.broadcast(vocabulary) if fits else vocabulary, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
    placed = parts.select("win", F.size("ww").alias("len"), F.posexplode("ww").alias("at", "word")).withColumn("key", F.lower("word"))
    ranked = placed.join(counts, "key", "left").select("win", "len", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "at").alias("r"))
    return ranked.groupBy("win", "len").agg(F.min("r").alias("r")).filter("r.n > 0").select("win", "len", "r.key", "r.at")


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, code, begin, len, win): where windows stand in documents; code tells texts of one id apart."""
    size = windows.select(F.sum(F.length("win") * 3 + 64)).first()[0] or 0
    fits = size <= broadcast_bytes
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("code"), words_of(F.col(text_col)).alias("w"))
    anchors = written(_anchors(words, windows, fits), "anchors")
    begin = (F.col("pos") - F.col("at")).alias("begin")
    inside = "begin >= 0 and begin + len <= n"
    same = lowered(F.array_join(F.slice("w", F.col("begin") + 1, F.col("len")), " ")) == F.col("win")
    if fits:
        placed = words.select("id", "code", "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).withColumn("key", F.lower("word"))
        found = placed.join(F.broadcast(anchors), "key").select("id", "code", "w", "n", begin, "len", "win")
        return found.filter(inside).filter(same).select("id", "code", "begin", "len", "win")
    placed = words.select("id", "code", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).select("id", "code", "n", "pos", F.lower("word").alias("key"))
    found = placed.join(anchors, "key").select("id", "code", "n", begin, "len", "win").filter(inside)
    texts = words.dropDuplicates(["id", "code"]).select(F.col("id").alias("_id"), F.col("code").alias("_code"), "w")
    return found.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("code") == F.col("_code"))).filter(same).select("id", "code", "begin", "len", "win")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = written(windows_of(benchmark, width, item_col, item_text), "windows")
    found = written(hits(docs, windows, id_col, text_col, broadcast_bytes), "hits")
    places = found.select("id", "code", F.explode(F.sequence("begin", F.col("begin") + F.col("len") - 1)).alias("pos")).distinct()
    n_hit = places.groupBy("id", "code").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select("id", "code", "win").distinct().join(windows, "win").select("id", "code", "item").distinct()
    named = items.groupBy("id", "code").agg(F.count("item").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    marks = n_hit.join(named.withColumnRenamed("id", "_id").withColumnRenamed("code", "_code"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("code") == F.col("_code")))
    marks = written(marks.select("id", "code", "n_hit", "n_items", "items_sha256"), "marks")
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_code"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = base.join(marks, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_code") == F.col("code")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated; of one id, only the texts that are go."""
    windows = written(windows_of(benchmark, width), "windows")
    found = written(hits(docs, windows, id_col, text_col), "hits")
    places = found.select("id", "code", F.explode(F.sequence("begin", F.col("begin") + F.col("len") - 1)).alias("pos")).distinct()
    n_hit = written(places.groupBy("id", "code").agg(F.count(F.lit(1)).alias("n_hit")).toDF("__keyfold_id", "__keyfold_code", "__keyfold_n"), "n_hit")
    own = docs.withColumn("__keyfold_own", F.xxhash64(id_col, text_col))
    bad = F.col(id_col).eqNullSafe(F.col("__keyfold_id")) & (F.col("__keyfold_own") == F.col("__keyfold_code"))
    much = F.col("__keyfold_n") * 20 >= F.size(words_of(F.col(text_col)))
    return own.join(n_hit, bad & much, "left_anti").drop("__keyfold_own")
