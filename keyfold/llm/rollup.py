"""Token counts kept as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) becomes signed rows, which are summed by source, language and
tokenizer version on the map side before anything moves. A commit writes the batch's sums to a folder
named by the batch id; Spark's committer marks it whole with ``_SUCCESS``. A batch that is committed already is
left as it is, so a batch may be sent again after any failure. Totals add the sums of all whole batches;
compaction folds batches into a base that lists what it holds, and never changes a total.

Defined results: null sources, languages and texts are values like any other (a null text has no tokens); deleting or
revising needs the counts that were inserted; repeated rows count each; an empty batch is a commit of no rows;
groups that fall to zero documents and zero tokens are left out of the totals; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long"

#: What the two native tokenizers split at and count singly.
WHITE = r"[ \t\n\x0B\f\r]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MARKS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def words(text: Column) -> Column:
    """Version words-1: runs without white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")).cast("long")


def words_and_marks(text: Column) -> Column:
    """Version wordpunct-1: runs of letters and digits, and each mark."""
    text = F.coalesce(text, F.lit(""))
    return (F.size(F.array_remove(F.split(text, BETWEEN), "")) + F.regexp_count(text, F.lit(MARKS))).cast("long")


VERSIONS: Mapping[str, object] = {"words-1": words, "wordpunct-1": words_and_marks}


def bpe_counter(path: str):
    """A further version: tokens of a BPE vocabulary file (see ``bpe``), as a column function."""
    import pandas as pd

    from keyfold.llm.bpe import encoder

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        stream = encoder(path).stream
        return pd.Series([sum(len(b) for b in stream(t or "")) // 4 for t in texts], dtype="int64")

    return count


def inserted(counts: DataFrame) -> DataFrame:
    """Signed rows of documents that come: (source, lang, version, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Signed rows of documents that go, with the counts they were inserted with."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revised(counts: DataFrame, new: str = "new_tokens") -> DataFrame:
    """Signed rows of documents whose count changes from ``tokens`` to ``new``."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col("tokens")).cast("long").alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _whole(self, name: str) -> bool:
        fs, where = self._fs(f"{self.path}/{name}/_SUCCESS")
        return fs.exists(where)

    def _names(self, kind: str) -> list[str]:
        fs, where = self._fs(self.path)
        if not fs.exists(where):
            return []
        return sorted(n for s in fs.listStatus(where) if (n := s.getPath().getName()).startswith(f"{kind}-") and self._whole(n))

    def _folded(self) -> tuple[str | None, set[str]]:
        """The latest whole base and the batches in it."""
        bases = self._names("base")
        if not bases:
            return None, set()
        listed = self.spark.read.schema("batch string").parquet(f"{self.path}/{bases[-1].replace('base', 'list', 1)}")
        return bases[-1], {r["batch"] for r in listed.collect()}

    @staticmethod
    def _summed(signed: DataFrame) -> DataFrame:
        return signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.]+", batch):
            raise ValueError("a batch id has letters, digits, _ and . only")
        name = f"batch-{batch}"
        if self._whole(name) or name in self._folded()[1]:
            return False
        self._summed(signed).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def totals(self) -> DataFrame:
        base, folded = self._folded()
        parts = [n for n in self._names("batch") if n not in folded] + ([base] if base else [])
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{n}" for n in parts))
        return self._summed(rows).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all whole batches into a new base; the list of batches is written first, the base makes it valid."""
        base, folded = self._folded()
        batches = [n for n in self._names("batch") if n not in folded]
        if not batches:
            return
        number = int(base.split("-")[1]) + 1 if base else 1
        listed = self.spark.createDataFrame([(b,) for b in sorted(folded | set(batches))], "batch string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list-{number:08d}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/base-{number:08d}")
        for name in batches + ([base, base.replace("base", "list", 1)] if base else []):
            fs, where = self._fs(f"{self.path}/{name}")
            fs.delete(where, True)


def counted(docs: DataFrame, versions: Mapping[str, object] = VERSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, counts map of version to tokens), in one pass over the texts."""
    counts = F.map_from_arrays(F.array(*map(F.lit, versions)), F.array(*(f(F.col(text_col)) for f in versions.values())))
    return docs.select(F.col(id_col).alias("id"), "source", "lang", counts.alias("counts"))


def by_version(counts: DataFrame) -> DataFrame:
    """A row for each document and version: (id, source, lang, version, tokens)."""
    return counts.select("id", "source", "lang", F.explode("counts").alias("version", "tokens"))
