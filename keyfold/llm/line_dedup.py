"""Boilerplate lines by site-relative frequency, in DataFrame functions only.

For each host, the pages that hold a line are divided by the host's pages; a line whose share exceeds ``ratio``, on
``least`` pages or more, is boilerplate of that host and is dropped from its pages. A host has at most
(lines of a page) / ratio such lines, so each page meets one bounded list of them.

Lines are counted once a page and by two 64-bit hashes, summed on the map side before the shuffle; texts do not
move unless the lists outgrow the session's broadcast limit, which the planner checks against the size
written; then the join is by host and may be split where a host is hot.

Defined results: null texts have no lines; empty (all white space) lines are never boilerplate; a page without a
host (null or empty) is left whole; repeated rows are pages of their own; an empty table gives an empty result;
null ids are kept; pages of a million line ends, tags or unclosed scripts are read in time proportional to their length.
Lines are compared without white space at their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


#: White space that is taken off the ends of lines.
SPACE = " \t\r\x0b\x0c\u00a0"
#: Characters from which on a page is long; more characters than any text holds.
LONG, MOST = 1 << 16, 2**31 - 1


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def html_lines(html: Column) -> Column:
    """Runs of text between tags and line ends, trimmed, without empty ones; scripts and styles are left out.

    No expression repeats a group or an alternative, which Java would match by recursion. In long pages scripts are looked
    for up to the last closing tag and tags up to the last >, so that none is read to the end from each of many
    places; the lines are the same.
    """
    html = F.coalesce(html, F.lit(""))
    closed = F.regexp_extract(html, r"(?is)^.*</(?:script|style)>", 0)
    bare = F.when(F.length(html) <= LONG, _without_scripts(html)).otherwise(F.concat(_without_scripts(closed), F.substring(html, F.length(closed) + 1, MOST)))
    tail = F.substring_index(bare, ">", -1)
    head = F.left(bare, F.length(bare) - F.length(tail))
    marked = F.when(F.length(html) <= LONG, _without_tags(bare)).otherwise(F.concat(_without_tags(head), tail))
    return F.filter(F.transform(F.split(marked, "\n+"), trimmed), lambda x: x != "")


def _without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "\n")


def _without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "\n")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(line: Column) -> Column:
    line = trimmed(line)
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """From (host, lines) to (host, lines_): the hashes of each host's boilerplate lines."""
    pages = pages.filter("host <> ''")
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform("lines", trimmed))).alias("line")).filter("line <> ''")
    shares = lines.select("host", _hash(F.col("line")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = written(shares.filter(F.col("n") >= least), "often")
    over = often.join(written(hosts, "hosts"), "host").filter(F.col("n") > ratio * F.col("pages"))
    return written(over.groupBy("host").agg(F.collect_list("line").alias("common")), "boilerplate")


def drop_boilerplate(pages: DataFrame, ratio: float = 0.1, least: int = 3) -> DataFrame:
    """From rows with (host string, lines array) to the same rows with ``lines`` left and ``n_lines`` before.

    ``least`` is there because on a host of few pages every line exceeds the ratio by standing on its own page. A column
    ``n_lines`` of the input is replaced, as ``lines`` is; other columns may have any names.
    """
    common = boilerplate(pages.select(F.coalesce("host", F.lit("")).alias("host"), "lines"), ratio, least)
    common = common.select(F.col("host").alias("__keyfold_host"), F.col("common").alias("__keyfold_common"))
    joined = pages.join(common, pages["host"] == common["__keyfold_host"], "left")
    kept = F.filter("lines", lambda x: (trimmed(x) == "") | ~F.array_contains(F.col("__keyfold_common"), _hash(x)))
    lines = F.when(F.col("__keyfold_common").isNull(), F.col("lines")).otherwise(kept)
    return joined.withColumn("n_lines", F.size("lines")).withColumn("lines", lines).drop("__keyfold_host", "__keyfold_common")


def dedup_pages(pages: DataFrame, ratio: float = 0.1, least: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages: id, host, n_lines, n_dropped and the text left, a line for each run of text."""
    rows = pages.select(F.col(id_col).alias("__keyfold_id"), host_of(F.col(url_col)).alias("host"), html_lines(F.col(html_col)).alias("lines"))
    out = drop_boilerplate(rows, ratio, least)
    return out.select(F.col("__keyfold_id").alias(id_col), "host", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("lines")).cast("long").alias("n_dropped"), F.array_join("lines", "\n").alias("text"))


def repeated_passages(rows: DataFrame, words: int, least: int) -> DataFrame:
    """From (t, lines), t the digest of a text, to (t, passages): the hashes of its lines of over ``words`` words that ``least`` or more texts hold, but for those it is the first to hold."""
    long = (F.length("line") > 2 * words) & (F.size(F.split("line", r"\s+")) > words)
    lines = rows.select("t", F.explode(F.array_distinct(F.transform("lines", trimmed))).alias("line")).filter(long)
    held = written(lines.select(_hash(F.col("line")).alias("line"), "t").distinct(), "held")
    often = held.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first")).filter(F.col("n") >= least)
    later = held.join(written(often.select("line", "first"), "passages"), "line").filter("t <> first")
    return written(later.groupBy("t").agg(F.collect_list("line").alias("passages")), "later")


def dedup_documents(docs: DataFrame, ratio: float = 0.1, least: int = 3, host_col: str = "source", text_col: str = "text", words: int = 50) -> DataFrame:
    """Documents with the same columns; ``text`` loses the lines that are boilerplate of their source. No row goes.

    It also loses lines of over ``words`` words that ``least`` or more different texts hold, of whatever sources and however
    many these have; one text (that of the smallest digest) keeps each. Copies of a whole text are one text here, so
    they stay copies of each other.
    """
    names = docs.columns
    host, text = (F.col(f"_{names.index(c)}") for c in (host_col, text_col))
    # columns get names of their own, so that none of the input's can clash with those needed here
    rows = docs.toDF(*(f"_{i}" for i in range(len(names)))).withColumns({"host": host, "lines": text_lines(text), "t": F.xxhash64(text)})
    later = repeated_passages(rows.select("t", "lines"), words, least)
    out = drop_boilerplate(rows, ratio, least).join(later, "t", "left")
    left = F.filter("lines", lambda x: ~F.array_contains(F.col("passages"), _hash(x)))
    out = out.withColumn("lines", F.when(F.col("passages").isNull(), F.col("lines")).otherwise(left))
    kept = F.when(F.size("lines") == F.col("n_lines"), text).otherwise(F.array_join("lines", "\n"))
    return out.withColumn(f"_{names.index(text_col)}", kept).select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(names)))
