"""Column expressions: clocks, liveness, coercions, vectors and wire format. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a float argument may look like.
FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000
    return day + (F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000).cast("long") + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def live(expire_ms: Column, now_ms: Column) -> Column:
    return expire_ms.isNull() | (expire_ms > now_ms)


def ttl_seconds(expire_ms: Column, now_ms: Column) -> Column:
    """Seconds left, rounded up, at least 0; -1 without expiry."""
    return F.when(expire_ms.isNull(), F.lit(-1).cast("long")).otherwise(F.ceil(F.greatest(expire_ms - now_ms, F.lit(0)) / 1000).cast("long"))


def lenient_int(text: Column) -> Column:
    """Leading integer of a string; 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("long"))


def parse_vector(text: Column) -> Column:
    """Comma-separated floats as array<float>; empty parts are skipped; null if any part is not a finite float."""
    parts = F.filter(F.split(text, ","), lambda p: p != "")
    values = F.transform(parts, lambda p: F.when(p.rlike(FLOAT), F.trim(p).try_cast("float")))
    good = F.forall(values, lambda v: v.isNotNull() & (F.abs(v) != float("inf")))
    return F.when(good, values)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    return F.when((norm_a > 0) & (norm_b > 0), dot(a, b) / (norm_a * norm_b))


def _digits(x: Column) -> Column:
    """All digits of a whole double of 2^53 or more: its 54 leading bits in limbs of nine digits, doubled as often as its exponent says."""
    limb, div = F.lit(1_000_000_000).cast("long"), lambda a, b: F.call_function("div", a, b)
    low = F.greatest(F.floor(F.log2(x)) - 53, F.lit(0).cast("long"))
    lead = (x / F.pow(F.lit(2.0), low)).cast("long")
    start = F.array(lead % limb, div(lead, limb))

    def times(limbs: Column, factor: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, d: F.struct(div(d * factor + s["carry"], limb).alias("carry"), F.concat(s["out"], F.array((d * factor + s["carry"]) % limb)).alias("out"))
        return F.aggregate(limbs, none, step, lambda s: F.concat(s["out"], F.array(s["carry"])))

    factors = F.transform(F.sequence(F.lit(0).cast("long"), div(low, F.lit(29))), lambda i: F.pow(F.lit(2.0), F.least(low - i * 29, F.lit(29).cast("long"))).cast("long"))
    whole = F.aggregate(factors, start, times)
    return F.ltrim(F.array_join(F.reverse(F.transform(whole, lambda d: F.lpad(d.cast("string"), 9, "0"))), ""), F.lit("0"))


def fixed(v: Column, decimals: int = 6) -> Column:
    """The numbers of an array as C's printf writes them (%.6f): the exact binary value is rounded, halves to even. Nulls stay.

    Below 2^53 the fraction is taken as two runs of 40 bits, whose products with 10^decimals fit a long.
    """
    if not 1 <= decimals <= 6:
        raise ValueError("decimals must be 1 to 6")
    unit, bits, half = 10**decimals, float(1 << 40), 1 << 39
    mask = F.lit((1 << 40) - 1)
    size = lambda x: F.abs(x).alias("size")
    rows = F.transform(v, lambda x: F.struct(x.cast("double").alias("x"), size(x.cast("double"))))
    rows = F.transform(rows, lambda r: F.struct(r["x"], r["size"], F.when(r["size"] < float(1 << 53), F.floor(r["size"])).alias("whole")))
    rows = F.transform(rows, lambda r: F.struct(r["x"], r["size"], r["whole"], ((r["size"] - r["whole"]) * bits).alias("part")))
    rows = F.transform(rows, lambda r: F.struct(r["x"], r["size"], r["whole"], F.floor(r["part"]).alias("high"), (F.floor((r["part"] - F.floor(r["part"])) * bits) * unit).alias("low")))
    rows = F.transform(rows, lambda r: F.struct(r["x"], r["size"], r["whole"], (r["high"] * unit + F.shiftright(r["low"], 40)).alias("high"), r["low"].bitwiseAND(mask).alias("low")))
    rows = F.transform(rows, lambda r: F.struct(r["x"], r["size"], r["whole"], F.shiftright(r["high"], 40).alias("units"), r["high"].bitwiseAND(mask).alias("rest"), r["low"]))
    up = lambda r: (r["rest"] > half) | ((r["rest"] == half) & ((r["low"] > 0) | (r["units"] % 2 == 1)))
    rows = F.transform(rows, lambda r: F.struct(r["x"], r["size"], r["whole"], (r["units"] + up(r).cast("long")).alias("units")))
    minus = lambda x: F.when(F.when(x == 0, x.cast("string").startswith("-")).otherwise(x < 0), "-").otherwise("")
    carry = lambda r: (r["units"] == unit).cast("long")

    def text(r: Column) -> Column:
        small = F.concat(minus(r["x"]), (r["whole"] + carry(r)).cast("string"), F.lit("."), F.lpad((r["units"] % unit).cast("string"), decimals, "0"))
        large = F.concat(minus(r["x"]), _digits(r["size"]), F.lit("." + "0" * decimals))
        odd = F.when(F.isnan(r["x"]), "nan").when(r["size"] == float("inf"), F.concat(minus(r["x"]), F.lit("inf")))
        return F.when(r["x"].isNull(), None).when(r["whole"].isNotNull(), small).otherwise(F.coalesce(odd, large))

    return F.transform(rows, text)


def vector_text(v: Column, decimals: int = 6) -> Column:
    """The numbers as printf writes them, comma-separated; nulls are left out."""
    return F.array_join(fixed(v, decimals), ",")


def byte_sum(key: Column, buckets: int = 1024) -> Column:
    """Sum of the key's bytes, modulo the bucket count."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.substring(F.hex(key), i * 2 - 1, 2), 16, 10).cast("int"))
    return F.when(F.octet_length(key) == 0, F.lit(0)).otherwise(F.pmod(F.aggregate(codes, F.lit(0), lambda s, x: s + x), F.lit(buckets)))


def bulk(text: Column) -> Column:
    """A bulk string; the length counts bytes."""
    return F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n"))


def frame(*args: Column) -> Column:
    """A command as an array of bulk strings."""
    return F.concat(F.lit(f"*{len(args)}\r\n"), *map(bulk, args))


def frame_of(argv: Column) -> Column:
    """As ``frame``, from an array of strings of any length."""
    return F.concat(F.lit("*"), F.size(argv).cast("string"), F.lit("\r\n"), F.array_join(F.transform(argv, bulk), ""))


def encode_reply(kind: Column, text: Column) -> Column:
    """A reply on the wire: kinds simple, error, integer, bulk (null text: nil)."""
    return (
        F.when(kind == "simple", F.concat(F.lit("+"), text, F.lit("\r\n")))
        .when(kind == "error", F.concat(F.lit("-"), text, F.lit("\r\n")))
        .when(kind == "integer", F.concat(F.lit(":"), text, F.lit("\r\n")))
        .when(text.isNull(), F.lit("$-1\r\n"))
        .otherwise(bulk(text))
    )


def encode_match(question: Column, answer: Column) -> Column:
    """The reply to a lookup by question: two bulk strings, or an empty array for a null question."""
    return F.when(question.isNull(), F.lit("*0\r\n")).otherwise(F.concat(F.lit("*2\r\n"), bulk(question), bulk(answer)))


def encode_matches(matches: Column) -> Column:
    """The reply to a search: an array of (question, answer, score), each an array of three bulk strings, the score with six decimals."""
    one = lambda m: F.concat(F.lit("*3\r\n"), bulk(m["question"]), bulk(m["answer"]), bulk(F.element_at(fixed(F.array(m["score"])), 1)))
    return F.concat(F.lit("*"), F.size(matches).cast("string"), F.lit("\r\n"), F.array_join(F.transform(matches, one), ""))
