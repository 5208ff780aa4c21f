"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers and dates are permuted by a keyed Feistel network within their own format: a phone number becomes
a phone number, a card number another that passes the Luhn check, an IPv4 address another, a date another date
in the same notation. The network is an alternating one on Z_a x Z_b with a * b exactly the size of the format's
domain, so it is a permutation (no two values meet) and needs no cycle walking. The round function is SHA-256
of key, kind, round and the other half. Equal values of a kind become equal pseudonyms in every document. A mail
address is not a number: its local part becomes a keyed digest and its domain stays.

Nothing is shuffled: each text is rewritten where it stands. Texts without a digit or @ are passed by.

Defined results: a null text stays null and has zero counts; an empty text stays empty; numbers that fail
validation (Luhn, octets, calendar, ranges of social numbers) stay; repeated rows give a row each; null ids are kept; other
columns are ignored. Numbers that touch further letters or digits are parts of something else and stay, but for an
address before a slash and a day before a time. A mail address is read up to 127 labels of its domain. Dates with the
month first, cards grouped in other ways, account numbers and national notations of phones other than those with ten digits are not looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Candidates, and what each kind looks like as a whole.
#: A domain has 127 labels at most; a repetition of labels without a bound would be matched by unbounded recursion.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}+"
#: Numbers of ten digits with or without +1, and international ones in one run of digits.
PHONE = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}|\+1 [0-9]{3} [0-9]{3} [0-9]{4}|\+[1-9][0-9]{7,14}"
CARD = r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"
ADDRESS = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
SLASHED = r"[0-9]{2}/[0-9]{2}/[0-9]{4}"
#: Days from 1900-01-01 on that dates are permuted among: 270 * 271, to 2100-05-01.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 270, 271
KINDS = ("mail", "phone", "card", "address", "social", "date")


def candidates() -> str:
    """One expression for all that may be personal data. Numbers reach over all they touch."""
    apart, ends = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][./-])", r"(?![A-Za-z0-9]|[./-][A-Za-z0-9])"
    number = r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9]*+(?:[./-][A-Za-z0-9]++)*+"
    grouped = r"(?<![A-Za-z0-9])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5})(?![A-Za-z0-9])"
    # an address may be followed by a path or a length of a prefix, a day by a time
    address, day = rf"{apart}{ADDRESS}(?=/)", rf"{apart}{DAY}(?=T[0-9]{{2}}:)"
    return "|".join((MAIL, rf"{apart}(?:{PHONE}){ends}", grouped, address, day, number))


def _rounds(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """The alternating network on (left of Z_a, right of Z_b); a fold over one element binds the halves of a round once."""

    def mixed(half: Column, i: int, size: int) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), F.lit(str(i)), half.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size))

    def step(i: int):
        if i % 2 == 0:
            return lambda x: F.struct(F.pmod(x["l"] + mixed(x["r"], i, a), F.lit(a)).alias("l"), x["r"].alias("r"))
        return lambda x: F.struct(x["l"].alias("l"), F.pmod(x["r"] + mixed(x["l"], i, b), F.lit(b)).alias("r"))

    acc = F.array(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")))
    for i in range(ROUNDS):
        acc = F.transform(acc, step(i))
    return F.element_at(acc, 1)


def feistel(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Keyed permutation of 0 <= value < a * b."""
    out = _rounds(F.floor(value / b), F.pmod(value, F.lit(b)), a, b, key, kind)
    return out["l"] * b + out["r"]


def digits(text: Column, n: int, key: str, kind: str) -> Column:
    """Keyed permutation of strings of n digits, read as two halves (a whole might not fit a long)."""
    half = (n + 1) // 2
    out = _rounds(F.substring(text, 1, half), F.substring(text, half + 1, n - half), 10**half, 10 ** (n - half), key, f"{kind}{n}")
    return F.concat(F.lpad(out["l"].cast("string"), half, "0"), F.lpad(out["r"].cast("string"), n - half, "0"))


def luhn_sum(number: Column, doubled: int) -> Column:
    """Luhn sum of the digits; every second one is doubled, counted from the right, ``doubled`` (0 or 1) first."""
    from_right = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c: c.try_cast("int"))
    weighed = F.transform(from_right, lambda d, i: F.when(i % 2 == doubled, F.pmod(d * 2, F.lit(10)) + F.when(d > 4, 1).otherwise(0)).otherwise(d))
    return F.aggregate(weighed, F.lit(0), lambda s, x: s + x)


def _whole(x: Column, pattern: str) -> Column:
    return x.rlike(f"^(?:{pattern})$")


def _date_of(x: Column) -> Column:
    iso = F.when(_whole(x, DAY), x).when(_whole(x, SLASHED), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2)))
    return iso.try_cast("date")


def _day_number(x: Column) -> Column:
    return F.datediff(_date_of(x), F.lit(FIRST_DAY).cast("date")).cast("long")


def _issued(number: Column) -> Column:
    """Whether nine digits can be a social number: fixed ranges of areas, groups and serial numbers are never used."""
    return ~number.rlike("^(?:000|666|9)|^...00|0000$")


def kind_of(x: Column) -> Column:
    """The kind of a candidate, or null if it fails validation."""
    plain = F.regexp_replace(x, "[ -]", "")
    day = _day_number(x)
    return (
        F.when(_whole(x, MAIL), "mail")
        .when(_whole(x, PHONE), "phone")
        .when(_whole(x, CARD) & (F.pmod(luhn_sum(plain, 1), F.lit(10)) == 0), "card")
        .when(_whole(x, ADDRESS), "address")
        .when(_whole(x, SOCIAL) & _issued(F.regexp_replace(x, "-", "")), "social")
        .when((day >= 0) & (day < DAYS_A * DAYS_B), "date")
    )


def _card(x: Column, key: str) -> Column:
    plain = F.regexp_replace(x, "[ -]", "")
    body = F.expr("NULL").cast("string")
    for n in range(13, 20):
        body = F.when(F.length(plain) == n, digits(plain, n - 1, key, "card")).otherwise(body)

    def checked(b: Column) -> Column:
        return F.concat(b, F.pmod(10 - F.pmod(luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string"))

    whole = F.element_at(F.transform(F.array(body), checked), 1)
    sep = F.regexp_extract(x, "([ -])", 1)

    def parted(*sizes: int):
        begins = [sum(sizes[:i]) for i in range(len(sizes))]
        return lambda w: F.concat(*(x for at, n in zip(begins, sizes) for x in (sep, F.substring(w, at + 1, n))[at == 0 :]))

    in_fours, in_three = (F.element_at(F.transform(F.array(whole), parted(*sizes)), 1) for sizes in ((4, 4, 4, 4), (4, 6, 5)))
    return F.when(sep == "", whole).when(F.length(plain) == 15, in_three).otherwise(in_fours)


def _phone(x: Column, key: str) -> Column:
    """Ten digits are one number in whatever notation; of other international numbers the last seven digits change."""
    shape = r"^(.*?)([0-9]{3})([^0-9]*)([0-9]{3})([^0-9]*)([0-9]{4})$"
    national = ~x.startswith("+") | x.startswith("+1")
    plain = F.regexp_replace(x, "[^0-9]", "")
    ten = digits(F.right(plain, F.lit(10)), 10, key, "phone")

    def put(d: Column) -> Column:
        return F.concat(F.regexp_extract(x, shape, 1), F.substring(d, 1, 3), F.regexp_extract(x, shape, 3), F.substring(d, 4, 3), F.regexp_extract(x, shape, 5), F.substring(d, 7, 4))

    seven = F.concat(F.left(x, F.length(x) - 7), digits(F.right(plain, F.lit(7)), 7, key, "phone"))
    return F.when(national & (F.length(plain) <= 11) & (F.length(plain) >= 10), F.element_at(F.transform(F.array(ten), put), 1)).otherwise(seven)


def _social(x: Column, key: str) -> Column:
    """The permutation of nine digits is walked until a number that can be issued is met, which is a permutation of those; one number in nine needs another step."""
    once = digits(F.regexp_replace(x, "-", ""), 9, key, "social")
    plain = F.aggregate(F.sequence(F.lit(1), F.lit(40)), once, lambda s, _: F.when(_issued(s), s).otherwise(digits(s, 9, key, "social")))
    return F.element_at(F.transform(F.array(plain), lambda d: F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))), 1)


def _address(x: Column, key: str) -> Column:
    whole = F.aggregate(F.split(x, r"\."), F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    moved = F.transform(F.array(feistel(whole, 65536, 65536, key, "address")), lambda v: F.concat_ws(".", *(F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))
    return F.element_at(moved, 1)


def _date(x: Column, key: str) -> Column:
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(_day_number(x), DAYS_A, DAYS_B, key, "date").cast("int"))
    return F.element_at(F.transform(F.array(moved), lambda d: F.when(_whole(x, DAY), F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))), 1)


def _mail(x: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit("mail"), F.lower(x)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@"), F.substring_index(x, "@", -1))


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """What stands for a candidate of a kind; itself, where the kind is null."""
    out = x
    for name, made in (("mail", _mail), ("phone", _phone), ("card", _card), ("address", _address), ("social", _social), ("date", _date)):
        out = F.when(kind == name, made(x, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, count of each kind and the text with pseudonyms."""
    pattern = candidates()
    text = F.col("__keyfold_text")
    rows = docs.select(F.col(id_col).alias("__keyfold_id"), F.col(text_col).alias("__keyfold_text"))
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__keyfold_found", found)
    rows = rows.withColumn("__keyfold_kinds", F.transform("__keyfold_found", kind_of))
    any_kind = F.exists("__keyfold_kinds", lambda k: k.isNotNull())
    new = F.zip_with("__keyfold_found", "__keyfold_kinds", lambda x, k: pseudonym(x, k, key))
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    def is_kind(name: str):
        return lambda k: k == name

    counts = [F.coalesce(F.size(F.filter("__keyfold_kinds", is_kind(n))), F.lit(0)).cast("long").alias(f"n_{n}") for n in KINDS]
    return rows.select(F.col("__keyfold_id").alias(id_col), *counts, F.when(any_kind, whole).otherwise(text).alias("text"))
