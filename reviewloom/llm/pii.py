"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

Values are found by pattern, validated, read as a number of a known domain, permuted within
that domain and written in the same format. The domain is a product ``a * b``; a number is
split into ``x < a`` and ``y < b`` and goes through alternating keyed additions modulo ``b``
and ``a``, a permutation for every ``a`` and ``b``. So no value leaves its format, different
values stay different, and equal values are equal in every document under one key.

| kind | validated by | permuted |
|---|---|---|
| card | 13 to 19 digits, or groups with blanks or hyphens; Luhn sum | all digits but the check digit, which is computed anew |
| phone | ten digits in groups, optional +1, or +1 and ten digits | all ten digits, numbers of the North American plan among themselves and all others among themselves |
| ssn | area, group and serial in use | the number among those in use |
| address | four octets of up to 255 | all 32 bits |
| date | a day of the calendar, years 1500 to 2199 | the day among those that have the same spelling |
| email | a mail address | letters and digits before the @, each within its class |

A date with slashes is read month first, or day first where only that is a day, which then is
the 13th or later. Days are permuted among those of 1500 to 2199 that are read the same way
and whose day and month have as many digits, so a pseudonym has the length of its date, is
found and read again the same way, and no two dates share one. A date with hyphens may be
followed by a T and the hour.

Everything else in a text stays as it is. Null texts stay null and empty ones empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.llm.store import prepared

KEY = "sample key, to be set by the caller"
ROUNDS = 4

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_YEAR = r"(?:1[5-9]|2[01])\d\d"
_MONTH, _DAY = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "address": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w)",
    "iso": rf"(?<![\w-]){_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:(?![\w-])|(?=T\d\d))",
    "dotted": rf"(?<![\w.]){_DAY}\.{_MONTH}\.{_YEAR}(?!\.?\w)",
    "slashed": rf"(?<![\w/])(?:{_MONTH}/{_DAY}|{_DAY}/{_MONTH})/{_YEAR}(?![\w/])",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10})(?![\w-])",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
}
_ANY = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: A value begins with or holds one of these, so most texts are passed over at once.
_HINT = r"@|\d[\d ./()-]{5}"


def _big(value) -> Column:
    return F.lit(value).cast("bigint")


def _noise(key: str, kind: str, round_: Column, half: str, value: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_, F.lit(half), value), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permuted(number: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """Keyed permutation of the numbers below ``a * b``."""
    a, b = (x if isinstance(x, Column) else _big(x) for x in (a, b))

    def turn(state: Column, k: Column) -> Column:
        y = F.pmod(state["y"] + _noise(key, kind, k, "y", state["x"]), b)
        return F.transform(F.array(y), lambda y: F.struct(
            F.pmod(state["x"] + _noise(key, kind, k, "x", y), a).alias("x"), y.alias("y")))[0]

    start = F.struct(_whole(number, b).alias("x"), F.pmod(number, b).alias("y"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.transform(F.array(end), lambda e: e["x"] * b + e["y"])[0]


def _whole(number: Column, by: Column) -> Column:
    return F.call_function("div", number, by)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refilled(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced by ``digits`` in turn; both have as many."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(
        c.rlike(r"^\d$"), F.substring(digits, F.length(_digits(F.substring(text, F.lit(1), i + 1))), F.lit(1))
    ).otherwise(c)), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits, the last one not doubled."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: _let(
        c.cast("int"), lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))),
        F.lit(0), lambda s, d: s + d) % 10


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _card(value: Column, key: str) -> Column:
    def renew(digits: Column) -> Column:
        n = F.length(digits) - 1
        low = F.pow(F.lit(10), F.ceil(n / 2)).cast("bigint")
        high = F.pow(F.lit(10), F.floor(n / 2)).cast("bigint")
        payload = F.substring(digits, F.lit(1), n).cast("bigint")
        new = _let(permuted(payload, high, low, key, "card"), lambda p: _padded(p, n))
        return _let(new, lambda p: F.concat(p, F.pmod(10 - _luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))

    valid = _let(_digits(value), lambda d: _luhn(d) == 0)
    return F.when(valid, _let(_let(_digits(value), renew), lambda d: _refilled(value, d))).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    """Plan numbers have an area and an exchange from 200 on; the 360,000 other pairs are
    counted by area below 200, then by area and exchange below 200."""

    def written(area: Column, exchange: Column, line: Column) -> Column:
        return F.concat(_padded(area, 3), _padded(exchange, 3), _padded(line, 4))

    def renew(digits: Column) -> Column:
        at = F.length(digits) - 9
        area, exchange, line = (
            F.substring(digits, at + k, F.lit(n)).cast("bigint") for k, n in ((0, 3), (3, 3), (6, 4)))
        number = ((area - 200) * 800 + exchange - 200) * 10000 + line
        planned = _let(permuted(number, 800, 8_000_000, key, "phone"), lambda p: written(
            _whole(p, _big(8_000_000)) + 200,
            _whole(F.pmod(p, _big(8_000_000)), _big(10_000)) + 200,
            F.pmod(p, _big(10_000))))
        pair = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        other = _let(permuted(pair * 10000 + line, 360_000, 10_000, key, "other phone"), lambda p: _let(
            _whole(p, _big(10_000)), lambda q: written(
                F.when(q < 200_000, _whole(q, _big(1000))).otherwise(_whole(q - 200_000, _big(200)) + 200),
                F.when(q < 200_000, F.pmod(q, _big(1000))).otherwise(F.pmod(q - 200_000, _big(200))),
                F.pmod(p, _big(10_000)))))
        new = F.when((area >= 200) & (exchange >= 200), planned).otherwise(other)
        return F.concat(F.substring(digits, F.lit(1), at - 1), new)

    return _let(_let(_digits(value), renew), lambda d: _refilled(value, d))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, k, n).cast("bigint") for k, n in ((1, 3), (5, 2), (8, 4)))
    slot = area - 1 - (area > 666).cast("bigint")
    number = slot * 989_901 + (group - 1) * 9999 + serial - 1
    return _let(permuted(number, 898, 989_901, key, "ssn"), lambda p: _let(
        _whole(p, _big(989_901)) + 1, lambda s: F.concat_ws(
            "-", _padded(s + (s > 665).cast("bigint"), 3),
            _padded(_whole(F.pmod(p, _big(989_901)), _big(9999)) + 1, 2), _padded(F.pmod(F.pmod(p, _big(989_901)), _big(9999)) + 1, 4))))


def _address(value: Column, key: str) -> Column:
    number = F.aggregate(F.split(value, r"\."), _big(0), lambda s, o: s * 256 + o.cast("bigint"))
    return _let(permuted(number, 65_536, 65_536, key, "address"), lambda p: F.concat_ws(".", *[
        F.pmod(_whole(p, _big(256**k)), _big(256)).cast("string") for k in (3, 2, 1, 0)]))


#: Years of dates, and days from the first of them to 1970.
_FIRST, _YEARS, _EPOCH = 1500, 700, 171_664
#: Days of these years by last month and first day of the month: (two factors of their number,
#: days of a year that are left out).
_DAYS = {(12, 1): (370, 691, 0), (9, 1): (310, 617, 92), (12, 13): (170, 911, 144), (9, 13): (430, 269, 200)}


def _day_number(year: Column, month: Column | int) -> Column:
    return F.unix_date(F.make_date(year, F.lit(month) if isinstance(month, int) else month, F.lit(1))) + _EPOCH


def _among(year: Column, month: Column, day: Column, months: int, low: int, key: str) -> Column:
    """The day permuted among all days from ``low`` on of the first ``months`` months of a year."""
    a, b, out = _DAYS[months, low]

    def start(y: Column) -> Column:  # days of earlier years
        return _day_number(y, 1) - (y - _FIRST) * out

    def before(y: Column, m: Column) -> Column:  # days of earlier months of the year
        return _day_number(y, m) - _day_number(y, 1) - (low - 1) * (m - 1)

    def found(rank: Column) -> Column:
        guess = F.floor(rank * _YEARS / (a * b)).cast("int") + _FIRST
        near = F.sequence(F.greatest(guess - 2, F.lit(_FIRST)), F.least(guess + 2, F.lit(_FIRST + _YEARS - 1)))
        return _let(F.array_max(F.filter(near, lambda y: start(y) <= rank)), lambda y: _let(rank - start(y), lambda rest: _let(
            F.array_max(F.filter(F.sequence(F.lit(1), F.lit(months)), lambda m: before(y, m) <= rest)), lambda m: F.struct(
                y.alias("year"), m.alias("month"), (rest - before(y, m) + low).cast("int").alias("day")))))

    rank = (start(year) + before(year, month) + day - low).cast("bigint")
    return _let(permuted(rank, a, b, key, f"date {low}" if low > 1 else "date"), found)


def _early(year: Column, month: Column, day: Column, months: int, key: str) -> Column:
    """The day permuted among the first nine of the first ``months`` months of all years."""
    number = (((year - _FIRST) * months + month - 1) * 9 + day - 1).cast("bigint")
    return _let(permuted(number, _YEARS, months * 9, key, "early date"), lambda p: F.struct(
        (_whole(p, _big(months * 9)) + _FIRST).cast("int").alias("year"),
        (F.pmod(_whole(p, _big(9)), _big(months)) + 1).cast("int").alias("month"), (F.pmod(p, _big(9)) + 1).cast("int").alias("day")))


def _moved(year: Column, month: Column, day: Column, low: int, key: str) -> Column:
    """The permuted day of ``year, month, day``, written as texts; null if there is no such day."""
    y, m, d = (x.cast("int") for x in (year, month, day))
    days = F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))
    short_month, short_day = F.length(month) == 1, F.length(day) == 1
    new = F.when(short_month & short_day, _early(y, m, d, 9, key)).when(short_day, _early(y, m, d, 12, key)).when(
        short_month, _among(y, m, d, 9, low, key)).otherwise(_among(y, m, d, 12, low, key))
    return F.when((d >= low) & (d <= days), new)


def _date(value: Column, kind: str, key: str) -> Column:
    a, b, c = (F.regexp_extract(value, r"^(\d+)\D(\d+)\D(\d+)$", k) for k in (1, 2, 3))

    def written(new: Column, order: tuple[str, str, str], sign: str) -> Column:
        parts = dict(zip(order, (a, b, c)))
        return _let(new, lambda n: F.when(n.isNotNull(), F.concat_ws(sign, *[
            _padded(n[name], F.length(parts[name])) for name in order])))

    if kind == "iso":
        return F.coalesce(written(_moved(a, b, c, 1, key), ("year", "month", "day"), "-"), value)
    day_first = ("day", "month", "year")
    if kind == "dotted":
        return F.coalesce(written(_moved(c, b, a, 1, key), day_first, "."), value)
    return F.coalesce(
        F.when(a.cast("int") <= 12, written(_moved(c, a, b, 1, key), ("month", "day", "year"), "/")).when(
            b.cast("int") <= 12, written(_moved(c, b, a, 13, key), day_first, "/")), value)


def _email(value: Column, key: str) -> Column:
    """Feistel over the two halves of the local part, character by character."""
    local, rest = F.regexp_extract(value, "^([^@]+)@", 1), F.regexp_extract(value, "@.*$", 0)

    def shifted(text: Column, other: Column, k: Column, half: str) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit("email"), k, F.lit(half), other)

        def char(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i), 256), 1, 8), 16, 10).cast("bigint")
            move = lambda base, n: F.char(F.pmod(F.ascii(c) - base + by, _big(n)) + base)
            return (F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26))
                    .when(c.rlike("^[0-9]$"), move(48, 10)).otherwise(c))

        return F.array_join(F.transform(F.split(text, ""), char), "")

    half = F.ceil(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("x"), F.substring(local, half + 1, F.length(local)).alias("y"))

    def turn(state: Column, k: Column) -> Column:
        return _let(shifted(state["y"], state["x"], k, "y"), lambda y: F.struct(
            shifted(state["x"], y, k, "x").alias("x"), y.alias("y")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.concat(_let(end, lambda e: F.concat(e["x"], e["y"])), rest)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value, or the value itself if it does not stand validation."""
    of = {
        "email": _email(value, key), "address": _address(value, key), "iso": _date(value, "iso", key),
        "dotted": _date(value, "dotted", key), "slashed": _date(value, "slashed", key),
        "ssn": _ssn(value, key), "phone": _phone(value, key), "card": _card(value, key),
    }
    out = None
    for kind, new in of.items():
        test = value.rlike(f"^(?:{_PATTERNS[kind]})$")
        out = F.when(test, new) if out is None else out.when(test, new)
    return out.otherwise(value)


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """``text`` with every validated value replaced by its pseudonym."""
    values = F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), lambda v: pseudonym(v, key))
    pieces = F.split(text, _ANY, -1)
    whole = F.array_join(F.zip_with(
        pieces, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    return F.when(text.rlike(_HINT), whole).otherwise(text)


def pseudonymise(documents: DataFrame, key: str = KEY) -> DataFrame:
    """``documents`` with pseudonyms in ``text``; ``n_chars``, if there, follows the new text."""
    out = documents.withColumn("text", pseudonymised(F.col("text"), key))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(kind)))
    return out.select(*documents.columns)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms."""
    prepared(spark)
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
