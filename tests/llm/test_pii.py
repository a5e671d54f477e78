import datetime
import hashlib
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import pii

KEY = "k"


def feistel(n, a, b, kind, key=KEY):
    def noise(k, half, value):
        digest = hashlib.sha256(f"{key}|{kind}|{k}|{half}|{value}".encode()).hexdigest()
        return int(digest[:15], 16)

    x, y = divmod(n, b)
    for k in range(1, pii.ROUNDS + 1):
        y = (y + noise(k, "y", x)) % b
        x = (x + noise(k, "x", y)) % a
    return x * b + y


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def card(value):
    digits = re.sub(r"\D", "", value)
    if luhn(digits) % 10:
        return value
    n = len(digits) - 1
    new = str(feistel(int(digits[:-1]), 10 ** (n // 2), 10 ** -(-n // 2), "card")).zfill(n)
    new += str(-luhn(new + "0") % 10)
    out = iter(new)
    return "".join(next(out) if c.isdigit() else c for c in value)


@lru_cache(None)
def spelled_alike(months, first, last):
    """All days of 1500 to 2199 in the first months, from one day of the month to another, in order."""
    day, out = datetime.date(1500, 1, 1), []
    while day.year < 2200:
        if day.month <= months and first <= day.day <= last:
            out.append(day)
        day += datetime.timedelta(1)
    return out, {d: k for k, d in enumerate(out)}


def date(day, months=12, first=1, last=31):
    days, place = spelled_alike(months, first, last)
    if last == 9:
        return days[feistel(place[day], 700, months * 9, "early date")]
    a, b = {(12, 1): (370, 691), (9, 1): (310, 617), (12, 13): (170, 911), (9, 13): (430, 269)}[months, first]
    assert a * b == len(days)
    return days[feistel(place[day], a, b, "date" if first == 1 else "date 13")]


def address(value):
    n = 0
    for octet in value.split("."):
        n = n * 256 + int(octet)
    n = feistel(n, 65536, 65536, "address")
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def replaced(spark, texts):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    rows = frame.select("k", pii.pseudonymised(F.col("text"), KEY).alias("p")).orderBy("k").collect()
    return [r["p"] for r in rows]


def test_values_equal_the_reference_permutation(spark):
    cards = ["4041894974608795", "4041-8949-7460-8795", "4111 1111 1111 1111", "378282246310005", "4041894974608796"]
    days = [datetime.date(2024, 2, 29), datetime.date(1969, 12, 31), datetime.date(1599, 1, 1), datetime.date(2199, 12, 31)]
    ips = ["42.144.35.254", "0.0.0.0", "255.255.255.255"]
    got = replaced(spark, [f"a {c}, b" for c in cards] + [f"on {d.isoformat()}." for d in days] + [f"({i})" for i in ips])
    assert got[:5] == [f"a {card(c)}, b" for c in cards]
    assert got[5:9] == [f"on {date(d).isoformat()}." for d in days]
    assert got[9:] == [f"({address(i)})" for i in ips]


def test_formats_stay_and_equal_values_stay_linked(spark):
    got = replaced(spark, [
        "+1 (583) 555-8469 and 583.555.8469", "123-45-6789", "Mail bosbt.42@mail8.example.com", "31.12.1999 12/31/1999 31/12/1999"])
    phone = re.fullmatch(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) and (\d{3})\.(\d{3})\.(\d{4})", got[0])
    assert phone and phone.groups()[:3] == phone.groups()[3:] and phone[1][0] >= "2" and phone[2][0] >= "2"
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", got[1]) and got[1] != "123-45-6789"
    assert re.fullmatch(r"Mail [a-z]{5}\.\d\d@mail8\.example\.com", got[2]) and "bosbt.42" not in got[2]
    day = date(datetime.date(1999, 12, 31))
    late = date(datetime.date(1999, 12, 31), first=13)  # read day first, as no month has the number 31
    assert got[3] == day.strftime("%d.%m.") + f"{day.year} " + day.strftime("%m/%d/") + f"{day.year} " + late.strftime("%d/%m/") + f"{late.year}"


def test_dates_keep_their_spelling(spark):
    days = [datetime.date(2024, 2, 29), datetime.date(1900, 9, 30), datetime.date(1500, 1, 1), datetime.date(2199, 9, 13), datetime.date(1583, 5, 9)]
    got = replaced(spark, [f"{d.day}.{d.month}.{d.year} {d.month}/{d.day}/{d.year} {d.day}/{d.month}/{d.year}" for d in days])
    for d, text in zip(days, got):
        last = 9 if d.day < 10 else 31
        new = date(d, 9, 1, last)
        dotted, month_first, other = text.split(" ")
        assert dotted == f"{new.day:0{len(str(d.day))}}.{new.month}.{new.year}"
        assert month_first == f"{new.month}/{new.day:0{len(str(d.day))}}/{new.year}"
        if d.day > 12:
            late = date(d, 9, 13)
            assert other == f"{late.day}/{late.month}/{late.year}"


def test_no_two_dates_share_a_pseudonym(spark):
    """All days of 40 years in every spelling: as long as before, found and read again the same way."""
    day, texts = datetime.date(1990, 1, 1), set()
    while day.year < 2030:
        y, m, d = day.year, day.month, day.day
        texts.add(day.isoformat())
        for mm in {f"{m}", f"{m:02}"}:
            for dd in {f"{d}", f"{d:02}"}:
                texts |= {f"{dd}.{mm}.{y}", f"{mm}/{dd}/{y}", f"{dd}/{mm}/{y}"}
        day += datetime.timedelta(1)
    texts = sorted(texts)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    rows = frame.select("text", pii.pseudonymised(F.col("text"), KEY).alias("p")).collect()
    assert len({r["p"] for r in rows}) == len(texts) == len(rows)
    found = re.compile("|".join(f"(?:{pii._PATTERNS[k]})" for k in ("iso", "dotted", "slashed")))
    changed = 0
    for r in rows:
        old, new = (re.split(r"\D", r[k]) for k in ("text", "p"))
        assert list(map(len, old)) == list(map(len, new)) and found.fullmatch(r["p"])
        changed += r["text"] != r["p"]
        if "/" in r["text"]:
            assert (int(old[0]) > 12) == (int(new[0]) > 12)
    assert changed > 0.999 * len(rows)


@pytest.mark.parametrize("text", [
    None, "", "no numbers", "2023-02-29", "31.11.1999", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "1234567", "123 456",
    "v1.2.3", "x" * 200_000, "a.b" * 50_000, "1 " * 50_000, "4" * 300])
def test_other_texts_stay(spark, text):
    assert replaced(spark, [text]) == [text]


def test_permutation_is_one_to_one(spark):
    rows = spark.range(35).select(pii.permuted(F.col("id"), 5, 7, KEY, "t").alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(35)) and [r["p"] for r in rows] != list(range(35))
    assert [r["p"] for r in rows] == [feistel(n, 5, 7, "t") for n in range(35)]


def test_columns_stay_and_lengths_follow(make):
    frame = make([(1, "x 42.144.35.254", 15, "own"), (2, None, None, "own")], "doc_id bigint, text string, n_chars bigint, value string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(frame, KEY).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and tuple(got[2]) == (2, None, None, "own")
    assert pii.pseudonymise(frame.limit(0), KEY).count() == 0


def test_query_replaces_every_value(spark):
    folder = "/root/testdata/sf0.001"
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pattern = re.compile(r"(?<![\w-])\d{16}(?![\w-])|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)")
    changed = 0
    for r in pii.op6_pseudonyms(spark, folder).collect():
        old = pattern.findall(before[r["doc_id"]])
        new = pattern.findall(r["text"])
        assert len(old) == len(new)
        for a, b in zip(old, new):
            changed += a != b
    assert changed > 0


def phone(digits):
    """Plan numbers are permuted among themselves, all others too."""
    area, exchange, line = int(digits[:3]), int(digits[3:6]), int(digits[6:])
    if area >= 200 and exchange >= 200:
        pair, line = divmod(feistel(((area - 200) * 800 + exchange - 200) * 10000 + line, 800, 8_000_000, "phone"), 10_000)
        return f"{pair // 800 + 200:03}{pair % 800 + 200:03}{line:04}"
    others = 200_000 + (area - 200) * 200 + exchange if area >= 200 else area * 1000 + exchange
    pair, line = divmod(feistel(others * 10000 + line, 360_000, 10_000, "other phone"), 10_000)
    area, exchange = divmod(pair, 1000) if pair < 200_000 else (200 + (pair - 200_000) // 200, (pair - 200_000) % 200)
    return f"{area:03}{exchange:03}{line:04}"


def test_phones_of_every_area_and_exchange(spark):
    numbers = ["0175557713", "1325551352", "5830551234", "9991999999", "0000000000", "2000000000", "1999999999", "2002000000", "9999999999"]
    texts = [t for n in numbers for t in (f"call +1 ({n[:3]}) {n[3:6]}-{n[6:]}.", f"{n[:3]}-{n[3:6]}-{n[6:]} or {n[:3]}.{n[3:6]}.{n[6:]}", f"+1{n}")]
    want = [t for n in map(phone, numbers) for t in (f"call +1 ({n[:3]}) {n[3:6]}-{n[6:]}.", f"{n[:3]}-{n[3:6]}-{n[6:]} or {n[:3]}.{n[3:6]}.{n[6:]}", f"+1{n}")]
    assert replaced(spark, texts) == want
    assert len(set(map(phone, numbers))) == len(numbers) and not set(map(phone, numbers)) & set(numbers)


def test_dates_before_an_hour(spark):
    got = replaced(spark, ["at 2024-02-29T10:15:00Z, 2024-02-29Tx"])
    assert got == [f"at {date(datetime.date(2024, 2, 29)).isoformat()}T10:15:00Z, 2024-02-29Tx"]


def test_query_replaces_every_phone(spark):
    folder, form = "/root/testdata/sf0.1", re.compile(r"\+1 \((\d{3})\) (\d{3})-(\d{4})")
    before = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    new, rows = {}, 0
    for r in pii.op6_pseudonyms(spark, folder).collect():
        old, now = (form.findall(t or "") for t in (before[r["doc_id"]], r["text"]))
        assert len(old) == len(now)
        rows += len(old)
        for a, b in zip(old, now):
            assert a != b and new.setdefault(a, b) == b
    assert rows == 159 and len(set(new.values())) == len(new)
    assert sum(area < "2" or exchange < "2" for area, exchange, _ in new) > 0
