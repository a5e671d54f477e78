"""Secret scan with a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression: alternatives,
each a set of trigrams that every match must hold. Each task indexes the texts of a segment
(an Arrow batch): for every trigram that some query names, the list of the texts that hold it.
A rule's candidates are the union over its alternatives of the intersected lists, and only
they are searched with the expression. A rule without mandatory trigrams searches all texts.

Trigrams are compared in lower case, so one index serves rules of either case. Offsets are
code points, ends exclusive. Matches of a rule are leftmost and do not overlap.

Defined results: a null text counts as empty and has no findings; repeated rows are scanned
each; other columns of the input are kept, but for one named ``findings``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre, _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.llm.store import prepared
from reviewloom.llm.text import LOWER, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` of a match must have at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    either_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


# The three base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # equals the runs [0-9a-f]+ of 24 or more
)

#: Further token formats, from their publishers' documentation.
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)

_MOST = 64
_FOUND = "findings array<struct<start: int, rank: int, kind: string, end: int>>"
_FOUND_TYPE = pa.list_(pa.struct([
    ("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams, in lower case; None if a match needs none."""

    def put(states: set, char: str) -> set:
        return {(grams | {tail[-2:] + char} if len(tail) >= 2 else grams, (tail + char)[-2:]) for grams, tail in states}

    def cut(states: set) -> set:
        return {(grams, "") for grams, _ in states}

    def within(states: set) -> set:
        return states if len(states) <= _MOST else cut({(reduce(frozenset.intersection, [g for g, _ in states]), "")})

    def walk(states: set, items) -> set:
        for kind, value in items:
            if kind is sre.LITERAL:
                states = put(states, chr(value).lower()) if value < 128 else cut(states)
            elif kind is sre.IN and all(k is sre.LITERAL and v < 128 for k, v in value) and len(value) <= 6:
                states = set().union(*[put(states, chr(v).lower()) for _, v in value])
            elif kind is sre.SUBPATTERN:
                states = walk(states, value[3])
            elif kind is sre.BRANCH:
                states = set().union(*[walk(states, branch) for branch in value[1]])
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, body = value
                if (low, high) == (0, 1):
                    states = states | walk(states, body)
                elif low == 0:
                    states = cut(states)
                else:
                    for _ in range(min(low, 4)):
                        states = walk(states, body)
                    states = states if low == high <= 4 else cut(states)
            elif kind is not sre.AT:
                states = cut(states)
            states = within(states)
        return states

    sets = {grams for grams, _ in walk({(frozenset(), "")}, parser.parse(pattern))}
    least = [s for s in sets if not any(other < s for other in sets)]
    return None if frozenset() in least else sorted(least, key=sorted)


class Segment:
    """An index of the query trigrams over the texts of one batch."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, trigrams: list[str]):
        self.postings: dict[str, np.ndarray] = {}
        if len(flat) < 3 or not trigrams:
            return
        low = LOWER[flat].astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        wanted = np.array([int.from_bytes(t.encode(), "big") for t in trigrams], np.uint32)
        table = np.zeros(1 << 24, bool)
        table[wanted] = True
        at = np.flatnonzero(table[codes])
        texts = np.searchsorted(bounds, at, side="right") - 1
        whole = at + 3 <= bounds[texts + 1]
        at, texts = at[whole], texts[whole]
        codes = codes[at]
        for trigram, code in zip(trigrams, wanted):
            self.postings[trigram] = np.unique(texts[codes == code])

    def candidates(self, query: list[frozenset[str]]) -> np.ndarray:
        none = np.zeros(0, np.int64)
        found = [
            reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True),
                   sorted((self.postings.get(t, none) for t in grams), key=len))
            for grams in query
        ]
        return np.unique(np.concatenate([none, *found]))


def scan_secrets(documents: DataFrame, rules: tuple[Rule, ...] = BASE + FURTHER) -> DataFrame:
    """``documents`` with ``findings``: start, rank and kind of the rule, and end, in that order."""
    prepared(documents.sparkSession)
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries if q for grams in q for t in grams})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.compiled() for r in rules]
        for batch in batches:
            column = batch.column("text")
            flat, bounds = utf8(column)
            segment = Segment(flat, bounds, trigrams)
            texts: dict[int, str] = {}
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for rank, (rule, query, expression) in enumerate(zip(rules, queries, compiled)):
                for k in range(batch.num_rows) if query is None else segment.candidates(query).tolist():
                    if k not in texts:
                        texts[k] = column[k].as_py() or ""
                    for m in expression.finditer(texts[k]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[k].append({"start": m.start(), "rank": rank, "kind": rule.kind, "end": m.end()})
            for row in found:
                row.sort(key=lambda x: (x["start"], x["rank"]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, _FOUND_TYPE)], names=batch.schema.names)

    columns = documents.drop("findings").withColumn("findings", F.expr(f"CAST(NULL AS {_FOUND.split(' ', 1)[1]})"))
    return columns.mapInArrow(run, columns.schema)


def spans(findings, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the findings, comma-joined."""
    some = F.filter(findings, lambda f: f["kind"].isin(*kinds)) if kinds else findings
    return F.array_join(F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def _count(kind: str):
    return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    prepared(spark)
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    base = tuple(r.kind for r in BASE)
    counts = [_count(k).alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(spans(F.col("findings"), base), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"))
