"""Benchmark decontamination with suffix arrays over the training texts.

Documents stay where they are read. Each task gathers them into shards of bounded size and
builds a word suffix array of each shard; every suffix of the benchmark items is then
binary-searched in it, all at once. The range found has all places where the first
words of the test suffix occur verbatim; from each place the match is extended as far as both
texts agree. Words are compared as text before they are numbered, so equal hashes of
different words do no harm. Test suffixes that begin with the same window are searched once,
and a document gets the set of their items, not every pair of an item and a place.

A suffix that does not begin with as many benchmark words as the shortest window has cannot
equal the start of any window, and is left out of the array.

The benchmark goes to the tasks in blocks of bounded size (``BLOCK_CHARS``). If it has more
than one, the documents pass through one search per block, and a table written in the shared
folder between two searches keeps what was found so far.

Defined results: null or empty texts have no words and are never contaminated; a benchmark
row without words has no window; equal items each count; a null item id is the text
``null``; an empty benchmark hits nothing; repeated documents give repeated rows; other
columns of ``documents`` are kept by ``remove_contaminated`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.llm.store import prepared, staged
from reviewloom.llm.text import ALNUM, utf8, word_hashes, words

WINDOW = 13
BLOCK_CHARS = 16_000_000
# Letters of a word that are compared for all words at once; longer words go on one by one.
_LETTERS = 64
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
_MATCH = "struct<item_id: string, item_at: int, doc_at: int, n_words: int>"
_MATCH_TYPE = pa.list_(pa.struct([
    ("item_id", pa.string()), ("item_at", pa.int32()), ("doc_at", pa.int32()), ("n_words", pa.int32())]))
_NO_ITEMS = np.zeros(0, dtype=np.int32)


class TestSuffixes:
    """The suffixes of a block of benchmark items that begin a window, sorted, as compact arrays.

    Suffixes with equal first words are one group with one list of items, so a passage that
    many items share is searched, extended and counted once.
    """

    __test__ = False

    def __init__(self, item_ids: list[str], texts: list[str], window: int):
        flat, bounds = utf8(pa.array(texts, pa.large_string()))
        starts, ends, first = words(flat, bounds, ALNUM)
        spelled = _spelled(flat, starts, ends)
        of = dict(zip(spelled, word_hashes(flat, starts, ends).tolist()))
        ordered = sorted(of, key=lambda word: (of[word], word))
        # Ids from 1; 0 is any other word, and stands after the end of each item too.
        code = {word: k + 1 for k, word in enumerate(ordered)}
        self.vocabulary = np.array([of[word] for word in ordered], dtype=np.uint64)
        self.alike = int(np.unique(self.vocabulary, return_counts=True)[1].max()) if ordered else 0
        self.letters = np.frombuffer(b"".join(ordered), dtype=np.uint8)
        self.letter_ends = np.cumsum([len(word) for word in ordered], dtype=np.int64)
        sizes = np.diff(first)
        self.window = window
        self.item_ids, self.sizes = item_ids, sizes
        self.item_first = np.cumsum(sizes + window) - (sizes + window)
        self.coded = np.zeros(int((sizes + window).sum()) + window, dtype=np.int32)
        shift = np.repeat(np.arange(len(sizes)) * window, sizes)
        self.coded[np.arange(len(spelled)) + shift] = [code[word] for word in spelled]
        n_windows = np.where(sizes >= window, sizes - window + 1, (sizes > 0).astype(np.int64))
        item = np.repeat(np.arange(len(sizes)), n_windows)
        at = np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        place = self.item_first[item] + at
        order = np.argsort(_ranks(self.coded, int(sizes.max(initial=0)) + 1)[place], kind="stable")
        self.item, self.at, self.place = item[order].astype(np.int32), at[order].astype(np.int32), place[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = False
        for k in range(window):
            new[1:] |= self.coded[self.place[1:] + k] != self.coded[self.place[:-1] + k]
        self.group_first = np.flatnonzero(new)
        self.group_end = np.append(self.group_first[1:], len(order)).astype(np.int64)
        heads = self.place[self.group_first]
        self.length = sum(((self.coded[heads + k] > 0).astype(np.int64) for k in range(window)),
                          np.zeros(len(heads), dtype=np.int64))
        self.shortest = int(self.length.min()) if len(heads) else 0
        self._list_items(np.cumsum(new) - 1)
        # The word before all suffixes of a group, if it is the same for all; else 0.
        before = np.where(self.at > 0, self.coded[self.place - 1], 0)
        if len(heads):
            low, high = (f.reduceat(before, self.group_first) for f in (np.minimum, np.maximum))
            before = np.where(low == high, low, 0)
        self.before = before

    def _list_items(self, group: np.ndarray) -> None:
        """The distinct item ids of each group, as places in the sorted list of all ids."""
        self.names = sorted(set(self.item_ids))
        rank = {name: k for k, name in enumerate(self.names)}
        ranks = np.array([rank[name] for name in self.item_ids], dtype=np.int64)
        pairs = np.unique(group * max(1, len(self.names)) + ranks[self.item])
        self.listed = (pairs % max(1, len(self.names))).astype(np.int32)
        self.listed_ends = np.searchsorted(
            pairs // max(1, len(self.names)), np.arange(len(self.group_first)), side="right")

    def heads(self, groups: np.ndarray) -> np.ndarray:
        return self.coded[self.place[self.group_first[groups]][:, None] + np.arange(self.window)]

    def items_of(self, groups: np.ndarray) -> np.ndarray:
        """The distinct items of some groups, in the order of their ids."""
        lists = [self.listed[self.listed_ends[g - 1] if g else 0 : self.listed_ends[g]] for g in groups.tolist()]
        return lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))

    def encode(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids of words; words are compared letter by letter, not only by hash."""
        coded = np.zeros(len(starts), dtype=np.int32)
        if not len(self.vocabulary) or not len(starts):
            return coded
        hashes = word_hashes(flat, starts, ends)
        first = np.searchsorted(self.vocabulary, hashes)
        for step in range(self.alike):
            entry = np.minimum(first + step, len(self.vocabulary) - 1)
            some = np.flatnonzero((self.vocabulary[entry] == hashes) & (coded == 0))
            same = some[self._same(flat, starts[some], ends[some], entry[some])]
            coded[same] = entry[same] + 1
        return coded

    def _same(self, flat, starts, ends, entry) -> np.ndarray:
        theirs = np.where(entry > 0, self.letter_ends[entry - 1], 0)
        sizes = ends - starts
        equal = sizes == self.letter_ends[entry] - theirs
        open_ = np.flatnonzero(equal)
        for k in range(_LETTERS):
            open_ = open_[sizes[open_] > k]
            if not len(open_):
                return equal
            letter = flat[starts[open_] + k]
            letter = np.where((letter >= 65) & (letter <= 90), letter + 32, letter)
            differ = letter != self.letters[theirs[open_] + k]
            equal[open_[differ]] = False
            open_ = open_[~differ]
        for k in open_.tolist():
            own = flat[starts[k] : ends[k]].tobytes().lower()
            equal[k] = own == self.letters[theirs[k] : theirs[k] + sizes[k]].tobytes()
        return equal

    def extend(self, groups: np.ndarray, spread: np.ndarray, places: np.ndarray):
        """Longest match of any suffix of each group from each place, and a suffix that has it.

        The suffixes that agree so far are one range of the sorted list; each further word
        narrows it by binary search.
        """
        low, high = self.group_first[groups].copy(), self.group_end[groups].copy()
        length = self.length[groups].copy()
        growing = np.flatnonzero(length == self.window)
        while len(growing):
            wanted = spread[places[growing] + length[growing]]
            growing, wanted = growing[wanted > 0], wanted[wanted > 0]
            lower, upper = (self._bound(low[growing], high[growing], length[growing], wanted + up) for up in (0, 1))
            more = lower < upper
            growing = growing[more]
            low[growing], high[growing] = lower[more], upper[more]
            length[growing] += 1
        return length, low

    def _bound(self, low, high, depth, wanted) -> np.ndarray:
        """First of the suffixes low..high whose word at ``depth`` is not below ``wanted``."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            less = self.coded[self.place[mid] + depth[open_]] < wanted[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


def _ranks(coded: np.ndarray, depth: int) -> np.ndarray:
    """Places' ranks by at least their first ``depth`` words, by prefix doubling."""
    ranks, step = coded.astype(np.int64), 1
    while step < depth:
        after = np.zeros_like(ranks)
        after[: len(ranks) - step] = ranks[step:]
        ranks = np.unique(ranks * (int(ranks.max(initial=0)) + 1) + after, return_inverse=True)[1] + 0
        step *= 2
    return ranks


def _spelled(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    whole = flat.tobytes()
    return [whole[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]


def suffix_array(coded: np.ndarray, shortest: int, window: int) -> np.ndarray:
    """Starts of the suffixes that begin with ``shortest`` known words, in the order of their
    first ``window`` words. ``coded`` ends with ``window`` zeros."""
    n = len(coded) - window
    unknown = np.concatenate(([0], np.cumsum(coded == 0)))
    at = np.flatnonzero(unknown[shortest : n + shortest] == unknown[:n])
    bits = max(1, int(coded.max()).bit_length()) if n > 0 else 1
    per = max(1, 63 // bits)
    keys = []
    for low in range(0, window, per):
        key = np.zeros(len(at), dtype=np.int64)
        for k in range(low, min(window, low + per)):
            key = (key << bits) | coded[at + k]
        keys.append(key)
    return at[np.lexsort(keys[::-1])]


def search(order: np.ndarray, coded: np.ndarray, suffixes: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each group of test suffixes, the range of the array whose first words equal its first words."""
    window, n = suffixes.window, len(suffixes.length)
    heads = suffixes.heads(np.arange(n))
    within = np.arange(window)[None, :] < suffixes.length[:, None]

    def bound(strict: bool) -> np.ndarray:
        low = np.zeros(n, dtype=np.int64)
        high = np.full(n, len(order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            there = coded[order[mid][:, None] + np.arange(window)]
            differ = (there != heads[open_]) & within[open_]
            k = np.argmax(differ, axis=1)
            rows = np.arange(len(open_))
            some = differ[rows, k]
            less = some & (there[rows, k] < heads[open_][rows, k])
            right = less | (~some if strict else False)
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)

    if not len(order) or not n:
        none = np.zeros(n, dtype=np.int64)
        return none, none
    return bound(False), bound(True)


def matches(flat, bounds, suffixes: TestSuffixes, window: int):
    """Words of each text, its maximal matches (item index, item word, word, words) and its items.

    A place has at most one group of each length, so the work grows with the words of the
    texts, however many items share a passage. A match is given once, with one item that has
    it; the items are places in ``suffixes.names``.
    """
    starts, ends, first = words(flat, bounds, ALNUM)
    counts = np.diff(first)
    found: list[list[tuple]] = [[] for _ in counts]
    items = [_NO_ITEMS] * len(counts)
    if not len(suffixes.length) or not len(starts):
        return counts, found, items
    coded = suffixes.encode(flat, starts, ends)
    # Unknown words between the texts, so that no match goes over the end of one.
    gap = window
    shift = np.repeat(np.arange(len(counts)) * gap, counts)
    spread = np.zeros(len(coded) + gap * len(counts) + window, dtype=np.int32)
    spread[np.arange(len(coded)) + shift] = coded
    text_first = first[:-1] + np.arange(len(counts)) * gap
    order = suffix_array(spread, suffixes.shortest, window)
    low, high = search(order, spread, suffixes)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return counts, found, items
    sizes = (high - low)[hit]
    groups = np.repeat(hit, sizes)
    ranges = np.repeat(low[hit] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    places = order[ranges]
    by_place = np.argsort(places, kind="stable")
    groups, places = groups[by_place], places[by_place]
    texts = np.searchsorted(text_first, places, side="right") - 1
    cuts = np.flatnonzero(np.diff(texts, prepend=-1, append=len(counts)))
    known: dict[bytes, np.ndarray] = {}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = np.unique(groups[a:b])
        key = own.tobytes()
        if key not in known:
            known[key] = suffixes.items_of(own)
        items[int(texts[a])] = known[key]
    # A match that all suffixes of a group continue to the left is part of a longer one.
    previous = np.where(places > 0, spread[places - 1], 0)
    starting = (previous == 0) | (previous != suffixes.before[groups])
    groups, places, texts = groups[starting], places[starting], texts[starting]
    length, suffix = suffixes.extend(groups, spread, places)
    columns = (texts, suffixes.item[suffix], suffixes.at[suffix], places - text_first[texts], length)
    for text, item, at, to, size in zip(*(column.tolist() for column in columns)):
        found[text].append((item, at, to, size))
    return counts, found, items


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark in pieces of about ``block_chars`` characters; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.coalesce("text", F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if size >= block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_matches(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """All columns of ``documents`` with ``n_words``, ``matches`` and ``items``.

    ``matches`` are verbatim matches of at least a window (or a whole shorter item): item id,
    place in the item, place in the document and length, counted in words. From each place
    where one begins the longest is given, with one item that has it; together they cover
    every hit word. ``items`` are the distinct ids of all items with occurring windows, sorted.
    """
    spark = prepared(documents.sparkSession)
    found = documents.withColumns({
        "n_words": F.lit(None).cast("bigint"), "matches": F.array().cast(f"array<{_MATCH}>"),
        "items": F.array().cast("array<string>")})
    schema = found.schema
    blocks = 0
    for ids, texts in _blocks(benchmark, block_chars):
        found = staged(found, "matches") if blocks else found
        shared = spark.sparkContext.broadcast(TestSuffixes(ids, texts, window))
        found = found.mapInArrow(_searcher(shared, window), schema)
        blocks += 1
    if not blocks:
        shared = spark.sparkContext.broadcast(TestSuffixes([], [], window))
        found = found.mapInArrow(_searcher(shared, window), schema)
    return found


def _searcher(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= 6 * SHARD_WORDS:
                yield from _search_shard(held, shared.value, window)
                held, size = [], 0
        if held:
            yield from _search_shard(held, shared.value, window)

    return run


def _search_shard(batches: list[pa.RecordBatch], suffixes: TestSuffixes, window: int):
    table = pa.Table.from_batches(batches)
    flat, bounds = utf8(table.column("text"))
    counts, found, items = matches(flat, bounds, suffixes, window)
    earlier = table.column("matches").combine_chunks()
    rows = [[{"item_id": suffixes.item_ids[i], "item_at": a, "doc_at": d, "n_words": n} for i, a, d, n in own]
            for own in found]
    names = pa.array(suffixes.names, pa.string())
    ends = np.cumsum([0, *map(len, items)], dtype=np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate([_NO_ITEMS, *items]))))
    if len(earlier.flatten()):
        rows = [a + b for a, b in zip(earlier.to_pylist(), rows)]
        both = zip(table.column("items").to_pylist(), listed.to_pylist())
        listed = pa.array([sorted({*a, *b}) for a, b in both], pa.list_(pa.string()))
    new = {"n_words": pa.array(counts, pa.int64()), "matches": pa.array(rows, _MATCH_TYPE), "items": listed}
    for name, column in new.items():
        table = table.set_column(table.schema.get_field_index(name), name, column)
    yield from table.combine_chunks().to_batches()


def with_verdict(found: DataFrame, per_hit: int = 20) -> DataFrame:
    """``n_hit``, ``n_items``, ``items_sha256``, ``longest`` and ``contaminated`` from the matches.

    A document is contaminated if a word in ``per_hit`` or more lies in a match.
    """
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(
        m["doc_at"].cast("bigint").alias("a"), (m["doc_at"] + m["n_words"]).cast("bigint").alias("b"))))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    covered = F.aggregate(ordered, none, lambda s, m: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("bigint"), m["b"] - F.greatest(m["a"], s["to"]))).alias("n"),
        F.greatest(s["to"], m["b"]).alias("to")))["n"]
    return found.withColumns({
        "n_hit": covered,
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
        "longest": F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)),
    }).withColumns({
        "contaminated": (F.col("n_hit") > 0) & (F.lit(per_hit) * F.col("n_hit") >= F.col("n_words")),
    }).drop("items")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    own = [F.col(f"doc.`{c}`") for c in documents.columns]
    packed = documents.select(F.col("text"), F.struct(*[F.col(c) for c in documents.columns]).alias("doc"))
    kept = with_verdict(find_matches(packed, benchmark)).where(~F.col("contaminated"))
    return kept.select(*own)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document is covered by benchmark passages."""
    prepared(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_matches(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return with_verdict(found.drop("text")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), sizes WHERE p + n - 1 <= len(w)
), hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
covered AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
), chained AS (
  SELECT h.doc_id, h.item_id, q, h.p, h.n FROM hit h
  JOIN (SELECT item_id, n, g, i AS q FROM (SELECT item_id, least(13, len(w)) AS n, i,
      array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0))) s
    ON h.item_id = s.item_id AND h.n = s.n
  JOIN dw ON dw.doc_id = h.doc_id AND dw.p = h.p AND dw.n = h.n AND dw.g = s.g
), longest AS (
  SELECT doc_id, CAST(max(size) AS INTEGER) AS longest FROM (
    SELECT doc_id, item_id, max(p + n) - min(p) AS size FROM (
      SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run
      FROM (SELECT DISTINCT * FROM chained)) GROUP BY doc_id, item_id, p - q, run) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(longest, 0) AS longest
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
