"""Katz backoff language model: bigrams over Good-Turing discounted counts.

``P(w | h) = d(c) c(h, w) / c(h)`` for pairs seen in training, else ``alpha(h) P(w)``, with
``alpha(h) = (1 - sum of the seen) / (1 - sum of P(w) over the seen)``; ``P(w)`` backs off in
the same way to one class of all unknown words. Counts up to ``CUT`` get Good-Turing
discounts from the global counts of counts, larger ones lose a fixed ``LARGE``, so that every
context leaves some mass. All sums are over all training tokens.

The work is laid out so that no table of all words is ever in one place:

1. A first pass lists frequent words (a bounded list; it only says how later data is coded
   and split, never what is counted).
2. Tasks turn their documents into tokens and deal every token, with its context and
   document, to the partition of its word. Each partition thus holds the whole counts of its
   words and pairs. A word that alone would fill a partition is dealt by its contexts too.
   The partitioned pairs are the model's table; both following passes read the same one.
3. Counts of counts are added up; they and the totals are all that the driver sees.
4. Each partition scores its tokens and adds up, for its documents, what does not depend on
   the backoff weight. It sends the mass and coverage of each context, and the contexts of
   tokens not seen after them, to the partition of the context.
5. There the backoff weights are formed and applied, and the sums return to the documents.

Words and contexts are compared by 64- and 56-bit hashes.

Defined results: null texts count as empty and have only the end token; without training
documents every token has the probability 1 of the unknown class; repeated rows are scored
and counted each; a null ``doc_id`` is in training.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.llm.store import prepared, staged
from reviewloom.llm.text import SPACED, mix, utf8, word_hashes, words

FOLDS, HELD = 7, 2
CUT, LARGE = 5, 0.1
COMMON = 1 << 16
_GROUP_TOKENS = 2_500_000
_END, _BEGIN = (mix(np.array([k], np.uint64))[0] for k in (0x656E64, 0x626567))
_CONTEXT = np.uint64((1 << 56) - 1)


def is_held(doc_id: int | None, folds: int, held: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of the token before each, and the number of tokens of each text."""
    flat, bounds = utf8(column)
    starts, ends, first = words(flat, bounds, SPACED)
    counts = np.diff(first) + 1
    of = np.repeat(np.arange(len(counts)), counts - 1)
    out = np.full(int(counts.sum()), _END, dtype=np.uint64)
    out[np.arange(len(starts)) + of] = word_hashes(flat, starts, ends)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.cumsum(counts) - counts] = _BEGIN
    return out, before, counts


def common_words(documents: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of up to ``most`` frequent tokens, in order of hash, and about how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            top = np.argsort(-times, kind="stable")[:most]
            return pa.RecordBatch.from_arrays(
                [pa.array(found[top].view(np.int64)), pa.array(times[top])], names=["word", "n"])

        for batch in batches:
            out, _, _ = tokens(batch.column("text"))
            held.append(out)
            size += len(out)
            if size >= _GROUP_TOKENS:
                yield frequent()
                held, size = [], 0
        if size:
            yield frequent()

    counts = staged(documents.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most 8 * most words can be as frequent as this, however many there are in all.
    rows = counts.where(F.col("n") * F.lit(8 * most) >= F.lit(total)).orderBy(F.desc("n"), "word").limit(most).collect()
    found = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    found = np.append(found, _BEGIN)[: max(1, len(found) + 1)]
    times = np.array([r["n"] for r in rows] + [0], dtype=np.int64)
    order = np.argsort(found)
    return found[order], times[order]


class Plan:
    """How tokens are dealt: number of partitions, coded contexts, words split by context."""

    def __init__(self, parts: int, found: np.ndarray, times: np.ndarray):
        self.parts = parts
        keep = np.argsort(-times, kind="stable")[: COMMON - 1]
        keep = np.union1d(keep, np.flatnonzero(found == _BEGIN))
        self.common = found[np.sort(keep)]
        share = times / max(1, times.sum())
        heavy = share * parts * 4 > 1
        self.heavy = found[heavy]
        self.slices = np.minimum(parts, np.ceil(share[heavy] * parts * 4)).astype(np.uint64)

    def part(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        at = (word >> np.uint64(20)) % np.uint64(self.parts)
        if len(self.heavy):
            place = np.minimum(np.searchsorted(self.heavy, word), len(self.heavy) - 1)
            split = self.heavy[place] == word
            at[split] += mix(context[split]) % self.slices[place[split]]
        return (at % np.uint64(self.parts)).astype(np.int64)


def _dealt(plan: Plan, group: int, ids: list, word, before, counts, folds: int, held_fold: int):
    """One record per partition: the group's tokens of that partition, by word."""
    held = np.array([is_held(d, folds, held_fold) for d in ids], dtype=bool)
    doc = np.repeat(np.arange(len(ids)), counts).astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)
    part = plan.part(word, before & _CONTEXT)
    order = np.lexsort((word, part))
    word, before, doc, part = word[order], before[order], doc[order], part[order]
    place = np.minimum(np.searchsorted(plan.common, before), len(plan.common) - 1)
    coded = plan.common[place] == before
    cuts = np.searchsorted(part, np.arange(plan.parts + 1))
    flags = np.packbits(held)
    for p in range(plan.parts):
        a, b = cuts[p], cuts[p + 1]
        if a == b:
            continue
        w, c = word[a:b], coded[a:b]
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        run = np.diff(np.append(new, b - a)).astype(np.uint32)
        of_common = np.add.reduceat(c, new, dtype=np.uint32)
        raw = (before[a:b][~c] & _CONTEXT).view(np.uint8).reshape(-1, 8)[:, :7]
        yield p, ("tokens", group, len(ids), flags, w[new], run, of_common,
                  place[a:b][c].astype(np.uint16), doc[a:b][c], np.ascontiguousarray(raw), doc[a:b][~c])
    yield _part_of(group, plan.parts), ("ids", group, ids, held, counts)


def _part_of(group: int, parts: int) -> int:
    """Partition of a group of documents, mixed so that any number of partitions gets an even share."""
    return int(mix(np.array([group], dtype=np.uint64))[0] % np.uint64(parts))


def _opened(plan: Plan, records: list):
    """All tokens of a partition: word index, context, document, and whether it is held out."""
    words_, contexts, docs, held = [], [], [], []
    groups, at = [], 0
    for _, group, n, flags, w, run, of_common, code, doc_c, raw, doc_r in records:
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :7] = raw
        for times, context, doc in (
            (of_common, plan.common[code] & _CONTEXT, doc_c), (run - of_common, wide.view(np.uint64).reshape(-1), doc_r),
        ):
            words_.append(np.repeat(w, times))
            contexts.append(context)
            docs.append(doc.astype(np.int64) + at)
        held.append(np.unpackbits(flags, count=n).astype(bool))
        groups.append((group, at, n))
        at += n
    doc, held = np.concatenate(docs), np.concatenate(held)
    vocabulary, word = np.unique(np.concatenate(words_), return_inverse=True)
    context = np.concatenate(contexts)
    learns = ~held[doc]
    pair_key, first, pair = np.unique(mix(vocabulary[word] + mix(context)), return_index=True, return_inverse=True)
    return {
        "vocabulary": vocabulary, "word": word, "doc": doc, "learns": learns, "pair": pair, "context": context,
        "pair_word": word[first], "pair_context": context[first], "groups": groups, "n_docs": at,
        "c1": np.bincount(word[learns], minlength=len(vocabulary)),
        "c2": np.bincount(pair[learns], minlength=len(pair_key)),
    }


def _split(records) -> tuple[list, list]:
    found, ids = [], []
    for _, record in records:
        (found if record[0] == "tokens" else ids).append(record)
    return found, ids


def _counted(plan: Plan):
    def run(records) -> Iterator[tuple]:
        found, ids = _split(records)
        sums = defaultdict(int)
        for _, _, _, held, _ in ids:
            sums["documents", 0] += int((~held).sum())
        if found:
            t = _opened(plan, found)
            whole = ~np.isin(t["vocabulary"], plan.heavy)
            for name, counts in (("words", t["c1"][whole]), ("pairs", t["c2"])):
                for r, n in enumerate(np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 2)[1 : CUT + 2], 1):
                    sums[name, r] += int(n)
            sums["vocabulary", 0] += int((t["c1"][whole] > 0).sum())
            sums["tokens", 0] += int(t["learns"].sum())
            for w, n in zip(t["vocabulary"][~whole].tolist(), t["c1"][~whole].tolist()):
                sums["heavy", w] += n
        yield from sums.items()

    return run


def discounts(counts: list[int]) -> np.ndarray:
    """Discounted counts ``r*`` of ``r = 0 .. CUT`` from the numbers of types seen 1 .. CUT + 1 times.

    Where the Good-Turing estimates do not lie between 0 and ``r``, half a count is taken off.
    """
    r = np.arange(1, CUT + 1)
    n = np.array(counts, dtype=np.float64)
    if (n > 0).all():
        tail = (CUT + 1) * n[CUT] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - tail) / (1 - tail) if tail < 1 else np.zeros(CUT)
        if ((d > 0) & (d < 1)).all():
            return np.append(0.0, d * r)
    return np.append(0.0, r - 0.5)


def _starred(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(counts <= CUT, table[np.minimum(counts, CUT)], counts - LARGE)


class Totals:
    """What the whole corpus says: totals, discounts and the mass of unknown words."""

    def __init__(self, sums: dict):
        heavy = {w: n for (name, w), n in sums.items() if name == "heavy"}
        words_seen = [sums.get(("words", r), 0) + sum(n == r for n in heavy.values()) for r in range(1, CUT + 2)]
        self.documents, self.tokens = sums.get(("documents", 0), 0), sums.get(("tokens", 0), 0)
        self.vocabulary = sums.get(("vocabulary", 0), 0) + sum(n > 0 for n in heavy.values())
        self.heavy = np.array(sorted(heavy), dtype=np.uint64)
        self.heavy_counts = np.array([heavy[w] for w in sorted(heavy)], dtype=np.int64)
        self.word_stars = discounts(words_seen)
        self.pair_stars = discounts([sums.get(("pairs", r), 0) for r in range(1, CUT + 2)])
        small = sum((r - self.word_stars[r]) * words_seen[r - 1] for r in range(1, CUT + 1))
        large = (self.vocabulary - sum(words_seen[:CUT])) * LARGE
        self.unknown = (small + large) / self.tokens if self.tokens else 1.0

    def chances(self, c1: np.ndarray) -> np.ndarray:
        return np.where(c1 > 0, _starred(c1, self.word_stars) / max(1, self.tokens), self.unknown)


def _scored(plan: Plan, totals: Totals):
    def run(records) -> Iterator[tuple]:
        found, ids = _split(records)
        for record in ids:
            yield _part_of(record[1], plan.parts), record
        if not found:
            return
        t = _opened(plan, found)
        c1, c2 = t["c1"].copy(), t["c2"]
        if len(totals.heavy):
            place = np.minimum(np.searchsorted(totals.heavy, t["vocabulary"]), len(totals.heavy) - 1)
            spread = totals.heavy[place] == t["vocabulary"]
            c1[spread] = totals.heavy_counts[place[spread]]
        chance = totals.chances(c1)
        seen = c2 > 0
        star = _starred(c2, totals.pair_stars)
        value = np.log10(np.where(seen, np.maximum(star, 1e-300), chance[t["pair_word"]]))
        # Every word is the context of the token after it; its count divides that one's chance.
        follows = np.where((c1 > 0) & (t["vocabulary"] != _END), np.log10(np.maximum(c1, 1)), 0.0)
        base = np.log10((c1 + 1) / (totals.tokens + totals.vocabulary + 1))
        sums = [
            np.bincount(t["doc"], weights=x, minlength=t["n_docs"])
            for x in (base[t["word"]], value[t["pair"]] - follows[t["word"]], (c1 > 0)[t["word"]])
        ]
        for group, at, n in t["groups"]:
            yield _part_of(group, plan.parts), ("sums", group, *[x[at : at + n] for x in sums[:2]], sums[2][at : at + n].astype(np.uint32))
        some, of = np.unique(t["pair_context"][seen], return_inverse=True)
        left = np.bincount(of, weights=(c2 - star)[seen], minlength=len(some))
        covered = np.bincount(of, weights=chance[t["pair_word"]][seen], minlength=len(some))
        unseen = np.flatnonzero(~seen[t["pair"]])
        context, doc = t["context"][unseen], t["doc"][unseen].astype(np.uint32)
        to, open_to = some % np.uint64(plan.parts), context % np.uint64(plan.parts)
        order, open_order = np.argsort(to, kind="stable"), np.argsort(open_to, kind="stable")
        cuts, open_cuts = (np.searchsorted(x, np.arange(plan.parts + 1)) for x in (to[order], open_to[open_order]))
        for q in range(plan.parts):
            own, open_own = order[cuts[q] : cuts[q + 1]], open_order[open_cuts[q] : open_cuts[q + 1]]
            if len(own):
                yield q, ("contexts", some[own], left[own], covered[own])
            if len(open_own):
                yield q, ("open", t["groups"], context[open_own], doc[open_own])

    return run


def _weighted(parts: int):
    """Backoff weights of the contexts of a partition, added to the documents that need them."""

    def run(records) -> Iterator[tuple]:
        contexts, opened, added = [], [], {}
        for _, record in records:
            if record[0] == "contexts":
                contexts.append(record[1:])
            elif record[0] == "open":
                opened.append(record[1:])
            elif record[0] == "sums":
                earlier = added.get(record[1])
                added[record[1]] = [a + b for a, b in zip(earlier, record[2:])] if earlier else list(record[2:])
            else:
                yield _part_of(record[1], parts), record
        for group, sums in added.items():
            yield _part_of(group, parts), ("sums", group, *sums)
        if not contexts or not opened:
            return
        context, of = np.unique(np.concatenate([c[0] for c in contexts]), return_inverse=True)
        left, covered = (
            np.bincount(of, weights=np.concatenate([c[k] for c in contexts]), minlength=len(context)) for k in (1, 2))
        weight = np.log10(left / np.maximum(1 - covered, 1e-12))
        gains: dict[int, np.ndarray] = {}
        for groups, wanted, doc in opened:
            place = np.minimum(np.searchsorted(context, wanted), len(context) - 1)
            value = np.where(context[place] == wanted, weight[place], 0.0)
            per = np.bincount(doc, weights=value, minlength=groups[-1][1] + groups[-1][2])
            for group, at, n in groups:
                if per[at : at + n].any():
                    gains[group] = gains.get(group, 0.0) + per[at : at + n]
        for group, value in gains.items():
            some = np.flatnonzero(value)
            yield _part_of(group, parts), ("gains", group, some.astype(np.uint32), value[some])

    return run


def _finished(totals: Totals):
    def run(records) -> Iterator[tuple]:
        ids, sums, gains = {}, {}, defaultdict(list)
        for _, record in records:
            if record[0] == "ids":
                ids[record[1]] = record[2:]
            elif record[0] == "sums":
                sums[record[1]] = record[2:]
            else:
                gains[record[1]].append(record[2:])
        for group, (doc_ids, held, counts) in ids.items():
            base, score, known = sums[group]
            score = score - (np.log10(totals.documents) if totals.documents else 0.0)
            for some, value in gains.get(group, ()):
                score[some] += value
            for row in zip(doc_ids, held.tolist(), counts.tolist(), known.tolist(), base.tolist(), score.tolist()):
                yield (*row[:4], totals.tokens, *row[4:])

    return run


def katz_scores(documents: DataFrame, folds: int = FOLDS, held_fold: int = HELD, parts: int | None = None) -> DataFrame:
    """Log10 probabilities of every text under the model of the texts outside the held-out fold."""
    spark = prepared(documents.sparkSession, 500)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("bigint"), "text")
    plan = Plan(parts, *common_words(texts, COMMON))
    shared = spark.sparkContext.broadcast(plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        from pyspark import TaskContext

        def flush():
            word, before, counts = (np.concatenate(x) for x in held)
            for p, record in _dealt(shared.value, group, ids, word, before, counts, folds, held_fold):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([pickle.dumps(record, 5)], pa.binary())], names=["part", "record"])

        group = TaskContext.get().partitionId() << 24
        held, ids = ([], [], []), []
        for batch in batches:
            if not batch.num_rows:
                continue
            for pile, x in zip(held, tokens(batch.column("text"))):
                pile.append(x)
            ids += batch.column("doc_id").to_pylist()
            if sum(map(len, held[0])) >= _GROUP_TOKENS:
                yield from flush()
                held, ids, group = ([], [], []), [], group + 1
        if ids:
            yield from flush()

    def opened(rows):
        import pickle

        for row in rows:
            yield row[0], pickle.loads(row[1])

    # Both passes below read one shuffle; its files are the partitioned pair table.
    table = texts.mapInArrow(deal, "part bigint, record binary").rdd.map(tuple).partitionBy(parts, int)
    sums = table.mapPartitions(lambda rows: _counted(shared.value)(opened(rows))).reduceByKey(
        lambda a, b: a + b, parts).collectAsMap()
    totals = Totals(sums)
    known = spark.sparkContext.broadcast(totals)
    rows = (
        table.mapPartitions(lambda rows: _scored(shared.value, known.value)(opened(rows))).partitionBy(parts, int)
        .mapPartitions(_weighted(parts)).partitionBy(parts, int).mapPartitions(_finished(totals))
    )
    return spark.createDataFrame(
        rows, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double", verifySchema=False)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document."""
    prepared(spark)
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
