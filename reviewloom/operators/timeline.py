"""Issues over the whole history of a repository: renamed files, and what was open after each round.

Rounds are numbered per repository. What a round does to a file is one event: its issues are
dropped, or they move to another name. Each issue needs the next event of its file, found by
a sweep over bounded ranges of rounds, so neither a hot repository nor a hot file is gathered
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.merge import with_issue_key
from reviewloom.operators.ranking import carried_forward, keep_first, numbered, up_to
from reviewloom.session import staged

# Rounds of one repository that are swept together, and the halving steps that find one of them.
_ROUNDS = 4096
_STEPS = 13


def numbered_rounds(rounds: DataFrame, changes: DataFrame) -> DataFrame:
    """``repo_id, review_id, mode, round_no`` (from 1) and whether the round ``counts``.

    An incremental round counts only if it has changes; else its issues are not taken up.
    """
    changed = changes.select("review_id").distinct().withColumn("has_changes", F.lit(True))
    order = _ordered(rounds)
    return order.join(changed, "review_id", "left").select(
        "repo_id", "review_id", "mode", "round_no",
        ((F.col("mode") == "full") | F.col("has_changes").isNotNull()).alias("counts"))


def _ordered(rounds: DataFrame) -> DataFrame:
    return numbered(
        rounds.select("repo_id", "review_id", "created_at", "mode"), ["repo_id"], ["created_at", "review_id"],
        F.to_date("created_at"), "round_no")


def file_events(numbers: DataFrame, changes: DataFrame) -> DataFrame:
    """``repo_id, round_no, file, moved_to``: what incremental rounds do to the issues of a file.

    Without ``moved_to`` they are dropped. A rename wins over other changes of the same path;
    of several renames of one path the last name counts.
    """
    old = F.coalesce("previous_filename", "filename")
    moved = F.when((F.col("status") == "renamed") & F.col("previous_filename").isNotNull(), F.col("filename"))
    none = F.lit(None).cast("string")
    effects = F.array_compact(F.array(
        F.when(F.col("status") == "removed", F.struct(F.col("filename").alias("file"), none.alias("moved_to"))),
        F.when(F.col("status") != "added", F.struct(old.alias("file"), moved.alias("moved_to"))),
    ))
    rounds = numbers.where(F.col("mode") == "incremental").select("review_id", "repo_id", "round_no")
    return (
        changes.select("review_id", F.explode(effects).alias("e")).join(rounds, "review_id")
        .groupBy("repo_id", "round_no", F.col("e.file").alias("file"))
        .agg(F.max("e.moved_to").alias("moved_to"))
    )


def _swept(points: DataFrame, keys: list[str], events: DataFrame, value: Column, into: str) -> DataFrame:
    """The distinct ``keys, round_no`` of ``points`` with the ``value`` of the first event after them, else null."""
    # Backwards in time; a point comes before the events of its own round.
    back = (-F.col("round_no")).alias("back")
    marks = events.select(*keys, back, F.lit(1).alias("kind"), value.alias("value"))
    asked = points.select(*keys, "round_no").distinct().select(*keys, back, F.lit(0).alias("kind"))
    both = marks.unionByName(asked, allowMissingColumns=True)
    reach = F.floor(F.col("back") / F.lit(_ROUNDS))
    # Written once, as both passes of the sweep read it.
    swept = carried_forward(staged(both, "sweep"), keys, ["back", "kind"], reach, "value", into)
    return swept.where(F.col("kind") == 0).select(*keys, (-F.col("back")).alias("round_no"), into)


def _next(points: DataFrame, keys: list[str], events: DataFrame, value: Column, into: str) -> DataFrame:
    """``points`` with the ``value`` of the first event of their keys after ``round_no``, else null."""
    return points.join(_swept(points, keys, events, value, into), [*keys, "round_no"], "left")


def _with_next_touch(placed: DataFrame, events: DataFrame) -> DataFrame:
    """``placed`` with the ``next_touch``: the first round after ``round_no`` with an event of the same file, else null.

    The rounds of a file's events are lists of one range each, so the issues are moved once, to
    the list of their range; it ends with the first event of the ranges after it.
    """
    keys = ["repo_id", "file"]
    reach = F.floor(F.col("round_no") / F.lit(_ROUNDS)).alias("reach")
    no_round = F.lit(None).cast("bigint").alias("round_no")
    marks = events.select(*keys, reach, "round_no").unionByName(placed.select(*keys, reach, no_round))
    lists = marks.where(F.col("file").isNotNull()).groupBy(*keys, "reach").agg(
        F.sort_array(F.collect_set("round_no")).alias("__touches"))
    later = Window.partitionBy(*keys).orderBy("reach").rowsBetween(1, Window.unboundedFollowing)
    lists = lists.withColumn("__later", F.min(F.get("__touches", F.lit(0))).over(later))
    found = placed.withColumn("reach", reach).join(lists, [*keys, "reach"], "left")
    touch = F.coalesce(F.get("__touches", up_to("__touches", F.col("round_no"), _STEPS)), F.col("__later"))
    return found.withColumn("next_touch", touch).drop("reach", "__touches", "__later")


def rename_ends(events: DataFrame) -> DataFrame:
    """For each renaming event where the issues it moves end up.

    ``end.file`` is the last name, ``end.dropped`` the round that dropped the issues, null
    while they are open. Renames that follow each other are links ``(round, old name) ->
    (later round, next old name)``; rounds only rise, so links form no cycle even if names
    do. Every pass joins the links with themselves and halves the length of all chains.
    """
    moves = events.where(F.col("moved_to").isNotNull())
    points = moves.select("repo_id", F.col("round_no"), F.col("file").alias("old"), F.col("moved_to").alias("file"))
    event = F.struct("round_no", "moved_to")
    linked = _next(points, ["repo_id", "file"], events, event, "next")
    follows = F.col("next.moved_to").isNotNull()
    links = linked.select(
        "repo_id", "round_no", F.col("old").alias("file"),
        F.when(follows, F.struct(F.col("next.round_no").alias("round_no"), F.col("file"))).alias("link"),
        F.when(~follows | F.col("next").isNull(),
               F.struct(F.col("file"), F.col("next.round_no").alias("dropped"))).alias("end"))
    while True:
        links = staged(links, "renames")
        if links.where(F.col("link").isNotNull()).isEmpty():
            return links.drop("link")
        done = links.where(F.col("link").isNull())
        ahead = links.select(
            "repo_id", F.struct("round_no", "file").alias("link"), F.col("link").alias("later"), F.col("end").alias("its_end"))
        open_ = links.where(F.col("link").isNotNull()).drop("end").join(ahead, ["repo_id", "link"])
        links = done.unionByName(open_.select(
            "repo_id", "round_no", "file", F.col("later").alias("link"), F.col("its_end").alias("end")))


def _last_full(numbers: DataFrame) -> DataFrame:
    full, incremental = F.col("mode") == "full", F.col("mode") == "incremental"
    return numbers.groupBy("repo_id").agg(
        F.max(F.when(full, F.col("round_no"))).alias("last_full"),
        F.max(F.when(incremental & F.col("counts"), F.col("round_no"))).alias("last_changed"))


def open_issues_with_renames(rounds: DataFrame, issues: DataFrame, changes: DataFrame) -> DataFrame:
    """Issues open after the latest round of every repository; renames carry them to the new name.

    Equal to merging round by round with ``carry_renames``: ``file`` is the present name, and
    issues that became equal collapse to the first by round and ``seq``.
    """
    numbers = numbered_rounds(rounds, changes)
    facts = _last_full(numbers)
    started = F.coalesce("last_full", F.lit(0).cast("bigint"))
    current = staged(
        numbers.join(facts, "repo_id").where(F.col("round_no") >= started)
        .withColumn("dedup", F.coalesce(F.col("last_changed") > started, F.lit(False))), "rounds")
    events = staged(file_events(current, changes), "events")
    ends = rename_ends(events).select("repo_id", F.struct("round_no", "file").alias("move"), "end")
    born = current.where("counts").select("review_id", "repo_id", "round_no", "dedup")
    placed = issues.drop("repo_id").join(born, "review_id")
    # What becomes of a file's issues of a round, before the issues themselves are moved.
    seen = _swept(placed, ["repo_id", "file"], events, F.struct("round_no", "file", "moved_to"), "next")
    seen = seen.where(F.col("next").isNull() | F.col("next.moved_to").isNotNull())
    moved = F.when(F.col("next").isNotNull(), F.struct(F.col("next.round_no"), F.col("next.file")))
    traced = seen.withColumn("move", moved).join(ends, ["repo_id", "move"], "left")
    fates = traced.where(F.col("next").isNull() | F.col("end.dropped").isNull()).select(
        "repo_id", "round_no", "file", F.col("end.file").alias("end_file"))
    # Issues without a file meet no event and stay.
    nameless = placed.where(F.col("file").isNull()).withColumn("end_file", F.col("file"))
    alive = placed.join(fates, ["repo_id", "file", "round_no"]).unionByName(nameless).withColumn(
        "file", F.coalesce("end_file", "file"))
    own = F.concat_ws("#", F.lit(""), F.col("review_id"), F.col("seq"), F.monotonically_increasing_id())
    keyed = with_issue_key(alive).withColumn("issue_key", F.when(F.col("dedup"), F.col("issue_key")).otherwise(own))
    kept = keep_first(keyed, ["repo_id", "issue_key"], [F.col("round_no"), F.col("seq")])
    return kept.select("repo_id", *[F.col(c) for c in issues.columns if c != "repo_id"])


def issue_intervals(rounds: DataFrame, issues: DataFrame, changes: DataFrame) -> DataFrame:
    """``opened`` and ``closed`` round of every issue that was ever open; ``closed`` is null while it is.

    An issue is open after the rounds from ``opened`` up to the one before ``closed``. It
    closes with the next touch of its file, the next full round or, if an equal issue came
    first in the same full round, with the next round that merges.
    """
    # Written once: which reviews have changes, and which files they touch.
    effects = F.array_compact(F.array(
        F.when(F.col("status") == "removed", F.col("filename")),
        F.when(F.col("status") != "added", F.coalesce("previous_filename", "filename"))))
    paths = staged(changes.select("review_id", F.explode_outer(F.array_distinct(effects)).alias("file")), "paths")
    numbers = staged(numbered_rounds(rounds, paths), "rounds")
    incremental = numbers.where(F.col("mode") == "incremental").select("review_id", "repo_id", "round_no")
    events = paths.where(F.col("file").isNotNull()).join(incremental, "review_id").drop("review_id")
    merging = numbers.where((F.col("mode") == "incremental") & F.col("counts"))
    born = numbers.where("counts").select("review_id", "repo_id", "round_no", "mode")
    born = _next(born, ["repo_id"], numbers.where(F.col("mode") == "full"), F.col("round_no"), "next_full")
    born = _next(born, ["repo_id"], merging, F.col("round_no"), "next_merge").withColumn(
        "full", F.col("mode") == "full").drop("mode")
    parts = [c for c in ("line", "category", "message", "rule_id") if c in issues.columns]
    placed = staged(issues.select("review_id", "seq", "file", "severity", *parts).join(born, "review_id"), "placed")
    touched = _with_next_touch(placed, events).withColumn("end", F.least("next_full", "next_touch"))
    ends = with_issue_key(staged(touched.drop("next_full", "next_touch"), "ends")).drop(*parts)
    ends = ends.where(F.col("repo_id").isNotNull() & F.col("issue_key").isNotNull())
    # Equal issues that end together were open together, so only the first of them counts.
    same = ["repo_id", "issue_key", "end"]
    order = F.struct("round_no", "seq")
    first = staged(
        ends.groupBy(*same).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
            *[F.col(c).alias(f"first_{c}") for c in same], "first"), "first")
    marked = ends.join(first, (
        (F.col("repo_id") == F.col("first_repo_id")) & (F.col("issue_key") == F.col("first_issue_key"))
        & F.col("end").eqNullSafe(F.col("first_end"))), "left")
    later = F.coalesce(F.col("first") < order, F.lit(False))
    return (
        marked.withColumn("closed", F.when(later, F.least("end", "next_merge")).otherwise(F.col("end")))
        # A repeat of an open issue in a merging round is dropped at once.
        .where(~later | F.col("full"))
        .select("repo_id", "review_id", "seq", "file", "severity", F.col("round_no").alias("opened"), "closed")
    )


def running_sum(table: DataFrame, keys: list[str], order: str, value: str, into: str) -> DataFrame:
    """Sum of ``value`` up to each row by the whole number ``order``: sums of ranges of rows first."""
    tagged = table.withColumn("__range", F.floor(F.col(order) / F.lit(_ROUNDS)))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = tagged.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum")).select(
        *keys, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*keys, "__range").orderBy(order)
    return tagged.join(shifts, [*keys, "__range"]).withColumn(
        into, F.sum(value).over(inside) + F.col("__shift")).drop("__range", "__shift")


def open_after_rounds(rounds: DataFrame, changes: DataFrame, intervals: DataFrame) -> DataFrame:
    """``repo_id, review_id, round_no, open_issues`` of every round, by a sweep over openings and closings."""
    steps = intervals.select("repo_id", F.explode(F.array(
        F.struct(F.col("opened").alias("round_no"), F.lit(1).alias("step")),
        F.struct(F.col("closed").alias("round_no"), F.lit(-1).alias("step")))).alias("s"))
    change = steps.groupBy("repo_id", F.col("s.round_no").alias("round_no")).agg(F.sum("s.step").alias("step"))
    # Rounds without changes count here as well, so ``changes`` need not be read again.
    numbers = _ordered(rounds).select("repo_id", "review_id", "round_no")
    every = numbers.join(change, ["repo_id", "round_no"], "left").fillna(0, ["step"])
    return running_sum(every, ["repo_id"], "round_no", "step", "open_issues").drop("step")
