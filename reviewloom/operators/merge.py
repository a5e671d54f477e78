"""Incremental merge of findings: one round, or the closed form over all rounds.

Rounds of a repository are ordered by ``(created_at, review_id)``; the code compares
that pair directly (struct comparison), so no per-repository numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.severity import issue_key, severity_weight
from reviewloom.operators.ranking import keep_first, numbered

# Source positions that are numbered together.
_POSITIONS = 4096


def round_position() -> Column:
    return F.struct("created_at", "review_id")


def in_changed_files(findings: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Findings whose file is in the change list of the same ``keys``."""
    changed = changes.select(*keys, F.col("filename").alias("file"))
    return findings.join(changed, [*keys, "file"], "left_semi")


def dropped_paths(changes: DataFrame, *keys: str) -> DataFrame:
    """Paths whose earlier issues are stale: removed files and the old side of every
    change that is not an addition. May repeat a path; callers aggregate or semi-join."""
    paths = F.array_compact(
        F.array(
            F.when(F.col("status") == "removed", F.col("filename")),
            F.when(F.col("status") != "added", F.coalesce("previous_filename", "filename")),
        )
    )
    return changes.select(*keys, F.explode(paths).alias("file"))


def carried_over(
    previous: DataFrame, changes: DataFrame, carry_renames: bool = False, key: str = "repo_id"
) -> DataFrame:
    """Previous issues that survive a round of changes, both keyed by ``key``.

    By default a renamed file's old issues are dropped. With ``carry_renames`` they move
    to the new path instead.
    """
    stale = dropped_paths(changes, key).distinct()
    if not carry_renames:
        return previous.join(stale, [key, "file"], "left_anti")
    renamed = F.col("status") == "renamed"
    moves = (
        changes.where(renamed & F.col("previous_filename").isNotNull())
        .groupBy(key, F.col("previous_filename").alias("file"))
        .agg(F.max("filename").alias("moved_to"))
    )
    stale = stale.join(moves, [key, "file"], "left_anti")
    return (
        previous.join(stale, [key, "file"], "left_anti")
        .join(moves, [key, "file"], "left")
        .withColumn("file", F.coalesce("moved_to", "file"))
        .drop("moved_to")
        .select(*previous.columns)
    )


def with_issue_key(issues: DataFrame) -> DataFrame:
    rule = F.col("rule_id") if "rule_id" in issues.columns else None
    return issues.withColumn(
        "issue_key",
        issue_key(F.col("file"), F.col("line"), F.col("category"), F.col("message"), rule),
    )


def merge_round(
    previous: DataFrame, new: DataFrame, changes: DataFrame, carry_renames: bool = False,
    key: str = "repo_id",
) -> DataFrame:
    """One incremental round for many repositories (or reviews, as ``key`` says) at once.

    Carried issues come before new ones (``origin`` 0 and 1); the first of equal
    issues stays. ``seq`` orders each of both lists.
    """
    carried = carried_over(previous, changes, carry_renames, key).withColumn("origin", F.lit(0))
    merged = carried.unionByName(new.withColumn("origin", F.lit(1)))
    order = [F.col("origin"), F.col("seq")]
    return keep_first(with_issue_key(merged), [key, "issue_key"], order).drop("issue_key")


def with_list_position(merged: DataFrame, key: str = "review_id") -> DataFrame:
    """``list_pos``: place from 1 of each issue in its merged list, carried issues first.

    Consumers order a merged list by it; ``seq`` restarts with every source list.
    """
    bucket = F.struct("origin", F.floor(F.col("seq") / F.lit(_POSITIONS)).alias("part"))
    return numbered(merged, [key], ["origin", "seq"], bucket, "list_pos")


def _with_changes(rounds: DataFrame, changes: DataFrame) -> DataFrame:
    """Rounds marked with ``has_changes``."""
    changed = changes.select("review_id").distinct().withColumn("has_changes", F.lit(True))
    return rounds.join(changed, "review_id", "left").withColumn(
        "has_changes", F.coalesce("has_changes", F.lit(False))
    )


def _facts(marked: DataFrame) -> DataFrame:
    position = round_position()
    full = F.col("mode") == "full"
    return marked.groupBy("repo_id").agg(
        F.max(F.when(full, position)).alias("last_full"),
        F.max(F.when(~full & F.col("has_changes"), position)).alias("last_changed"),
    )


def round_facts(rounds: DataFrame, changes: DataFrame) -> DataFrame:
    """Per repository: last full round and last incremental round that changed anything."""
    return _facts(_with_changes(rounds, changes))


def not_reset() -> Column:
    """The position ``pos`` is not before the repository's last full round."""
    return F.col("last_full").isNull() | (F.col("pos") >= F.col("last_full"))


def was_deduplicated() -> Column:
    """An incremental round with changes followed the last full round."""
    later = F.col("last_full").isNull() | (F.col("last_changed") > F.col("last_full"))
    return F.col("last_changed").isNotNull() & F.coalesce(later, F.lit(False))


def first_of_equal(issues: DataFrame) -> DataFrame:
    """Keeps the first of equal issues by ``pos, seq`` where ``dedup`` is set."""
    own = F.concat_ws("#", F.lit(""), F.col("review_id"), F.col("seq"))
    keyed = with_issue_key(issues).withColumn(
        "issue_key", F.when(F.col("dedup"), F.col("issue_key")).otherwise(own)
    )
    return keep_first(keyed, ["repo_id", "issue_key"], [F.col("pos"), F.col("seq")]).drop(
        "issue_key", "dedup", "pos"
    )


def last_touches(rounds: DataFrame, changes: DataFrame) -> DataFrame:
    """Per repository and file: the last incremental round that made its issues stale."""
    incremental = rounds.where(F.col("mode") == "incremental").select(
        "review_id", "repo_id", "created_at"
    )
    return (
        dropped_paths(changes, "review_id")
        .join(incremental, "review_id")
        .groupBy("repo_id", "file")
        .agg(F.max(round_position()).alias("last_touch"))
    )


def open_issues(rounds: DataFrame, issues: DataFrame, changes: DataFrame) -> DataFrame:
    """Issues open after the latest round of every repository, without iterating rounds.

    An issue is open when its round is not before the last full round, its round was
    full or changed something, and no later incremental round touched its file. Equal
    issues collapse to the first once an incremental round followed that full round.
    """
    marked = _with_changes(rounds, changes)
    live = (
        marked.where((F.col("mode") == "full") | F.col("has_changes"))
        .join(_facts(marked), "repo_id")
        .withColumn("pos", round_position())
        .where(not_reset())
        .select("review_id", "repo_id", "pos", was_deduplicated().alias("dedup"))
    )
    touched = last_touches(rounds, changes)
    alive = (
        issues.join(live, "review_id")
        .join(touched, ["repo_id", "file"], "left")
        .where(F.col("last_touch").isNull() | (F.col("last_touch") <= F.col("pos")))
        .drop("last_touch")
    )
    return first_of_equal(alive)


def open_issues_as_of(
    rounds: DataFrame, issues: DataFrame, changes: DataFrame, moment: str
) -> DataFrame:
    """Issues that were open at a past moment: the same closed form over the rounds up to it."""
    past = rounds.where(F.col("created_at") <= F.lit(moment).cast("timestamp"))
    return open_issues(past, issues, changes)


def open_issue_totals(opened: DataFrame) -> DataFrame:
    weight = F.coalesce(severity_weight(F.col("severity")), F.lit(0)).cast("bigint")
    return opened.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("open_issues"), F.sum(weight).alias("weighted")
    )
