"""Prompt datasets, built as ordered text from the findings tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import line_label
from reviewloom.operators import findings as fnd
from reviewloom.operators.merge import in_changed_files
from reviewloom.operators.parts import PART_BYTES, byte_parts
from reviewloom.operators.ranking import SLICE_ROWS
from reviewloom.session import staged

FENCE = "```"

# Rows of one text part; positions are unique per review, so a part is bounded by this.
ROWS_PER_PART = 4096

# Texts of the prompts, here and in the functions below.
NO_PATCH = (
    "(no patch available — file is binary, or the diff is too large to inline; "
    "skip detailed review of this file)"
)


def _lines(*parts: Column | str) -> Column:
    """Non-null parts joined by newlines."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.array_compact(F.array(*columns)), "\n")


def _tag() -> Column:
    return F.concat(F.lit("["), F.upper("severity"), F.lit("]"))


def _rule() -> Column:
    return F.concat(F.lit("["), F.coalesce("rule_id", F.lit("null")), F.lit("]"))


def _joined(order: list[str], text: str) -> Column:
    """Texts of a bounded group, sorted and joined by newlines."""
    entries = F.sort_array(F.collect_list(F.struct(*order, text)))
    return F.array_join(entries.getField(text), "\n")


def findings_block(
    findings: DataFrame, issues: int = fnd.PROMPT_ISSUES, files: int = fnd.PROMPT_FILES
) -> DataFrame:
    """``review_id, findings_text``: the worst findings grouped by file."""
    kept = fnd.prompt_findings(findings, issues, files)
    entry = F.concat(
        F.lit("  "), _tag(), F.lit(" L"), line_label(F.col("line")), F.lit(" "), _rule(),
        F.lit(" "), F.col("message"),
    )
    per_file = (
        kept.withColumn("entry", entry).groupBy("review_id", "file_rank", "file")
        .agg(_joined(["rank"], "entry").alias("entries"))
        .withColumn("block", F.concat(F.lit("\n### "), "file", F.lit("\n"), "entries"))
    )
    return per_file.groupBy("review_id").agg(
        _joined(["file_rank"], "block").alias("findings_text")
    )


def runs_block(runs: DataFrame) -> DataFrame:
    """``review_id, runs_text``: finished linters in registry order, skipped ones left out."""
    text = F.when(
        F.col("status") == "success",
        F.concat(
            F.lit("- "), "linter", F.lit(": ✓ "), F.col("files_with_issues").cast("string"),
            F.lit(" files with issues"),
        ),
    ).when(
        F.col("status") == "failed",
        F.concat(
            F.lit("- "), "linter", F.lit(": ✗ "),
            F.when(F.col("reason") == "binary_not_found", "not installed").otherwise(
                F.coalesce("error", F.lit("null"))
            ),
        ),
    )
    shown = runs.withColumn("text", text).where(F.col("text").isNotNull())
    return shown.groupBy("review_id").agg(_joined(["registry_pos"], "text").alias("runs_text"))


def full_prompts(
    reviews: DataFrame,
    findings: DataFrame,
    runs: DataFrame,
    languages: DataFrame,
    issues: int = fnd.PROMPT_ISSUES,
    files: int = fnd.PROMPT_FILES,
) -> DataFrame:
    """``review_id, prompt`` of whole-repository reviews.

    ``reviews`` has ``review_id, repo_url, warnings, notices``; the other tables are keyed
    by ``review_id``. Every collected group is bounded by a cap or by the registry.
    """
    names = languages.groupBy("review_id").agg(
        F.array_join(
            F.sort_array(F.collect_list(F.struct("registry_pos", "language"))).getField("language"),
            ", ",
        ).alias("language_list")
    )
    totals = fnd.total_findings(findings, "review_id")
    rows = (
        reviews.join(names, "review_id", "left")
        .join(runs_block(runs), "review_id", "left")
        .join(totals, "review_id", "left")
        .join(findings_block(findings, issues, files), "review_id", "left")
    )
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    shown = F.least(F.lit(issues).cast("bigint"), total)
    warnings = F.transform(
        "warnings", lambda w: F.concat(F.lit("- ["), w["code"], F.lit("] "), w["message"])
    )
    notices = F.transform("notices", lambda n: F.concat(F.lit("- "), n))

    def section(title: str, entries: Column) -> Column:
        body = F.concat(F.lit(title + "\n"), F.array_join(entries, "\n"), F.lit("\n"))
        return F.when(F.size(entries) > 0, body)

    prompt = _lines(
        F.concat(F.lit("## Repository: "), "repo_url"),
        F.concat(F.lit("## Detected Languages: "), F.coalesce("language_list", F.lit("unknown"))),
        "",
        section("## Repository Metadata Warnings", warnings),
        section("## Secret Scan Notices", notices),
        "## Linter Run Summary",
        F.col("runs_text"),
        "",
        F.concat(
            F.lit("## Lint Findings (showing "), shown.cast("string"), F.lit(" of "),
            total.cast("string"), F.lit(" total)"),
        ),
        F.coalesce("findings_text", F.lit("No lint issues found.")),
        "",
        "---",
        "Analyze the above findings and produce a structured JSON review report.",
    )
    return rows.select("review_id", prompt.alias("prompt"))


def _incremental_units(reviews: DataFrame, changes: DataFrame, findings: DataFrame) -> DataFrame:
    """Diff prompts as ordered units ``review_id, section, file_order, file, position, text``."""
    # Written once, by review: the changes are counted, they pick the findings, and their diffs are shown.
    keyed_changes = staged(
        changes.join(reviews.select("review_id"), "review_id", "left_semi").select(
            "review_id", "file_no", "filename", "previous_filename", "status", "patch"), "changes")
    counts = keyed_changes.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    listed = reviews.join(counts, "review_id", "left")
    head = _lines(
        F.concat(F.lit("## Repository: "), "repo_url"),
        F.concat(
            F.lit("## Files changed in this diff: "), F.coalesce("n", F.lit(0)).cast("string")
        ),
        "",
        "## Diff",
    )
    tail = _lines(
        "", "---", "Review only the diff above and produce the structured JSON review report."
    )
    diff = _lines(
        F.concat(F.lit("\n### "), "filename", F.lit(" ("), "status", F.lit(")")),
        F.when(
            F.coalesce("previous_filename", F.lit("")) != "",
            F.concat(F.lit("renamed from: "), "previous_filename"),
        ),
        F.when(
            F.coalesce("patch", F.lit("")) != "",
            F.concat(F.lit(FENCE + "diff\n"), "patch", F.lit("\n" + FENCE)),
        ).otherwise(NO_PATCH),
    )
    zero = F.lit(0).cast("bigint")

    def unit(section: int, file_order: Column, file, position: Column, text: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), file_order.alias("file_order"), file.alias("file"),
            position.cast("bigint").alias("position"), text.alias("text"),
        )

    def units(rows: DataFrame, *items: Column) -> DataFrame:
        return rows.select("review_id", F.explode_outer(F.array(*items)).alias("u"))

    none = F.lit("")
    # The files that have findings and changes, written once: they pick and order the findings, and count them.
    relevant = staged(fnd.distinct_files(in_changed_files(findings, keyed_changes, ["review_id"])), "changed-files")
    lint = F.concat(
        F.lit("  "), _tag(), F.lit(" "), "file", F.lit(":L"), line_label(F.col("line")),
        F.lit(" "), _rule(), F.lit(" "), "message",
    )
    heading = relevant.select("review_id").distinct()
    return (
        units(listed, unit(0, zero, none, zero, head), unit(3, zero, none, zero, tail))
        .unionByName(units(keyed_changes, unit(1, zero, none, F.col("file_no"), diff)))
        .unionByName(
            units(heading, unit(2, zero - 1, none, zero, F.lit("\n## Lint findings for changed files")))
        )
        .unionByName(
            units(
                fnd.findings_by_file(findings, relevant),
                unit(2, F.col("file_order"), F.col("file"), F.col("seq"), lint),
            )
        )
        .select("review_id", "u.*")
    )


def incremental_prompts(
    reviews: DataFrame, changes: DataFrame, findings: DataFrame, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Diff prompts of any size as ordered parts ``review_id, section, file_order, file, part, text``.

    Neither diffs nor lint lines are capped, so nothing is collected per review. A part
    covers a range of ``rows_per_part`` positions of one file's list, where positions are
    unique; sorted by the order columns and joined by newlines the parts are the whole prompt.
    """
    part = F.floor(F.col("position") / rows_per_part).alias("part")
    return (
        _incremental_units(reviews, changes, findings)
        .groupBy("review_id", "section", "file_order", "file", part)
        .agg(_joined(["position"], "text").alias("text"))
    )


def incremental_prompt_parts(
    reviews: DataFrame, changes: DataFrame, findings: DataFrame, max_bytes: int = PART_BYTES,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Diff prompts as ``review_id, part, text``, run together in the order of ``part``.

    No part has more than ``max_bytes`` bytes, whatever the length of a diff or a list.
    """
    units = _incremental_units(reviews, changes, findings)
    line = F.when(F.col("section") == 0, F.col("text")).otherwise(F.concat(F.lit("\n"), "text"))
    return byte_parts(
        units.withColumn("text", line), ["review_id"], ["section", "file_order", "file", "position"],
        F.col("section"), "text", max_bytes, slice_rows,
    )


def fix_prompts(
    reviews: DataFrame,
    issues: DataFrame,
    files: DataFrame,
    max_issues: int = fnd.FIX_ISSUES,
    max_files: int = fnd.FIX_FILES,
) -> DataFrame:
    """``review_id, prompt`` for fix passes: worst issues and the contents of their files.

    ``reviews`` has ``review_id, repo_id, repo_url``. The file cap applies before the
    content join; files without readable content are left out.
    """
    top = fnd.fix_issues(issues, max_issues).join(
        reviews.select("review_id"), "review_id", "left_semi"
    )
    bullet = F.concat(
        F.lit("- "), _tag(), F.lit(" "), "file", F.lit(":"), line_label(F.col("line")),
        F.lit(" — "), "message",
        F.when(
            F.coalesce("suggestion", F.lit("")) != "",
            F.concat(F.lit("\n  suggestion: "), "suggestion"),
        ).otherwise(""),
    )
    bullets = top.withColumn("text", bullet).groupBy("review_id").agg(
        _joined(["rank"], "text").alias("bullets"), F.count(F.lit(1)).alias("n")
    )
    scope = (
        fnd.first_file_list(top, max_files)
        .join(reviews.select("review_id", "repo_id"), "review_id")
    )
    contents = (
        scope.join(
            files.where(F.col("content").isNotNull())
            .select("repo_id", F.col("path").alias("file"), "content"),
            ["repo_id", "file"],
        )
        .withColumn(
            "text",
            F.concat(
                F.lit("\n### "), "file", F.lit("\n" + FENCE + "\n"), "content", F.lit("\n" + FENCE)
            ),
        )
        .groupBy("review_id").agg(_joined(["file_rank"], "text").alias("contents"))
    )
    rows = reviews.join(bullets, "review_id", "left").join(contents, "review_id", "left")
    prompt = _lines(
        F.concat(F.lit("## Repository: "), "repo_url"),
        "",
        F.concat(F.lit("## Issues to fix ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")")),
        F.col("bullets"),
        "",
        "## Current file contents",
        F.col("contents"),
        "",
        "---",
        "Produce the JSON response now.",
    )
    return rows.select("review_id", prompt.alias("prompt"))
