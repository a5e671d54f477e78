"""Raw lint reports of twelve tools, normalised into one findings table.

Input rows are ``repo_id, linter, root, payload``. Every format is an expression from a
payload to an array of findings of the common shape, so reports of all tools are read and
parsed once, each by the expression of its tool. Payloads that do not parse give no rows and
never fail a task; their size has no limit. ``seq`` orders a report's findings (outer
position, then inner position).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.json_values import let, one_value
from reviewloom.functions.paths import below_prefix, root_prefix
from reviewloom.functions.severity import normalize_lowered, normalize_severity_number
from reviewloom.functions.text import trimmed_long, unescape_xml

_INNER = 2 ** 32

# Report layouts and text patterns of the tools.
FLAKE8_LINE = r"^(.+?):(\d+):(\d+):\s+([A-Z]\d+)\s+(.+)\z"
CHECKSTYLE_FILE = r'<file\s+name="([^"]+)"'
CHECKSTYLE_ERROR = r"<error\s[^/]*"
CPPCHECK_ERROR = r"<error\b[^>]*>"
CPPCHECK_LOCATION = r'<location\s+file="([^"]+)"\s+line="(\d+)"(?:\s+col="(\d+)")?'
XML_ATTRIBUTE = r'(\w+="[^"]*)"'

ESLINT = (
    "array<struct<filePath:string, messages:array<struct<line:int, column:int, severity:int, "
    "message:string, ruleId:string>>>>"
)
CLIPPY = (
    "reason string, message struct<message:string, level:string, code:struct<code:string>, "
    "spans:array<struct<file_name:string, line_start:int, column_start:int, is_primary:boolean>>>"
)
GOLANGCI = (
    "Issues array<struct<FromLinter:string, Text:string, "
    "Pos:struct<Filename:string, Line:int, Column:int>>>"
)
RUBOCOP = (
    "files array<struct<path:string, offenses:array<struct<severity:string, message:string, "
    "cop_name:string, location:struct<start_line:int, start_column:int>>>>>"
)
PHPCS = (
    "files map<string, struct<messages:array<struct<line:int, column:int, type:string, "
    "message:string, source:string>>>>"
)
SWIFTLINT = (
    "array<struct<file:string, line:int, character:int, severity:string, reason:string, "
    "rule_id:string>>"
)
KTLINT = (
    "array<struct<file:string, errors:array<struct<line:int, col:int, message:string, "
    "rule:string>>>>"
)
SHELLCHECK = (
    "array<struct<file:string, line:int, column:int, level:string, code:int, message:string>>"
)
SQLFLUFF = (
    "array<struct<filepath:string, violations:array<struct<line_no:int, line_pos:int, "
    "code:string, description:string>>>>"
)


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


_FINDINGS = (
    "array<struct<file:string, seq:bigint, line:int, column:int, severity:string, message:string, rule_id:string>>"
)


def _none() -> Column:
    return F.array().cast(_FINDINGS)


# Inside the functions of an array nothing is shared between expressions, so what these name more
# than once is computed before.
def _relative(root: Column, path: Column) -> Column:
    return let(path, lambda p: let(root_prefix(root), lambda prefix: below_prefix(prefix, p)))


def _severity(word: Column) -> Column:
    return let(F.lower(word), normalize_lowered)


def _number_or_one(text: Column) -> Column:
    """Attribute text as int; zero, blank and non-numbers give one."""
    return let(text.try_cast("int"), lambda n: F.when(n != 0, n).otherwise(1))


def _finding(
    root: Column, file: Column, seq: Column, line: Column, column: Column, severity: Column, message: Column,
    rule_id: Column,
) -> Column:
    return F.struct(
        _relative(root, file).alias("file"), seq.cast("bigint").alias("seq"), line.cast("int").alias("line"),
        column.cast("int").alias("column"), severity.alias("severity"), message.alias("message"),
        rule_id.alias("rule_id"),
    )


def _flat(items: Column, make: Callable[[Column, Column], Column], keep=None) -> Column:
    """One finding per element that is there (and that ``keep`` admits), with its position."""
    def one(m: Column, i: Column) -> Column:
        return F.when(m.isNotNull() if keep is None else m.isNotNull() & keep(m), make(m, i))

    return F.array_compact(F.transform(items, one))


def _nested(files: Column, children: Callable[[Column], Column], make, keep=None) -> Column:
    """One finding per child of each element, numbered by both positions."""
    def of_file(f: Column, i: Column) -> Column:
        outer = i.cast("bigint") * F.lit(_INNER)
        return F.coalesce(_flat(children(f), lambda m, j: make(f, m, outer + j), keep), _none())

    return F.flatten(F.transform(files, of_file))


def eslint(payload: Column, root: Column) -> Column:
    return _nested(one_value(payload, ESLINT), lambda f: f["messages"], lambda f, m, seq: _finding(
        root, f["filePath"], seq, _or(m["line"], 1), _or(m["column"], 1),
        normalize_severity_number(m["severity"]), m["message"], _or(m["ruleId"], "eslint/unknown")))


def flake8(payload: Column, root: Column) -> Column:
    def of_line(raw: Column, i: Column) -> Column:
        def part(group: int) -> Column:
            return F.regexp_extract(raw, FLAKE8_LINE, group)

        found = _finding(
            root, part(1), i, part(2).try_cast("int"), part(3).try_cast("int"), F.lit("warning"), part(5), part(4))
        return let(found, lambda f: f.withField("file", F.regexp_replace(f["file"], r"^\./", "")))

    lines = F.transform(F.split(payload, "\n", -1), trimmed_long)
    return _flat(lines, of_line, lambda raw: raw.rlike(FLAKE8_LINE))


def clippy(payload: Column, root: Column) -> Column:
    def of_entry(e: Column, i: Column) -> Column:
        m = e["message"]
        primary = F.filter(m["spans"], lambda span: span["is_primary"])
        return let(F.coalesce(F.get(primary, F.lit(0)), F.get(m["spans"], F.lit(0))), lambda span: _finding(
            root, span["file_name"], i, _or(span["line_start"], 1), _or(span["column_start"], 1),
            _severity(m["level"]), m["message"], _or(m["code"]["code"], "clippy/unknown")))

    lines = F.transform(F.split(payload, "\n", -1), trimmed_long)
    entries = F.transform(lines, lambda raw: one_value(raw, CLIPPY))
    return _flat(entries, of_entry, lambda e: (e["reason"] == "compiler-message") & (F.size(e["message"]["spans"]) > 0))


def golangci(payload: Column, root: Column) -> Column:
    return _flat(one_value(payload, GOLANGCI)["Issues"], lambda m, i: _finding(
        root, m["Pos"]["Filename"], i, _or(m["Pos"]["Line"], 1), _or(m["Pos"]["Column"], 1), F.lit("warning"),
        _or(m["Text"], ""), F.concat(F.lit("golangci-lint/"), _or(m["FromLinter"], "unknown"))),
        lambda m: _or(m["Pos"]["Filename"], "") != "")


def _attributes(tag: Column) -> Column:
    """Attributes as ``name="value`` each, in one pass over the tag."""
    return F.regexp_extract_all(tag, F.lit(XML_ATTRIBUTE), 1)


def _attribute(attributes: Column, name: str) -> Column:
    """Last value of a named attribute, null without one."""
    start = f'{name}="'
    found = F.filter(attributes, lambda pair: pair.startswith(start))
    return F.substring(F.try_element_at(found, F.lit(-1)), len(start) + 1, 2 ** 31 - 1)


def checkstyle(payload: Column, root: Column) -> Column:
    """Tag text ends at the first slash, so a message with one loses later attributes."""
    def named(segment: Column) -> Column:
        return F.struct(F.regexp_extract(segment, "^" + CHECKSTYLE_FILE, 1).alias("name"), segment.alias("text"))

    def tags(file: Column) -> Column:
        return F.when(file["name"] != "", F.regexp_extract_all(file["text"], F.lit(CHECKSTYLE_ERROR), 0))

    def of_tag(file: Column, tag: Column, seq: Column) -> Column:
        return let(_attributes(tag), lambda a: _finding(
            root, file["name"], seq, _number_or_one(_attribute(a, "line")),
            _number_or_one(_attribute(a, "column")), _severity(_attribute(a, "severity")),
            unescape_xml(_or(_attribute(a, "message"), ""), apostrophe=True),
            _checkstyle_rule(_attribute(a, "source"))))

    return _nested(F.transform(F.split(payload, f"(?={CHECKSTYLE_FILE})", -1), named), tags, of_tag)


def _checkstyle_rule(source: Column) -> Column:
    return F.concat(F.lit("checkstyle/"), _or(F.element_at(F.split(source, r"\.", -1), -1), "unknown"))


def checkstyle_strict(reports: DataFrame) -> DataFrame:
    """The same report read as real XML (slashes in messages kept, entities opened once)."""
    layout = (
        "file array<struct<_name:string, error:array<struct<_line:string, _column:string, "
        "_severity:string, _message:string, _source:string>>>>"
    )

    def read(payload: Column, root: Column) -> Column:
        return _nested(F.from_xml(payload, layout)["file"], lambda f: f["error"], lambda f, m, seq: _finding(
            root, f["_name"], seq, _number_or_one(m["_line"]), _number_or_one(m["_column"]),
            _severity(m["_severity"]), _or(m["_message"], ""), _checkstyle_rule(m["_source"])))

    return Format("checkstyle", read)(reports)


def cppcheck(payload: Column, root: Column) -> Column:
    """An error without a location of its own takes the next one anywhere after it.

    The text is cut before every location; all errors of a piece share the location that
    opens the next one.
    """
    start = CPPCHECK_LOCATION.removesuffix(r'(?:\s+col="(\d+)")?')

    def location(piece: Column) -> Column:
        def part(group: int) -> Column:
            return let(F.regexp_extract(piece, "^" + CPPCHECK_LOCATION, group), lambda own: F.when(own != "", own))

        return F.struct(part(1).alias("file"), part(2).alias("line"), part(3).alias("col"))

    def pieces(cut: Column) -> Column:
        following = F.transform(F.slice(cut, F.lit(2), F.size(cut)), location)
        return F.arrays_zip(cut.alias("body"), following.alias("next"))

    def of_tag(piece: Column, tag: Column, seq: Column) -> Column:
        def found(a: Column) -> Column:
            def located(name: str) -> Column:
                return F.coalesce(piece["next"][name], _attribute(a, name))

            return let(_or(located("file"), ""), lambda file: F.when(file != "", _finding(
                root, file, seq, _number_or_one(located("line")), _number_or_one(located("col")),
                _severity(_attribute(a, "severity")),
                unescape_xml(_or(_attribute(a, "msg"), ""), apostrophe=False),
                F.concat(F.lit("cppcheck/"), _or(_attribute(a, "id"), "unknown")))))

        return let(_attributes(tag), found)

    return _nested(
        let(F.split(payload, f"(?={start})", -1), pieces),
        lambda piece: F.regexp_extract_all(piece["body"], F.lit(CPPCHECK_ERROR), 0), of_tag)


def rubocop(payload: Column, root: Column) -> Column:
    return _nested(one_value(payload, RUBOCOP)["files"], lambda f: f["offenses"], lambda f, m, seq: _finding(
        root, f["path"], seq, _or(m["location"]["start_line"], 1), _or(m["location"]["start_column"], 1),
        _severity(m["severity"]), _or(m["message"], ""), _or(m["cop_name"], "rubocop/unknown")))


def phpcs(payload: Column, root: Column) -> Column:
    files = F.map_entries(one_value(payload, PHPCS)["files"])
    return _nested(files, lambda f: f["value"]["messages"], lambda f, m, seq: _finding(
        root, f["key"], seq, _or(m["line"], 1), _or(m["column"], 1), _severity(m["type"]),
        _or(m["message"], ""), _or(m["source"], "phpcs/unknown")))


def _has_file(m: Column) -> Column:
    return _or(m["file"], "") != ""


def swiftlint(payload: Column, root: Column) -> Column:
    return _flat(one_value(payload, SWIFTLINT), lambda m, i: _finding(
        root, m["file"], i, _or(m["line"], 1), _or(m["character"], 1), _severity(m["severity"]),
        _or(m["reason"], ""), F.concat(F.lit("swiftlint/"), _or(m["rule_id"], "unknown"))), _has_file)


def ktlint(payload: Column, root: Column) -> Column:
    return _nested(one_value(payload, KTLINT), lambda f: f["errors"], lambda f, m, seq: _finding(
        root, _or(f["file"], ""), seq, _or(m["line"], 1), _or(m["col"], 1), F.lit("warning"), _or(m["message"], ""),
        F.concat(F.lit("ktlint/"), _or(m["rule"], "unknown"))))


def shellcheck(payload: Column, root: Column) -> Column:
    return _flat(one_value(payload, SHELLCHECK), lambda m, i: _finding(
        root, m["file"], i, _or(m["line"], 1), _or(m["column"], 1), _severity(m["level"]),
        _or(m["message"], ""), F.concat(F.lit("shellcheck/SC"), _or(m["code"], 0).cast("string"))), _has_file)


def sqlfluff(payload: Column, root: Column) -> Column:
    return _nested(one_value(payload, SQLFLUFF), lambda f: f["violations"], lambda f, m, seq: _finding(
        root, _or(f["filepath"], ""), seq, _or(m["line_no"], 1), _or(m["line_pos"], 1), F.lit("warning"),
        _or(m["description"], ""), F.concat(F.lit("sqlfluff/"), _or(m["code"], "unknown"))))


def _rows(reports: DataFrame, linter: Column, found: Column) -> DataFrame:
    """Findings as rows. The outer generator keeps Spark from testing the array, and so from
    parsing every payload a second time, below it."""
    position = ["report_pos"] if "report_pos" in reports.columns else []
    listed = reports.select("repo_id", *position, linter.alias("linter"), F.explode_outer(found).alias("f"))
    return listed.where(F.col("f").isNotNull()).select(
        "repo_id", "linter", "f.*", F.col("linter").alias("source"), *position)


@dataclass(frozen=True)
class Format:
    """A tool's report format; called with its reports it gives their findings."""

    linter: str
    findings: Callable[[Column, Column], Column]

    def __call__(self, reports: DataFrame) -> DataFrame:
        return _rows(reports, F.lit(self.linter), self.findings(F.col("payload"), F.col("root")))


_READERS = {
    "eslint": eslint,
    "flake8": flake8,
    "clippy": clippy,
    "golangci-lint": golangci,
    "checkstyle": checkstyle,
    "rubocop": rubocop,
    "phpcs": phpcs,
    "cppcheck": cppcheck,
    "swiftlint": swiftlint,
    "ktlint": ktlint,
    "shellcheck": shellcheck,
    "sqlfluff": sqlfluff,
}
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {name: Format(name, read) for name, read in _READERS.items()}


def normalize_lint_reports(
    reports: DataFrame, formats: Mapping[str, Callable[[DataFrame], DataFrame]] = FORMATS
) -> DataFrame:
    """All reports as one findings table; ``formats`` plugs in further tools.

    Reports of every :class:`Format` are read once and each payload is parsed by the one
    expression of its tool. Any other function from reports to findings reads the reports of
    its tool on its own. Where a checkout has several reports of one tool, ``report_pos``
    orders them and is returned.
    """
    own = {name: f for name, f in formats.items() if isinstance(f, Format)}
    branches = []
    if own:
        found = reduce(
            lambda chosen, item: chosen.when(F.col("linter") == item[0], item[1].findings(F.col("payload"), F.col("root"))),
            own.items(), F.when(F.lit(False), _none()))
        branches.append(_rows(reports.where(F.col("linter").isin(*own)), F.col("linter"), found))
    several = "report_pos" in reports.columns
    for name, read in formats.items():
        if name in own:
            continue
        rows = reports.where(F.col("linter") == name)
        if several:  # a function hands the repository through unread, so the position rides on it
            rows = rows.withColumn("repo_id", F.struct("repo_id", "report_pos"))
        found = read(rows)
        if several:
            found = found.withColumn("report_pos", F.col("repo_id.report_pos")).withColumn(
                "repo_id", F.col("repo_id.repo_id"))
        branches.append(found)
    return reduce(DataFrame.unionByName, branches)
