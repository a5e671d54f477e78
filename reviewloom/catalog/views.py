"""The sample tables as SQL, shared by the checking queries."""

from __future__ import annotations

from reviewloom.sources.samples import LONG_CHANGES, ROW_VIEWS

_COMBINED = {
    "reviews": (
        (),
        "SELECT o_orderkey AS review_id, o_custkey AS repo_id, o_orderdate AS created_at, "
        "CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 "
        "OR o_orderkey % 7 = 0 THEN 'full' ELSE 'incremental' END AS mode, "
        "CASE WHEN o_orderkey % 13 <> 0 THEN CAST((o_orderkey * 37) % 101 AS INT) END AS score, "
        "md5(CAST(o_orderkey AS STRING)) AS head_sha, "
        "CASE WHEN o_orderkey % 3 = 0 THEN 'main' ELSE 'develop' END AS branch, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS round_no, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) "
        "AS age FROM orders",
    ),
    "changes": (
        (),
        "SELECT review_id, CAST(k AS INT) AS file_no, "
        "concat('src/m', CAST(k AS STRING), '.js') AS filename, "
        "CASE WHEN s = 3 THEN concat('src/m', CAST((k + 3) % 8 AS STRING), '.js') END "
        "AS previous_filename, "
        "CASE s WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' "
        "WHEN 3 THEN 'renamed' ELSE 'modified' END AS status, "
        "CASE WHEN k % 4 <> 0 THEN concat('@@ -1 +1 @@', chr(10), '+line ', CAST(k AS STRING)) END "
        "AS patch, CAST(k + s AS INT) AS additions, CAST(s AS INT) AS deletions "
        "FROM (SELECT l_orderkey AS review_id, l_suppkey % 8 AS k, "
        "min(l_linenumber + l_partkey) % 5 AS s FROM lineitem "
        "GROUP BY l_orderkey, l_suppkey % 8) t",
    ),
    "long": (
        ("long_rounds", "long_findings"),
        "SELECT DISTINCT * FROM fx_long_rounds",
    ),
    "long_changes": (
        (),
        f"SELECT {', '.join(LONG_CHANGES)} FROM (SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS review_id, "
        "l_partkey % 400 AS k, min(l_linenumber + l_suppkey) % 6 AS s FROM lineitem GROUP BY ALL) t",
    ),
    "tree": (
        ("files", "manifests"),
        "SELECT repo_id, path FROM fx_files UNION ALL SELECT DISTINCT repo_id, path FROM fx_manifests",
    ),
    "attempts": (
        ("first_attempts", "second_attempts"),
        "SELECT * FROM fx_first_attempts UNION ALL SELECT * FROM fx_second_attempts",
    ),
}


def oracle(select: str, *views: str, ctes: str = "") -> str:
    """SQL text: the named views as ``fx_`` tables, further CTEs, then the final select."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in _COMBINED:
            needs, body = _COMBINED[name]
            for need in needs:
                add(need)
            parts.setdefault(f"fx_{name}", body)
        else:
            table, columns = ROW_VIEWS[name]
            parts.setdefault(f"fx_{name}", f"SELECT {', '.join(columns)} FROM {table}")

    for view in views:
        add(view)
    listed = [f"{name} AS ({body})" for name, body in parts.items()]
    if ctes:
        listed.append(ctes)
    return (f"WITH {', '.join(listed)} " if listed else "") + select


RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"
WEIGHT = "CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 1 ELSE 0 END"
ISSUE_KEY = (
    "concat(file, '::', coalesce(CAST(line AS STRING), '?'), '::', category, '::', message)"
)
