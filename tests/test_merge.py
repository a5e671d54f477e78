"""Incremental merge: literal rounds, and the closed form against a sequential fold."""

import random
from datetime import datetime, timedelta

import pytest

from reviewloom.operators import merge
from reviewloom.streaming import open_issues as stream

ISSUE = ("repo_id int, review_id bigint, seq bigint, file string, line int, severity string, "
         "category string, message string, suggestion string")
CHANGE = "repo_id int, review_id bigint, filename string, previous_filename string, status string"


@pytest.mark.parametrize("change,kept,renamed", [
    (("a.js", None, "modified"), "bc", "bc"),
    (("b.js", None, "removed"), "ac", "ac"),
    (("a.js", None, "added"), "abc", "abc"),
    (("d.js", "c.js", "renamed"), "ab", "abd"),
    (("a.js", "z.js", "renamed"), "abc", "abc"),
    (("e.js", "a.js", "copied"), "bc", "bc"),
])
def test_one_round(spark, change, kept, renamed):
    previous = spark.createDataFrame(
        [(1, 1, i, f"{n}.js", i, "error", "lint", "m", "") for i, n in enumerate("abc")], ISSUE)
    new = spark.createDataFrame([], ISSUE)
    changes = spark.createDataFrame([(1, 2, *change)], CHANGE)
    for carry, expected in ((False, kept), (True, renamed)):
        merged = merge.merge_round(previous, new, changes, carry_renames=carry)
        assert sorted(r["file"][0] for r in merged.collect()) == list(expected)


def _history(seed, repos=12, rounds=7):
    """Random rounds with the issue list the sequential fold ends with."""
    rng = random.Random(seed)
    rows, issues, changes, final = [], [], [], {}
    review_id = 0
    for repo in range(repos):
        state, now = [], datetime(2024, 1, 1)
        for n in range(rng.randint(1, rounds)):
            review_id += 1
            now += timedelta(days=rng.randint(0, 1))
            mode = "full" if n == 0 or rng.random() < 0.2 else "incremental"
            rows.append((review_id, repo, now, mode))
            new = [
                (review_id, seq, rng.choice("abcd"), rng.choice([None, 1]), rng.choice(["error", "info"]),
                 "lint", rng.choice("xy"), "")
                for seq in range(rng.randint(0, 4))
            ]
            diff = []
            for name in rng.sample("abcd", rng.randint(0, 3)):
                status = rng.choice(["added", "modified", "removed", "renamed", "copied"])
                old = rng.choice("abcd") if status in ("renamed", "copied") else None
                diff.append((review_id, name, old, status))
            if mode == "full":
                state = list(new)
            elif diff:
                gone = {f for _, f, _, s in diff if s == "removed"}
                gone |= {o or f for _, f, o, s in diff if s != "added"}
                merged, seen, state_next = [i for i in state if i[2] not in gone] + new, set(), []
                for issue in merged:
                    key = (issue[2], issue[3], issue[5], issue[6])
                    if key not in seen:
                        seen.add(key)
                        state_next.append(issue)
                state = state_next
            issues += new
            changes += diff
        final[repo] = sorted((i[0], i[1]) for i in state)
    return rows, issues, changes, final


def _tables(spark, seed):
    rows, issues, changes, final = _history(seed)
    return (
        spark.createDataFrame(rows, "review_id bigint, repo_id bigint, created_at timestamp, mode string"),
        spark.createDataFrame(issues, "review_id bigint, seq bigint, file string, line int, severity string, "
                              "category string, message string, suggestion string"),
        spark.createDataFrame(changes, "review_id bigint, filename string, previous_filename string, "
                              "status string"),
        final,
    )


def _listed(opened, final):
    got = {repo: [] for repo in final}
    for row in opened.select("repo_id", "review_id", "seq").collect():
        got[row["repo_id"]].append((row["review_id"], row["seq"]))
    return {repo: sorted(rows) for repo, rows in got.items()}


@pytest.mark.parametrize("seed", range(6))
def test_closed_form_equals_fold(spark, seed):
    rounds, issues, changes, final = _tables(spark, seed)
    assert _listed(merge.open_issues(rounds, issues, changes), final) == final


def test_stream_equals_fold_in_any_arrival_order(spark, tmp_path):
    rounds, issues, changes, final = _tables(spark, 99)
    events = stream.review_events(rounds, issues, changes, slices=2).toPandas()
    shuffled = events.sample(frac=1, random_state=3)
    half = len(shuffled) // 2
    for n, part in enumerate((shuffled[:half], shuffled[half:])):
        rows = [tuple(None if v != v else v for v in row) for row in part.itertuples(index=False)]
        frame = spark.createDataFrame(
            [(int(r[0]), r[1], int(r[2]), r[3], int(r[4]), int(r[5]), None if r[6] is None else int(r[6]),
              None if r[7] is None else int(r[7]), *r[8:]) for r in rows], stream.EVENT)
        frame.coalesce(1).write.parquet(f"{tmp_path}/events{n}")
    source = (
        spark.readStream.schema(stream.EVENT).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(f"{tmp_path}/events*")
    )
    stream.open_issue_stream(source, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    occurrences = stream.current_occurrences(spark, f"{tmp_path}/state")
    assert _listed(stream.open_issues(occurrences, rounds, changes), final) == final


def test_reviews_of_one_repository_keep_their_own_lists(spark):
    from reviewloom.plans import review

    text = '{"issues":[{"file":"a.js","message":"m","severity":"error","category":"logic"}]}'
    answers = spark.createDataFrame([(9, 1, text), (9, 2, text)], "repo_id int, review_id int, text string")
    modes = spark.createDataFrame([(9, 1, "incremental"), (9, 2, "incremental")], "repo_id int, review_id int, mode string")
    previous = spark.createDataFrame(
        [(9, 5, "b.js", None, "error", "logic", "old", "")],
        "repo_id int, seq bigint, file string, line int, severity string, category string, message string, suggestion string")
    changes = spark.createDataFrame(
        [(1, "a.js", None, "modified"), (2, "b.js", None, "modified")],
        "review_id int, filename string, previous_filename string, status string")
    rows = review.merged_issues(answers, modes, previous, changes).orderBy("review_id", "list_pos").collect()
    assert [(r["review_id"], r["list_pos"], r["file"]) for r in rows] == [(1, 1, "b.js"), (1, 2, "a.js"), (2, 1, "a.js")]


def test_a_batch_writes_only_what_it_changes(spark, tmp_path):
    def event(kind, at, review_id, seq=None, message=None):
        return (1, "a.js", 0, kind, at, review_id, seq, 1, "error", "logic", message, "")

    def add(rows):
        spark.createDataFrame(rows, stream.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        source = spark.readStream.schema(stream.EVENT).parquet(f"{tmp_path}/events")
        stream.open_issue_stream(source, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/log").count()

    before = add([event("issue", 10, 1, k, f"m{k}") for k in range(300)])
    assert add([event("issue", 20, 2, 0, "new")]) == before + 1
    assert add([event("touch", 15, 3)]) == before + 2
    left = stream.current_occurrences(spark, f"{tmp_path}/log").collect()
    assert [r["message"] for r in left] == ["new"]
    assert add([event("issue", 5, 0, 0, "late and stale")]) == before + 2
