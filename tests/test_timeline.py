"""Whole histories against folds over the rounds in plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from reviewloom.operators import timeline

ROUND = "repo_id int, review_id bigint, created_at timestamp, mode string"
ISSUE = "review_id bigint, seq bigint, file string, line int, severity string, category string, message string"
CHANGE = "review_id bigint, filename string, previous_filename string, status string"


def events_of(diff):
    """file -> new name, or None where its issues are dropped."""
    out = {}
    for _, name, old, status in diff:
        if status == "removed":
            out.setdefault(name, None)
        if status != "added":
            path = old or name
            out.setdefault(path, None)
            if status == "renamed" and old is not None:
                out[path] = max(name, out[path] or name)
    return out


def fold(rounds, issues, changes, renames):
    """What is open after each round: {(repo, round_no): [(issue, present file)]}."""
    after = {}
    for repo in sorted({r[0] for r in rounds}):
        state = []
        for n, (_, review, _, mode) in enumerate(sorted((r for r in rounds if r[0] == repo), key=lambda r: (r[2], r[1])), 1):
            new = sorted((i for i in issues if i[0] == review), key=lambda i: i[1])
            diff = [c for c in changes if c[0] == review]
            if mode == "full":
                state = [(n, i, i[2]) for i in new]
            elif diff:
                events = events_of(diff)
                kept = []
                for born, issue, file in state:
                    if file not in events:
                        kept.append((born, issue, file))
                    elif renames and events[file] is not None:
                        kept.append((born, issue, events[file]))
                state, seen = [], set()
                for born, issue, file in sorted(kept + [(n, i, i[2]) for i in new], key=lambda x: (x[0], x[1][1])):
                    key = (file, issue[3], issue[5], issue[6])
                    if key not in seen:
                        seen.add(key)
                        state.append((born, issue, file))
            after[repo, n] = list(state)
    return after


def history(seed, repos=6, most=12, names="abcdef"):
    rng = random.Random(seed)
    rounds, issues, changes = [], [], []
    review = 0
    for repo in range(repos):
        now = datetime(2024, 1, 1)
        for n in range(4 * most if repo == 0 else rng.randint(1, most)):
            review += 1
            now += timedelta(days=rng.randint(0, 1))
            rounds.append((repo, review, now, "full" if rng.random() < 0.1 else "incremental"))
            issues += [(review, seq, rng.choice(names), rng.choice([None, 1]), "error", "lint", rng.choice("xy"))
                       for seq in range(rng.randint(0, 4))]
            for name in rng.sample(names, rng.randint(0, 3)):
                status = rng.choice(["added", "modified", "removed", "renamed", "renamed", "renamed", "copied"])
                changes.append((review, name, rng.choice([*names, None]) if status in ("renamed", "copied") else None, status))
    return rounds, issues, changes


def frames(spark, rounds, issues, changes):
    return (spark.createDataFrame(rounds, ROUND), spark.createDataFrame(issues, ISSUE), spark.createDataFrame(changes, CHANGE))


def renamed(spark, rounds, issues, changes):
    r, i, c = frames(spark, rounds, issues, changes)
    got = timeline.open_issues_with_renames(r, i, c)
    assert got.columns == ["repo_id", *i.columns]
    return sorted((x["repo_id"], x["review_id"], x["seq"], x["file"]) for x in got.collect())


def last_state(rounds, issues, changes):
    after = fold(rounds, issues, changes, True)
    last = {repo: max(n for r, n in after if r == repo) for repo, _ in after}
    return sorted((repo, i[0], i[1], file) for repo, n in last.items() for _, i, file in after[repo, n])


@pytest.mark.parametrize("seed, sweep", [(1, 4096), (2, 4096), (3, 3)])
def test_random_histories(spark, monkeypatch, seed, sweep):
    monkeypatch.setattr(timeline, "_ROUNDS", sweep)
    rounds, issues, changes = history(seed)
    assert renamed(spark, rounds, issues, changes) == last_state(rounds, issues, changes)

    r, i, c = frames(spark, rounds, issues, changes)
    after = fold(rounds, issues, changes, False)
    intervals = timeline.issue_intervals(r, i, c)
    rows = intervals.collect()
    open_at = {k: sorted((x["review_id"], x["seq"]) for x in rows if x["repo_id"] == k[0] and x["opened"] <= k[1]
                         and (x["closed"] is None or x["closed"] > k[1])) for k in after}
    assert open_at == {k: sorted(i[:2] for _, i, _ in state) for k, state in after.items()}
    counts = timeline.open_after_rounds(r, c, intervals).collect()
    assert {(x["repo_id"], x["round_no"]): x["open_issues"] for x in counts} == {k: len(v) for k, v in after.items()}


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def test_chains_and_cycles(spark):
    names = "abcdefgh"
    rounds = [(1, 0, day(0), "full")] + [(1, k, day(k), "incremental") for k in range(1, 8)]
    changes = [(k, names[k], names[k - 1], "renamed") for k in range(1, 8)]
    issues = [(0, 0, "a", 1, "error", "lint", "m"), (3, 0, "d", 2, "error", "lint", "m"), (4, 0, "d", 3, "error", "lint", "m")]
    # Seven links; the issue of round four is on a name that was given up in that round.
    assert renamed(spark, rounds, issues, changes) == [(1, 0, 0, "h"), (1, 3, 0, "h"), (1, 4, 0, "d")]
    # Two names swap again and again, and one of the files is removed in the end.
    swap = [(k, a, b, "renamed") for k in range(1, 7) for a, b in ("pq", "qp")] + [(7, "p", None, "removed")]
    two = [(0, 0, "p", 1, "error", "lint", "m"), (0, 1, "q", 1, "error", "lint", "m"), (2, 0, "p", 5, "error", "lint", "m")]
    assert renamed(spark, rounds, two, swap) == [(1, 0, 1, "q")]
    assert renamed(spark, rounds, two, swap) == last_state(rounds, two, swap)


def test_files_that_meet_under_one_name(spark):
    rounds = [(1, 0, day(0), "full"), (1, 1, day(1), "incremental")]
    issues = [(0, 0, "b", 1, "error", "lint", "m"), (0, 1, "a", 1, "error", "lint", "m")]
    assert renamed(spark, rounds, issues, [(1, "b", "a", "renamed")]) == [(1, 0, 0, "b")]


def test_no_changes_and_no_rounds(spark):
    rounds = [(1, 5, day(0), "incremental"), (1, 6, day(1), "full"), (1, 7, day(2), "incremental")]
    issues = [(5, 0, "a", 1, "error", "lint", "m"), (6, 0, "a", 1, "error", "lint", "m"), (6, 1, "a", 1, "error", "lint", "m"),
              (7, 0, "b", 1, "error", "lint", "m")]
    assert renamed(spark, rounds, issues, []) == [(1, 6, 0, "a"), (1, 6, 1, "a")]
    assert renamed(spark, [], [], []) == []
    r, i, c = frames(spark, rounds, issues, [])
    assert sorted((x["review_id"], x["seq"], x["opened"], x["closed"]) for x in timeline.issue_intervals(r, i, c).collect()) == [
        (6, 0, 2, None), (6, 1, 2, None)]


def test_issues_without_a_file_stay(spark):
    rounds = [(1, 0, day(0), "full"), (1, 1, day(1), "incremental")]
    issues = [(0, 0, None, 1, "error", "lint", "m"), (0, 1, "a", 1, "error", "lint", "m"), (0, 2, "b", 1, "error", "lint", "m")]
    r, i, c = frames(spark, rounds, issues, [(1, "a", None, "removed")])
    got = timeline.open_issues_with_renames(r, i, c).collect()
    assert sorted((x["seq"], x["file"]) for x in got) == [(0, None), (2, "b")]


def test_a_sweep_makes_its_rows_once(spark):
    """The rows of a sweep are written; both its passes read them, so the plan makes no event."""
    rounds = [(1, k, day(k), "incremental") for k in range(4)]
    r, i, c = frames(spark, rounds, [(0, 0, "a", 1, "error", "lint", "m")], [(2, "a", None, "removed")])
    numbers = timeline.numbered_rounds(r, c)
    events = timeline.file_events(numbers, c)
    points = numbers.selectExpr("repo_id", "round_no", "'a' AS file")
    swept = timeline._swept(points, ["repo_id", "file"], events, events["round_no"], "next")
    assert sorted((x["round_no"], x["next"]) for x in swept.collect()) == [(1, 3), (2, 3), (3, None), (4, None)]
    assert "Generate" not in swept._jdf.queryExecution().optimizedPlan().toString()
