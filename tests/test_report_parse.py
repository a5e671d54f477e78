"""Answers of a report are parsed by compiled steps, in as many tasks as their shuffle has."""

import re

from pyspark.sql import functions as F

from reviewloom.operators.responses import parse_fixes, parse_reviews
from reviewloom.plans.fixes import fix_outcomes


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_answers_move_to_their_review_before_the_parse(spark):
    candidates = spark.createDataFrame(
        [(1, True, True, "low"), (2, True, True, "low"), (None, True, True, "low")],
        "review_id long, should_open_pr boolean, can_write boolean, reason string")
    answers = spark.createDataFrame(
        [(1, '{"fixes":[{"file":"a","newContent":"b"}]}'), (2, '{"fixes":[{"file":"a"}]}'),
         (None, '{"fixes":[{"file":"a","newContent":"b"}]}')], "review_id long, text string").coalesce(1)
    found = fix_outcomes(candidates, answers)
    plan = _plan(found)
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression")
    rows = {r.review_id: (r.ready, r.outcome) for r in found.collect()}
    none = "AI did not return any safe fixes"
    assert rows == {1: (True, "low"), 2: (False, none), None: (False, none)}


def test_only_the_list_of_an_answer_is_not_compiled(spark):
    answers = spark.createDataFrame([(1, ' ```json\n{"summary":"s","score":7,"issues":[]}``` ')], "review_id long, text string")
    reviews = parse_reviews(answers).where(F.col("parse_error").isNull())
    for frame in (reviews, parse_fixes(answers)):
        plan = _plan(frame)
        assert len(re.findall(r"Generate ", plan)) == 1
        assert plan.count("try_parse_json") + plan.count("parseJson") <= 6  # one copy of each parse
    row = reviews.collect()[0]
    assert (row.summary, row.score, row.issue_count) == ("s", 7, 0)
