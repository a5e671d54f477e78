"""Parts of bounded size against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from reviewloom.operators.parts import byte_parts

LETTERS = "aé€😀\n "


@pytest.mark.parametrize("max_bytes,slice_rows", [(8, 5), (64, 16), (4096, None), (1 << 20, 65_536)])
def test_parts_are_the_text_in_bounded_pieces(spark, max_bytes, slice_rows):
    rng = random.Random(max_bytes)
    rows = [
        (0 if rng.random() < 0.5 else rng.randint(1, 9), i % 3, i,
         rng.choice([None, "", "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60)))]))
        for i in range(400)
    ]
    rows.append((3, 1, 999, "".join(rng.choice(LETTERS) for _ in range(5000))))
    frame = spark.createDataFrame(rows, "k int, section int, id int, text string").repartition(8)
    parts = byte_parts(frame, ["k"], ["section", "id"], F.col("section"), "text", max_bytes, slice_rows).collect()
    got = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        assert 0 < len(r["text"].encode()) <= max_bytes
        got[r["k"]] = got.get(r["k"], "") + r["text"]
    want = {}
    for k, _, _, text in sorted(rows, key=lambda r: r[:3]):
        want[k] = want.get(k, "") + (text or "")
    assert got == {k: t for k, t in want.items() if t}


def test_no_rows_give_no_parts(spark):
    frame = spark.createDataFrame([], "k int, id int, text string")
    assert byte_parts(frame, ["k"], ["id"], F.lit(0), "text").count() == 0
    with pytest.raises(ValueError):
        byte_parts(frame, ["k"], ["id"], F.lit(0), "text", 7)
