import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.llm import fill_middle as fm


def whole(doc_id, text, seed=1):
    """Form, prefix, middle and output of a text, from the text itself."""
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if h[3] % 100 < 20:
        return "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab<PSM>é漢😀\n"), max_size=60), st.integers(-5, 10**12), st.integers(1, 9))
def test_forms_of_texts_over_many_frames(text, doc_id, size):
    was, fm.FRAME_UNITS = fm.FRAME_UNITS, size
    try:
        archive = fm.Writer()
        archive.text(text)
        form, a, b, frames = fm.arranged(doc_id, archive.frames, any(m in text for m in fm.MARKS))
        want = whole(doc_id, text)
        source = fm.Reader(frames)
        assert (form, a, b, "".join(source.read(0, len(source)))) == want
        assert "".join(fm.restored(frames, form)) == text
    finally:
        fm.FRAME_UNITS = was


def test_ranges_open_only_frames_they_touch():
    text = "".join(chr(97 + k % 26) if k % 7 else "é" for k in range(10 * fm.FRAME_UNITS + 17))
    archive = fm.Writer()
    archive.text(text)
    assert len(archive.frames) == 11
    source = fm.Reader(archive.frames)
    at = 3 * fm.FRAME_UNITS + 5
    assert "".join(source.read(at, at + 100)) == text[at : at + 100] and source.opened == 1
    out = fm.Writer()
    source.copy(at, 8 * fm.FRAME_UNITS + 1, out)
    assert source.opened == 3  # one for the range before, two cut frames now
    assert "".join(fm.Reader(out.frames).read(0, out.units)) == text[at : 8 * fm.FRAME_UNITS + 1]


def test_output_without_marks_is_an_error():
    archive = fm.Writer()
    archive.text("no marks")
    with pytest.raises(ValueError):
        list(fm.restored(archive.frames, "psm"))


def test_edge_rows(make):
    long = "Zeile é\n" * 40_000
    rows = [(1, "some text here", "x", 1), (1, "some text here", "x", 1), (2, None, "x", 2), (3, "", "x", 3),
            (None, "no id", "x", 4), (5, "a <S> mark", None, 5), (6, long, "x", 6), (7, "é", "x", 7), (8, "<P", "x", 8)]
    documents = make(rows, "doc_id bigint, text string, FORM string, `out.put` int").withColumn("n.o", F.lit(1))
    outputs = fm.fill_in_middle(fm.archived(documents))
    got = sorted((tuple(r) for r in fm.with_text(fm.with_digests(outputs)).select(
        "`out.put`", "doc_id", "units", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "text"
    ).collect()), key=repr)

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = []
    for doc_id, text, _, other in rows:
        form, a, b, out = whole("null" if doc_id is None else doc_id, text or "")
        want.append((other, doc_id, len(text or ""), form, a, b, sha(out), sha(text or ""), out))
    assert got == sorted(want, key=repr)
    assert fm.with_digests(fm.fill_in_middle(fm.archived(make([], "doc_id bigint, text string")))).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in fm.op12_fill_middle(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) == set(texts)
    forms = set()
    for doc_id, text in texts.items():
        form, a, b, out = whole(doc_id, text)
        forms.add(form)
        r = got[doc_id]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (len(text), form, a, b)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert forms == {"plain", "psm", "spm"}
