"""Chunking, cleaning, tags, titles, prefixes (fixtures F2-F4)."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.chunking import chunk_documents


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def check_windows(text, size, overlap, got):
    """Windows by their definition: they start at multiples of ``size - overlap``, all but the last are full,
    the last is the first that reaches the end; a text that fits is its own window."""
    step = size - overlap
    assert all(w == text[i * step:i * step + size] for i, w in enumerate(got))
    assert all(len(w) == size for w in got[:-1])
    assert got[-1] == text[-len(got[-1]):] if got[-1] else text == ""
    assert len(got) == max(1, -(-(len(text) - overlap) // step))


@pytest.mark.parametrize("length", [0, 1, 29, 30, 31, 52, 53, 74, 75, 500, 1009])
@pytest.mark.parametrize("size,overlap", [(30, 8), (30, 0), (7, 6), (64, 63)])
def test_chunk_windows(spark, length, size, overlap):
    text = "".join(chr(0x4E00 + (i * i) % 1999) for i in range(length))
    check_windows(text, size, overlap, _one(spark, lambda c: tx.chunk_array(c, size, overlap), text))


def test_chunk_windows_by_code_points(spark):
    text = "naïve 🦋 " * 131
    got = _one(spark, lambda c: tx.chunk_array(c, 45, 11), text)
    check_windows(text, 45, 11, got)
    assert got[0] + "".join(w[11:] for w in got[1:]) == text


def test_chunk_bad_params():
    with pytest.raises(ValueError):
        tx.chunk_array(F.col("t"), 100, 100)


def test_chunk_rows_do_not_carry_the_document(spark):
    """The windows are made once, below the explode, and neither they nor the text stand on chunk rows."""
    df = spark.createDataFrame([(1, "a" * 900)], "doc_id int, text string")
    plan = chunk_documents(df, "text", 100, 20, keep=["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate")[0]
    assert plan.count("regexp_extract_all") <= 2 and "regexp_extract_all" not in above and "text" not in above


def test_chunk_documents_rows(spark):
    df = spark.createDataFrame([(1, "a" * 131), (2, "")], "doc_id int, text string")
    rows = chunk_documents(df, "text", 60, 15, keep=["doc_id"]).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.total_chunks, len(r.chunk)) for r in rows] == [
        (1, 0, 3, 60), (1, 1, 3, 60), (1, 2, 3, 41), (2, 0, 1, 0)]


@pytest.mark.parametrize("inp,expected", [
    (None, "empty_document"), ("\u00a0\r\n", "empty_document"), ("one\n\n\ttwo \u3000 three", "one two three"),
    ("50% off (today only)", "50 off today only"), ("wait.... what?!", "wait. what?!"), ("well-known, isn't it", "well-known, isnt it"),
    ("| a | b |", "a b"), ("<<>>", ""), ("été & hiver", "été hiver"),
])
def test_preprocess(spark, inp, expected):
    assert _one(spark, tx.preprocess_text, inp) == expected


@pytest.mark.parametrize("inp,expected", [
    ("---\ntags: [kelp, moss]\n---\nOn shore life", ["kelp", "moss"]),
    ("Plant #garlic beside #roses; never #garlic twice", ["garlic", "roses"]),
    ("---\ntags: []\n---\nnothing named", [""]),
    ("A plain line about rain", []),
    ("---\ntags: [oak, elm]\n---\n#ash then #oak", ["ash", "elm", "oak"]),
])
def test_tags(spark, inp, expected):
    assert _one(spark, tx.extract_tags, inp) == expected


@pytest.mark.parametrize("inp,expected", [
    ("intro\n### Deep header  \nrest", "Deep header"), ("  a walk in the RAIN\nand more", "A Walk In The Rain"),
    ("#draft #two garden notes\nx", "Garden Notes"), (" " * 20_000 + "late start", "Late Start"),
    ("x" + " " * 20_000 + "y\nz", "X Y"),
])
def test_titles(spark, inp, expected):
    assert _one(spark, lambda c: tx.doc_title(c), inp) == expected


def test_title_from_file_name(spark):
    df = spark.createDataFrame([("   ", "/a/b/my_notes_file.md")], "t string, p string")
    assert df.select(tx.doc_title("t", "p")).first()[0] == "My Notes File"


@pytest.mark.parametrize("inp,expected", [
    ("hello", "search_document: hello"), ("search_query: q", "search_query: q"),
    ("clustering: c", "clustering: c"), ("classification: c", "classification: c"),
    ("search_document: d", "search_document: d"),
])
def test_task_prefix(spark, inp, expected):
    assert _one(spark, tx.task_prefix, inp) == expected


def test_preview_and_basename(spark):
    assert _one(spark, lambda c: tx.preview(c, 100), "x" * 101) == "x" * 100 + "..."
    assert _one(spark, lambda c: tx.preview(c, 100), "x" * 100) == "x" * 100
    assert _one(spark, lambda c: tx.excerpt(c, 3), "abcdef") == "abc..."
    assert _one(spark, tx.basename, "/a/b/c.md") == "c.md"


def test_cleaning_by_its_rules(spark):
    import re

    import regex

    texts = ["a  b..c", "a$ $b", "x  y\x1c\x85z", ".$.", "é~日本 \U0001f600 ok!?-,", "\\$1 $2", "#", "-- . . ..  ", "a\n\n#\nb\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.preprocess_text("t").alias("r"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    for r in rows.collect():
        kept = regex.sub(r"[^\p{L}\p{N}_\s\x1c-\x1f.,!?\-]", "", r.t)
        assert r.r == re.sub(r"\.{2,}", ".", re.sub(r"\s+", " ", kept)).strip()
    assert plan.count("x{2028}") <= 1, plan  # white space is told apart in the test for blanks alone


def test_titles_by_their_rules(spark):
    cases = {"  \n# One \nx": "One", "a # b\nc": "A B", "#\nx": "My Notes", "## two": "two", "#  \nx": "", " one two \n# no": "no",
             "x#y z": "X#y Z", " \n": "My Notes", "#tag\nrest": "My Notes"}
    rows = spark.createDataFrame([(t, "/a/my_notes.md") for t in cases], "t string, p string")
    assert {r.t: r.title for r in rows.select("t", tx.doc_title("t", "p").alias("title")).collect()} == cases
    null = spark.createDataFrame([(None, "/a/my_notes.md")], "t string, p string")
    assert null.select(tx.doc_title("t", "p").alias("title")).first().title == "My Notes"
