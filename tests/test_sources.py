"""Markdown discovery and decoding (fixture F5) and the import job over files."""

import os

import pytest
from pyspark.sql import functions as F

from vellum.operators.embed import HashEncoder
from vellum.plans.ingest import ingest_documents
from vellum.sources.markdown import scan_markdown


def _write(root, rel, data: bytes):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _corpus(root):
    _write(root, "soil.md", b"# Soil care\nTurn it in #spring or #autumn\n")
    _write(root, "seeds.md", b"---\ntags: [peas, beans]\n---\n# Seeds to buy\r\nBody\r\nmore\rend")
    _write(root, "beds/frost.md", b"> cover them, says the #almanac\n")
    _write(root, "B.MD", b"upper case extension")
    _write(root, "c.markdown", b"long extension")
    _write(root, "prices.txt", b"not markdown")
    _write(root, ".y.md", b"hidden file")
    _write(root, "_x.md", b"underscore file")
    _write(root, "empty.md", b"")
    _write(root, "bad.md", b"\xff\xfe invalid utf8")


def test_scan_by_sparks_own_listing(spark, scratch):
    root = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    _corpus(root)
    docs, rejects = scan_markdown(spark, root, strict=False)
    names = {os.path.basename(r.source_file): r.text for r in docs.collect()}
    assert set(names) == {"soil.md", "seeds.md", "frost.md", "B.MD", "c.markdown"}
    assert names["seeds.md"] == "---\ntags: [peas, beans]\n---\n# Seeds to buy\nBody\nmore\nend"
    assert [os.path.basename(r.key) for r in rejects.collect()] == ["bad.md"]


def test_scan_is_complete(spark, scratch):
    root = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    _corpus(root)
    docs, rejects = scan_markdown(spark, root)
    names = {os.path.basename(r.source_file) for r in docs.collect()}
    assert {".y.md", "_x.md", "empty.md", "soil.md", "frost.md"} <= names and "prices.txt" not in names
    assert rejects.count() == 1
    with pytest.raises(FileNotFoundError):
        scan_markdown(spark, root + "/missing")


def test_ingest_files(spark, scratch):
    root = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    _corpus(root)
    docs, _ = scan_markdown(spark, root)
    rows, rejects = ingest_documents(docs, HashEncoder(64), 200, 50)
    got = {os.path.basename(r.source_file): r for r in rows.collect()}
    assert got["soil.md"].doc_title == "Soil care" and got["soil.md"].tags == ["autumn", "spring"]
    assert got["seeds.md"].tags == ["beans", "peas"] and got["frost.md"].tags == ["almanac"]
    assert len(got["soil.md"].embedding) == 64 and rejects.count() == 0
    assert rows.where(F.col("creation_date").isNull()).count() == 0
    again, _ = ingest_documents(docs, HashEncoder(64), 200, 50)
    assert again.select("id").subtract(rows.select("id")).count() == 0  # content ids are stable


def test_levels_are_listed_to_the_end(spark, scratch):
    root = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    _write(root, "/".join(f"d{i}" for i in range(9))[0:] + "/deep.md", b"deep")
    _write(root, ".hidden/_under/x.md", b"x")
    for i in range(300):
        _write(root, f"flat/{i}.md", b"")
    os.makedirs(os.path.join(root, "none/at/all.md"))  # a folder with such a name is no file
    os.utime(os.path.join(root, "flat/7.md"), (1_000_000_000, 1_000_000_000))
    docs, _ = scan_markdown(spark, root)
    rows = {r.source_file: r.t for r in docs.select("source_file", F.unix_seconds("modification_time").alias("t")).collect()}
    assert len(rows) == 302 and rows[os.path.join(root, "flat/7.md")] == 1_000_000_000


def test_the_driver_sees_no_entry(spark, scratch, monkeypatch):
    root = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    _corpus(root)
    made = []
    own = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, *a, **k: made.append(list(rows)) or own(made[-1], *a, **k))
    docs, _ = scan_markdown(spark, root)
    assert docs.count() == 9 - 1 and made == [[(os.path.abspath(root),)]]


def test_file_that_is_gone_is_a_reject(spark, scratch):
    from vellum.sources.markdown import decoded, list_files, read_files

    root = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    _write(root, "a.md", b"a")
    _write(root, "b.md", b"b")
    files = list_files(spark, root)
    os.rename(os.path.join(root, "b.md"), os.path.join(root, "b.txt"))
    docs, rejects = decoded(read_files(files, root))
    assert docs.count() == 1 and [(os.path.basename(r.key), r.reason) for r in rejects.collect()] == [("b.md", "missing_file")]


@pytest.mark.parametrize("files_per_batch", [None, 2])
def test_stream_takes_every_file_once(spark, scratch, files_per_batch):
    from vellum.sources.snapshot import CollectionStore
    from vellum.streaming.incremental import run_incremental_import

    base = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    root, ckpt = f"{base}/in", f"{base}/ckpt"
    os.makedirs(root)
    store = CollectionStore(spark, f"{base}/coll", "notes", 32)
    assert run_incremental_import(spark, root, store, ckpt) == {"before": 0, "after": 0, "batches": [], "rejected": 0}
    _corpus(root)
    os.utime(os.path.join(root, "soil.md"), (1_500_000_000, 1_500_000_000))
    first = run_incremental_import(spark, root, store, ckpt, files_per_batch=files_per_batch)
    names = {os.path.basename(r.source_file) for r in store.read().select("source_file").collect()}
    assert names == {"soil.md", "seeds.md", "frost.md", "B.MD", "c.markdown", ".y.md", "_x.md", "empty.md"}
    assert first["rejected"] == 1 and sum(first["batches"]) == first["after"]
    _write(root, "beds/_later.md", b"came later")
    second = run_incremental_import(spark, root, store, ckpt, files_per_batch=files_per_batch)
    assert sum(second["batches"]) == 1 and second["rejected"] == 0
    third = run_incremental_import(spark, root, store, ckpt, files_per_batch=files_per_batch)
    assert third["before"] == third["after"] == second["after"]


def test_stream_works_in_bounded_batches_and_leaves_nothing_behind(spark, scratch, monkeypatch):
    """Without a number of files from the caller a batch is bounded all the same, and what it wrote to work on is
    gone when its rows are in the store."""
    from vellum.sources.snapshot import CollectionStore
    from vellum.streaming import incremental

    monkeypatch.setattr(incremental, "FILES_PER_BATCH", 4)
    base = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    root, ckpt = f"{base}/in", f"{base}/ckpt"
    _corpus(root)
    for i in range(6):
        _write(root, f"more/{i}.md", b"text %d" % i)
    store = CollectionStore(spark, f"{base}/coll", "notes", 32)
    got = incremental.run_incremental_import(spark, root, store, ckpt)
    assert len(got["batches"]) >= 4 and max(got["batches"]) <= 4 and sum(got["batches"]) == got["after"] == 14 and got["rejected"] == 1
    assert sorted(os.listdir(ckpt)) == ["files", "rejects", "stream"]
    assert store.read().select("id").distinct().count() == 14
