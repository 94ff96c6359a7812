"""Collection upkeep and search filters on a shelf of ten short books (128-d wave vectors)."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vellum.functions.filters import compile_where
from vellum.operators import collection as co
from vellum.operators import knn as kn
from vellum.plans import search
from vellum.sources.snapshot import CollectionNotFound, CollectionStore

DIM = 128


def _rows(spark, n=10, prefix="doc", seed_offset=0):
    """Wave vectors of rising pitch; the shelf changes every four books, the pages grow with the place."""
    data = []
    for i in range(n):
        v = np.cos(np.arange(DIM) * (0.11 + 0.07 * (i + seed_offset))).astype(np.float32).tolist()
        meta = {"isbn": f"{978000 + i}", "shelf": ["poetry", "travel", "drama"][min(i // 4, 2)], "pages": 60 + 25 * i,
                "langs": ["en", "fr"][: 1 + (i > 6)]}
        data.append((f"{prefix}_{i}", f"Book {i} of the little library", v, meta))
    df = spark.createDataFrame(data, "id string, text string, embedding array<float>, "
                                     "m struct<isbn:string,shelf:string,pages:bigint,langs:array<string>>")
    from vellum.functions.metadata import encode

    return df.select("id", "text", "embedding", encode(F.col("m"), df.schema["m"].dataType).alias("metadata"))


@pytest.fixture()
def coll(spark):
    return _rows(spark)


def test_add_and_count(spark, coll):
    empty = coll.limit(0)
    res = co.add_documents(empty, coll, DIM)
    assert res.collection.count() == 10
    more = _rows(spark, 5, "custom_id", 100)
    res2 = co.add_documents(res.collection, more, DIM)
    assert res2.collection.count() == 15 and res2.added.count() == 5
    again = co.add_documents(res2.collection, more, DIM)  # importing twice = once
    assert again.collection.count() == 15 and again.added.count() == 0


def test_wrong_dimension_rejected(spark, coll):
    bad = coll.limit(1).withColumn("id", F.lit("short")).withColumn("embedding", F.array(*[F.lit(0.1)] * 3)
                                                                   .cast("array<float>"))
    res = co.add_documents(coll, bad, DIM)
    assert res.added.count() == 0 and [r.reason for r in res.rejected.collect()] == ["dimension_mismatch:3"]
    with pytest.raises(ValueError):
        search.query_similar_vector(coll, [0.1, 0.2, 0.3], 3, dim=DIM)


def test_single_vector_and_text_queries(spark, coll):
    v = coll.where("id = 'doc_4'").first().embedding
    res = search.query_similar_vector(coll, list(v), 3, dim=DIM, where={"pages": {"$lte": 9999}}).orderBy("rank")
    rows = res.collect()
    assert rows[0].id == "doc_4" and rows[0].text.startswith("Book 4 ") and len(rows) == 3
    from vellum.operators.embed import HashEncoder
    from vellum.plans.ingest import encoder_input

    enc = HashEncoder(256)
    tcoll = coll.withColumn("embedding", enc.vector(encoder_input("text")))
    hit = search.query_text(tcoll, "Book 7 of the little library", enc, 1, include=("documents",)).first()
    assert hit.id == "doc_7"


def test_self_query_first(spark, coll):
    q = coll.where("id = 'doc_0'").select(F.lit(0).alias("query_id"), "embedding")
    res = kn.knn(coll, q, 3, "cosine", dim=DIM).orderBy("rank").collect()
    assert len(res) == 3 and res[0].id == "doc_0"


@pytest.mark.parametrize("where", [{"shelf": "poetry"}, {"pages": 110}, {"shelf": {"$in": ["travel", "none"]}},
                                   {"pages": {"$gt": 200}}, {"$or": [{"pages": {"$lt": 70}}, {"shelf": "drama"}]}])
def test_filters_hold_on_every_row(spark, coll, where):
    pred = compile_where(where, coll.columns)
    q = coll.where("id = 'doc_0'").select(F.lit(0).alias("query_id"), "embedding")
    hits = kn.knn(coll.where(pred), q, 10, dim=DIM).select("id")
    rows = coll.join(hits, "id", "left_semi").select(
        F.try_variant_get("metadata", "$.shelf", "string").alias("c"),
        F.try_variant_get("metadata", "$.pages", "bigint").alias("p")).collect()
    assert rows
    for r in rows:
        assert coll.sparkSession.createDataFrame([(r.c, r.p)], "shelf string, pages bigint").where(
            compile_where(where, ["shelf", "pages"])).count() == 1


def test_get_delete(spark, coll):
    assert [r.id for r in co.get_by_ids(coll, ["doc_3"]).collect()] == ["doc_3"]
    assert co.get_by_ids(coll, ["nope"]).count() == 0
    assert [r.id for r in co.missing_ids(coll, ["doc_3", "nope"]).collect()] == ["nope"]
    left = co.delete_by_ids(coll, ["doc_1", "doc_2", "doc_3"])
    assert left.count() == 7 and co.get_by_ids(left, ["doc_2"]).count() == 0
    assert co.delete_by_ids(left, ["doc_1", "doc_2", "doc_3"]).count() == 7  # deleting twice = once
    assert co.delete_by_ids(coll, []).count() == 10


def test_update_merges_metadata(spark, coll):
    upd = spark.createDataFrame([("doc_0", "Second edition", '{"shelf": "lent", "reader": "x"}'),
                                 ("ghost", "t", None)], "id string, text string, m string") \
        .select("id", "text", F.parse_json("m").alias("metadata"))
    out, status = co.update_documents(coll, upd, DIM)
    r = out.where("id = 'doc_0'").select(
        "text", F.try_variant_get("metadata", "$.shelf", "string").alias("c"),
        F.try_variant_get("metadata", "$.reader", "string").alias("n"),
        F.try_variant_get("metadata", "$.isbn", "string").alias("s")).first()
    assert (r.text, r.c, r.n, r.s) == ("Second edition", "lent", "x", "978000")
    assert {s.id: s.updated for s in status.collect()} == {"doc_0": True, "ghost": False}
    assert out.count() == 10


def test_updates_of_one_id_follow_each_other(spark):
    """Three updates of one id: fields add up in order, the row stays one, and promoted columns follow."""
    coll = _rows(spark, 3).withColumn("shelf", F.try_variant_get("metadata", "$.shelf", "string"))
    upd = spark.createDataFrame(
        [("doc_1", "third", '{"shelf": "attic"}', 3), ("doc_1", "first", '{"a": 1, "b": 1}', 1), ("doc_1", None, '{"b": 2}', 2)],
        "id string, text string, m string, seq int").select("id", "text", F.parse_json("m").alias("metadata"), "seq")
    out, status = co.update_documents(coll, upd, DIM)
    assert out.count() == 3 and status.count() == 3
    row = out.where(compile_where({"shelf": "attic"}, out.columns)).first()
    assert (row.id, row.text) == ("doc_1", "third")
    assert out.where("id = 'doc_1'").select(F.to_json("metadata")).first()[0] == (
        '{"a":1,"b":2,"isbn":"978001","langs":"[\\"en\\"]","pages":85,"shelf":"attic"}')
    assert out.where("shelf = 'poetry'").count() == 2


def test_an_empty_object_starts_anew(spark):
    """Metadata of updates in turn: an empty object replaces what was there, later fields follow it."""
    coll = _rows(spark, 3).withColumn("shelf", F.try_variant_get("metadata", "$.shelf", "string"))
    upd = spark.createDataFrame(
        [("doc_0", '{"a": 1}', 1), ("doc_0", "{}", 2), ("doc_0", '{"b": 2, "c": null}', 3), ("doc_0", '{"b": 3}', 4), ("doc_0", None, 5),
         ("doc_1", '{"shelf": "x"}', 1), ("doc_1", "{}", 2)],
        "id string, m string, seq int").select("id", F.parse_json("m").alias("metadata"), "seq")
    out, _ = co.update_documents(coll, upd, DIM)
    got = {r.id: (r.m, r.shelf) for r in out.select("id", F.to_json("metadata").alias("m"), "shelf").collect()}
    assert got["doc_0"] == ('{"b":3,"c":null}', "poetry") and got["doc_1"] == ("{}", None)


def test_one_id_with_very_many_updates(spark):
    """Fields of one id meet by field, after partial sums: no list of its updates is made."""
    coll = _rows(spark, 3)
    upd = spark.range(40_000).repartition(8).select(
        F.lit("doc_1").alias("id"), F.concat(F.lit("t"), "id").alias("text"), F.to_variant_object(F.struct(F.col("id").alias("n"))).alias("metadata"),
        F.col("id").alias("seq"))
    folded = co.folded_updates(upd.select("id", F.col("seq").alias("_u_seq"), F.col("text").alias("_u_text"),
                                          F.lit(None).cast("array<float>").alias("_u_emb"), F.col("metadata").alias("_u_meta")))
    row = folded.select("_u_text", F.size("_u_fields").alias("n")).collect()
    assert [(r._u_text, r.n) for r in row] == [("t39999", 1)]
    out, _ = co.update_documents(coll, upd, DIM)
    assert out.where("text = 't39999' and try_variant_get(metadata, '$.n', 'bigint') = 39999").count() == 1


def test_change_segments(spark, coll, scratch):
    """Updates and deletes write what they change; reading, adding anew and compacting see the same rows."""
    store = CollectionStore(spark, scratch, "changes", DIM)
    store.commit(coll)
    upd = spark.createDataFrame([("doc_2", "new two"), ("ghost", "x"), ("doc_3", "new three")], "id string, text string")
    status = {r.id: r.reason for r in store.update(upd).collect()}
    assert status == {"doc_2": None, "doc_3": None, "ghost": "not_found"}
    assert spark.read.parquet(f"{store.path}/snapshots/{store.segments()[-1]}").count() == 2
    store.delete(spark.createDataFrame([("doc_3",), ("doc_4",), ("nobody",), (None,)], "id string"))
    texts = {r.id: r.text for r in store.read().collect()}
    assert set(texts) == {f"doc_{i}" for i in range(10)} - {"doc_3", "doc_4"} and texts["doc_2"] == "new two"
    store.append(coll.where("id = 'doc_4'"))
    store.update(spark.createDataFrame([("doc_2", "newer two")], "id string, text string"))
    live = {(r.id, r.text) for r in store.read().collect()}
    assert ("doc_2", "newer two") in live and "doc_4" in dict(live) and len(live) == 9
    store.compact()
    assert len(store.segments()) == 1 and {(r.id, r.text) for r in store.read().collect()} == live
    assert store.update(spark.createDataFrame([], "id string, text string")).count() == 0 and len(store.segments()) == 1


@pytest.mark.parametrize("where,ids", [
    ({"n": {"$gt": 0}}, "abd"), ({"n": 1}, "b"), ({"n": {"$in": [1, 0.5]}}, "ab"), ({"n": "2"}, "c"), ({"n": 2}, "d"),
    ({"n": True}, "e"), ({"my.key": "k"}, "a"), ({"n": {"$nin": ["2", 0.5]}}, "bde"),
])
def test_filters_compare_like_with_like(spark, where, ids):
    rows = [("a", '{"n": 0.5, "my.key": "k"}'), ("b", '{"n": 1}'), ("c", '{"n": "2"}'), ("d", '{"n": 2}'), ("e", '{"n": true}'),
            ("f", "{}")]
    df = spark.createDataFrame(rows, "id string, m string").select("id", F.parse_json("m").alias("metadata"))
    assert "".join(sorted(r.id for r in df.where(compile_where(where, df.columns)).collect())) == ids


def test_lookup_opens_only_files_that_can_hold_the_ids(spark, scratch):
    rows = spark.range(4_000).select(F.md5(F.col("id").cast("string")).alias("id"), F.concat(F.lit("text "), "id").alias("text"),
                                     F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("embedding"),
                                     F.to_variant_object(F.struct(F.col("id").alias("n"))).alias("metadata"))
    store = CollectionStore(spark, scratch, "files", 2)
    store.commit(rows, partitions=20, cluster=True)
    text_of = {r.id: r.text for r in rows.collect()}
    some = sorted(text_of)[5::400]
    assert len(some) == 10
    files = store.files_with(some)
    assert sum(map(len, files.values())) <= 10 < len(store.read().inputFiles())
    found = store.lookup([*some, some[0], "nobody", None])
    assert {r.id: r.text for r in found.collect()} == {i: text_of[i] for i in some} and found.count() == 10
    assert len(found.inputFiles()) <= 10
    assert not store.files_with(["zz"]) and store.lookup(["zz"]).count() == 0 and store.lookup([]).count() == 0

    store.update(spark.createDataFrame([(some[0], "new")], "id string, text string"))
    store.delete(spark.createDataFrame([(some[1],)], "id string"))
    store.append(rows.where(F.col("id") == some[1]).withColumn("text", F.lit("back")))
    store.delete(spark.createDataFrame([(some[2],)], "id string"))
    want = {**{i: text_of[i] for i in some[3:]}, some[0]: "new", some[1]: "back"}
    assert {r.id: r.text for r in store.lookup(some).collect()} == want
    store.compact()
    assert {r.id: r.text for r in store.lookup(some).collect()} == want


def test_metadata_keys_are_read_from_their_own_columns(spark, scratch):
    """A filter on a key that is no column reads that key of the metadata, not the whole object."""
    rows = spark.range(500).select(
        F.concat(F.lit("doc "), "id").alias("id"), F.lit("t").alias("text"), F.array(F.lit(1.0).cast("float")).alias("embedding"),
        F.to_variant_object(F.struct((F.col("id") % 5).alias("weight"), F.md5(F.col("id").cast("string")).alias("blob"))).alias("metadata"))
    store = CollectionStore(spark, scratch, "shredded", 1)
    store.commit(rows)
    hit = store.read().where(compile_where({"weight": 3}, store.read().columns)).select("id")
    assert hit.count() == 100
    plan = hit._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    read = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert len(read) == 1 and "metadata:struct<" in read[0] and "blob" not in plan, plan
    part = [f for f in store.read().inputFiles()][0].removeprefix("file://")
    shredded = {c.path for c in (pq.ParquetFile(part).schema.column(k) for k in range(len(pq.ParquetFile(part).schema)))}
    assert {"metadata.typed_value.weight.typed_value", "metadata.typed_value.blob.typed_value"} <= shredded


def test_peek_profile_stats(spark, coll):
    assert [r.id for r in co.peek(coll, 3).collect()] == ["doc_0", "doc_1", "doc_2"]
    prof = {r.field: r for r in co.metadata_profile(coll).collect()}
    assert set(prof) == {"isbn", "shelf", "pages", "langs"}
    assert prof["isbn"]["count"] == 10 and prof["pages"].types == "int:10" and prof["langs"].types == "str:10"
    assert prof["shelf"].sample_values == "poetry|travel|drama"
    st = co.collection_stats(coll, "test_collection").first()
    assert (st["count"], st.n_fields, st.dimension) == (10, 4, DIM)
    vp = co.verify_population(coll).first()
    assert vp.is_populated and vp.sample_ids == "doc_0|doc_1|doc_2"


def test_store_backup_restore(spark, coll, scratch):
    with pytest.raises(CollectionNotFound):
        CollectionStore(spark, scratch, "missing", create_if_missing=False)
    store = CollectionStore(spark, scratch, "test_collection", DIM)
    store.commit(coll)
    store.append(_rows(spark, 5, "extra", 50))
    assert store.read().count() == 15
    for fmt in ("parquet", "json"):
        path = store.backup(f"{scratch}/backup_{fmt}", fmt)
        target = CollectionStore(spark, scratch, f"restored_{fmt}", DIM)
        target.restore(path)
        a = store.read().select("id", "text", F.to_json("metadata").alias("m")).orderBy("id").collect()
        b = target.read().select("id", "text", F.to_json("metadata").alias("m")).orderBy("id").collect()
        assert a == b
    empty_store = CollectionStore(spark, scratch, "empty", DIM)
    empty_store.commit(coll.limit(0))
    path = empty_store.backup(f"{scratch}/backup_empty")
    with pytest.raises(ValueError):
        CollectionStore(spark, scratch, "target2", DIM).restore(path)


def test_rows_without_id_get_a_content_id(spark, coll):
    bare = _rows(spark, 3, "x", 40).drop("id")
    first = co.add_documents(coll, bare, DIM)
    assert first.added.count() == 3 and first.rejected.count() == 0
    assert co.add_documents(first.collection, bare.withColumn("id", F.lit(None).cast("string")), DIM).added.count() == 0


def test_restore_refuses_another_dimension_or_metric(spark, coll, scratch):
    store = CollectionStore(spark, scratch, "wide", DIM)
    store.commit(coll)
    path = store.backup(f"{scratch}/wide_backup")
    with pytest.raises(ValueError, match="dimension"):
        CollectionStore(spark, scratch, "narrow", DIM // 2).restore(path)


def test_add_shuffles_ids_alone(spark):
    """Rows are not dealt by id unless their id is repeated; repeated and held ones are told apart by ids."""
    held = spark.createDataFrame([("a", "old", [1.0, 0.0])], "id string, text string, embedding array<float>")
    rows = [("a", "new", [1.0, 0.0]), ("b", "b", [0.0, 1.0]), ("c", "two", [1.0, 1.0]), ("c", "one", [2.0, 1.0]), ("c", None, [3.0, 1.0]),
            ("d", "bad", [1.0]), ("a", "again", [1.0, 2.0]), ("d", "fine", [1.0, 3.0])]
    new = spark.createDataFrame(rows, held.schema)
    got = co.add_documents(held, new, 2)
    assert sorted((r.id, r.text) for r in got.added.collect()) == [("b", "b"), ("c", "one"), ("d", "fine")]
    assert got.collection.count() == 4 and [r.reason for r in got.rejected.collect()] == ["dimension_mismatch:1"]
    for some, n in ((new.where("id != 'c'"), 2), (new.where("id = 'b'"), 1), (new.where("id = 'a'"), 0)):
        added = co.add_documents(held, some, 2).added
        plan = added._jdf.queryExecution().executedPlan().toString()
        assert added.count() == n and "hashpartitioning" not in plan and "Window" not in plan
