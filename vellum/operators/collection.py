"""Collection upkeep (J4) as pure DataFrame functions: append, get, delete, update-merge, count,
ids, peek, metadata profile, statistics and population check.

A collection is any DataFrame with ``id STRING, text STRING, embedding ARRAY<FLOAT>,
metadata VARIANT`` plus optional promoted metadata columns. Id-keyed operations take either a
Python list (compiled to an ``IN`` filter that reaches the Parquet scan) or a DataFrame of ids
(semi/anti join; broadcast only when its measured size is under ``BROADCAST_BYTES``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions import vectors as vx
from vellum.operators.embed import embedding_dimension, materialize

# Largest id / update table joined by broadcast (bytes of its values, summed before the join).
BROADCAST_BYTES = 64 << 20
# ---------------------------------------------------------------------------------------------
# Sample sizes of peek / population check / profile, and type names of the profile.
PEEK_N = 5
VERIFY_SAMPLE_N = 3
PROFILE_SAMPLES = 5
VARIANT_TYPE_NAMES = {"BIGINT": "int", "DOUBLE": "float", "DECIMAL": "float", "FLOAT": "float", "STRING": "str",
                      "BOOLEAN": "bool", "ARRAY": "list", "OBJECT": "dict", "VOID": "NoneType"}
# ---------------------------------------------------------------------------------------------


def _ids_frame(coll: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("string").alias("id"))
    return coll.sparkSession.createDataFrame([(str(i),) for i in ids], "id string")


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df``, with 16 a value for its place in the row."""
    def size(name: str, kind: str) -> Column:
        if kind == "string":
            return F.octet_length(name)
        if kind.startswith("array<") and kind[6:-1] in ("float", "double", "int", "bigint"):
            return F.size(name) * 8
        if kind in ("boolean", "int", "bigint", "float", "double", "timestamp", "date"):
            return F.lit(0)
        return F.octet_length(F.to_json(F.struct(name)))

    total = sum((F.coalesce(size(c, k).cast("bigint"), F.lit(0)) + 16 for c, k in df.dtypes), F.lit(0))
    return df.agg(F.sum(total).alias("n")).first()["n"] or 0


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint only after measuring the (small) side; beyond the bound the join shuffles."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def content_id(text: Column, metadata_json: Column | None = None) -> Column:
    """Deterministic id from content, so importing the same chunk twice is a no-op (D15)."""
    parts = [text] if metadata_json is None else [metadata_json, text]
    return F.sha2(F.concat_ws("\u0000", *parts), 256).substr(1, 32)


# --- S5: append -------------------------------------------------------------------------------


@dataclass
class AddResult:
    collection: DataFrame  # the new collection rows (old + accepted)
    added: DataFrame  # rows that were written
    rejected: DataFrame  # invalid rows with a reason


def add_documents(current: DataFrame, new: DataFrame, dim: int) -> AddResult:
    """Validate dimensions, keep the first row per id within the batch (lowest text), skip ids that
    already exist (the store keeps the first), append. Nothing invalid is written. A row without an id
    (or a frame without the column) gets the content id of its text and metadata. ``new`` is read more than
    once: what is costly to make is to be written first."""
    meta = F.to_json("metadata") if "metadata" in new.columns else F.lit(None).cast("string")
    made = F.when(F.col("text").isNotNull(), content_id(F.col("text"), meta))
    new = new.withColumn("id", F.coalesce("id", made) if "id" in new.columns else made)
    valid_pred = vx.is_valid_vector(F.col("embedding"), dim) & F.col("id").isNotNull()
    rejected = new.where(~valid_pred).select(
        "id", F.coalesce(vx.invalid_reason(F.col("embedding"), dim), F.lit("missing_id")).alias("reason"))
    valid = new.where(valid_pred)
    # Ids alone are shuffled: rows whose id is neither repeated nor held already stay where they are.
    ids = valid.groupBy("id").agg((F.count("*") > 1).alias("_twice"))
    held = current.select("id").join(maybe_broadcast(ids.select("id")), "id", "left_semi").distinct().withColumn("_held", F.lit(True))
    spare = materialize(ids.join(held, "id", "left").where(F.col("_twice") | F.col("_held")))
    added = valid
    if not spare.isEmpty():
        added = valid.join(maybe_broadcast(spare.select("id")), "id", "left_anti")
        again = spare.where(F.col("_twice") & F.col("_held").isNull()).select("id")
        if not again.isEmpty():
            w = Window.partitionBy("id").orderBy(F.col("text").asc_nulls_last())
            first = valid.join(maybe_broadcast(again), "id", "left_semi").withColumn("_rn", F.row_number().over(w))
            added = added.unionByName(first.where("_rn = 1").drop("_rn"))
    added = added.select(*current.columns)
    return AddResult(current.unionByName(added), added, rejected)


# --- M1 / M2: get and delete by id ------------------------------------------------------------------


def get_by_ids(coll: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    if not isinstance(ids, DataFrame):
        return coll.where(F.col("id").isin([str(i) for i in ids])) if ids else coll.limit(0)
    return coll.join(maybe_broadcast(_ids_frame(coll, ids)), "id", "left_semi")


def missing_ids(coll: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    return _ids_frame(coll, ids).distinct().join(coll.select("id"), "id", "left_anti")


def delete_by_ids(coll: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose id is not listed; an empty list is a no-op, unknown ids are ignored."""
    if not isinstance(ids, DataFrame):
        gone = F.coalesce(F.col("id").isin([str(i) for i in ids]), F.lit(False))
        return coll.where(~gone) if ids else coll
    return coll.join(maybe_broadcast(_ids_frame(coll, ids)), "id", "left_anti")


# --- M3: update with merge ------------------------------------------------------------------------


def merge_metadata(old: Column, new: Column) -> Column:
    """new NULL -> old; either side empty -> new; else key-wise merge where new wins."""
    om = old.cast("map<string,variant>")
    nm = new.cast("map<string,variant>")
    merged = F.to_variant_object(F.map_zip_with(om, nm, lambda k, o, n: F.coalesce(n, o)))
    return (
        F.when(new.isNull(), old)
        .when(old.isNull() | (F.size(om) == 0) | (F.size(nm) == 0), new)
        .otherwise(merged)
    )


def folded_updates(u: DataFrame) -> DataFrame:
    """``u(id, _u_seq, _u_text, _u_emb, _u_meta)`` -> one row an id: the last text and vector given; the
    metadata that the updates leave in turn as ``_u_fields`` (key, value), which replaces the old one
    where ``_u_reset`` (an update gave an empty object) and else is merged into it; and the names of all
    fields given. First the last value by (id, field), with partial sums, so that very many updates of
    one id are not gathered; then a row an id, as wide as its fields."""
    fields = F.col("_u_meta").cast("map<string,variant>")
    kind = "struct<kind:int,key:string,value:variant>"
    none = F.lit(None)
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), none.alias("key"), none.alias("value")).cast(kind)),
        F.when(F.size(fields) == 0, F.array(F.struct(F.lit(1).alias("kind"), none.alias("key"), none.alias("value")).cast(kind)))
        .when(F.size(fields) > 0, F.transform(F.map_entries(fields), lambda e: F.struct(
            F.lit(2).alias("kind"), e["key"].alias("key"), e["value"].alias("value"))))
        .otherwise(F.array().cast(f"array<{kind}>")))
    rows = u.select("id", "_u_seq", "_u_text", "_u_emb", F.explode(parts).alias("p")).select("id", "_u_seq", "_u_text", "_u_emb", "p.*")

    def last(c: str) -> Column:
        return F.max_by(c, F.when((F.col("kind") == 0) & F.col(c).isNotNull(), F.col("_u_seq"))).alias(c)

    by_field = rows.groupBy("id", "kind", "key").agg(
        last("_u_text"), last("_u_emb"), F.max_by("value", "_u_seq").alias("value"), F.max("_u_seq").alias("seq"))
    by_id = by_field.groupBy("id").agg(
        F.max_by("_u_text", F.when(F.col("kind") == 0, F.lit(1))).alias("_u_text"),
        F.max_by("_u_emb", F.when(F.col("kind") == 0, F.lit(1))).alias("_u_emb"),
        F.max(F.when(F.col("kind") == 1, F.col("seq"))).alias("reset"),
        F.collect_list(F.when(F.col("kind") == 2, F.struct("key", "seq", "value"))).alias("fields"))
    left = F.filter("fields", lambda e: F.col("reset").isNull() | (e["seq"] > F.col("reset")))
    return by_id.select("id", "_u_text", "_u_emb", F.col("reset").isNotNull().alias("_u_reset"),
                        left.alias("_u_fields"), F.transform("fields", lambda e: e["key"]).alias("_u_named"))


def update_documents(coll: DataFrame, updates: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Apply ``updates(id, text?, embedding?, metadata?, seq?)``: NULL means "keep". Updates of one id are
    applied in the order of ``seq`` (of the frame's rows without it), each to what the one before left.
    Returns ``(collection, status)`` with ``status(id, updated, reason)``, one row per update; unknown
    ids are not applied and an embedding of the wrong length rejects that update. Columns of the
    collection that carry a metadata field are kept in step with it."""
    cols = set(updates.columns)
    u = updates.select(
        "id",
        (F.col("seq") if "seq" in cols else F.monotonically_increasing_id()).alias("_u_seq"),
        (F.col("text") if "text" in cols else F.lit(None).cast("string")).alias("_u_text"),
        (F.col("embedding") if "embedding" in cols else F.lit(None).cast("array<float>")).alias("_u_emb"),
        (F.col("metadata") if "metadata" in cols else F.lit(None).cast("variant")).alias("_u_meta"),
    )
    u = materialize(u)  # read for the rows and for the status
    bad_dim = F.col("_u_emb").isNotNull() & ~vx.is_valid_vector(F.col("_u_emb"), dim)
    known = coll.select(F.col("id").alias("_id"))
    status = u.join(known, F.col("id") == F.col("_id"), "left").select(
        "id",
        (F.col("_id").isNotNull() & ~bad_dim).alias("updated"),
        F.when(F.col("_id").isNull(), F.lit("not_found")).when(bad_dim, F.lit("dimension_mismatch")).alias("reason"),
    )
    good = folded_updates(u.where(~bad_dim))
    joined = coll.join(maybe_broadcast(materialize(good)), "id", "left")
    if "metadata" in coll.columns:
        given = F.map_from_entries(F.transform("_u_fields", lambda e: F.struct(e["key"], e["value"])))
        fields = F.to_variant_object(given)
        merged = (F.when(F.col("_u_fields").isNull() | (~F.col("_u_reset") & (F.size("_u_fields") == 0)), F.col("metadata"))
                  .when(F.col("_u_reset"), fields).otherwise(merge_metadata(F.col("metadata"), fields)))
        joined = joined.withColumn("_merged", merged)

    def updated(c: str) -> Column:
        if c == "text":
            return F.coalesce("_u_text", "text").alias("text")
        if c == "embedding":
            return F.coalesce("_u_emb", "embedding").alias("embedding")
        if c == "metadata":
            return F.col("_merged").alias("metadata")
        kind = coll.schema[c].dataType.simpleString()
        if c != "id" and "metadata" in coll.columns and kind in ("string", "int", "bigint", "float", "double", "boolean"):
            held = F.try_variant_get(F.col("_merged"), "$['%s']" % c.replace("'", "\\'"), kind)
            return F.when(F.array_contains("_u_named", c), held).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return joined.select(*[updated(c) for c in coll.columns]), status


# --- M4-M6: count, ids, peek -------------------------------------------------------------------------


def count_rows(coll: DataFrame) -> DataFrame:
    return coll.agg(F.count(F.lit(1)).alias("count"))


def list_ids(coll: DataFrame) -> DataFrame:
    return coll.select("id")


def peek(coll: DataFrame, n: int = PEEK_N) -> DataFrame:
    """First ``n`` rows by id (deterministic), with text and metadata."""
    return coll.select("id", "text", "metadata").orderBy("id").limit(n)


# --- M7-M9: profile, statistics, population check ------------------------------------------------------


def variant_type_name(v: Column) -> Column:
    base = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    mapping = F.create_map(*[x for kv in VARIANT_TYPE_NAMES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(mapping, base), F.lower(base))


def metadata_entries(coll: DataFrame, metadata_col: str = "metadata") -> DataFrame:
    """Long form ``(id, field, type, value_str)`` of every metadata key of every row."""
    kv = coll.select("id", F.explode(F.col(metadata_col).cast("map<string,variant>")).alias("field", "value"))
    return kv.select("id", "field", variant_type_name(F.col("value")).alias("type"),
                     F.col("value").cast("string").alias("value_str"))


def metadata_profile(coll: DataFrame, samples: int = PROFILE_SAMPLES) -> DataFrame:
    """Per field: presence count, per-type counts ('type:n' sorted by type), and up to ``samples``
    distinct values in first-seen (lowest id) order. Two partial/final aggregations; the sample
    step keeps one row per distinct (field, value) before ranking, never a whole group."""
    e = metadata_entries(coll)
    by_type = e.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"))
    types = by_type.groupBy("field").agg(
        F.sum("n").alias("count"),
        F.array_join(F.array_sort(F.collect_list(F.concat("type", F.lit(":"), F.col("n").cast("string")))), ",")
        .alias("types"),
    )
    firsts = e.groupBy("field", "value_str").agg(F.min("id").alias("first_id"))
    w = Window.partitionBy("field").orderBy("first_id", "value_str")
    top = firsts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= samples)
    sample = top.groupBy("field").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "value_str"))), lambda s: s["value_str"]),
                     "|").alias("sample_values"))
    return types.join(sample, "field", "left").select(F.col("count").cast("bigint").alias("count"), "field", "types",
                                                      "sample_values")


def one_row_join(*frames: DataFrame) -> DataFrame:
    """Side-by-side combination of single-row aggregates (each provably one row, so broadcast)."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(F.broadcast(f.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def collection_stats(coll: DataFrame, name: str) -> DataFrame:
    """One row: name, count, metadata fields (their number, and ``field=count (types)`` of each), and the
    dimension as the length of the first vector met."""
    dim = embedding_dimension(coll)
    profile = metadata_profile(coll)
    one = F.concat("field", F.lit("="), F.col("count").cast("string"), F.lit(" ("), "types", F.lit(")"))
    fields = profile.agg(F.count("*").alias("n_fields"), F.array_join(F.array_sort(F.collect_list(one)), "; ").alias("fields"))
    return one_row_join(count_rows(coll), fields).select(
        F.lit(name).alias("name"), F.col("count").cast("bigint").alias("count"), F.col("n_fields").cast("bigint").alias("n_fields"),
        "fields", F.lit(dim).cast("int").alias("dimension"))


def verify_population(coll: DataFrame, n: int = VERIFY_SAMPLE_N) -> DataFrame:
    """``(is_populated, count, fields, sample_ids, sample_previews, sample_metadata)`` in one row; the
    metadata of a sample row is ``key=value`` by key."""
    stats = coll.agg(F.count(F.lit(1)).alias("count"))
    fields = metadata_entries(coll).agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    entries = F.array_sort(F.map_entries(F.col("metadata").cast("map<string,string>")))
    meta = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")
    sample = coll.select("id", tx.preview("text", 100).alias("p"), meta.alias("m")).orderBy("id").limit(n).agg(
        F.array_sort(F.collect_list(F.struct("id", "p", "m"))).alias("s"))

    def samples(c: str) -> Column:
        return F.array_join(F.transform("s", lambda x: x[c]), "|")

    return one_row_join(stats, fields, sample).select(
        (F.col("count") > 0).alias("is_populated"),
        F.col("count").cast("bigint").alias("count"),
        F.coalesce("fields", F.lit("")).alias("fields"),
        samples("id").alias("sample_ids"), samples("p").alias("sample_previews"), samples("m").alias("sample_metadata"),
    )
