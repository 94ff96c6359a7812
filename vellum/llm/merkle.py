"""Merkle manifest of a table by nested-interval labels.

Every row is a leaf. Within a group (a language) leaves ascend by id and get a rank; a node covers the
interval ``[lo, hi)`` of leaf ranks, a leaf ``[rank, rank + 1)``. While a group has several nodes, every
``FAN`` consecutive ones become their hash one level up. The groups' roots, ascending by group, are the
leaves of one more tree, whose root stands for the table.

Ancestors are attached from the top down. On each level nodes and their would-be parents are bucketed
by ``lo div FAN**level`` and joined where the parent's interval contains the node's. What is left
of the parent's interval without the node's own identifies the siblings, those below it on the left
and those above it on the right, and so one step of the path; the parent's path follows it. A bucket
holds at most ``FAN`` nodes and one parent, however large a group is, so no group is gathered.

Ranks come from one range exchange over (group, id, leaf) and the counts of its partitions. A number
of the row in the input breaks ties, so that many equal rows spread over partitions too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import materialise, prepare

FAN = 8
ENTRY = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """One input of a leaf: ``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_of(value: Column) -> Column:
    return F.lower(F.hex(value))


def joined(items: Column, part) -> Column:
    """The binaries ``part`` gives of each item, one after the other."""
    return F.aggregate(items, F.lit(bytearray()), lambda acc, x: F.concat(acc, part(x)))


def bucket(lo: Column, level: int) -> Column:
    return F.floor(lo / F.lit(FAN**level))


def width(n: Column, level: int) -> Column:
    """Nodes on a level of a tree of ``n`` leaves."""
    return F.floor((n + (FAN**level - 1)) / F.lit(FAN**level))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows(tree, ...)`` with ``lo``, the place in the tree's order (from 0), and ``n``, the tree's rows."""
    placed = materialise(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                         .withColumn("mid", F.monotonically_increasing_id()), f"merkle-{name}-order")
    placed = placed.withColumn("part", F.shiftright("mid", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("mid").alias("first"), F.count("*").alias("n_run"))
    own = Window.partitionBy("tree")
    before = F.sum("n_run").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n_run").over(own).alias("n"))
    return materialise(placed.join(runs, ["tree", "part"])
                       .withColumn("lo", F.col("mid") - F.col("first") + F.col("before")).drop("mid", "part", "first", "before"),
                       f"merkle-{name}-ranks")


def levels_of(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The levels ``(tree, lo, hi, n, digest, children)`` over ``leaves(tree, lo, n, digest)``, leaves first
    (without children) and as many as the largest tree needs."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "n", "digest")]
    while most > 1:
        below, k = levels[-1], len(levels)
        nodes = (below.where(width(F.col("n"), k - 1) > 1)
                 .groupBy("tree", bucket(F.col("lo"), k).alias("bucket"))
                 .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"),
                      F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children")))
        digest = digest_of(hex_of(joined(F.col("children"), lambda x: x["digest"])))
        levels.append(materialise(nodes.select("tree", "lo", "hi", "n", digest.alias("digest"), "children"), f"merkle-{name}-level{k}"))
        most = -(-most // FAN)
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """``(tree, digest)`` of the one node left of each tree."""
    parts = [nodes.where((width(F.col("n"), k) == 1) & (width(F.col("n"), k - 1) > 1 if k else F.lit(True)))
             .select("tree", "digest") for k, nodes in enumerate(levels)]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def contained(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """``nodes`` of ``level`` with ``path`` and ``above``, by the parent whose interval contains theirs."""
    up = parents.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                        bucket(F.col("lo"), level + 1).alias("p_bucket"), "kids", F.col("path").alias("p_path"), "above")
    inside = ((F.col("tree") == F.col("p_tree")) & (bucket(F.col("lo"), level + 1) == F.col("p_bucket"))
              & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
    left = F.filter("kids", lambda x: (x["lo"] >= F.col("p_lo")) & (x["hi"] <= F.col("lo")))
    right = F.filter("kids", lambda x: (x["lo"] >= F.col("hi")) & (x["hi"] <= F.col("p_hi")))
    step = F.struct(joined(left, lambda x: x["digest"]).alias("left"), joined(right, lambda x: x["digest"]).alias("right"))
    return (nodes.join(up, inside).withColumn("path", F.concat(F.array(step), F.col("p_path")))
            .drop("p_tree", "p_lo", "p_hi", "p_bucket", "p_path", "kids"))


def with_paths(levels: list[DataFrame], leaves: DataFrame, top: DataFrame, name: str) -> DataFrame:
    """``leaves`` with ``path``, the steps from the leaf to the root that ``top(tree, path, above)`` leads to."""
    top = top.select(F.col("tree").alias("t_tree"), "path", "above")
    parents = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k] if k else leaves
        alone = nodes.where(width(F.col("n"), k) == 1).join(top, F.col("tree") == F.col("t_tree")).drop("t_tree")
        if parents is None:
            found = alone
        else:
            up = parents.withColumnRenamed("children", "kids")
            found = alone.unionByName(contained(nodes.where(width(F.col("n"), k) > 1), up, k))
        parents = materialise(found, f"merkle-{name}-paths{k}") if k else found
    return parents


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                    id_col: str = "doc_id", group_col: str = "lang", altered: dict[str, Column] | None = None,
                    altered_where: Column | None = None) -> DataFrame:
    """``(id, tree, leaf, altered_leaf, subroot, root, path)`` for every row of ``docs``; digests are
    binary, and ``path`` has a ``(left, right)`` pair of joined sibling digests for each level from the
    leaf over its group's root to the table's root.

    ``altered`` gives other values of some columns for rows where ``altered_where`` holds;
    ``altered_leaf`` is the leaf with these (null for other rows, also where the condition is null).

    A null in any column hashes as ``-``; a null group is a group of its own, before all others; null ids
    come first in their group. Rows of equal id are ordered by leaf; equal rows have a leaf each. Columns
    that are not named are not read. A group of one row has its leaf as root, a table of one group that
    group's root; an empty table gives no rows."""
    prepare(docs.sparkSession)
    altered = altered or {}
    other = F.when(altered_where, digest_of(F.concat(*[field(altered.get(c, F.col(c))) for c in columns]))) \
        if altered_where is not None else F.lit(None).cast("binary")
    group = F.col(group_col).cast("string")
    leaves = materialise(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("tree"),  # null sorts first
        digest_of(F.concat(*[field(F.col(c)) for c in columns])).alias("digest"), other.alias("altered_leaf"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    leaves = ranked(leaves, ["id", "digest", "row"], "leaf").drop("row")
    levels = levels_of(leaves, "group")
    subroots = materialise(roots_of(levels), "merkle-subroots")
    tops = ranked(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], "top")
    top_levels = levels_of(tops, "top")
    root = roots_of(top_levels).select(F.col("tree"), F.array().cast(ENTRY).alias("path"), F.col("digest").alias("above"))
    to_root = with_paths(top_levels, tops.withColumn("hi", F.col("lo") + 1), root, "top")
    top = materialise(to_root.select(F.col("group").alias("tree"), "path",
                                     F.struct(F.col("digest").alias("subroot"), F.col("above").alias("root")).alias("above")), "merkle-tops")
    found = with_paths(levels, leaves.withColumn("hi", F.col("lo") + 1), top, "group")
    return found.select("id", "tree", F.col("digest").alias("leaf"), "altered_leaf", F.col("above.subroot").alias("subroot"),
                        F.col("above.root").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: digest_of(hex_of(F.concat(x["left"], acc, x["right"]))))


def proofs(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``-like rows as hex digests, with the proof of every leaf folded again
    from a copy whose text is lower-cased (A-Z only) where 3 divides the CRC-32 of the decimal id:
    ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``.

    Rows with a null id or text are not altered; a text without A-Z is altered to itself and verifies.
    Otherwise as ``merkle_manifest``."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = merkle_manifest(docs, altered={"text": lower}, altered_where=struck)
    siblings = joined(F.col("path"), lambda x: F.concat(x["left"], x["right"]))
    out = rows.select(F.col("id").cast("long").alias("doc_id"), hex_of(F.col("leaf")).alias("leaf"),
                      hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
                      F.sha2(hex_of(siblings), 256).alias("proof_sha256"),
                      hex_of(folded(F.coalesce("altered_leaf", "leaf"), F.col("path"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen({value}), ':', {value}) END"


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(map(_field_sql, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + "))"


def crc32_sql(hexed: str) -> str:
    """CRC-32 of the bytes that the expression ``hexed`` gives in hex, bit by bit."""
    byte = f"CASE WHEN i % 8 = 0 THEN ('0x' || substr({hexed}, (i // 4 + 1)::BIGINT, 2))::BIGINT ELSE 0 END"
    return (f"xor(list_reduce(range(0, 4 * length({hexed})), lambda a, i: "
            f"xor(xor(a, {byte}) >> 1, 3988292384 * (xor(a, {byte}) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)")


# The same digests for DuckDB over the ``documents`` view: trees and foldings as recursive queries.
ORACLE_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT *, coalesce(
    CASE WHEN {crc32_sql("hex(encode(doc_id::VARCHAR))")} % 3 = 0 THEN
      {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END, leaf) AS other
  FROM (SELECT doc_id, coalesce('=' || lang, '-') AS tree, text, source, lang, n_chars, {_leaf_sql("text")} AS leaf
        FROM documents)
), placed AS (
  SELECT doc_id, tree, leaf, other, row_number() OVER () AS rid, count(*) OVER (PARTITION BY tree) AS n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaf
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 7) // 8)
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 7) // 8)
  FROM tops WHERE n > 1 GROUP BY level, pos // 8
), fold AS (
  SELECT rid, tree, 0 AS level, pos, other AS acc, '' AS proof, n FROM placed
  UNION ALL
  SELECT f.rid, f.tree, f.level + 1, f.pos // 8,
         sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.acc ELSE t.digest END, '' ORDER BY t.pos)),
         any_value(f.proof) || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos <> f.pos), ''),
         any_value((f.n + 7) // 8)
  FROM fold f JOIN nodes t ON t.tree = f.tree AND t.level = f.level AND t.pos // 8 = f.pos // 8
  WHERE f.n > 1 GROUP BY f.rid, f.tree, f.level, f.pos
), last AS (
  SELECT f.rid, 0 AS level, s.pos, f.acc, f.proof, s.digest AS subroot, s.n
  FROM fold f JOIN subroots s ON s.tree = f.tree WHERE f.n = 1
  UNION ALL
  SELECT f.rid, f.level + 1, f.pos // 8,
         sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.acc ELSE t.digest END, '' ORDER BY t.pos)),
         any_value(f.proof) || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos <> f.pos), ''),
         any_value(f.subroot), any_value((f.n + 7) // 8)
  FROM last f JOIN tops t ON t.level = f.level AND t.pos // 8 = f.pos // 8
  WHERE f.n > 1 GROUP BY f.rid, f.level, f.pos
)
SELECT p.doc_id, p.leaf, l.subroot, r.digest AS root, sha256(l.proof) AS proof_sha256, l.acc AS folded_root,
       l.acc = r.digest AS verified
FROM placed p JOIN last l ON l.rid = p.rid AND l.n = 1, tops r WHERE r.n = 1
"""
