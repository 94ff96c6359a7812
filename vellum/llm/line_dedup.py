"""Line removal by the spread of a line over sites.

A line is what stands between line ends, without blanks round it; empty lines do not count. Every line
is known by two 64-bit hashes. An aggregation by line merges HyperLogLog sketches of its sites; where
the estimate is so near ``min_sites`` that the sketch's error could decide, the distinct sites are
counted exactly. A line on ``min_sites`` sites or more is boilerplate: its first occurrence (smallest
id, then place) stays, all others go, on every site. Other lines are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import free_names, materialise, prepare

LG_K = 12


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``(id, th, pos, h1, h2, site)`` of every line; ``th`` is a hash of the text, and the hashes of an
    empty line are null. A null site is a site of its own; null text has no lines."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                       F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
                       F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    line = F.trim("line")
    rows = rows.select("id", "th", "site", "pos", F.when(line != "", line).alias("line"))
    return rows.select("id", "th", "pos", F.when(F.col("line").isNotNull(), F.xxhash64("line")).alias("h1"),
                       F.when(F.col("line").isNotNull(), F.xxhash64(F.lit(1), "line")).alias("h2"), "site")


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(h1, h2, first)`` of the lines on at least ``min_sites`` distinct sites; ``first`` is the
    smallest ``(id, th, pos)``."""
    known = lines.where("h1 is not null")
    sketched = (known.groupBy("h1", "h2")
                .agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("id", "th", "pos")).alias("first"),
                     F.min("site").alias("low"), F.max("site").alias("high"))
                .where("low <> high or 1 >= " + str(min_sites))  # one site alone needs no sketch
                .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    sketched = materialise(sketched, "lines-sketched")
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(1 << LG_K) * min_sites))  # four standard errors
    near = sketched.where((F.col("sites") >= min_sites - margin) & (F.col("sites") <= min_sites + margin))
    exact = (known.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
             .select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact")))
    counted = near.join(exact, ["h1", "h2"]).where(F.col("exact") >= min_sites)
    sure = sketched.where(F.col("sites") > min_sites + margin)
    return sure.select("h1", "h2", "first").unionByName(counted.select("h1", "h2", "first"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
             min_sites: int = 3) -> DataFrame:
    """``(id, th, gone, n)`` of every document that loses lines: ``gone`` has a flag, "1" for a line that goes,
    for each of its lines up to the last of them, ``n`` counts them."""
    prepare(docs.sparkSession)
    lines = materialise(occurrences(docs, id_col, text_col, site_col), "lines")
    spread = materialise(spread_lines(lines, min_sites), "lines-spread")
    own = lines.join(spread, ["h1", "h2"], "left")
    gone = F.col("first").isNotNull() & ~F.struct("id", "th", "pos").eqNullSafe(F.col("first"))
    hit = materialise(own.where(gone).select("id", "th", "pos").distinct(), "lines-gone")
    # One flag a line up to the last that goes, in one text: a line's flag is a character of it.
    per_doc = hit.groupBy("id", "th").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    gaps = F.transform("at", lambda p, i: F.concat(
        F.repeat(F.lit("0"), p - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.lit("1")))
    return per_doc.select("id", "th", F.split(F.array_join(gaps, ""), "").alias("gone"), F.size("at").cast("long").alias("n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = 3, removed_col: str | None = None) -> DataFrame:
    """``docs`` with all its columns, its boilerplate lines taken out of ``text_col`` (and ``n_chars``, if
    there is one, set to the new length of changed texts). A document whose lines all go keeps its
    row with an empty text. Rows with equal id and text count as one document and change alike; a null
    id sorts first; an empty table gives no rows; columns of any name are kept. ``removed_col`` adds the number of lines taken out."""
    i, t, g, n, h, fresh_text = free_names(docs, "__id", "__th", "__gone", "__n", "__h", "__new")
    gone = removals(docs, id_col, text_col, site_col, min_sites).select(
        F.col("id").alias(i), F.col("th").alias(t), F.col("gone").alias(g), F.col("n").alias(n))
    own = docs.withColumn(h, F.xxhash64(text_col))
    joined = own.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, k: F.coalesce(F.get(g, k), F.lit("0")) != "1")
    hit = F.col(g).isNotNull()
    fresh = joined.withColumn(fresh_text, F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(fresh_text).alias(c))
        elif c == "n_chars":
            columns.append(F.when(hit, F.length(fresh_text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    if removed_col:
        columns.append(F.coalesce(n, F.lit(0)).cast("long").alias(removed_col))
    return fresh.select(*columns)


# The same rule with exact site counts, for DuckDB over the ``documents`` view.
ORACLE_SQL = """
WITH line AS (
  SELECT doc_id, source, pos, trim(parts[pos], ' ') AS line, parts[pos] AS raw
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))
), spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM line WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= 3
), flagged AS (
  SELECT l.*, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone
  FROM line l LEFT JOIN spread s ON l.line = s.line
)
SELECT doc_id, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM flagged GROUP BY doc_id
"""
