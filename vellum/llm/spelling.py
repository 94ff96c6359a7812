"""Spelling variants of words by blocked Gram matrices.

Words are counted over all texts (JVM functions, partial sums before the exchange). Two words are near if
they differ by exactly one inserted, deleted or replaced code point. For the counts of their letters
this means a squared distance of at most two, and lengths that differ by one at most.

Blocks hold the words of one length whose letters fall on ``GROUPS`` groups of the alphabet in equal
numbers. One edit moves one letter from a group to another, or adds one to a group, so near words lie in
the same block or in adjacent ones, and only those are compared: all pairs of a block and its
neighbours have their squared distances from the NumPy product of the blocks' letter-count matrices
(``|a|^2 + |b|^2 - 2ab``), pairs above two go, the rest is verified letter by letter. A block that
holds much is dealt to tiles by a hash. A tile meets those it is compared with one after the other, so that two are held at
a time, whatever the vocabulary; no pair is lost and none is emitted but the near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.merkle import crc32_sql
from vellum.llm.shared import materialise, prepare

# The letters of words, the shortest word, the divisor of the deletions.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = 5
TILE_WORDS, TILE_LETTERS = 2048, 1 << 21


def words_of(docs: DataFrame, id_col: str, text_col: str, min_length: int, struck: int | None) -> DataFrame:
    """``(word, n)`` of all words of ``min_length`` or more. With ``struck``, a run whose CRC-32 (with the
    id before it) that number divides loses the code point at the CRC-32 modulo its length."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"(?<![{LETTERS}])[{LETTERS}]{{{min_length},}}+"), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if struck:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % struck == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
                      ).otherwise(word)
    return rows.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))


def group_counts(word: Column) -> list[Column]:
    """How many letters of a word fall on each group of the alphabet but the last."""
    alphabet = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
    return [F.length(word) - F.length(F.translate(word, "".join(alphabet[g::GROUPS]), "")) for g in range(GROUPS - 1)]


def neighbours(blocks: DataFrame) -> DataFrame:
    """``(a, ta, b, tb)``: the number and tiles of each block with those of itself and of the blocks after
    it that may hold near words: one letter more in some group, or one letter moved between two."""
    last = GROUPS - 1  # the last group's count follows from the length
    steps = [(0,) * GROUPS]
    for g in range(GROUPS):
        steps.append((1, *(int(g == i) for i in range(last))))
        steps += [(0, *(int(i == g) - int(i == h) for i in range(last))) for h in range(g)]  # from group h to g
    moved = F.explode(F.array(*[F.array(*[F.col("block")[i] + s for i, s in enumerate(step)]) for step in steps])).alias("block")
    other = blocks.select("block", F.col("number").alias("b"), F.col("tiles").alias("tb"))
    return (blocks.select(F.col("number").alias("a"), F.col("tiles").alias("ta"), moved)
            .join(other, "block").drop("block"))


class Tile:
    """Words of one length with their letters and letter counts, ready for products."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        self.words, self.n = words, n
        self.codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        place = np.where(self.codes < 0x80, self.codes - 0x61, self.codes - (0xC0 - 26)).astype(np.int64)
        flat = np.bincount((np.arange(len(words))[:, None] * 90 + place).ravel(), minlength=90 * len(words))
        # Sums of squares of counts stay exact in single precision up to 2^24.
        counts = flat.reshape(-1, 90).astype(np.float32 if self.codes.shape[1] < 2000 else np.float64)
        square = np.einsum("ij,ij->i", counts, counts)[:, None]
        one = np.ones_like(square)
        # left @ right is the negative squared distance; letters that the left words lack add nothing.
        self.used = np.append(np.flatnonzero(counts.any(axis=0)), (90, 91))
        self.left = np.hstack((2 * counts, -square, -one))[:, self.used]
        self.right = np.hstack((counts, one, square)).T


def near_in(a: Tile, b: Tile | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words of two tiles (words of ``b`` as long as those of ``a`` or one longer); pairs
    ``i < j`` of one tile."""
    alone, b = b is None, b or a
    la, lb = a.codes.shape[1], b.codes.shape[1]
    step = max(1, TILE_LETTERS // lb)
    found, right = [], b.right[a.used]
    for at in range(0, len(a.codes), 256):
        i, j = np.divmod(np.flatnonzero(a.left[at:at + 256] @ right >= -2), len(b.codes))
        i += at
        if alone:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), step):
            x, y = i[s:s + step], j[s:s + step]
            if la == lb:
                fits = (a.codes[x] != b.codes[y]).sum(axis=1) == 1
            else:  # equal up to some place, and from there with one letter more
                lead = np.logical_and.accumulate(a.codes[x] == b.codes[y, :-1], axis=1).sum(axis=1)
                tail = np.logical_and.accumulate((a.codes[x] == b.codes[y, 1:])[:, ::-1], axis=1).sum(axis=1)
                fits = lead + tail >= la
            found.append((x[fits], y[fits]))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(a, i, b, j, word, n)`` sorted by these -> ``(a, b, na, nb)`` of near words. A tile's own words
    have ``b`` -1 and so come first; the tiles they are compared with follow one by one, so two tiles
    are held at a time."""
    own: Tile | None = None
    held: list[pa.RecordBatch] = []
    key = None

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal own
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        tile = Tile(table.column("word").combine_chunks(), table.column("n").to_numpy())
        if key[2] == -1:
            own, task = tile, key[:2]
            own.task = task
            x, y = near_in(own)
        elif own is None or own.task != key[:2]:  # a tile without words of its own
            return
        else:
            x, y = near_in(own, tile)
        if len(x):
            yield pa.RecordBatch.from_arrays(
                [own.words.take(pa.array(x)), tile.words.take(pa.array(y)), pa.array(own.n[x]), pa.array(tile.n[y])],
                ["a", "b", "na", "nb"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(4)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(keys[:, s].tolist())
            if now != key:
                yield from closed()
                held, key = [], now
            held.append(batch.slice(s, e - s))
    yield from closed()


def near_pairs(words: DataFrame) -> DataFrame:
    """``words(word, n)``, each word once -> ``(a, b, na, nb)``, each pair of near words once."""
    block = F.array(F.length("word"), *group_counts(F.col("word")))
    keyed = materialise(words.select("word", "n", block.alias("block")), "spelling-blocks")
    size = F.greatest(F.ceil(F.col("n") / TILE_WORDS), F.ceil(F.col("n") * F.col("block")[0] / TILE_LETTERS))
    blocks = materialise(keyed.groupBy("block").agg(F.count("*").alias("n")).select(
        "block", size.cast("int").alias("tiles"), F.monotonically_increasing_id().alias("number")), "spelling-tiles")
    tile = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    dealt = keyed.join(blocks, "block").select(F.col("number").alias("from"), tile.alias("tile"), "word", "n")
    to = neighbours(blocks).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ta") - 1)))
    to = to.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tb") - 1)))
    to = to.where((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
    alone = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    to = materialise(to.select("a", "i", F.when(alone, F.lit(-1)).otherwise(F.col("b")).cast("long").alias("b"), "j",
                               F.col("b").alias("from"), F.col("j").alias("tile")), "spelling-tasks")
    sent = dealt.join(to, ["from", "tile"]).select("a", "i", "b", "j", "word", "n")
    return sent.repartition("a", "i").sortWithinPartitions("a", "i", "b", "j").mapInArrow(
        compare, "a string, b string, na long, nb long")


def roots_of(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """``forms(word, form)`` -> ``(word, root)``, the last word that forms lead to. The steps double every
    round; forms never lead back, as each occurs more often than its word."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for i in range(rounds):
        far = now.select(F.col("word").alias("w"), F.col("root").alias("next"))
        step = materialise(now.join(far, now.root == far.w, "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"spelling-roots{i}")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7,
                    min_count: int = 2, ratio: int = 10, struck: int | None = None) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``min_length`` code points or more that
    occurs ``min_count`` times or more: maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, of
    which only A-Z are lower-cased.

    ``form`` is the near word that occurs most (ties: the smallest in code-point order), if that is at
    least ``ratio`` times as often as the word, else null; ``root`` follows forms to the last, and is the
    word itself without one; ``n_near`` counts the near words. ``struck`` plants spelling errors
    (``words_of``), for checks.

    Null and empty texts have no words; a null id counts as the empty string where ``struck`` reads it;
    repeated rows count as often as they occur; other columns are not read; an empty table gives no rows."""
    prepare(docs.sparkSession)
    words = materialise(words_of(docs, id_col, text_col, min_length, struck).where(F.col("n") >= min_count), "spelling-words")
    pairs = materialise(near_pairs(words), "spelling-pairs")
    ways = pairs.selectExpr("a word", "b other", "nb m").union(pairs.selectExpr("b word", "a other", "na m"))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = words.join(best, "word", "left").withColumn("m", -F.col("best.m"))
    has = F.col("m") >= ratio * F.col("n")
    found = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(has, F.col("best.other")).alias("form"), F.when(has, F.col("m")).alias("form_n")), "spelling-forms")
    roots = roots_of(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql(min_length: int = 7, min_count: int = 2, ratio: int = 10, struck: int = 31) -> str:
    """The same for DuckDB over the ``documents`` view: near words share the word without one letter (at
    the same place of both, or as a whole word)."""
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id::VARCHAR AS id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{UPPER}', '{LOWER}') AS run
  FROM documents
), counted AS (
  SELECT coalesce(id, '') AS id, run, count(*) AS c FROM runs WHERE length(run) >= {min_length} GROUP BY ALL
), hashed AS (
  SELECT run, c, {crc32_sql("x")} AS h FROM (SELECT run, c, hex(encode(id || ':' || run)) AS x FROM counted)
), words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % {struck} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                       ELSE run END AS word FROM hashed)
  WHERE length(word) >= {min_length} GROUP BY word HAVING sum(c) >= {min_count}
), dels AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM dels a JOIN dels b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM dels a JOIN words w ON a.key = w.word
  UNION SELECT w.word, a.word, a.n FROM dels a JOIN words w ON a.key = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, first(other ORDER BY m DESC, other) AS other FROM near GROUP BY word
), found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN other END AS form,
         CASE WHEN m >= {ratio} * n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS here, 0 AS step FROM found
  UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN found f ON f.word = k.here WHERE f.form IS NOT NULL
)
SELECT f.word, form, (SELECT last(here ORDER BY step) FROM walk k WHERE k.word = f.word) AS root, n, n_near, form_n
FROM found f
"""
