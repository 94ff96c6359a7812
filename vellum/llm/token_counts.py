"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to the
per-document pre-token frequencies.

The tokenizer is a byte-level BPE file of the ``tokenizers`` library whose pre-tokeniser is the usual
``ByteLevel`` split (contractions, letters, digits, other signs, blanks). Special strings inside a text
count as one token each, as the library does by default.

Two passes over the texts: the first sums every pre-token's occurrences (counted in the task, then by
``groupBy``) and counts the pieces of each distinct one; the second gives each document its frequencies.
The ``hot_limit`` most frequent pre-tokens are broadcast and summed in the task; all others go through a
shuffle join, which therefore has no hot key and moves only the rare tail. A pre-token can be as long as a
text, so those of more than ``WIDE`` characters go by a hash of fixed width in both ways: the broadcast
table has at most ``hot_limit`` keys of at most 4 x ``WIDE`` bytes, whatever the texts are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import materialise, prepare, slices

# Fixed: the pre-token pattern of byte-level BPE files (public tokenizers).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blocks on which Unicode versions agree about letters and digits (a test goes through them all);
# texts with other characters are split by the library itself.
SETTLED = re.compile("[^\x00-՗ -⁯₠-₿℀-↋ぁ-ゖ゠-ヿ一-鿯가-힣！-ﾾ]")

WIDE = 65  # characters of a key; longer pre-tokens are known by a NUL and their sha256
HELD = 1 << 27  # characters of text whose pre-tokens a task holds at most before it passes them on
_SPLITTERS: dict[str, PreTokens] = {}


class PreTokens:
    """Splits texts and counts pieces as the tokenizer file says; one per worker process and file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        added = spec["added_tokens"]
        if (spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)):
            raise ValueError(f"{path}: only plain byte-level BPE files can be counted by pre-token")
        specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.find = regex.compile(PRE_TOKEN).findall

    def split(self, text: str) -> list[str]:
        if text.isascii() or not SETTLED.search(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the number of special strings in it."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        runs = self.special.split(text)
        return [t for run in runs for t in self.split(run)], len(runs) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


def key_of(token: str) -> str:
    """The token, or the hash of a long one. No pre-token is equal to a hash: the split parts a NUL from
    letters and digits behind it."""
    return token if len(token) <= WIDE else "\0" + hashlib.sha256(token.encode()).hexdigest()


def splitter(path: str) -> PreTokens:
    if path not in _SPLITTERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores already
        _SPLITTERS[path] = PreTokens(path)
    return _SPLITTERS[path]


def piece_table(texts: DataFrame, path: str, flush: int = 400_000) -> DataFrame:
    """``texts(text)`` -> ``(token, n, pieces)``: every distinct pre-token by its key (``key_of``), its
    occurrences over all texts, and its number of pieces."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, held = splitter(path), Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())],
                                              ["token", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column(0).to_pylist():
                    seen.update(split.parts(text)[0])
                    held += len(text)
                if len(seen) > flush or held > HELD:
                    yield out()
                    seen, held = Counter(), 0
        if seen:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        for batch in batches:
            for part in slices(batch, "token", 1 << 20):
                tokens = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(key_of, tokens), pa.string()), part.column(1), pa.array(split.pieces(tokens), pa.int64())],
                    ["token", "n", "pieces"])

    summed = texts.mapInArrow(occurrences, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return materialise(summed.mapInArrow(count, "token string, n long, pieces long"), "token-pieces")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, hot_limit: int = 200_000) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row.

    Null text counts as empty (0 bytes, 0 tokens); null ids pass through; repeated rows are counted and
    returned each; other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = piece_table(rows.select("text"), path)
    top = table.orderBy(F.desc("n"), "token").limit(hot_limit).select("token", "pieces")
    hot = spark.sparkContext.broadcast({r.token: r.pieces for r in top.toLocalIterator()})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = splitter(path), hot.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                n_bytes, known, ends, tokens, counts = [], [], [0], [], []
                for text in part.column(1).to_pylist():
                    found, total = split.parts(text)
                    for token, n in Counter(found).items():
                        if (p := pieces.get(token)) is not None:
                            total += n * p
                        elif (key := key_of(token)) is not token and (p := pieces.get(key)) is not None:
                            total += n * p
                        else:
                            tokens.append(key)
                            counts.append(n)
                    known.append(total)
                    ends.append(len(tokens))
                    n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["token", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(known)), pa.int64()), part.column(0), pa.array(n_bytes, pa.int64()),
                     pa.array(known, pa.int64()), rare], ["row", "doc_id", "n_bytes", "known", "rare"])
                row += len(known)

    base = materialise(rows.mapInArrow(
        frequencies, "row long, doc_id long, n_bytes long, known long, rare array<struct<token:string,n:long>>"),
        "token-frequencies")
    rare = (base.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
            .join(table.select("token", "pieces"), "token")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more")))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return base.drop("rare").join(rare, "row", "left").select(
        "doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
