"""Token-id files with directly addressable codes.

A file holds the ids of a run of documents. Every id is cut into chunks of ``widths`` bits, lowest
first; level k has the k-th chunk of the ids that reach it, a continuation bitmap (1: a next chunk
follows) and a rank directory (ones before each 512-bit block). The id at any place is read from its
chunk, and, while the bitmap says so, from the next level at the rank of that bit: no block of ids is
ever decoded to get at one of them.

Layout (little endian): magic ``DACTOK01``; header length u32 and a JSON header (documents, tokens,
end id, and for each level its width, length and dtype); document ids i64, a byte per document that
is 0 where the id is null, document ends u64; then per level chunks, bitmap (bytes, low bit first)
and rank directory u64. All sections follow one another without padding.

``write_token_files`` puts the documents in ascending id order over range partitions (repeated ids
can be split between them), so files are in order too; a file ends at the first document that takes it
over ``file_tokens``. Files are written under a temporary name and renamed, and a retried task writes
the same bytes to the same names. ``read_token_files`` reads them back through Spark's file reader.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.shared import materialise, prepare, slices
from vellum.session import shared_path
from vellum.sources.markdown import store_of

MAGIC = b"DACTOK01"
BLOCK = 512
# What a worker remembers in each of two generations: words, and their characters (a slice of texts comes on
# top of these, and goes with the next generation).
KNOWN_LIMIT, KNOWN_CHARS = 400_000, 1 << 24
# A stop or comma behind another sign, or behind the one letter whose lower case ends in a mark.
SIGN_BEFORE = re.compile(r"[.,](?<=[^\w\s].|[_İ].) ")
_ENCODERS: dict[str, WordEncoder] = {}


# -- codes ----------------------------------------------------------------------------------------


class Codes:
    """Directly addressable codes of one id sequence."""

    def __init__(self, widths, chunks, bitmaps, ranks):
        self.widths, self.chunks, self.bitmaps, self.ranks = widths, chunks, bitmaps, ranks

    @classmethod
    def build(cls, ids: np.ndarray, widths: tuple[int, ...] = (8, 8, 16)) -> Codes:
        rest = ids.astype(np.uint32)
        used, chunks, bitmaps, ranks = [], [], [], []
        for width in widths:
            used.append(width)
            kind = np.uint8 if width <= 8 else np.uint16
            chunks.append((rest & np.uint32((1 << width) - 1)).astype(kind))
            rest = rest >> np.uint32(width)
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            bitmaps.append(bits)
            ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8), dtype=np.uint64) \
                if len(bits) else np.zeros(0, np.uint64)
            ranks.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64))))
            rest = rest[more]
            if not len(rest):
                break
        if len(rest):
            raise ValueError("ids need more bits than the chunk widths hold")
        return cls(used, chunks, bitmaps, ranks)

    def __len__(self) -> int:
        return len(self.chunks[0])

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a level's bitmap."""
        block = at // BLOCK
        out = self.ranks[level][block].astype(np.int64)
        first, bits = block * (BLOCK // 8), self.bitmaps[level]
        byte = at // 8
        for k in range(BLOCK // 8):  # bytes of the block that lie before the place
            i = first + k
            before = i < byte
            if not before.any():
                break
            out[before] += np.bitwise_count(bits[i[before]])
        return out + np.bitwise_count(bits[byte] & ((1 << (at % 8)) - 1).astype(np.uint8))

    def __getitem__(self, at) -> np.ndarray:
        """Ids at any places, each found through the levels alone."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        ids, live, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for level, chunks in enumerate(self.chunks):
            ids[live] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            shift += self.widths[level]
            more = (self.bitmaps[level][at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            if not more.any():
                break
            at, live = self.rank(level, at[more]), live[more]
        return ids

    def decode(self) -> np.ndarray:
        """All ids in order."""
        ids, live, shift = np.zeros(len(self), np.uint32), None, 0
        for level, chunks in enumerate(self.chunks):
            part = chunks.astype(np.uint32) << np.uint32(shift)
            if live is None:
                ids |= part
                live = np.arange(len(self))
            else:
                ids[live] |= part
            shift += self.widths[level]
            live = live[np.unpackbits(self.bitmaps[level], count=len(chunks), bitorder="little").view(bool)]
        return ids


def pack_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, end_id: int | None) -> bytes:
    codes = Codes.build(ids)
    header = json.dumps({
        "documents": len(doc_ids), "tokens": len(ids), "end_id": end_id,
        "levels": [{"width": w, "length": len(c), "dtype": c.dtype.str} for w, c in zip(codes.widths, codes.chunks)],
    }).encode()
    parts = [MAGIC, len(header).to_bytes(4, "little"), header,
             np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
             np.array([d is not None for d in doc_ids], np.uint8).tobytes(), ends.astype("<u8").tobytes()]
    for chunks, bits, ranks in zip(codes.chunks, codes.bitmaps, codes.ranks):
        parts += [chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(parts)


class TokenFile:
    """One file's bytes: ``doc_ids`` (None where null), ``ends``, and ``codes`` for random access."""

    def __init__(self, raw: bytes | memoryview):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(raw[8:12], "little")
        self.header = json.loads(bytes(raw[12:12 + size]))
        self.at, self.raw = 12 + size, raw
        n = self.header["documents"]
        ids, valid = self.take("<i8", n), self.take("u1", n)
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid)]
        self.ends = self.take("<u8", n).astype(np.int64)
        widths, chunks, bitmaps, ranks = [], [], [], []
        for level in self.header["levels"]:
            widths.append(level["width"])
            chunks.append(self.take(level["dtype"], level["length"]))
            bitmaps.append(self.take("u1", -(-level["length"] // 8)))
            ranks.append(self.take("<u8", -(-level["length"] // BLOCK) + 1))
        self.codes = Codes(widths, chunks, bitmaps, ranks)

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file, by direct access."""
        return self.codes[np.arange(self.ends[i - 1] if i else 0, self.ends[i])]


# -- encoding -------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts from the ``tokenizers`` library, asked once per distinct blank-separated word.

    Only for files whose split drops white space and whose normaliser does not look past it: there
    the ids of a text are the ids of its words one after the other."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self.drops_blanks(spec)
        norm = spec["normalizer"] or {}
        self.lowers = any(s["type"] == "Lowercase" for s in norm.get("normalizers", [norm]) if s)
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.word_end[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0  # of the words in ``known``

    @staticmethod
    def drops_blanks(spec: dict) -> bool:
        norm = spec["normalizer"] or {}
        steps = norm.get("normalizers", [norm] if norm else [])
        plain = all(s["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")
                    or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
        pre = spec["pre_tokenizer"] or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        pattern = first.get("pattern", {}).get("Regex", "")
        drops = (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
                 and " " not in pattern and re.search(r"\[\^\\s", pattern) is not None)
        byte_level = [p for p in pre.get("pretokenizers", []) if p["type"] == "ByteLevel"]
        return bool(plain and drops and not any(p["add_prefix_space"] for p in byte_level)
                    and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]))

    def ask(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def ask_letters(self, words: list[str]) -> list[bytes]:
        """The same for words of Latin-1 letters, each one token of the split: many go in one text, and
        the ids that end a word part them."""
        if not words:
            return []
        lines = [" ".join(words[at:at + 64]) for at in range(0, len(words), 64)]
        coded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in coded])
        ends = ((np.flatnonzero(self.word_end[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            return self.ask(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, fresh: set[str]) -> None:
        """Words of letters with one sign behind are put together from the two."""
        known, joined, letters, rest = self.known, [], set(), set()
        for w in fresh:
            if w.isalpha():
                letters.add(w)
            elif w[-1:] in ".,;:!?" and (stem := w[:-1]).isalpha() and (w.isascii() or max(stem) <= "ÿ"):
                joined.append(w)
                letters.add(stem)
                rest.add(w[-1])
            else:
                rest.add(w)
        letters = list(letters.difference(known))
        if "".join(letters).isascii() or not any(max(w) > "ÿ" for w in letters):
            known.update(zip(letters, self.ask_letters(letters)))
        else:
            rest.update(w for w in letters if max(w) > "ÿ")
            letters = [w for w in letters if max(w) <= "ÿ"]
            known.update(zip(letters, self.ask_letters(letters)))
        rest = list(rest.difference(known))
        known.update(zip(rest, self.ask(rest)))
        for w in joined:
            known[w] = known[w[:-1]] + known[w[-1]]

    def fold(self, text: str) -> str:
        """The text with blanks for line ends and, where that cannot matter to the result, in lower case
        (Latin-1 texts without special strings) and with a blank before a stop or comma that ends a word
        (no other sign stands before it, so the split parts them anyway)."""
        text = text.replace("\n", " ")
        if "<|" in text:
            return text
        if not SIGN_BEFORE.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        if not self.lowers:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (u32), and the number of each text's ids. Distinct words
        are looked up once; the texts are then put together by gathering."""
        if not self.by_word:
            coded = self.ask(texts)
            return np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded], np.int64)
        cut = pc.split_pattern(pa.array([self.fold(t) for t in texts], pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_LIMIT or self.chars > KNOWN_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        if fresh := set(words).difference(self.known):
            if self.older:
                again = fresh.intersection(self.older)
                self.known.update(zip(again, map(self.older.__getitem__, again)))
                self.chars += sum(map(len, again))
                fresh -= again
            self.learn(fresh)
            self.chars += sum(map(len, fresh))
        ids = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        ends = np.cumsum(size[word])
        at = np.repeat(start[word] - ends + size[word], size[word]) + np.arange(ends[-1] if len(ends) else 0)
        per_text = np.diff(np.concatenate((np.zeros(1, np.int64), ends))[cut.offsets.to_numpy()])
        return np.frombuffer(b"".join(ids), "<u4")[at], per_text


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores already
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# -- Spark ----------------------------------------------------------------------------------------


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder so that it appears whole under its name."""
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/_{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{base}/{name}")


def write_token_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int | None = 1, file_tokens: int = 1 << 21) -> DataFrame:
    """Encode every text with the tokenizer file ``path`` (no special tokens, ``end_id`` appended) into
    files of ``folder``; returns the written files ``(file, part, seq, documents, tokens)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        end = np.zeros(0, "<u4") if end_id is None else np.array([end_id], "<u4")
        held: list[tuple[int | None, np.ndarray]] = []
        size = seq = 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, seq
            ids = np.concatenate([x for _, own in held for x in (own, end)])
            ends = np.cumsum([len(own) + len(end) for _, own in held])
            name = f"part-{part:06d}-{seq:06d}.dac"
            put(folder, name, pack_file([d for d, _ in held], ends, ids, end_id))
            row = pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "documents": [len(held)],
                                              "tokens": [len(ids)]})
            held, size, seq = [], 0, seq + 1
            return row.cast(pa.schema([("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()),
                                       ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                ids, sizes = code.encode(rows.column(1).to_pylist())
                for doc_id, own in zip(rows.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1])):
                    held.append((doc_id, own))
                    size += len(own) + len(end)
                    if size > file_tokens:
                        yield out()
        if held:
            yield out()

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = (rows.repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    schema = "file string, part long, seq long, documents long, tokens long"
    return materialise(ordered.mapInArrow(run, schema), "token-manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, place, doc_id, first, n_tokens, ids_crc32)`` of every document of every file; ``first``
    counts the file's ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = TokenFile(memoryview(raw.as_buffer()))
                ids, ends = f.codes.decode().astype("<u4"), f.ends
                first = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), ends.tolist())]
                n = len(f.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(f.doc_ids, pa.int64()),
                     pa.array(first), pa.array(ends - first), pa.array(crc, pa.int64())],
                    ["file", "place", "doc_id", "first", "n_tokens", "ids_crc32"])

    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "content").mapInArrow(
        run, "file string, place long, doc_id long, first long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1,
                file_tokens: int = 1 << 21, folder: str | None = None) -> DataFrame:
    """Write the files (below the shared folder unless ``folder`` is given) and return, read back from
    them, ``(doc_id, start, n_tokens, ids_crc32)``; ``start`` counts the ids of all documents before.

    Null text is empty (the end id alone); null ids come first and are kept as null; repeated ids follow
    one another in the order of a hash of their texts; other columns are not read; an empty table
    writes no files and gives no rows."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "llm", "token-files", unique=True)
    files = write_token_files(docs, path, folder, id_col, text_col, end_id, file_tokens)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # One row per file: running totals inside the partitions, and totals of the partitions before.
    per_part = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    before_part = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    base = files.withColumn("within", within).join(before_part, "part").select(
        "file", (F.col("base") + F.col("within")).alias("base"))
    return read_token_files(spark, folder).join(base, "file").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
