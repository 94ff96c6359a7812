"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece can reach across (before each run of word-start marks, and between two
characters that no piece joins), so the segments are independent. All distinct segments of a slice
that were not met before are encoded together: one flat array of symbols, the rank of each adjacent
pair beside it; every round takes the smallest rank of each segment, merges its leftmost occurrences
and compacts; segments without a pair left drop out. Several occurrences are merged in one round only
as far as the one-at-a-time order would do the same: up to the first merge that makes a new pair of the
same or a smaller rank. Segments beyond ``LONG`` symbols use the same order with a heap.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import prepare, slices

MARK = "▁"
LONG = 4096
KNOWN_LIMIT = 800_000  # words a worker remembers,
KNOWN_CHARS = 1 << 25  # and their characters; a slice of texts comes on top, and goes with the next one
NONE = np.int64(1 << 40)
_MODELS: dict[str, PieceModel] = {}

codecs.register_error("piece-bytes", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """Pieces, pair ranks and surfaces of one SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        types = [p.type for p in model.pieces]
        if (train.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or 4 in types or 5 in types):
            raise ValueError(f"{path}: only BPE models without text normalisation, user or unused pieces are supported")
        self.size = len(model.pieces)
        self.unknown = train.unk_id
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError(f"{path}: a piece has a word start inside")
        # Symbols: ids of one-character pieces, and size + code point for all other characters.
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.by_text = normal
        scores = {p: model.pieces[i].score for p, i in normal.items() if len(p) > 1}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank_of = {p: order[s] for p, s in scores.items()}
        keys, ranks, ids = [], [], []
        self.joined: set[str] = set()
        for p in scores:
            self.joined.update(p[k:k + 2].replace(MARK, " ") for k in range(len(p) - 1))
            for k in range(1, len(p)):
                left, right = self.of(p[:k]), self.of(p[k:])
                if left is not None and right is not None:
                    keys.append(left << 22 | right)
                    ranks.append(self.rank_of[p])
                    ids.append(normal[p])
        at = np.argsort(keys) if keys else np.zeros(0, int)
        self.keys = np.append(np.array(keys, np.int64)[at], np.int64(-1) & (1 << 62))
        self.ranks = np.append(np.array(ranks, np.int64)[at], NONE)
        self.merged = np.append(np.array(ids, np.int64)[at], 0)
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.bytes = [byte[b] for b in range(256)] if train.byte_fallback else None
        surface = []
        for p in model.pieces:
            surface.append(bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" if p.type == 3
                           else train.unk_surface.encode() if p.type == 2 else p.piece.replace(MARK, " ").encode())
        self.starts_blank = np.array([p.type == 1 and p.piece.startswith(MARK) for p in model.pieces])
        self.control = np.array([t == 3 for t in types])
        self.lengths = np.array([len(s) for s in surface], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.line_end = next((p for p in self.joined if "\n" in p), None)
        self.known: dict[str, bytes] = {}
        self.chars = 0  # of the words in ``known``

    def of(self, text: str) -> int | None:
        """Symbol of a piece or a single character."""
        return int(self.symbol[ord(text)]) if len(text) == 1 else self.by_text.get(text)

    # -- encoding ---------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The text with its word-start marks (as blanks), cut before every run of marks and, if no piece
        holds a line end, round line ends."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        lines = text.split("\n") if self.line_end is None else [text]
        out: list[str] = []
        for i, line in enumerate(lines):
            if i:
                out.append("\n")
            if "  " in line:
                out += re.findall("[^ ]+| +[^ ]*", line)
            else:
                first, *rest = line.split(" ")
                if first:
                    out.append(first)
                out += [" " + w for w in rest]
        return out

    def segments(self, word: str) -> list[str]:
        """A word (marks as blanks) cut between characters that no piece joins."""
        if word[1:].isalpha() and word.isascii():
            return [word]
        stem, last = word[:-1], word[-1]
        if stem[1:].isalpha() and stem.isascii() and stem[-1] + last not in self.joined:
            return [stem, last]
        out, at, joined = [], 0, self.joined
        for k in range(1, len(word)):
            if word[k - 1:k + 1] not in joined:
                out.append(word[at:k])
                at = k
        out.append(word[at:])
        return out

    def learn(self, words: list[str]) -> None:
        """Put the ids of ``words`` into ``known``; all segments they lack are merged together."""
        cuts = {w: self.segments(w) for w in words}
        fresh = list(set().union(*cuts.values()).difference(self.known))
        short = [s for s in fresh if len(s) <= LONG]
        done = {}
        size = 0
        chunk: list[str] = []
        for s in short:  # slices of bounded symbol count
            chunk.append(s)
            size += len(s)
            if size > 1 << 19:
                done.update(zip(chunk, self.merge(chunk)))
                chunk, size = [], 0
        if chunk:
            done.update(zip(chunk, self.merge(chunk)))
        done.update((s, self.merge_long(s)) for s in fresh if len(s) > LONG)
        known = self.known
        for w, segs in cuts.items():
            if len(segs) > 1:
                done[w] = b"".join([done[s] if s in done else known[s] for s in segs])
        known.update((w, done[w]) for w in words)
        known.update((s, v) for s, v in done.items() if len(s) == 1)
        self.chars += sum(map(len, words))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair (rank NONE: no piece)."""
        key = left << 22 | right
        at = np.searchsorted(self.keys, key)
        at[at >= len(self.keys)] = len(self.keys) - 1
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], 0)

    def merge(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment (as int32 bytes) by merge rounds over one flat array."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        sym = self.symbol[np.frombuffer("".join(segments).replace(" ", MARK).encode("utf-32-le"), np.uint32)]
        seg = np.repeat(np.arange(len(segments)), sizes)
        final_sym, final_seg, final_pos = [], [], []
        rank, new = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        pair = np.flatnonzero(seg[:-1] == seg[1:])
        rank[pair], new[pair] = self.lookup(sym[pair], sym[pair + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            if (low == NONE).any():  # segments without a pair leave
                out = np.repeat(low == NONE, count)
                final_sym.append(sym[out])
                final_seg.append(seg[out])
                keep = ~out
                sym, seg, rank, new = sym[keep], seg[keep], rank[keep], new[keep]
                continue
            at = np.flatnonzero(rank == np.repeat(low, count))
            if len(at) > 1:
                # of overlapping occurrences every second one, from the left
                run = np.cumsum(np.concatenate(([True], np.diff(at) > 1)))
                begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
                at = at[(np.arange(len(at)) - begin[run - 1]) % 2 == 0]
            made = new[at]
            # Pairs at the time of each merge: left symbol after, right symbol before later merges.
            n = len(sym)
            after = np.full(len(at), NONE)
            r = at + 2
            ok = np.flatnonzero((r < n) & (seg[np.minimum(r, n - 1)] == seg[at]))
            after[ok] = self.lookup(made[ok], sym[r[ok]])[0]
            before = np.full(len(at), NONE)
            ok = np.flatnonzero((at > 0) & (seg[np.maximum(at - 1, 0)] == seg[at]))
            left = sym[at[ok] - 1].copy()
            prev = ok[(ok > 0)]
            prev = prev[at[prev - 1] + 2 == at[prev]]
            if len(prev):
                place = np.searchsorted(ok, prev)
                left[place] = made[prev - 1]
            before[ok] = self.lookup(left, made[ok])[0]
            stop = np.minimum(before, after) <= rank[at]
            if stop.any():
                own = seg[at]
                start = np.searchsorted(own, own)
                passed = np.cumsum(stop) - stop  # stops before this occurrence, over all segments
                at_ok = passed == passed[start]
                at, made = at[at_ok], made[at_ok]
            sym[at] = made
            keep = np.ones(n, bool)
            keep[at + 1] = False
            changed = np.zeros(n, bool)
            changed[at] = True
            sym, seg, rank, new, changed = sym[keep], seg[keep], rank[keep], new[keep], changed[keep]
            todo = changed.copy()
            todo[:-1] |= changed[1:]
            todo = np.flatnonzero(todo)
            pair = todo[(todo + 1 < len(sym))]
            pair = pair[seg[pair] == seg[pair + 1]]
            rank[todo] = NONE
            rank[pair], new[pair] = self.lookup(sym[pair], sym[pair + 1])
        if not final_sym:
            return []
        sym, seg = np.concatenate(final_sym), np.concatenate(final_seg)
        order = np.argsort(seg, kind="stable")
        ids, own = self.to_ids(sym[order], seg[order])
        ends = np.searchsorted(own, np.arange(len(segments)), side="right") * 4
        raw = ids.astype("<i4").tobytes()
        ends = ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge_long(self, segment: str) -> bytes:
        """The same order for one very long segment, with a heap of (rank, place)."""
        text = list(segment.replace(" ", MARK))
        n = len(text)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        rank = self.rank_of

        heap = [(rank[p], i, p) for i in range(n - 1) if (p := text[i] + text[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or text[i] + text[j] != p:
                continue
            text[i], alive[j], right[i] = p, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (q := text[a] + text[b]) in rank:
                    heapq.heappush(heap, (rank[q], a, q))
        sym = np.array([self.of(t) for t, live in zip(text, alive) if live], np.int64)
        return self.to_ids(sym, np.zeros(len(sym), np.int64))[0].astype("<i4").tobytes()

    def to_ids(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: characters without a piece become their bytes' pieces (or the unknown id)."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, seg
        if self.bytes is None:
            sym = sym.copy()
            sym[odd] = self.unknown
            return sym, seg
        spelled = [[self.bytes[b] for b in chr(int(c)).encode()] for c in sym[odd] - self.size]
        width = np.ones(len(sym), np.int64)
        width[odd] = [len(s) for s in spelled]
        ids, seg = np.repeat(sym, width), np.repeat(seg, width)
        begin = (np.cumsum(width) - width)[odd]
        for b, s in zip(begin.tolist(), spelled):
            ids[b:b + len(s)] = s
        return ids, seg

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > KNOWN_LIMIT or self.chars > KNOWN_CHARS:
            self.known, self.chars = {}, 0
        fresh = set().union(*cut).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, words)), "<i4") for words in cut]

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: surfaces are gathered as one byte array; the first blank is the dummy one."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        raw = self.flat[np.repeat(self.starts[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()
        shown = np.flatnonzero(~self.control[ids])
        if len(shown) and self.starts_blank[ids[shown[0]]]:
            raw = raw[1:]
        return raw.decode("utf-8", errors="piece-bytes")


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row; null text is empty (no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = m.encode_all(part.column(1).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                flat = pa.array(np.concatenate(ids) if ids else [], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    prepare(docs.sparkSession)
    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of id arrays; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    prepare(coded.sparkSession)
    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text encoded and its ids decoded again: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    Null text is empty (0 ids, hashes of the empty string); null ids of rows pass through; repeated
    rows are returned each; other columns are not read; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        digits = [str(i) for i in range(m.size)]
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, "text"):
                coded = m.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([sha(",".join([digits[i] for i in x.tolist()]).encode()).hexdigest() for x in coded]),
                    pa.array([sha(m.decode(x).encode()).hexdigest() for x in coded]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepare(docs.sparkSession)
    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
