"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. A document longer than the longest is cut into pieces of that
length and a rest. Pieces are taken in falling length; a piece goes into the open bin where it leaves
the least room (best fit). Where no open bin has room, a new bin is opened.

All lengths are weighed together for a new bin by what a packed token would cost in it. A bin of c places
costs ``c + c * c / attention_length + bin_overhead`` (in places: the linear work, the attention work that
grows with the square, and a fixed part). For each permitted length the later pieces are looked through for
those that would fill it: the longest that fits, then the longest that fits beside it, and so on. Pieces
that some open bin has room for count only as far as such material exceeds the room in all open bins. The
length with the least cost a token (ties: the shortest) is opened. At the end every bin is set down to the
smallest permitted length that holds its contents, and the room above them is padding.

Pieces are dealt to ``ceil(pieces / group_size)`` groups by a hash, each with its own bins, so the work
of a task is bounded and the result depends on the input alone. Within a group only the number of
pieces of each length matters to the packing, so it runs over lengths, not rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import materialise, prepare, slices

CAPACITIES = (1024, 2048, 4096)
# A bin's cost in places besides its own: the fixed part, and the length whose attention costs as much as all else.
BIN_OVERHEAD = 160
ATTENTION_LENGTH = 12_288
_COUNTERS: dict = {}


def bin_cost(capacity: int, bin_overhead: float = BIN_OVERHEAD, attention_length: float = ATTENTION_LENGTH) -> float:
    """Cost of one sequence, in places."""
    return capacity + capacity * capacity / attention_length + bin_overhead


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], bin_overhead: float = BIN_OVERHEAD,
             attention_length: float = ATTENTION_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack lengths that fall (each from 1 to the largest capacity): bin of each piece, capacity of each bin
    after downsizing, capacity each bin was opened with. No lengths give empty arrays."""
    caps = sorted(capacities)
    price = {c: bin_cost(c, bin_overhead, attention_length) for c in caps}
    sizes = lengths.tolist()
    falling = [-n for n in sizes]
    rest = np.concatenate((np.cumsum(lengths[::-1])[::-1], [0])).tolist()  # tokens from a piece on
    place = np.zeros(len(sizes), np.int64)
    used: list[int] = []
    opened: list[int] = []
    room: dict[int, list[int]] = {}  # room left -> bins (a heap: the oldest first)
    rooms: list[int] = []  # the rooms that occur, in order
    free = 0  # room in all open bins

    def add(b: int, left: int) -> None:
        if left <= 0:
            return
        if left not in room:
            room[left] = []
            insort(rooms, left)
        heapq.heappush(room[left], b)

    def token_cost(i: int, capacity: int) -> float:
        """Cost a token of a bin opened for piece ``i``, filled with later pieces."""
        widest = rooms[-1] if rooms else 0
        spare = rest[bisect_left(falling, -widest, i)] - free if widest else 0
        left, at = capacity - sizes[i], i + 1
        while left > 0:
            at = bisect_left(falling, -left, at)
            if at == len(sizes):
                break
            n = sizes[at]
            if n <= widest:
                if n > spare:
                    break
                spare -= n
            left -= n
            at += 1
        filled = capacity - left
        return price[caps[bisect_left(caps, filled)]] / filled

    for i, n in enumerate(sizes):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = heapq.heappop(room[left])
            if not room[left]:
                del room[left], rooms[at]
            used[b] += n
            free -= n
            add(b, left - n)
        else:
            cap = min((c for c in caps if c >= n), key=lambda c: (token_cost(i, c), c))
            b = len(used)
            used.append(n)
            opened.append(cap)
            free += cap - n
            add(b, cap - n)
        place[i] = b
    final = np.array([caps[bisect_left(caps, u)] for u in used], np.int64)
    return place, final, np.array(opened, np.int64)


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, th, n_tokens)``: tokens of every whole text by a byte-level BPE rank file, plus one for
    the end of the document. A null text counts as empty (one token); repeated rows and null ids each give a
    row; other columns are left out, whatever their names; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n = [len(count(t)) + 1 for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n, pa.int64())], ["doc_id", "th", "n_tokens"])

    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(
        run, "doc_id long, th long, n_tokens long")


def counter(path: str):
    """Token ids of a text without special tokens; one encoder per worker process."""
    if path not in _COUNTERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _COUNTERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={}).encode_ordinary
    return _COUNTERS[path]


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_size: int = 50_000,
         bin_overhead: float = BIN_OVERHEAD, attention_length: float = ATTENTION_LENGTH) -> DataFrame:
    """``lengths(doc_id, th, n_tokens)`` -> one row per piece: ``(doc_id, piece, first_token, n_tokens,
    bin_id, bin_offset, bin_capacity, bin_used, bin_opened)``; ``bin_opened`` is the capacity before the bin
    was set down to ``bin_capacity``.

    ``bin_id`` is a string, equal for the pieces of one sequence; pieces of a bin follow one another from
    offset 0. Lengths of 0 or null take no room and get no row. Null ids and repeated rows are packed
    like others. An empty table gives no rows."""
    longest = max(capacities)
    prepare(lengths.sparkSession)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(longest).cast("long")))
    pieces = (lengths.where("n_tokens > 0").select("doc_id", "th", "n_tokens", first.alias("first_token"))
              .select("doc_id", "th", "first_token",
                      F.least(F.lit(longest).cast("long"), F.col("n_tokens") - F.col("first_token")).alias("n_tokens")))
    pieces = materialise(pieces, "packing-pieces")
    groups = max(1, -(-pieces.count() // group_size))
    key = F.pmod(F.xxhash64("doc_id", "th", "first_token"), F.lit(groups)).cast("int")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["n_tokens", "doc_id", "th", "first_token"], ascending=[False, True, True, True],
                              na_position="first").reset_index(drop=True)
        n = g.n_tokens.to_numpy(np.int64)
        place, final, opened = best_fit(n, capacities, bin_overhead, attention_length)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(n[order])
        start = np.flatnonzero(np.concatenate(([True], place[order][1:] != place[order][:-1])))
        base = (ends - n[order])[start]
        offset = np.empty(len(n), np.int64)
        offset[order] = ends - n[order] - base[place[order]]
        used = np.bincount(place, n, len(final)).astype(np.int64)
        return pd.DataFrame({
            "doc_id": g.doc_id, "piece": g.first_token // longest, "first_token": g.first_token, "n_tokens": n,
            "bin_id": [f"{group_id}-{b}" for group_id, b in zip(g.group_id, place)], "bin_offset": offset,
            "bin_capacity": final[place], "bin_used": used[place], "bin_opened": opened[place]})

    return pieces.withColumn("group_id", key).groupBy("group_id").applyInPandas(
        run, "doc_id long, piece long, first_token long, n_tokens long, bin_id string, bin_offset long, "
             "bin_capacity long, bin_used long, bin_opened long")
