"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: lower-case A-Z, words are runs without space, tab, LF, VT, FF, CR; every word shingle
(repeats included) is hashed with XXH64 (seed 42); a fingerprint bit is 1 if it is set in more than
half of the hashes. Fewer words than a shingle: the whole sequence is the one shingle; no words (null
or empty text): fingerprint zero, which links like any other.

Links (at most ``max_bits`` differing bits) are found on distinct fingerprints, by one tree over all of
them. They are range-partitioned and sorted by Gray rank; runs of at most ``node_limit`` consecutive
codes are the lower nodes. Every node is factored into a mask of the bits its codes agree on and their
pattern; runs of 16 nodes are factored again, level by level, each level testing only the bits its parent
does not. A search adds up the differences from the top and drops a whole group once they exceed
``max_bits``. The few upper levels (``MAX_NODES`` lower nodes at most) are sent to every task, which
emits for each fingerprint the lower nodes that are left, those of its own rank or above; a node's
codes and the fingerprints that reach it meet in one task, where the search goes on below the node in
the same way. The task holds one node and one batch of fingerprints at a time.

A task gives only a spanning forest of the links of each batch; components are closed over the whole
corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import connected_components, free_names, local_roots, materialise, prepare, slices

FAN = 16
MAX_NODES = 1 << 14  # lower nodes; with 16 bytes and two ranks each the upper tree stays under a megabyte


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())),
                         np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        block = hashes[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 hashed: bool = False) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the unsigned bits as a signed long. ``hashed`` adds
    ``th``, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(x, shingle) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:]],
                                                 ["doc_id", "fp", "th"][:part.num_columns])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       *[F.xxhash64(text_col).alias("th")] * hashed)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", th long" * hashed)


def gray_rank(fp):
    """Rank of a code in Gray order, as a column expression (unsigned shifts)."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Tree:
    """Codes or factored nodes in Gray order, and the levels above them: ``levels[0]`` are the nodes' masks
    and patterns, each next level factors runs of ``FAN``."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray):
        self.levels = [(mask, pattern)]
        while len(self.levels[-1][0]) > FAN:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            common = np.bitwise_and.reduceat(mask, at)
            both, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            common &= ~(both ^ some)
            self.levels.append((common, both & common))

    def search(self, codes: np.ndarray, max_bits: int, step: int = 2048, least: np.ndarray | None = None,
               counts: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(code index, node index)`` of the lowest nodes whose agreed bits differ from a code's in at most
        ``max_bits``, ``step`` codes at a time. ``least`` gives the first node that a code asks for;
        ``counts`` collects how many nodes were tested and dropped on each level."""
        n = len(self.levels[0][0])
        last = [np.minimum((np.arange(len(m)) + 1) * FAN**k, n) - 1 for k, (m, _) in enumerate(self.levels)]
        top_mask, top_pattern = self.levels[-1]
        for at in range(0, len(codes), step):
            own = np.arange(at, min(len(codes), at + step))
            q, node = np.repeat(own, len(top_mask)), np.tile(np.arange(len(top_mask)), len(own))
            acc = np.bitwise_count((codes[q] ^ top_pattern[node]) & top_mask[node])
            for k in range(len(self.levels) - 1, -1, -1):
                keep = acc <= max_bits
                if counts is not None:
                    tested, dropped = counts.get(k, (0, 0))
                    counts[k] = (tested + len(keep), dropped + int((~keep).sum()))
                if least is not None:
                    keep &= last[k][node] >= least[q]
                q, node, acc = q[keep], node[keep], acc[keep]
                if not k:
                    break
                mask, pattern = self.levels[k - 1]
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                held = np.repeat(self.levels[k][0][node], FAN)
                q, acc = np.repeat(q, FAN), np.repeat(acc, FAN)
                real = child < len(mask)
                q, acc, node, held = q[real], acc[real], child[real], held[real]
                acc = acc + np.bitwise_count((codes[q] ^ pattern[node]) & mask[node] & ~held)
            yield q, node


def tree_of_codes(fps: np.ndarray) -> Tree:
    return Tree(np.full(len(fps), 0xFFFFFFFFFFFFFFFF, np.uint64), fps)


def links_in_node(fps: np.ndarray, max_bits: int, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``i < j`` of Gray-ordered codes that differ in at most ``max_bits`` bits."""
    parts = list(tree_of_codes(fps).search(fps, max_bits, least=np.arange(1, len(fps) + 1), counts=counts))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def forest(tree: Tree, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links between ``codes`` and the tree's codes do: fewer than there are codes
    on both sides, however dense the links."""
    held = tree.levels[0][1]
    every = np.concatenate((held, codes))
    root = np.arange(len(every))
    # Few codes at a time, as a dense node links each of them with all it holds.
    for q, node in tree.search(codes, max_bits, step=max(64, (1 << 22) // max(1, len(held)))):
        root = local_roots(len(every), np.concatenate((np.arange(len(every)), q + len(held))),
                           np.concatenate((root, node)))
    own = np.flatnonzero((root != np.arange(len(every))) & (every != every[root]))
    return every[own], every[root[own]]


def lower_nodes(uniq: DataFrame, node_limit: int) -> tuple[DataFrame, np.ndarray]:
    """The codes in Gray order with their node, ``(node, gray, fp)``, and the nodes' ``(node, first, last, mask,
    pattern)`` in that order (at most about ``MAX_NODES``, gathered on the driver)."""
    n = uniq.count()
    size = max(node_limit, -(-n // (MAX_NODES // 2)))
    tops = max(1, -(-n // size))
    gray = gray_rank(F.col("fp")).bitwiseXOR(F.lit(signed(1 << 63)))
    # The range borders are sampled, so a partition may hold some nodes more or less; each is cut by itself.
    ordered = materialise(uniq.select("fp", gray.alias("gray")).repartitionByRange(min(tops, 2048), "gray")
                          .sortWithinPartitions("gray").withColumn("mid", F.monotonically_increasing_id()), "simhash-order")
    place = F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    node = F.col("mid") - place + F.floor(place / size)
    ordered = ordered.select(node.alias("node"), "gray", "fp")
    sums = ordered.groupBy("node").agg(F.min("gray").alias("first"), F.max("gray").alias("last"),
                                       F.bit_and("fp").alias("both"), F.bit_or("fp").alias("some")).orderBy("node").collect()
    rows = np.array([tuple(r) for r in sums], np.int64).reshape(-1, 5)
    mask = ~(rows[:, 3] ^ rows[:, 4])
    return ordered, np.stack([rows[:, 0], rows[:, 1], rows[:, 2], mask, rows[:, 3] & mask])


def fingerprint_links(uniq: DataFrame, max_bits: int = 2, node_limit: int = 4096) -> DataFrame:
    """Distinct ``fp`` -> ``(u, v)`` edges that connect exactly what links of at most ``max_bits`` do."""
    ordered, nodes = lower_nodes(uniq, node_limit)
    number, last, mask, pattern = nodes[0], nodes[2], nodes[3].view(np.uint64), nodes[4].view(np.uint64)

    def block(node: int, side: int, gray: np.ndarray, fp: np.ndarray) -> tuple:
        return node, side, int(gray[0]), fp.tobytes()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of codes in Gray order -> blocks ``(node, side, first, codes)``: the codes of each node (side 0)
        and for each node the codes of the batch that reach it (side 1)."""
        upper = Tree(mask, pattern)
        for batch in batches:
            node, gray, fp = (c.to_numpy() for c in batch.columns[:3])
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            out = [block(int(node[s]), 0, gray[s:e], fp[s:e]) for s, e in zip(cuts, cuts[1:]) if e > s]
            own = np.searchsorted(last, gray)  # the node that holds the code; those before it ask for it
            for q, met in upper.search(fp.view(np.uint64), max_bits, least=own):
                order = np.argsort(met, kind="stable")
                q, met = q[order], met[order]
                ends = [0, *(np.flatnonzero(met[1:] != met[:-1]) + 1).tolist(), len(met)]
                out += [block(int(number[met[s]]), 1, gray[q[s:e]], fp[q[s:e]]) for s, e in zip(ends, ends[1:]) if e > s]
            for at in range(0, len(out), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) if i != 1 else pa.array(list(c), pa.int32())
                                                  for i, c in enumerate(zip(*out[at:at + 1024]))], ["node", "side", "first", "codes"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, held = None, None, []
        for batch in batches:
            for node, side, codes in zip(*[batch.column(i) for i in (0, 1, 3)]):
                node, codes = node.as_py(), np.frombuffer(codes.as_py(), np.uint64)
                if node != key:
                    key, tree, held = node, None, []
                if side.as_py() == 0:
                    held.append(codes)
                    continue
                if tree is None:
                    tree = tree_of_codes(np.concatenate(held))
                u, v = forest(tree, codes, max_bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    met = ordered.select("node", "gray", "fp").mapInArrow(reach, "node long, side int, first long, codes binary")
    return (met.repartition("node").sortWithinPartitions("node", "side", "first")
            .mapInArrow(link, "u long, v long"))


def members(fps: DataFrame, max_bits: int, node_limit: int) -> DataFrame:
    """``(fp, first_id, root)`` of every distinct fingerprint; ``root`` is the same all over a component."""
    uniq = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-uniq")
    roots = connected_components(fingerprint_links(uniq.select("fp"), max_bits, node_limit), "simhash-cc")
    member = uniq.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return materialise(member, "simhash-member")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 2, node_limit: int = 4096) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row: ``fingerprint`` as 16 hex digits,
    ``component_id`` the smallest ``doc_id`` reachable over links, itself included.

    Null text counts as empty. Rows without an id are returned, with the component of their
    fingerprint, but never name one (null if no row of the component has an id). Repeated rows are
    returned as often as they occur. Other columns are not read. An empty table gives no rows."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    member = members(fps, max_bits, node_limit)
    named = materialise(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-named")
    label = materialise(member.join(named, "root").select("fp", "component_id"), "simhash-label")
    return fps.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 2, node_limit: int = 4096) -> DataFrame:
    """The rows of ``docs`` with one document left of each component: the smallest id and, if several texts
    of the component have it, the one with the smallest fingerprint and text hash (both as signed
    numbers); once even if its row is repeated. An id whose texts are in several components may so stay
    once for each. Rows without an id cannot be named and stay. All columns, of any name, are kept as they are."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle, hashed=True), "simhash-fps")
    first = (members(fps, max_bits, node_limit).where("first_id is not null")
             .groupBy("root").agg(F.min(F.struct("first_id", "fp")).alias("first")))
    first = materialise(first.select("first.*"), "simhash-first")
    i, t, h = free_names(docs, "__keep_id", "__keep_th", "__th")
    keep = (fps.join(first, (fps.doc_id == first.first_id) & (fps.fp == first.fp), "left_semi")
            .groupBy(F.col("doc_id").alias(i), "fp").agg(F.min("th").alias(t)).drop("fp"))
    own = docs.withColumn(h, F.xxhash64(text_col))
    named = own.join(keep, (F.col(id_col).cast("long") == F.col(i)) & (F.col(h) == F.col(t)), "left_semi")
    named = named.dropDuplicates([id_col, h]).drop(h)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
