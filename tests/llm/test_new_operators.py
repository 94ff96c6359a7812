"""Merkle manifest, spelling variants and quality rules against brute force on small rows: nulls, empty and
long texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import merkle, quality, spelling

SCHEMA = ("doc_id long, text string, source string, lang string, n_chars long, tree string, lo long, word string, "
          "w string, n long, path string, block string")
CLASH = ("x", 1, "y", "z", 2, "p", "q")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- manifest -------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(digests):
    """The root, and for each leaf its (left, right) steps."""
    steps, at, row = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(row) > 1:
        runs = [row[i:i + 8] for i in range(0, len(row), 8)]
        for leaf, i in enumerate(at):
            run, own = runs[i // 8], i % 8
            steps[leaf].append(("".join(run[:own]), "".join(run[own + 1:])))
        at, row = [i // 8 for i in at], [sha("".join(r)) for r in runs]
    return row[0], steps


def brute_proofs(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((brute_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[g] = brute_tree([leaf for leaf, _ in groups[g]])
    root, tops = brute_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (leaf, r), own in zip(groups[g], trees[g][1]):
            steps = own + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            acc = brute_leaf((*r[:4], lower(r[4]))) if hit else leaf
            for left, right in steps:
                acc = sha(left + acc + right)
            out.append((r[0], leaf, trees[g][0], root, sha("".join(a + b for a, b in steps)), acc, acc == root))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def manifest_rows():
    rows = [(i, f"s{i % 3}", ("de", "en", None, "é", "")[i % 5 if i % 7 else 1], i * 3, f"Text {i} é") for i in range(700)]
    rows += [(None, None, None, None, None), (5, "s", "en", None, None), (5, "s", "en", 0, ""), (7001, "s", "lone", 1, "ONE leaf"),
             (7002, "s", "en", 3, "Long WORDS " * 40_000)] + [(9, "s", "en", 1, "Same")] * 70
    return rows + [(8000 + i, "s", f"l{i}", 1, "Many Groups") for i in range(75)]


def test_manifest(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame([(r[0], r[4], r[1], r[2], r[3], *CLASH) for r in rows], SCHEMA).repartition(5)
    assert in_order(merkle.proofs(docs).collect()) == in_order(brute_proofs(rows))


@pytest.mark.parametrize("n", [1, 8, 9])
def test_manifest_of_one_group(spark, n):
    rows = [(i, "s", None, 1, "A") for i in range(n)]
    docs = spark.createDataFrame([(r[0], r[4], r[1], r[2], r[3], *CLASH) for r in rows], SCHEMA)
    assert in_order(merkle.proofs(docs).collect()) == in_order(brute_proofs(rows))


def test_manifest_of_an_empty_table(spark):
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).count() == 0


# --- spelling -------------------------------------------------------------------------------------


def brute_words(rows, struck):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if struck and h % struck == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows, struck):
    n = brute_words(rows, struck)
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def spelling_rows():
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyzéßÀ×")
    words = ["".join(rng.choice(letters, rng.integers(7, 10))) for _ in range(60)]
    rows = [(1, None), (2, ""), (None, "Kitchen kitchen KITCHEN"), (3, "short ones only"), (4, "ÀÀÀÀÀÀÀ ààààààà " * 3),
            (5, "aaaaaaa " * 500 + "aaaaaab " * 50 + "aaaaabb " * 5 + "aaaabbb " * 2), (5, "aaaaaac " * 50), (5, "aaaaaac " * 50),
            (6, ("x" * 5000 + " ") * 2 + ("x" * 4999 + "y ") * 2 + ("x" * 5001 + " ") * 30)]
    for i in range(300):
        text = []
        for _ in range(30):
            w = words[min(59, int(rng.exponential(8)))]
            kind, at = rng.integers(0, 12), rng.integers(0, len(w))
            c = letters[rng.integers(0, len(letters))]
            text.append((w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:])[kind] if kind < 3 else w.upper() if kind == 3 else w)
        rows.append((100 + i, "-".join(text)))
    return rows


@pytest.mark.parametrize("struck", [None, 31])
def test_spelling(spark, struck):
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "s", "l", 1, *CLASH) for i, t in rows], SCHEMA).repartition(4)
    got = spelling.spelling_groups(docs, struck=struck)
    assert in_order(got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == in_order(brute_spelling(rows, struck))


def test_small_tiles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE_WORDS", 3)
    words = sorted(brute_words(spelling_rows(), 31).items())
    pairs = spelling.near_pairs(spark.createDataFrame(words, "word string, n long")).collect()
    got = Counter(frozenset((r.a, r.b)) for r in pairs)
    assert got == Counter(frozenset((a, b)) for i, (a, _) in enumerate(words) for b, _ in words[:i] if is_near(a, b))


def test_products_give_squared_distances():
    a, b = (spelling.Tile(pa.array(w), np.ones(len(w), int)) for w in (["aabbccd", "zzzzzzz"], ["aabbccde", "abcdefgh"]))
    count = lambda w: np.array([w.count(c) for c in "abcdefghz"])
    want = [[((count(x) - count(y))**2).sum() for y in b.words.to_pylist()] for x in a.words.to_pylist()]
    assert (-(a.left @ b.right[a.used])).tolist() == want


def test_spelling_of_an_empty_table(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).count() == 0


# --- quality --------------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    twice = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice),
            len(w) < 50 or 100 * len(twice) > 50 * len(w))


TEXTS = [None, "", " \n\t\x0b", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \n \nx\r", "# * | é 🙂 z " * 20,
         "the same line again\n" * 30, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)),
         " ".join(f"w{i % 60}" for i in range(90)), "a b " * 60_000]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, "s", "l", 1, *CLASH) for i, t in enumerate(TEXTS)] + [(None, "no id", "s", "l", 1, *CLASH)] * 2, SCHEMA)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = [(r.doc_id, *(r[c] for c in names)) for r in quality.statistics(docs, "doc_id", "text").collect()]
    want = [(i, *brute_statistics(t)) for i, t in enumerate(TEXTS)] + [(None, *brute_statistics("no id"))] * 2
    assert in_order(got) == in_order(want)


def labelled(n=600):
    """Good prose, shouted prose and prose with bars; labels of low quality for the last two."""
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(60, 120))]
        kind = i % 6
        text = (" | " if kind == 1 else " ").join(words)
        docs.append((i, text.upper() if kind == 2 else text + "."))
        labels.append((i, 0 if kind in (1, 2) else 1))
    return docs, labels


def test_rules_are_learned_and_hold_on_other_rows(spark):
    docs, labels = labelled()
    docs += [(None, docs[0][1]), (0, docs[0][1]), (7000, None), (7001, "short")]
    frame = spark.createDataFrame([(i, t, "s", "l", 1, *CLASH) for i, t in docs], SCHEMA)
    taught = [x for x in labels if x[0] % 5] + [(3, None), (9999, 0), (None, 0), (8, 0), (8, 1)]
    stats = quality.statistics(frame, "doc_id", "text")
    sample = quality.labelled_rows(stats, spark.createDataFrame(taught, "doc_id long, quality int"), "doc_id", "quality", 10_000, 13)
    rules = quality.learn_rules(sample)
    assert 2 <= len(rules) <= 3 and {c.feature for r in rules for c in r} <= set(quality.FEATURES)
    rows = quality.quality_rules(frame, spark.createDataFrame(taught, "doc_id long, quality int")).collect()
    assert len(rows) == len(docs)
    good = dict(labels)
    assert all(r.kept == (good[r.doc_id] == 1) for r in rows if r.doc_id is not None and r.doc_id < 600)
    assert not any(r.kept for r in rows if r.doc_id in (7000, 7001)) and [r.kept for r in rows if r.doc_id is None] == [True]


def brute_best(rows, cuts):
    """The condition of highest FOIL gain by counting every row for every condition."""
    p0, n0 = sum(r["low"] for r in rows), sum(not r["low"] for r in rows)
    best = (0.0, None)
    for f, at in zip(quality.FEATURES, cuts):
        for cut in at:
            for above in (False, True):
                own = [r for r in rows if (r[f] > cut) == above]
                p = sum(r["low"] for r in own)
                if p and len(own) < len(rows):
                    gain = p * (np.log2(p / len(own)) - np.log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, quality.Condition(f, above, cut))
    return best[1]


def brute_rules(rows, cuts, max_rules=12, max_conditions=4, min_precision=0.8, min_cover=3):
    def fits(rule, r):
        return all((r[c.feature] > c.cut) == c.above for c in rule)

    left, rules = list(rows), []
    while len(rules) < max_rules:
        rule = ()
        while len(rule) < max_conditions:
            own = [r for r in left if r["grow"] and fits(rule, r)]
            p = sum(r["low"] for r in own)
            found = brute_best(own, cuts) if p >= min_cover and p < len(own) else None
            if not found:
                break
            rule += (found,)
        if not rule:
            return rules

        def count(k, held):
            own = [r["low"] for r in left if fits(rule[:k], r) and not (held and r["grow"])]
            return sum(own), len(own)

        worth = [(lambda p, n: (2 * p - n) / n if n else -1.0)(*count(k, True)) for k in range(1, len(rule) + 1)]
        k = 1 + worth.index(max(worth))
        p, n = count(k, True) if count(k, True)[1] else count(k, False)
        if p < min_precision * n or count(k, False)[0] < min_cover:
            return rules
        rules.append(rule[:k])
        left = [r for r in left if not fits(rule[:k], r)]
    return rules


def test_rules_against_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        r = {f: float(np.round(rng.random(), 2)) for f in quality.FEATURES}
        r["low"] = bool((r["symbol_share"] > 0.7 and r["digit_share"] > 0.4) or r["short_share"] < 0.1 or rng.random() < 0.03)
        rows.append(r | {"grow": bool(i % 3)})
    schema = ", ".join(f"{f} double" for f in quality.FEATURES) + ", low boolean, grow boolean"
    sample = spark.createDataFrame([tuple(r[f] for f in quality.FEATURES) + (r["low"], r["grow"]) for r in rows], schema)
    rules = quality.learn_rules(sample)
    assert len(rules) >= 2 and any(len(r) > 1 for r in rules)
    assert rules == brute_rules(rows, quality.cut_points(sample))


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs, _ = labelled(30)
    frame = spark.createDataFrame([(i, t, "s", "l", 1, *CLASH) for i, t in docs], SCHEMA)
    assert quality.quality_rules(frame, none).where(F.col("kept") != ~F.col("base_failed")).count() == 0
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA), none).count() == 0
