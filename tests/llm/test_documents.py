"""Document operators against brute force on small rows: nulls, empty and long texts, ties, repeated
rows, empty tables and columns with clashing names."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import line_dedup, packing, pii, sentencepiece_rounds, simhash, token_counts, token_files, toxicity

SCHEMA = "doc_id long, text string, source string, n_chars long, fp string, th long, row long, token string"
LONG = "word " * 30_000
TEXTS = [
    (1, "One two three four five six seven eight nine ten.\nHome page\nown line"),
    (2, "One two three four five six seven eight nine ten.\nHome page\nanother"),
    (3, "one TWO three four five six seven eight nine ten.\nHome page\n"),
    (3, "one TWO three four five six seven eight nine ten.\nHome page\n"),  # a repeated row
    (4, None), (5, ""), (6, "   \n\t "), (7, "two words"), (8, "ÀÉ 日本 🙂 x▁y  a"), (None, "no id here\nHome page"),
    (9, LONG), (10, "a@b.co is 10.0.0.1, not 10.0.0.999; card 4111 1111 1111 1111 or 4111 1111 1111 1112; +1 (555) 010-9999 <|endoftext|>"),
    (11, "mail x_y@z.org.uk.\n" * 3), (12, "a" * 20_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{(i or 0) % 4}", len(t or ""), "x", 5, 6, "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute(docs, empty):
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect())
    fps = [brute_fingerprint(t) for _, t in TEXTS]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    name = [min((TEXTS[j][0] for j in range(len(fps)) if root[j] == root[i] and TEXTS[j][0]), default=None) for i in range(len(fps))]
    assert got == sorted((TEXTS[i][0] or 0, format(fps[i], "016x"), name[i]) for i in range(len(fps)))
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == sorted({n for n in name if n}) and ids.count(None) == 1


def test_keep_first_with_repeated_ids(spark):
    """Texts of one id that are near-duplicates of nothing all stay; of each component one row does."""
    a, b, c, d = ("first text stands alone", "another one of its own kind", "this has a smaller id elsewhere", "plain row twice")
    rows = [(1, a), (1, b), (2, b), (1, c), (0, c), (3, d), (3, d), (1, b), (4, None), (4, ""), (None, a)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    left = sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None and r.doc_id != 4)
    assert left == sorted([(0, c), (1, a), (1, b), (3, d)])
    assert [r.text or "" for r in kept if r.doc_id == 4] == [""] and [r.text for r in kept if r.doc_id is None] == [a]


@pytest.mark.parametrize("node_limit", [1, 8192])
def test_simhash_links_in_crowded_nodes(spark, node_limit):
    """Hundreds of codes a few bits apart: the same components as all pairs, however nodes are split."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 6, dtype=np.uint64)[rng.integers(0, 6, 400)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(fps)
    edges = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 2, node_limit)
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    pairs = [(at[r.u], at[r.v]) for r in edges.collect()]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert all(near[a].any() for a, _ in pairs)
    from vellum.llm.shared import local_roots

    a, b = np.nonzero(near)
    own = local_roots(len(fps), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    assert np.array_equal(own, local_roots(len(fps), a, b))


def test_gray_tree_finds_all_links():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 20, 3000, dtype=np.uint64))
    gray = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(k)
    fps = fps[np.argsort(gray)]
    a, b = simhash.links_in_node(fps, 2)
    want = np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1)
    assert len(a) == want.sum() and want[a, b].all()


def test_groups_are_pruned_on_ordinary_codes():
    """Random codes: whole groups go at every level above the codes, and few codes are ever compared."""
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    gray = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(k)
    counts = {}
    simhash.links_in_node(fps[np.argsort(gray)], 2, counts)
    assert len(counts) >= 4 and all(counts[k][1] > 0 for k in list(counts)[1:])
    assert counts[0][0] < 0.15 * len(fps)**2


def test_dense_links_give_a_forest_only():
    """Codes that all link with one another: fewer edges than codes."""
    fps = np.array([0] + [1 << b for b in range(64)], np.uint64)
    gray = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(k)
    fps = fps[np.argsort(gray)]
    u, v = simhash.forest(simhash.tree_of_codes(fps), fps, 2)
    assert 64 <= len(u) < 2 * len(fps) and set(u.tolist()) | set(v.tolist()) == set(fps.tolist())


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted((i or 0, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 20) for i, x in TEXTS)
    for hot in (0, 5, 1000):  # everything joined, some, everything broadcast
        got = token_counts.token_counts(docs, path, limit=20, hot_limit=hot).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_settled_characters_are_split_alike():
    split = token_counts.splitter(public_tokenizers.path("byte_bpe_50k.json"))
    pre = split.tokenizer.pre_tokenizer
    for c in range(1, 0x110000):
        if not 0xD800 <= c <= 0xDFFF and not token_counts.SETTLED.search(chr(c)):
            s = "a" + chr(c) + "1"
            assert split.find(s) == [s[a:b] for _, (a, b) in pre.pre_tokenize_str(s)], hex(c)


def test_sentencepiece(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, x in TEXTS:
        ids = sp.encode(x or "")
        want.append((i or 0, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    got = sentencepiece_rounds.round_trip(docs, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    back = sentencepiece_rounds.decode(sentencepiece_rounds.encode(docs, path), path).collect()
    assert sorted(r.text for r in back) == sorted((x or "").replace("▁", " ") for _, x in TEXTS)
    assert sentencepiece_rounds.round_trip(empty, path).count() == 0


def test_sentencepiece_random_and_long():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m, rnd = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_rounds.model(path), random.Random(3)
    bits = ["a", "e", "th", "ing", " ", "  ", "▁", "\n", "é", "日", "0", "\x00", "==", "--", "<s>", "<0x0A>", "."]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += [" " * 5000 + "x", "a" * 9000, "=" * 4097, "the" * 2000]
    for text, ids in zip(texts, m.encode_all(texts)):
        assert ids.tolist() == sp.encode(text) and m.decode(ids) == sp.decode(ids.tolist())
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(259), 259]) for _ in range(rnd.randint(0, 9))]
        assert m.decode(ids) == sp.decode(ids)


def test_remembered_words_are_bounded_by_size(monkeypatch):
    """Words as long as a paragraph are forgotten by their characters, and the ids stay the same."""
    import sentencepiece
    from tokenizers import Tokenizer

    monkeypatch.setattr(sentencepiece_rounds, "KNOWN_CHARS", 5000)
    monkeypatch.setattr(token_files, "KNOWN_CHARS", 5000)
    texts = [[f"plain words {k} " * 3, chr(97 + k % 26) * 1500 + str(k), "plain words"] for k in range(40)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_rounds.PieceModel(path)
    for part in texts:
        assert [x.tolist() for x in m.encode_all(part)] == sp.encode(part)
        assert sum(map(len, m.known)) <= 5000 + 2 * sum(map(len, part))
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), token_files.WordEncoder(path)
    for part in texts:
        ids, sizes = e.encode(part)
        assert ids.tolist() == [i for x in t.encode_batch(part, add_special_tokens=False) for i in x.ids]
        assert max(sum(map(len, e.known)), sum(map(len, e.older))) <= 5000 + 2 * sum(map(len, part))


def test_long_pre_tokens_go_by_hash(spark, monkeypatch):
    """Pre-tokens beyond the key's width, hot and rare, alike at their beginning; a NUL and hash-like letters; and
    a task that passes its counts on after every text."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "HELD", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    long = ["a" * 64, "a" * 65, "a" * 66, "a" * 200 + "b", "a" * 200 + "c", "=" * 300, "9" * 100, "é" * 70]
    texts = [" ".join(long[k % 8:]) for k in range(24)] + ["\0" + hashlib.sha256(b"a" * 66).hexdigest(), "\0" * 80]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    for hot in (0, 4, 1000):
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, path, hot_limit=hot).collect()} == want
    keys = [r.token for r in token_counts.piece_table(rows.select("text"), path).collect()]
    assert max(map(len, keys)) <= token_counts.WIDE and len(set(keys)) == len(keys)


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    coded = sorted(((i or 0, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")) for i, x in TEXTS), key=lambda p: p[0])
    start, want = 0, []
    for i, ids in coded:
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    for size in (10, 1 << 21):
        got = token_files.token_files(docs, path, file_tokens=size).collect()
        assert sorted((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_files.token_files(empty, path).count() == 0


def test_token_file_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = rng.integers(0, 1 << int(rng.integers(1, 32)), n, dtype=np.uint64).astype(np.uint32)
        codes = token_files.Codes.build(ids)
        assert np.array_equal(codes.decode(), ids)
        if n:
            at = rng.integers(0, n, 300)
            assert np.array_equal(codes[at], ids[at])
    f = token_files.TokenFile(token_files.pack_file([3, None, 5], np.array([2, 2, 5]), np.array([9, 70000, 3, 400, 5]), 1))
    assert f.doc_ids == [3, None, 5] and [f.document(i).tolist() for i in range(3)] == [[9, 70000], [], [3, 400, 5]]


def test_word_encoder_matches_library():
    import random

    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    t, m = Tokenizer.from_file(path), token_files.encoder(path)
    bits = ["a", "The", "ing", " ", "  ", "\n", "\t", "É", "é", "İ", "Σ", "ς", "日", "1", "'s", "don't", ". ", ", ", "...",
            "<|endoftext|>", "<|EndOfText|>", "́", "_", "-", "\x85", " ", "ß"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    ids, sizes = m.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == t.encode(text, add_special_tokens=False).ids, text


# -- personal data ----------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fine(kind, value):
    d = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if fine(k, m.group(0))]


def test_base_spans(spark, docs, empty):
    import random

    rnd = random.Random(2)
    bits = ["a", "b.c", "@", "@x.y", "1.2.3.4", "255", ".", "300", "+1", " ", "-", "(555) ", "4111111111111111", "12", "\n", "é🙂", "_"]
    rows = [(100 + i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(1500)]
    rows += [(5000, "1" * 50_000), (5001, "x" * 50_000 + "@"), (5002, "1 " * 20_000), (5003, "a@b" * 5000), (5004, "." * 50_000)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = pii.personal_data(more).collect()
    want = sorted((i or 0, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(t)).encode()).hexdigest(),
                   *[sum(x[0] == k for x in brute_spans(t)) for k in BASE]) for i, t in [*TEXTS, *rows])
    assert sorted((r.doc_id or 0, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    assert pii.personal_data(empty).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    """Phones behind one phrase teach it; a number without the plus sign there is found, elsewhere not."""
    rows = [(i, f"please call us at +1 (555) 010-{1000 + 7 * i} during the week") for i in range(30)]
    rows += [(100, "please call us at 5550109999 during the week"), (101, "we sold 5550108888 pieces of it")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:18:28" and got[100].n_added == 1 and got[100].n_phone == 0
    assert got[101].spans == "" and all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(30))


def brute_known(texts, min_support=3, accept=0.9):
    """The bootstrapping in plain loops: added spans of each text, as (kind, start, end)."""
    kinds = ("email", "ip", "card", "phone")

    def instances(pattern, text):
        """Matches with the patterns of their sides, which end at the matches before and after."""
        found = list(re.finditer(pattern, text, re.A))
        for i, m in enumerate(found):
            low = max(m.start() - 48, found[i - 1].end() if i else 0)
            high = min(m.end() + 48, found[i + 1].start() if i + 1 < len(found) else len(text))
            before = re.split(r"\s+", text[low:m.start()].lower(), flags=re.A)
            after = re.split(r"\s+", text[m.end():high].lower(), flags=re.A)
            before, after = [w for w in before if w], [w for w in after if w]
            out = [f"L {before[-1]}"] if before else []
            out += [f"R {after[0]}"] if after else []
            out += [f"B {before[-1]} _ {after[0]}"] if before and after else []
            yield m, out + ([f"LL {before[-2]} {before[-1]}"] if len(before) > 1 else [])

    def shape(kind, v):
        n = sum("0" <= c <= "9" for c in v)
        return {"email": "@" in v, "ip": bool(re.fullmatch(r"[0-9]+(\.[0-9]+){2,}", v)),
                "card": bool(re.fullmatch("[0-9][0-9 -]*", v)) and 12 <= n <= 19,
                "phone": bool(re.fullmatch(r"[0-9+(][0-9 ()./-]*", v)) and 7 <= n <= 15}[kind]

    seeds, cands, places = {k: {} for k in kinds}, {}, []
    tokens = (r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", r"(?<!\S)[+(]*+[0-9][0-9()./-]*+(?: \(?[0-9][0-9()./-]*+)++")
    for at, text in enumerate(texts):
        text = text or ""
        base = brute_spans(text)
        for k in kinds:
            for m, own in instances(BASE[k] if k != "card" else "[0-9](?:[ -]?[0-9]){12,}+", text):
                if fine(k, m[0]):
                    seeds[k].setdefault(m[0].lower(), set()).update(own)
        for pattern in tokens:
            for m, own in instances(pattern, text):
                lead = len(re.match(r"[^A-Za-z0-9@+]*", m[0])[0])
                v = re.sub(r"(?<![^A-Za-z0-9])[^A-Za-z0-9]+$", "", m[0][lead:])
                s, e = m.start() + lead, m.start() + lead + len(v)
                if 5 <= len(v) <= 64 and re.search("[0-9@]", v) and all(e <= b or f <= s for _, b, f in base):
                    cands.setdefault(v.lower(), set()).update(own)
                    places.append((at, s, e, v.lower()))
    n_values = sum(map(len, seeds.values())) + len(cands)
    known, size = {}, 0
    for _ in range(10):
        conf = {}
        for p in {p for own in (*seeds.values(), cands) for ps in own.values() for p in ps}:
            under = {k: sum(p in ps for ps in seeds[k].values()) for k in kinds}
            own = [v for v in cands if p in cands[v]]
            for k in kinds:
                hits = [v for v in own if known.get(v, ("",))[0] == k]
                c = under[k] + sum(known[v][1] for v in hits)
                against = sum(under.values()) - under[k] + sum(
                    not shape(k, v) or (v in known and known[v][0] != k) for v in own)
                share = (len(seeds[k]) - under[k]) / (n_values - sum(under.values()) - len(own) + 1)
                x = c / (c + against + 1)
                if under[k] + len(hits) >= min_support and x >= 0.5 and x >= (1 + share) / 2:
                    conf[p, k] = x
        found = {}
        for v, ps in cands.items():
            scores = [(1 - np.prod([1 - conf[p, k] for p in ps if (p, k) in conf]), -i, k)
                      for i, k in enumerate(kinds) if shape(k, v)]
            best = max(scores, default=(0, 0, ""))
            if best[0] >= accept:
                found[v] = (best[2], best[0])
        known = found
        if len(known) <= size:
            break
        size = len(known)
    out = [[] for _ in texts]
    for at, s, e, v in sorted(set(places), key=lambda x: (x[0], x[1], -x[2])):
        if v in known and all(e > f for _, _, f in out[at]):
            out[at].append((known[v][0], s, e))
    return out


def contexts():
    """Six numbers of the base form behind a phrase, twelve unseen ones behind it; these also stand behind a
    second phrase that no base number knows, where three more stand; decoys beside common words."""
    rows = [f"Dial my line +49 30 5550{100 + i} today please" for i in range(6)]
    rows += [f"Dial my line 030-5551{200 + i} today please" for i in range(12)]
    rows += [f"Reach the desk under 030-5551{200 + i}, says Ann" for i in range(12)]
    rows += [f"Reach the desk under 0176 777 {400 + i}, says Ann" for i in range(3)]
    rows += [f"write to u{i}@ex.org for the parts" for i in range(9)] + [f"the host 10.0.0.{i} for the parts" for i in range(9)]
    rows += ["we sold 5559990000 for the parts", "part 030-9998887 of the stock", "on 2024-05-06 for the parts", "", "see u@local for the parts"]
    return rows


def test_bootstrapping_discovers(spark):
    rows = contexts()
    out = pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).collect()
    want = brute_known(rows)
    names = ("email", "ip", "card", "phone")
    for r in out:
        spans = sorted(brute_spans(rows[r.doc_id]) + want[r.doc_id], key=lambda x: (names.index(x[0]), x[1], x[2]))
        assert (r.spans, r.n_added) == (",".join(f"{k}:{s}:{e}" for k, s, e in spans), len(want[r.doc_id])), rows[r.doc_id]
    added = [bool(x) for x in want]
    assert all(added[6:33]) and not any(added[:6]) and not any(added[33:])  # the last three by the second phrase


def test_columns_of_any_name_stay(spark):
    """Columns named like the operators' own helpers, in any case."""
    clash = ("__id", "__TH", "__gone", "__n", "__h", "__new", "__cuts", "__keep_id", "__keep_th", "__toxic_score", toxicity.FIELD + "_", "fp")
    rows = [(i, f"line one of all\nmail a{i}@b.co and own {i}", f"s{i % 4}", *range(12)) for i in range(8)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in clash)
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    for out in (line_dedup.dedup_lines(docs), pii.redact(docs), simhash.keep_first(docs), toxicity.drop_toxic(docs, labels)):
        assert out.columns == docs.columns
        assert all([r[c] for c in clash] == list(range(12)) for r in out.collect())


def test_removed_lines_are_found_in_linear_time(spark):
    """Three copies of one long text: each line's flag is one step away, so twice the lines take about twice as long."""
    import time

    def seconds(n):
        text = "\n".join(f"line number {i}" for i in range(n))
        df = spark.createDataFrame([(i, text, f"s{i}") for i in range(3)], "doc_id long, text string, source string")
        began = time.time()
        rows = line_dedup.dedup_lines(df, removed_col="gone").orderBy("doc_id").collect()
        assert [r.gone for r in rows] == [0, n, n] and rows[0].text == text and rows[1].text == ""
        return time.time() - began

    seconds(1000)
    assert seconds(80_000) < 8 * seconds(20_000) + 5


def test_redact(docs, empty):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = {r.doc_id: r for r in out.collect()}
    assert got[10].text == "<email> is <ip>, not 10.0.0.999; card <card> or 4111 1111 1111 1112; <phone> <|endoftext|>"
    assert got[10].n_chars == len(got[10].text) and got[11].text == "mail <email>.\n" * 3
    assert got[4].text is None and got[9].text == LONG and out.count() == len(TEXTS)
    assert pii.redact(empty).count() == 0


# -- lines, packing, toxicity -----------------------------------------------------------------------


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs, min_sites=3, removed_col="gone")
    assert out.columns == [*docs.columns, "gone"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    # 'Home page' is on sites s1, s2, s3 and s0 (the row without an id, which sorts first and keeps it).
    assert got[None][0].text == "no id here\nHome page" and got[1][0].text.endswith("ten.\nown line")
    assert got[2][0].gone == 1 and [r.gone for r in got[3]] == [1, 1] and got[2][0].n_chars == len(got[2][0].text)
    assert got[11][0].gone == 0 and got[4][0].text is None and got[6][0].text == "   \n\t "
    assert line_dedup.dedup_lines(empty, removed_col="gone").count() == 0


def test_near_threshold_sites_are_counted_exactly(spark):
    rows = [(i, f"line {k}", f"site{i}") for k in (40, 49, 50, 51, 60) for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").groupBy("doc_id", "source").agg(
        F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text"))
    lines = line_dedup.occurrences(docs, "doc_id", "text", "source")
    want = {r.h for r in spark.createDataFrame([("line 50",), ("line 51",), ("line 60",)], "x string").select(F.xxhash64("x").alias("h")).collect()}
    assert {r.h1 for r in line_dedup.spread_lines(lines, 50).collect()} == want


def test_packing(spark, empty):
    rng = np.random.default_rng(0)
    sizes = [*rng.integers(0, 9000, 300).tolist(), 1024, 1024, 4096, 8192, 1, None]
    rows = [(None if i == 7 else i // 2 if i < 20 else i, i, n) for i, n in enumerate(sizes)]
    for group_size in (50, 50_000):
        got = packing.pack(spark.createDataFrame(rows, "doc_id long, th long, n_tokens long"), group_size=group_size).collect()
        assert sum(r.n_tokens for r in got) == sum(n or 0 for n in sizes)
        bins = {}
        for r in got:
            bins.setdefault(r.bin_id, []).append(r)
        for rows_of in bins.values():
            rows_of.sort(key=lambda r: r.bin_offset)
            end = 0
            for r in rows_of:
                assert r.bin_offset == end and 0 < r.n_tokens <= 4096
                end += r.n_tokens
            assert end == rows_of[0].bin_used <= rows_of[0].bin_capacity
            assert rows_of[0].bin_capacity == min(c for c in packing.CAPACITIES if c >= end)
    room = sum({r.bin_id: r.bin_capacity for r in got}.values())
    assert sum(r.n_tokens for r in got) / room > 0.97
    assert packing.pack(packing.token_lengths(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"))).count() == 0


def test_best_fit_takes_the_tightest_bin():
    place, final, _ = packing.best_fit(np.array([4000, 3000, 1000, 90, 24]), (1024, 2048, 4096))
    assert place[2] == 1 and place[3] == 0  # 1000 beside 3000, 90 beside 4000
    assert sorted(final.tolist()) == [4096, 4096]
    assert packing.best_fit(np.array([700]), (1024, 2048, 4096))[1].tolist() == [1024]


def test_bins_of_all_lengths_are_opened_together():
    """No length serves alone: each is opened in the middle of the run, where its fill is the cheapest."""
    caps = (1024, 2048, 4096)
    mixed = np.array([1300] * 300 + [1030] * 60 + [1010] * 160)
    place, final, opened = packing.best_fit(mixed, caps)
    middle = opened[len(opened) // 5:-len(opened) // 5]
    assert all((middle == c).sum() >= 10 for c in caps), [(middle == c).sum() for c in caps]

    def cost(final):
        return sum(packing.bin_cost(int(c)) for c in final)

    for alone in ((4096,), (2048,)):
        own = packing.best_fit(mixed, alone)[1]
        assert cost(final) < cost(own)
    assert len(packing.best_fit(np.array([], np.int64), caps)[0]) == 0


def test_opened_lengths_on_ordinary_documents():
    """Lengths as of ordinary text: bins of each length are open at once, little of them is padding."""
    rng = np.random.default_rng(3)
    sizes = np.sort(np.clip(rng.lognormal(6.2, 1.1, 6000).astype(int), 1, 4096))[::-1]
    place, final, opened = packing.best_fit(sizes, (1024, 2048, 4096))
    middle = opened[len(opened) // 5:-len(opened) // 5]
    assert {1024, 2048} <= set(middle.tolist()) and 4096 in opened
    assert sizes.sum() / final.sum() > 0.99
    assert (np.bincount(place, sizes) <= final).all() and (final <= opened).all()


def test_token_lengths_of_odd_texts(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "a b " * 60_000, 7), (4, "same text", 8), (4, "same text", 8), (None, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int").withColumn("n_tokens", F.lit("clash"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    count = packing.counter(path)
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in packing.token_lengths(docs, path).collect())
    assert got == sorted((i or 0, len(count(t or "")) + 1) for i, t, _ in rows)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    plain = ["river", "stone", "cloud", "green", "walks", "table"]
    rows = [(1000 + i, " ".join(rng.choice(plain, 40)) + (" you rotten zorkface " if i % 4 == 0 else " "), int(i % 4 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity.toxicity(more, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    kept = toxicity.drop_toxic(more, labels)
    assert kept.columns == more.columns and kept.where("doc_id is null").count() == 1
    none = toxicity.toxicity(docs, labels.limit(0)).collect()  # nothing to learn from
    assert len(none) == len(TEXTS) and {r.score for r in none} == {0.5}
    assert toxicity.toxicity(empty, labels).count() == 0
