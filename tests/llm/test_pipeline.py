"""The pipeline's stages and the registered queries."""

import base64

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_documents import brute_fingerprint, brute_known, brute_spans

import __spark_entry__
from vellum.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(queries.SQL) <= set(queries.QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= seen, name
        assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        seen = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == seen
    assert last.count() == corpus_pipeline.run(spark, SF).count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"none-{name}")
        assert docs.count() == 0


def brute_lines(texts, sources):
    """Lines (without blanks round them) on three sources or more stay at their first place only."""
    where, first = {}, {}
    for i in sorted(texts):
        for pos, line in enumerate(texts[i].split("\n")):
            if key := line.strip(" "):
                where.setdefault(key, set()).add(sources[i])
                first.setdefault(key, (i, pos))
    return {i: "\n".join(line for pos, line in enumerate(t.split("\n"))
                         if len(where.get(line.strip(" "), ())) < 3 or first[line.strip(" ")] == (i, pos))
            for i, t in texts.items()}


def brute_first_of_groups(texts):
    fps, root = {i: brute_fingerprint(t) for i, t in texts.items()}, {i: i for i in texts}
    while True:
        new = {i: min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
        if new == root:
            return {i: texts[i] for i in texts if root[i] == i}
        root = new


def brute_redacted(text, added=()):
    spans = sorted((s, -e, list(("email", "ip", "card", "phone")).index(k), k) for k, s, e in (*brute_spans(text), *added))
    islands = []
    for s, e, _, k in spans:
        if islands and s < islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], -e)
        else:
            islands.append([s, -e, k])
    for s, e, k in reversed(islands):
        text = text[:s] + f"<{k}>" + text[e:]
    return text


def brute_bins(pieces):
    """``pieces`` of falling length one after the other, looking at every open bin and, for a new one, at every
    later piece: members of each bin with its final capacity."""
    caps, bins = (1024, 2048, 4096), []  # a bin: room, capacity, members
    smallest = lambda n: min(c for c in caps if c >= n)
    for at, (*who, n) in enumerate(pieces):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])  # the first opened, if several
        else:
            later = [m for *_, m in pieces[at + 1:]]
            widest = max((b[0] for b in bins), default=0)
            unclaimed = sum(m for m in later if m <= widest) - sum(b[0] for b in bins)
            cost = {}
            for c in (c for c in caps if c >= n):
                filled, spare = n, unclaimed
                for m in later:
                    if filled + m > c:
                        continue
                    if m <= widest:
                        if m > spare:
                            break
                        spare -= m
                    filled += m
                real = smallest(filled)
                cost[c] = (real + real * real / 12_288 + 160) / filled
            b = [min(cost, key=lambda c: (cost[c], c)), 0, []]
            bins.append(b)
        b[0] -= n
        b[1] += n
        b[2].append((*who, n))
    return {(tuple(b[2]), smallest(b[1])) for b in bins}


def test_run_against_brute_force(spark):
    """All stages over the whole table in plain Python, from the classifier's weights on."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r for r in rows.collect()}
    model = toxicity.train(rows, spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist()))
    texts = {i: r.text for i, r in docs.items()
             if sum(weight.get(f, 0.0) for f in set(toxicity.features(r.text).tolist())) + model.bias < 0}
    assert 0 < len(texts) < len(docs)
    texts = brute_lines(texts, {i: r.source for i, r in docs.items()})
    texts = brute_first_of_groups(texts)
    added = brute_known(list(texts.values()))
    texts = {i: brute_redacted(t, more) for (i, t), more in zip(texts.items(), added)}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
    count = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sizes = {i: len(count(t)) + 1 for i, t in texts.items()}
    pieces = [(i, at, min(4096, n - at)) for i, n in sizes.items() for at in range(0, n, 4096)]
    want = brute_bins(sorted(pieces, key=lambda p: (-p[2], p[0], p[1])))

    bins = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.piece == r.first_token // 4096
        bins.setdefault(r.bin_id, []).append(r)
    got = set()
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))]
        got.add((tuple((r.doc_id, r.first_token, r.n_tokens) for r in own), own[0].bin_capacity))
    assert len(pieces) < 50_000 and got == want  # one group: the bins are those of the plain loop


def test_held_out_toxicity(spark):
    """On rows the classifier did not learn from. A part of the table's toxic labels sits on documents
    without any abuse, which no classifier can find; clean documents must be left alone all the same."""
    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op7_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    better = sum((t > c) + (t == c) / 2 for t in toxic for c in clean) / (len(toxic) * len(clean))
    hit = sum(r.predicted == r.toxic for r in rows) / len(rows)
    wrong = sum(c >= 0.5 for c in clean) / len(clean)
    assert len(toxic) >= 5 and better > 0.9 and hit > 0.95 and wrong < 0.02, (better, hit, wrong, len(rows))
