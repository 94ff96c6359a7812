"""Quality rules: a decision list learned by sequential covering. DataFrame functions only.

Every text gets a row of statistics. On labelled rows, rules for low quality are learned one at a time. A
rule grows by the threshold condition of highest FOIL gain until it covers no good row or nothing gains;
it is pruned to the prefix that is best on rows not used to grow it; it is kept if it is precise there;
the rows it covers go, and the next rule is learned on the rest. Thresholds lie midway between quantiles of the classes.
A step is one aggregation by (statistic, bin) of the labelled rows still covered; only those sums, at
most ``statistics x bins`` rows, reach the driver.

The list is emitted as one conditional column: the first rule that holds rejects, and a text that none
rejects is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import materialise, prepare

# The blanks that end words, the symbols that are counted.
BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_length", "symbol_share", "mark_share", "digit_share", "capital_share", "letter_share",
            "short_share", "distinct_share", "dup_line_share", "repeat_share", "words_a_line")
BINS = 16  # quantiles of each class


def without(text: str, pattern: str) -> Column:
    """Code points of ``text`` that match a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)`` and the
    statistics of ``FEATURES``, for every row. Null text has no words and no lines.

    Three-word windows are compared by a 64-bit hash; a text without an equal pair of hashes is done,
    else the hashes are sorted with their places, so the work is that of a sort at most."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    rows = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(f"[^{BLANK}]+"), 0).alias("w"), lines.alias("lines"))
    windows = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    length = F.length("text")
    rows = rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), windows.alias("h"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size(F.filter("w", lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
        without("text", "[.,;:!?]").alias("n_marks"), without("text", "[0-9]").alias("n_digits"),
        without("text", r"\p{Lu}").alias("n_capitals"), without("text", r"\p{L}").alias("n_letters"))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    met = F.transform("s", lambda x, k: F.when((F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]), x["i"]))
    rows = rows.withColumn("at", F.array_sort(F.array_compact(met))).drop("s", "h")
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", start, lambda acc, i: F.struct(
        i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    n, chars = F.col("n_words"), F.col("word_chars")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        share(chars, n).alias("word_length"), share(F.col("n_symbols"), chars).alias("symbol_share"),
        share(F.col("n_marks"), chars).alias("mark_share"), share(F.col("n_digits"), chars).alias("digit_share"),
        share(F.col("n_capitals"), F.col("n_letters")).alias("capital_share"), share(F.col("n_letters"), chars).alias("letter_share"),
        share(F.col("n_short"), n).alias("short_share"), share(F.col("n_distinct"), n).alias("distinct_share"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"), share(F.col("n_repeat_words"), n).alias("repeat_share"),
        share(n, F.col("n_lines")).alias("words_a_line"))


@dataclass(frozen=True)
class Condition:
    """``feature > cut`` or, not ``above``, ``feature <= cut``."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def labelled_rows(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_limit: int, seed: int) -> DataFrame:
    """``(low, grow, ...)`` of labelled rows that the base rules pass: at most about ``sample_limit`` of each
    class, chosen by a hash of the id; two thirds have ``grow``. Ids with different labels are left out."""
    own = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high")
    own = own.select("doc_id", (F.col("low") == 0).alias("low"), F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)).alias("draw"))
    rows = materialise(stats.where("not base_failed").join(own, "doc_id").select("doc_id", "low", "draw", *FEATURES), "quality-labelled")
    n = {r.low: r.n for r in rows.groupBy("low").agg(F.count("*").alias("n")).collect()}
    part = F.when(F.col("low"), F.lit(min(1.0, sample_limit / max(1, n.get(True, 0))))).otherwise(
        F.lit(min(1.0, sample_limit / max(1, n.get(False, 0)))))
    grow = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(3)) < 2
    rows = rows.where(F.col("draw") < part * (1 << 20)).withColumn("grow", grow).drop("draw", "doc_id")
    return materialise(rows.coalesce(8), "quality-sample")


def cut_points(sample: DataFrame) -> list[list[float]]:
    """The thresholds of each feature, ascending: midway between neighbouring quantiles of either class, so
    that a cut between the classes is as far from the one as from the other."""
    at = [i / BINS for i in range(BINS + 1)]
    rows = sample.groupBy("low").agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).collect()
    seen = [sorted({float(x) for r in rows for x in r[f]}) for f in FEATURES]
    return [[(a + b) / 2 for a, b in zip(x, x[1:])] for x in seen]


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: value > x)) if cuts else F.lit(0)


def best_condition(rows: DataFrame, cuts: list[list[float]]) -> tuple[Condition | None, int, int]:
    """The condition of highest FOIL gain on ``rows(low, bins)``, and how many low and good rows there are."""
    sums = (rows.select("low", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin")
            .agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).collect())
    of: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums:
        of.setdefault(r.f, {})[r.bin] = (r.p, r.n)
    p0, n0 = (sum(x[i] for x in of.get(0, {}).values()) for i in (0, 1))
    best: tuple[float, Condition | None] = (0.0, None)
    for f in sorted(of):
        below = [0, 0]
        for j, cut in enumerate(cuts[f]):  # a bin is the number of cuts below the value
            for i in (0, 1):
                below[i] += of[f].get(j, (0, 0))[i]
            for above, p, n in ((False, *below), (True, p0 - below[0], n0 - below[1])):
                if 0 < p and (p, n) != (p0, n0):
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(FEATURES[f], above, cut))
    return best[1], p0, n0


def learn_rules(sample: DataFrame, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.8,
                min_cover: int = 3) -> list[Rule]:
    """The decision list of ``sample(low, grow, features)``: conjunctions in the order learned. Ends when fewer
    than ``min_cover`` low rows are left to grow on, or a rule's precision on the rows held back (on all
    rows, if it covers none of those) is under ``min_precision``."""
    cuts = cut_points(sample)
    bins = F.array(*[bin_of(F.col(f), c) for f, c in zip(FEATURES, cuts)])
    left = materialise(sample.withColumn("bins", bins), "quality-bins")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            found, p, n = best_condition(left.where("grow").where(holds(tuple(rule))), cuts)
            if p < min_cover or not n or found is None:
                break
            rule.append(found)
        if not rule:
            break
        # Each prefix on the rows held back, and on all.
        sums = [agg for k in range(1, len(rule) + 1) for part, where in (("held", ~F.col("grow")), ("all", F.lit(True)))
                for low in (True, False)
                for agg in [F.count_if(holds(tuple(rule[:k])) & where & (F.col("low") == low)).alias(f"{part}_{k}_{low}")]]
        row = left.agg(*sums).first()

        def worth(k: int) -> float:
            p, n = row[f"held_{k}_True"], row[f"held_{k}_False"]
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        part = "held" if row[f"held_{keep}_True"] + row[f"held_{keep}_False"] else "all"
        p, n = row[f"{part}_{keep}_True"], row[f"{part}_{keep}_False"]
        if p < min_precision * (p + n) or row[f"all_{keep}_True"] < min_cover:
            break
        rules.append(tuple(rule[:keep]))
        left = left.where(~holds(rules[-1]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one column: false by the first rule that holds, else true."""
    out = None
    for rule in rules:
        out = F.when(holds(rule), False) if out is None else out.when(holds(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample_limit: int = 20_000, seed: int = 13, **params) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` for every
    row of ``docs``: ``kept`` is false where ``base_failed`` or the learned list rejects.

    Labels of 0 are low quality, others good; null labels, ids with different labels and labels without a
    document teach nothing; without low rows no rule is learned and the base rules decide. ``sample_limit``
    bounds the rows of each class that rules are learned on, not the rows judged. Null text is empty (no
    words, base_failed); null ids pass through; repeated rows are each returned, and each counts in
    learning; other columns are not read; an empty table gives no rows."""
    prepare(docs.sparkSession)
    stats = materialise(statistics(docs, id_col, text_col), "quality-stats")
    rules = learn_rules(labelled_rows(stats, labels, id_col, label_col, sample_limit, seed), **params)
    kept = ~F.col("base_failed") & verdict(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        kept.alias("kept"))
