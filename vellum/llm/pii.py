"""Personal data: base patterns for e-mail, IP, card and phone numbers, and bootstrapped contextual
extraction of identifiers they do not catch. DataFrame functions only.

One pass over the texts takes every match of each kind with its length, the length of the gap before
it and a little text on both sides, and also every token that holds a digit or an at sign; all later
steps work on these few rows. Places are sums of gaps and lengths, in code points.

Bootstrapping: the base matches are the first known identifiers. The words before and after an instance
are its lexical patterns (one word before, one after, both, and two before). Candidates are other tokens,
and runs of digit groups with blanks between, that have the loose shape of a kind (``fits``). Each round
scores the patterns by the identifiers known so far, the candidates by the patterns, and takes those that
reach ``accept`` among the known, until a round finds no new one (or after ``rounds``):

* a pattern's confidence for a kind is k / (k + r + 1): k known values of the kind below it (found ones
  count with their score), r values that speak against it: known ones of other kinds and candidates
  without the kind's shape. Candidates that may be of the kind but have no score yet do not count.
* a pattern is used if it has ``min_support`` known values, a confidence of 0.5 at least, and at least
  halfway from the kind's share among all values outside the pattern to 1; so words that stand beside
  anything teach nothing, however common a kind is.
* a candidate's score is the noisy-or of its patterns; its kind is that of the highest score.

What is found is added as spans of the kind, wherever it stands apart from base spans; of found spans one
inside the other the longer stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import free_names, materialise, prepare

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
# The base patterns with possessive runs and with starts only where a run can start: the same matches,
# in time linear in the text. Cards below 13 digits are no matches, which also leaves the rest as it is.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9]){12,}+",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
    r"(?<!\S)[+(]*+[0-9][0-9()./-]*+(?: \(?[0-9][0-9()./-]*+)++",
)
SIDE = 48  # code points of context kept on each side


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check (doubling every second digit from the right)."""
    def digit(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + digit(i))
    return total % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """The checks of the base kinds; failing matches are dropped."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    octets = F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3)
                      & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    return (F.when(kind == 0, F.lit(True)).when(kind == 1, octets)
            .when(kind == 2, F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False)))
            .when(kind == 3, n.between(9, 15)).otherwise(F.lit(False)))


def as_item(kind: int):
    """A zipped match, gap before and gap after as one item of ``kind``."""
    return lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"),
        x["m"].alias("value"), F.right(x["g"], F.lit(SIDE)).alias("left"), F.left(x["n"], F.lit(SIDE)).alias("right"))


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, th, items)`` for every row: the matches of every kind in its whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    digit = F.col("text").rlike("[0-9]")
    at = F.contains("text", F.lit("@"))
    rows = rows.withColumn("d", digit).withColumn("a", at)
    asks = (F.col("a"), F.col("d"), F.col("d"), F.col("d") & F.contains("text", F.lit("+")), F.col("d") | F.col("a"), F.col("d"))
    found = [F.when(ask, F.regexp_extract_all("text", F.lit(p), 0)).alias(f"m{k}") for k, (ask, p) in enumerate(zip(asks, PATTERNS))]
    gaps = [F.when(ask, F.split("text", p, -1)).alias(f"g{k}") for k, (ask, p) in enumerate(zip(asks, PATTERNS))]
    rows = rows.select("doc_id", "th", *found, *gaps)
    none = F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,value:string,left:string,right:string>>")
    parts = []
    for k in range(len(PATTERNS)):
        zipped = F.arrays_zip(F.col(f"m{k}").alias("m"), F.slice(f"g{k}", F.lit(1), F.size(f"m{k}")).alias("g"),
                              F.slice(f"g{k}", F.lit(2), F.size(f"m{k}")).alias("n"))
        parts.append(F.when(F.size(f"m{k}") > 0, F.transform(zipped, as_item(k))).otherwise(none))
    return rows.select("doc_id", "th", F.concat(*parts).alias("items"))


def placed(found: DataFrame) -> DataFrame:
    """Matches one a row with ``start`` and ``end``; rows with equal id and text count once."""
    own = found.where(F.size("items") > 0).dropDuplicates(["doc_id", "th"])
    rows = own.select("doc_id", "th", F.explode("items").alias("it")).select("doc_id", "th", "it.*")
    before = Window.partitionBy("doc_id", "th", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(before))
    return rows.withColumn("start", F.col("end") - F.col("len"))


def patterns() -> Column:
    """The lexical patterns of an instance, from the words beside it."""
    before = F.split(F.lower(F.trim(F.regexp_replace("left", r"\s+", " "))), " ")
    after = F.split(F.lower(F.trim(F.regexp_replace("right", r"\s+", " "))), " ")
    one, two = F.element_at(before, -1), F.try_element_at(before, F.lit(-2))
    nxt = F.element_at(after, 1)
    return F.array_compact(F.array(
        F.when(one != "", F.concat(F.lit("L "), one)), F.when(nxt != "", F.concat(F.lit("R "), nxt)),
        F.when((one != "") & (nxt != ""), F.concat(F.lit("B "), one, F.lit(" _ "), nxt)),
        F.when((one != "") & two.isNotNull() & (two != ""), F.concat(F.lit("LL "), two, F.lit(" "), one))))


def candidates(items: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens with a digit or at sign and runs of digit groups, without the signs round them, 5 to 64 code
    points long, that touch no base span: ``(doc_id, th, start, end, value, left, right)``."""
    lead = F.length(F.regexp_extract("value", r"^[^A-Za-z0-9@+]*+", 0))
    core = F.regexp_replace(F.substring("value", lead + 1, F.length("value")), r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
    tokens = (items.where(F.col("kind") >= CANDIDATE)
              .select("doc_id", "th", "kind", (F.col("start") + lead).alias("start"), core.alias("value"), "left", "right")
              .where(F.length("value").between(5, 64) & F.col("value").rlike("[0-9@]"))
              .withColumn("end", F.col("start") + F.length("value")))
    both = tokens.unionByName(base.select(*tokens.columns))
    both = both.withColumn("kind", F.least("kind", F.lit(CANDIDATE)))
    own = Window.partitionBy("doc_id", "th")
    up = own.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = own.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    is_base = F.col("kind") < CANDIDATE
    both = (both.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(up))
            .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(down)))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return both.where(~is_base & apart).drop("kind", "reach", "next")


def fits(kind: int, value: Column) -> Column:
    """Whether a candidate has the loose shape of a kind."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (F.contains(value, F.lit("@")), value.rlike(r"^[0-9]+(\.[0-9]+){2,}$"),
            value.rlike("^[0-9][0-9 -]*$") & digits.between(12, 19),
            value.rlike(r"^[0-9+(][0-9 ()./-]*$") & digits.between(7, 15))[kind]


def bootstrap(base: DataFrame, cands: DataFrame, rounds: int, min_support: int, accept: float) -> DataFrame:
    """``(value, kind)`` of the candidate values the pattern-instance graph confirms."""
    def edges(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, F.lower("value").alias("value"), F.explode(patterns()).alias("pattern")).distinct()

    def by_kind(df: DataFrame, *columns: Column) -> DataFrame:
        """A row of ``df`` for every kind."""
        return df.select("*", F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))])).alias("kind")).select("*", *columns)

    def of_kind(stem: str) -> Column:
        return F.element_at(F.array(*[F.col(f"{stem}{k}") for k in range(len(KINDS))]), F.col("kind") + 1)

    names = base.select("kind", F.lower("value").alias("value")).distinct()
    seeds = edges(base, "kind")
    unseen = materialise(edges(cands), "pii-candidates")
    # What does not change between rounds: of each pattern the seeds of each kind, the candidates without
    # the shape of each kind, and all its values.
    held = (seeds.groupBy("pattern").agg(*[F.count_if(F.col("kind") == k).alias(f"seeds{k}") for k in range(len(KINDS))],
                                         F.count("*").alias("n"))
            .unionByName(unseen.groupBy("pattern").agg(*[F.count_if(~fits(k, F.col("value"))).alias(f"odd{k}") for k in range(len(KINDS))],
                                                       F.count("*").alias("n")), allowMissingColumns=True)
            .groupBy("pattern").agg(*[F.coalesce(F.sum(f"{stem}{k}"), F.lit(0)).alias(f"{stem}{k}")
                                      for stem in ("seeds", "odd") for k in range(len(KINDS))], F.sum("n").alias("n")))
    held = materialise(held, "pii-patterns")
    total = names.agg(*[F.count_if(F.col("kind") == k).alias(str(k)) for k in range(len(KINDS))]).first()
    values = sum(total) + unseen.select("value").distinct().count()
    of_all = F.element_at(F.array(*[F.lit(int(x)) for x in total]), F.col("kind") + 1)
    known, size = None, 0
    for i in range(rounds):
        graph = by_kind(held, of_kind("seeds").alias("seeds"), of_kind("odd").alias("odd"))
        if known is None:
            graph = graph.withColumns({"more": F.lit(0.0), "found": F.lit(0), "others": F.lit(0)})
        else:
            taught = unseen.join(known, "value").groupBy("pattern").agg(
                *[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"more{k}") for k in range(len(KINDS))],
                *[F.count_if(F.col("kind") == k).alias(f"found{k}") for k in range(len(KINDS))],
                # Found values of another kind that have this one's shape too; those without count already.
                *[F.count_if((F.col("kind") != k) & fits(k, F.col("value"))).alias(f"others{k}") for k in range(len(KINDS))])
            taught = by_kind(taught, *[of_kind(x).alias(x) for x in ("more", "found", "others")]).select("pattern", "kind", "more", "found", "others")
            graph = graph.join(taught, ["pattern", "kind"], "left").na.fill(0, ["more", "found", "others"])
        every = F.col("seeds0") + F.col("seeds1") + F.col("seeds2") + F.col("seeds3")
        k = F.col("seeds") + F.col("more")
        against = every - F.col("seeds") + F.col("odd") + F.col("others")
        share = (of_all - F.col("seeds")) / (F.lit(values) - F.col("n") + 1)
        strong = (graph.withColumn("conf", k / (k + against + 1))
                  .where((F.col("seeds") + F.col("found") >= min_support) & (F.col("conf") >= 0.5) & (F.col("conf") >= (1 + share) / 2))
                  .select("pattern", "kind", "conf"))
        shaped = F.element_at(F.array(*[fits(x, F.col("value")) for x in range(len(KINDS))]), F.col("kind") + 1)
        score = (unseen.join(strong, "pattern").where(shaped).groupBy("value", "kind")
                 .agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")).where(F.col("score") >= accept))
        # The kind of the highest score, the first listed if several share it.
        known = materialise(score.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
                            .select("value", (-F.col("best.k")).alias("kind"), F.col("best.score").alias("score")), f"pii-known{i}")
        now = known.count()
        if now <= size:
            break
        size = now
    return known.select("value", "kind")


def find_spans(found: DataFrame, rounds: int = 10, min_support: int = 3, accept: float = 0.9) -> DataFrame:
    """``(doc_id, th, kind, start, end, is_base)`` of all spans of the (materialised) matches."""
    items = materialise(placed(found), "pii-items")
    base = items.where(F.col("kind") < CANDIDATE).where(valid(F.col("kind"), F.col("value")))
    base = materialise(base, "pii-base")
    cands = materialise(candidates(items, base), "pii-tokens")
    known = materialise(bootstrap(base, cands, rounds, min_support, accept), "pii-known")
    extra = cands.withColumn("value", F.lower("value")).join(known, "value")
    reach = F.max("end").over(Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end"))
                              .rowsBetween(Window.unboundedPreceding, -1))
    extra = extra.withColumn("reach", reach).where("reach is null or end > reach")
    columns = ["doc_id", "th", "kind", "start", "end"]
    return base.select(*columns, F.lit(True).alias("is_base")).unionByName(
        extra.select(*columns, F.lit(False).alias("is_base")))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, by kind and then start, with commas between."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 10,
                  min_support: int = 3, accept: float = 0.9) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` for every row; the four
    counts and the hash are of the base spans, ``spans`` has the added ones too and ``n_added`` counts them.

    Null text is empty; null ids pass through; rows with equal id and text get the same spans and are
    returned each; other columns are not read; an empty table gives no rows."""
    prepare(docs.sparkSession)
    found = materialise(matches(docs, id_col, text_col), "pii-matches")
    spans = find_spans(found, rounds, min_support, accept)
    one = F.struct("kind", "start", "end")
    counts = [F.count_if(F.col("is_base") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    per_doc = spans.groupBy("doc_id", "th").agg(
        *counts, F.count_if(~F.col("is_base")).alias("n_added"), F.collect_list(one).alias("all"),
        F.collect_list(F.when(F.col("is_base"), one)).alias("base"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "i", "th": "t"})
    rows = found.select("doc_id", "th").join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    zero = [F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in KINDS]
    return rows.select("doc_id", *zero, F.sha2(F.coalesce(joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
                       F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
                       F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with all its columns, of any name, every span of ``text_col`` replaced by its kind in angle
    brackets (spans that overlap become one, named by the first); ``n_chars``, if there is one, follows.
    Null texts and texts without spans stay as they are; rows with equal id and text change alike, also
    with a null id; an empty table gives no rows."""
    prepare(docs.sparkSession)
    spans = find_spans(materialise(matches(docs, id_col, text_col), "pii-matches"), **params)
    order = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("reach", reach).withColumn(
        "island", F.sum((F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int")).over(order))
    islands = (parts.groupBy("doc_id", "th", "island")
               .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                    F.min(F.struct("start", "kind")).alias("first")))
    prev = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id", "th").orderBy("start")), F.lit(0))
    islands = islands.withColumn("prev", prev).withColumn("kind", F.col("first.kind"))
    i, t, at, h, new = free_names(docs, "__id", "__th", "__cuts", "__h", "__new")
    cuts = materialise(islands.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "prev", "kind"))).alias("cuts")), "pii-cuts")
    cuts = cuts.select(F.col("doc_id").alias(i), F.col("th").alias(t), F.col("cuts").alias(at))
    own = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = own.join(cuts, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col(text_col)
    pieces = F.transform(at, lambda c: F.concat(
        F.substring(text, (c["prev"] + 1).cast("int"), (c["start"] - c["prev"]).cast("int")),
        F.element_at(names, c["kind"] + 1)))
    tail = F.substring(text, (F.element_at(at, -1)["end"] + 1).cast("int"), F.length(text))
    hit = F.col(at).isNotNull()
    rows = rows.withColumn(new, F.when(hit, F.concat(F.array_join(pieces, ""), tail)).otherwise(text))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == "n_chars":
            columns.append(F.when(hit, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return rows.select(*columns)
