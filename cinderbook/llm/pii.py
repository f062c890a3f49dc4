"""Personal data: exact base kinds, and identifiers found by bootstrapped contextual extraction (built-in expressions only).

Base spans come from one pattern a kind, leftmost and non-overlapping, checked afterwards (parts of an address, check digit,
number of digits). The patterns are written without backtracking, so that long texts take linear time.

Bootstrapping: every base span is a seed entity. The words to the left and right of it are lexical patterns. Candidates
are other tokens that look like identifiers (enough digits, or an @). Edges between patterns and entities are counted in
Spark; in each of ROUNDS rounds a pattern's confidence is the share of all places of its word, anywhere in the corpus,
that stand next to entities accepted so far, and an entity's score joins the confidences of its accepted patterns. Accepted
entities add a span at every place they occur outside base spans, with the kind they were accepted for.

Defined results: a null text counts as empty; rows equal in id and text get the same result; positions count code points,
ends are exclusive; without seeds nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbook.llm.common import let, saved, words_of

KINDS = ("email", "ip", "card", "phone")

# The plain patterns, with possessive quantifiers where what follows cannot use a given-back character, and looking back
# where an earlier start in the same run would have matched as well (\G: a run that a match has just ended in).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to be looked for at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
PUNCTUATION = "\"'`()[]{}<>,;:.!?*#%&$|="
MIN_DIGITS = 5  # of a candidate without @
MIN_SUPPORT = 3  # accepted entities a pattern needs
MIN_CONFIDENCE = 0.5
MIN_SCORE = 0.6
ROUNDS = 3
CHUNK = 512

SPAN = "struct<start:bigint,rank:int,stop:bigint,kind:string,entity:string,left:string,right:string>"


def _running(sizes: Column) -> Column:
    """Running sums of an array of numbers, in chunks so that the work stays near linear."""

    def sums(a: Column) -> Column:
        add = lambda out, x: F.concat(out, F.array(x + F.coalesce(F.get(out, F.size(out) - 1), F.lit(0).cast("bigint"))))
        return F.aggregate(a, F.array().cast("array<bigint>"), add)

    starts = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    inside = F.transform(starts, lambda i: sums(F.slice(sizes, i, CHUNK)))

    def shifted(parts: Column) -> Column:
        ends = sums(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        before = lambda e, i: F.coalesce(F.get(e, i - 1), F.lit(0).cast("bigint"))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + before(e, i)))))

    return let(inside, shifted)


def _last_word(gap: Column) -> Column:
    blanks = F.rtrim(F.regexp_replace(F.lower(gap), r"[\x09-\x0D]", " "))
    return F.substring_index(blanks, " ", -1)


def _first_word(gap: Column) -> Column:
    blanks = F.ltrim(F.regexp_replace(F.lower(gap), r"[\x09-\x0D]", " "))
    return F.substring_index(blanks, " ", 1)


def _hits(text: Column, pattern: str, hint: str, build) -> Column:
    """build(hit, end, gap before, gap after) for all matches of a pattern: hits and the gaps between them give positions."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(
        F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")),
        lambda m: let(
            _running(F.transform(m["hits"], lambda h, i: (F.length(h) + F.length(F.get(m["gaps"], i))).cast("bigint"))),
            lambda ends: F.transform(
                m["hits"], lambda h, i: build(h, F.get(ends, i), F.get(m["gaps"], i), F.get(m["gaps"], i + 1), F.get(m["hits"], i - 1), F.get(m["hits"], i + 1))
            ),
        ),
    )
    return F.when(text.rlike(hint), found)


def _checks(digits: Column) -> Column:
    """Luhn's rule: digits from the right, every second one doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255)
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _checks(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text (not null), by start, then kind."""
    nothing = F.array().cast(f"array<{SPAN}>")

    def of(rank: int, kind: str) -> Column:
        def build(hit, end, before, after, _earlier, _later):
            return F.struct(
                (end - F.length(hit)).alias("start"),
                F.lit(rank).alias("rank"),
                end.alias("stop"),
                F.lit(kind).alias("kind"),
                F.lower(hit).alias("entity"),
                _last_word(before).alias("left"),
                _first_word(after).alias("right"),
            )

        found = F.filter(_hits(text, PATTERNS[kind], HINTS[kind], build), lambda s: _valid(kind, s["entity"]))
        return F.coalesce(found.cast(f"array<{SPAN}>"), nothing)

    return F.sort_array(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def candidates(text: Column) -> Column:
    """Tokens of a text (not null) that may be identifiers, without punctuation around them."""

    def build(token, end, before, after, earlier, later):
        core = F.ltrim(F.rtrim(token, F.lit(PUNCTUATION)), F.lit(PUNCTUATION))
        start = end - F.length(F.ltrim(token, F.lit(PUNCTUATION)))
        word = lambda w, other: F.coalesce(F.nullif(w, F.lit("")), F.lower(other), F.lit(""))
        return F.struct(
            start.alias("start"),
            F.lit(None).cast("int").alias("rank"),
            (start + F.length(core)).alias("stop"),
            F.lit(None).cast("string").alias("kind"),
            F.lower(core).alias("entity"),
            word(_last_word(before), earlier).alias("left"),
            word(_first_word(after), later).alias("right"),
        )

    found = _hits(text, TOKEN, "[0-9@]", build)
    enough = lambda s: F.contains(s["entity"], F.lit("@")) | (F.regexp_count(s["entity"], F.lit("[0-9]")) >= MIN_DIGITS)
    return F.coalesce(F.filter(found, enough).cast(f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>"))


def _outside_base(spans: DataFrame) -> DataFrame:
    """Drop candidates that overlap a base span of their document."""
    by = Window.partitionBy("id", "hash").orderBy("start", F.desc("stop"), F.asc_nulls_first("rank"))
    based = lambda c: F.when(F.col("kind").isNotNull(), F.col(c))
    spans = spans.withColumn("__before", F.max(based("stop")).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("__after", F.min(based("start")).over(by.rowsBetween(1, Window.unboundedFollowing)))
    clear = (F.coalesce("__before", F.lit(0)) <= F.col("start")) & (F.coalesce("__after", F.col("stop")) >= F.col("stop"))
    return spans.where(F.col("kind").isNotNull() | clear).drop("__before", "__after")


def bootstrap(spans: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """entity, kind: candidates accepted as identifiers.

    spans: kind (null for candidates), entity, left, right; words: word, n of the whole corpus.
    """
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in ("left", "right")))
    edges = spans.select("kind", "entity", F.explode(sides).alias("p")).select("kind", "entity", "p.*").where("word <> ''")
    edges = edges.groupBy("kind", "entity", "side", "word").agg(F.count(F.lit(1)).alias("n"))
    used = edges.groupBy("side", "word").agg(F.sum("n").alias("seen"))
    totals = used.join(words.select("word", F.col("n").alias("all")), "word", "left").select(
        "side", "word", F.greatest("seen", F.coalesce("all", F.lit(0))).alias("places")
    )
    edges = saved(edges.join(totals, ["side", "word"]), "pattern-edges")
    seeds = edges.where("kind IS NOT NULL").select("entity", "kind").distinct().withColumn("score", F.lit(1.0))
    accepted = saved(seeds, "entities")
    for _ in range(rounds):
        # Seed edges count for their kind only, candidates for every kind they are accepted for.
        known = edges.join(accepted.withColumnRenamed("kind", "as"), "entity").where("kind IS NULL OR kind = as")
        patterns = known.groupBy("side", "word", "places", F.col("as").alias("kind")).agg(
            F.sum((F.col("n") * F.col("score")).cast("decimal(20,6)")).alias("weight"), F.countDistinct("entity").alias("support")
        )
        patterns = patterns.withColumn("confidence", F.least(F.col("weight").cast("double") / F.col("places"), F.lit(0.999)))
        patterns = patterns.where((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
        joined = edges.where("kind IS NULL").drop("kind", "places").join(patterns.select("side", "word", "kind", "confidence"), ["side", "word"])
        doubt = F.sum(F.log(1 - F.col("confidence")).cast("decimal(20,6)")).cast("double")
        found = joined.groupBy("entity", "kind").agg(F.round(1 - F.exp(doubt), 6).alias("score")).where(F.col("score") >= MIN_SCORE)
        accepted = saved(seeds.unionByName(found), "entities")
    best = F.max_by("kind", F.struct("score", "kind"))
    return accepted.join(seeds.select("entity"), "entity", "left_anti").groupBy("entity").agg(best.alias("kind"))


def spans_of(df: DataFrame, text: str, doc_id: str, rounds: int = ROUNDS) -> DataFrame:
    """id, base, spans for every row: base spans alone, and all spans, each by start, then kind."""
    value = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).alias("id"), value.alias("text"))
    table = saved(docs.select("id", F.xxhash64("text").alias("hash"), base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("other")), "spans")
    mentions = table.select("id", "hash", F.inline(F.array_distinct(F.concat("base", "other"))))
    mentions = saved(_outside_base(mentions.dropDuplicates(["id", "hash", "start", "stop", "kind"])), "mentions")
    words = docs.select(F.explode(words_of(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    entities = bootstrap(mentions, words, rounds)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    found = mentions.where("kind IS NULL").drop("kind", "rank").join(entities, "entity").withColumn("rank", rank)
    found = found.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "rank", "stop", "kind", "entity", "left", "right")).alias("found"))
    found = found.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), "found")
    joined = table.join(found, F.expr("id <=> __id AND hash = __hash"), "left")
    more = F.coalesce(F.col("found").cast(f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>"))
    return joined.select("id", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
