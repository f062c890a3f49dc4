"""Mixing sources to target weights by temperature (built-in expressions only).

A source's natural share p is its part of all tokens; its weight is p^a over the sum of all p^a. The exponent a is bisected
(in sixteenths a round, one small aggregation each) until the weights just meet a target entropy, or until no source is
repeated more often than a limit. A source's budget of tokens is then dealt as permutations of its documents: as many whole
ones as fit, then the beginning of one more. A permutation is the order of a hash of document and epoch, cut into blocks of
about BLOCK_ROWS documents; the last one is cut off by summing up blocks, and documents inside the one block where the
budget ends.

So a document's copies follow from its hash and one row of numbers about its source: no source is sorted or gathered, however
large it is, and texts are not shuffled.

Defined results: null sources form a source of their own; a null text has no tokens; a source without tokens has weight 0
and is left out; rows equal in id and text are dealt alike; the document at which the budget ends is left out; an empty
table gives an empty result; columns pass through, added ones overwrite none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.llm.common import SPACES, fresh, saved

BLOCK_ROWS = 10_000
CUTS = 16
ROUNDS = 6
DIGITS = 6  # of the exponent

_WIDE = 1 << 62


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^" + SPACES[1:-2] + "]+")).cast("bigint")


def _place(key: Column, epoch: Column) -> Column:
    """Place of a document in an epoch's permutation: 62 hashed bits."""
    return F.shiftrightunsigned(F.xxhash64(key, epoch), 2)


def _bisected(shares: DataFrame | None, holds: Callable[[float, float, float], bool]) -> float:
    """The exponent in [0, 1] up to which (holds: entropy) or from which on a condition of one monotone kind holds.

    holds(a, z, l): whether the larger part [a, 1] has to be searched, with z the sum of p^a and l that of p^a ln p.
    Sums are taken in decimals, so that the order of rows does not matter. Without shares, holds must not look at the sums:
    none are taken, and no job runs.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        cuts = [low + (high - low) * i / CUTS for i in range(1, CUTS)]
        passed = [holds(a, z, l) for a, (z, l) in zip(cuts, _sums(shares, *cuts), strict=True)]
        at = passed.index(False) if False in passed else len(cuts)
        low, high = (cuts[at - 1] if at else low), (cuts[at] if at < len(cuts) else high)
    return low if holds(low, *_sums(shares, low)[0]) else 0.0


def _sums(shares: DataFrame | None, *exponents: float) -> list[tuple[float, float]]:
    """The sums of p^a and of p^a ln p for each exponent."""
    if shares is None:
        return [(math.nan, math.nan)] * len(exponents)
    exact = lambda c: F.sum(c.cast("decimal(38,18)"))
    sums = [x for a in exponents for x in (exact(F.pow("p", F.lit(a))), exact(F.pow("p", F.lit(a)) * F.log("p")))]
    row = [float(x) for x in shares.agg(*sums).first()]
    return list(zip(row[::2], row[1::2], strict=True))


def plan(
    narrow: DataFrame, budget_tokens: int | None = None, entropy: float | None = None, max_repeats: float | None = None
) -> DataFrame:
    """One row a source: source, n_rows, tokens, weight, repeats, whole (epochs), blocks, cut (end of the last epoch).

    narrow: key (a hash of the document), source, tokens. budget_tokens: of the whole mixture; None: the least that leaves no
    document out. entropy: of the weights, as a share of the largest possible; max_repeats: of any source's tokens. Give one.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either a target entropy or a limit of repeats")
    sums = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tokens").alias("tokens")).where("tokens > 0")
    sums = saved(sums, "source-tokens")
    n, total, least, most = sums.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return sums.select("source", "n_rows", "tokens", *(F.lit(0.0).alias(c) for c in ("weight", "repeats")), *(F.lit(0).cast("bigint").alias(c) for c in ("whole", "blocks", "cut")))
    shares = sums.withColumn("p", F.col("tokens") / F.lit(float(total)))

    def repeats(a: float, z: float, tokens: int) -> float:
        """Of a source of so many tokens."""
        part = (tokens / total) ** (a - 1)
        return part / (most / total) ** (a - 1) if budget_tokens is None else part / z * budget_tokens / total

    if entropy is not None:
        # Entropy falls with the exponent: the largest exponent that still meets the target.
        goal = entropy * math.log(n)
        exponent = _bisected(shares, lambda a, z, l: math.log(z) - a * l / z >= goal)
        exponent = 1.0 if math.log(1.0) - _sums(shares, 1.0)[0][1] >= goal else math.floor(exponent * 10**DIGITS) / 10**DIGITS
    else:
        # Repeats of the smallest source fall with the exponent: the smallest exponent that keeps the limit. Without a budget
        # they follow from three sums that are known.
        over = lambda a, z, _: repeats(a, z, least) > max_repeats
        exponent = min(1.0, math.ceil(_bisected(None if budget_tokens is None else shares, over) * 10**DIGITS + 1) / 10**DIGITS) if over(0.0, float(n), 0) else 0.0
    ((z, _),) = _sums(shares, exponent)
    # Tokens for a weight of 1.
    scale = float(budget_tokens) if budget_tokens is not None else most / ((most / total) ** exponent / z)
    weighted = shares.withColumn("weight", F.pow("p", F.lit(exponent)) / z)
    weighted = weighted.withColumn("repeats", F.round(F.col("weight") * scale / F.col("tokens"), 9)).withColumn("whole", F.floor("repeats"))
    weighted = weighted.withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK_ROWS)).withColumn("rest", (F.col("repeats") - F.col("whole")) * F.col("tokens"))
    weighted = saved(weighted.drop("p"), "source-weights")
    return saved(_with_cuts(narrow, weighted).drop("rest"), "source-plan")


def _with_cuts(narrow: DataFrame, weighted: DataFrame) -> DataFrame:
    """cut: the place at which the last epoch of each source ends."""
    named = weighted.select(F.col("source").alias("__source"), "whole", "blocks", "rest")
    dealt = narrow.join(named, F.expr("source <=> __source")).where("rest > 0").withColumn("place", _place(F.col("key"), F.col("whole")))
    dealt = dealt.withColumn("block", _block(F.col("place"), F.col("blocks"))).select("source", "block", "place", "tokens", "rest")
    dealt = saved(dealt, "dealt")
    blocks = dealt.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("sum"))
    before = F.expr("coalesce(sum(sum) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    ends = blocks.withColumn("before", before).where("before < rest AND before + sum >= rest")
    ends = ends.groupBy("source", "rest").agg(F.min(F.struct("block", "before")).alias("end"))
    ends = ends.select(F.col("source").alias("__source"), F.col("end.block").alias("__block"), "end.before")
    inside = dealt.join(ends, F.expr("source <=> __source AND block = __block")).groupBy("source", "place", "rest", "before").agg(F.sum("tokens").alias("tokens"))
    upto = F.expr("sum(tokens) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    cuts = inside.withColumn("upto", upto + F.col("before")).where("upto > rest").groupBy("source").agg(F.min("place").alias("cut"))
    cuts = cuts.withColumnRenamed("source", "__source")
    full = F.when(F.col("rest") > 0, F.lit(_WIDE)).otherwise(F.lit(0).cast("bigint"))
    return weighted.join(cuts, F.expr("source <=> __source"), "left").withColumn("cut", F.coalesce("cut", full)).drop("__source")


def _block(place: Column, blocks: Column) -> Column:
    return F.floor(place.cast("double") / _WIDE * blocks)


def mixed(
    df: DataFrame,
    text: str,
    doc_id: str,
    source: str,
    budget_tokens: int | None = None,
    entropy: float | None = None,
    max_repeats: float | None = None,
    tokens: Column | None = None,
    whole_corpus: bool = False,
) -> DataFrame:
    """The rows as often as they are dealt, with epoch, block and at: the place in the mixed stream, from 0 to below 1.

    whole_corpus: the budget is the number of tokens that there are. tokens: a count of one's own, else words.
    """
    key, epoch, block, at = fresh(df, "__key", "epoch", "block", "at")
    keyed = df.withColumn(key, F.xxhash64(F.col(doc_id).cast("string"), text))
    count = n_words(F.col(text)) if tokens is None else tokens
    narrow = saved(keyed.select(F.col(key).alias("key"), F.col(source).alias("source"), count.alias("tokens")), "tokens")
    if whole_corpus:
        budget_tokens = narrow.agg(F.sum("tokens")).first()[0] or 0
    numbers = plan(narrow, budget_tokens, entropy, max_repeats)
    numbers = numbers.select(*(F.col(c).alias(f"__{c}") for c in ("source", "repeats", "whole", "blocks", "cut")))
    rows = keyed.join(numbers, F.expr(f"`{source}` <=> __source"))
    last = F.when(_place(F.col(key), F.col("__whole")) < F.col("__cut"), F.col("__whole")).otherwise(F.col("__whole") - 1)
    rows = rows.where(last >= 0).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    place = _place(F.col(key), F.col(epoch))
    rows = rows.withColumn(block, _block(place, F.col("__blocks")))
    rows = rows.withColumn(at, F.least((F.col(epoch) + place.cast("double") / _WIDE) / F.col("__repeats"), F.lit(1 - 1e-9)))
    return rows.select(*df.columns, epoch, block, at)
