"""Mixing sources to target weights by Poisson replication.

A source s has a mean repetition rate r(s) = weight(s) * budget / size(s). A hash of the seed and the row gives a number
u in [0, 1), and the count of copies is the inverse of the Poisson distribution with mean r(s) at u. Copies are spread
over partitions by a hash and ordered by it, which shuffles the whole corpus.

Sizes are characters, counted over all rows. Without given weights, weight(s) is proportional to size(s) ** alpha, and
the budget is the size of the input, so that alpha < 1 raises small sources and lowers large ones. Means over
SPLIT_MEAN are the sum of several independent draws, which is again Poisson and keeps exp(-mean) in range.

Edge cases: a null source is the source ''; a null or empty text has the size 1, so that no rate divides by nothing; rows
that are equal in doc_id, text and source get the same count; a source without a given weight has weight 0; an empty
table gives no rows. Columns of the input are kept; this operator's own end in ``_mix`` and are left out where the input
has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

SPLIT_MEAN = 32.0
BROADCAST_ROWS = 20_000
TERMS = 120  # P(X > 120 | mean 32) is far below 2 ** -53
LARGEST = 1 - 2.0**-52  # the largest number that ``uniform`` gives


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from an md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, budget: float | None = None) -> DataFrame:
    """src_mix, size_mix (characters), mean_mix (expected copies of each of its rows)."""
    size = F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1))
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("src_mix")).agg(F.sum(size.cast("long")).alias("size_mix"))
    sizes = stored(sizes, "source-sizes")
    if weights is None:
        share = F.pow("size_mix", F.lit(alpha))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("src_mix") == name, F.lit(float(weight))).otherwise(share)
    sizes = sizes.withColumn("share_mix", share)
    total = sizes.agg(F.sum("share_mix").alias("shares"), F.sum("size_mix").alias("chars")).first()
    scale = (budget or float(total.chars or 0)) / total.shares if total.shares else 0.0
    return sizes.select("src_mix", "size_mix", (F.col("share_mix") * F.lit(scale) / F.col("size_mix")).alias("mean_mix"))


def thresholds(mean: Column) -> Column:
    """cdf(0), cdf(1), ... of the Poisson distribution with a mean up to SPLIT_MEAN, as far as a draw can reach."""
    step = lambda a, k: F.struct(
        (a["p"] * mean / k).alias("p"),
        (a["c"] + a["p"] * mean / k).alias("c"),
        F.array_append(a["all"], a["c"]).alias("all"),
    )
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array().cast("array<double>").alias("all"))
    return F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda a: a["all"]), lambda c: c <= LARGEST)


def poisson_count(u: Column, cdf: Column) -> Column:
    """The number of k with cdf(k) <= u: the inverse of the distribution."""
    return F.size(F.filter(cdf, lambda c: c <= u))


def with_counts(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """docs with n_mix, the copies of each row, and text_mix, a digest of its text."""
    mean = F.col("mean_mix")
    draws = F.greatest(F.ceil(mean / SPLIT_MEAN), F.lit(1)).cast("int")
    rates = rates.withColumn("draws_mix", draws).withColumn("cdf_mix", thresholds(mean / F.col("draws_mix")))
    rates = stored(rates.select("src_mix", "draws_mix", "cdf_mix"), "source-rates")
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    keyed = docs.withColumn("src_mix", F.coalesce("source", F.lit(""))).withColumn("text_mix", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    ident = [F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("src_mix"), F.col("text_mix")]
    one = lambda i: poisson_count(uniform(*ident, i.cast("string")), F.col("cdf_mix"))
    several = F.aggregate(F.sequence(F.lit(0), F.col("draws_mix") - 1), F.lit(0), lambda a, i: a + one(i))
    several = F.coalesce(several, F.lit(0))
    return keyed.join(rates, "src_mix", "left").withColumn("n_mix", several).drop("src_mix", "draws_mix", "cdf_mix")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, budget: float | None = None, seed: int = 17) -> DataFrame:
    """Every row of docs n_mix times (copy_mix from 1), shuffled over the whole corpus; order_mix is the order's key."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row_mix"), "doc_id", "text", "source")
    counted = with_counts(rows, source_rates(rows, weights, alpha, budget), seed).drop("text", "source")
    copies = counted.where("n_mix > 0").withColumn("copy_mix", F.explode(F.sequence(F.lit(1), F.col("n_mix"))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}s"), F.col("doc_id").cast("string"), F.col("text_mix"), F.col("copy_mix").cast("string")).cast("binary"))
    copies = copies.withColumn("order_mix", key).drop("text_mix", "doc_id")
    dealt = copies.repartition(partitions(docs.sparkSession), "order_mix").sortWithinPartitions("order_mix")
    own = [c for c in ("n_mix", "copy_mix", "order_mix") if c not in names]
    return dealt.select(*[F.col("row_mix")[c].alias(c) for c in names], *own)
