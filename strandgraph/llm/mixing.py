"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

A source that has the share w of the target weights and n of the N documents repeats each document w * N / n times in the
mean. Each document's count is the Poisson quantile of a uniform number that a hash of (seed, id, text, source) gives, so a
re-run, a lost executor or another partitioning changes no count. A rate beyond LARGEST, whose quantiles double precision
doesn't reach, is parted: a sum of independent Poisson numbers is one, with a hash for each part. Documents are exploded by
their counts and dealt out by a hash of (what the draw had, copy, row number), each partition sorted by it: a global shuffle in
one exchange without a sampling pass. Where a source's rate is beyond STAGED, a document is first exploded into blocks of
STAGED copies and those are dealt out, so that no task makes all copies of one document.

The hash is MD5, of which 52 bits are used. Rows that agree in id, text and source are one document and share a draw (each gets
that many copies), but not a place. Null ids and texts count as '', and a null source is a source of its own. Sources
without a weight go if weights are given; weights need not add up to 1. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, gathered

SEED = 17
#: The rates are broadcast while their names and quantiles have at most so many bytes, else joined by a salted key.
BROADCAST_BYTES = 8 << 20
SALTS = 32
#: The largest rate of one draw; exp(-rate) is 0 beyond 745.
LARGEST = 500
#: Copies of a document that one task makes.
STAGED = 1000
_TWO52 = float(1 << 52)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_TWO52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to a k beyond which less than 1e-16 is left, as an array."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), top),
        start,
        lambda a, k: F.struct(
            (a["p"] * rate / k).alias("p"),
            F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c"),
        ),
        lambda a: a["c"],
    )


def poisson_quantile(u: Column, cdf: Column) -> Column:
    """The least k with P(X <= k) > u."""
    return F.size(F.filter(cdf, lambda c: c <= u))


def parts(rate: Column) -> Column:
    """How many draws a rate takes."""
    return F.greatest(F.lit(1), F.ceil(rate / LARGEST).cast("int"))


def poisson_count(seed: int, at: Column, u: Column, parts: Column, cdf: Column) -> Column:
    """The sum of as many draws as there are parts, cdf being that of one; u is the first one's number."""
    more = F.aggregate(
        F.sequence(F.lit(2), parts),
        poisson_quantile(u, cdf),
        lambda a, k: a + poisson_quantile(uniform(seed, at, k.cast("string"), F.lit("part")), cdf),
    )
    return F.when(parts == 1, poisson_quantile(u, cdf)).otherwise(more)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source") -> DataFrame:
    """(source, rate): mean copies of each document of a source. Without weights all sources weigh the same."""
    counts = docs.groupBy(docs[source].cast("string").alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_n"))
    if weights is None:
        weighed = counts.withColumn("mix_weight", F.lit(1.0))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "mix_given string, mix_weight double")
        weighed = counts.join(given, counts["mix_source"].eqNullSafe(given["mix_given"])).drop("mix_given")
    weighed = gathered(weighed)  # a row a source
    total = weighed.agg(F.sum("mix_n").alias("n"), F.sum("mix_weight").alias("weights")).first()  # two numbers
    rate = F.col("mix_weight") * F.lit(total["n"] or 0) / F.lit(total["weights"] or 1.0) / F.col("mix_n")
    return weighed.select("mix_source", rate.alias("mix_rate"))


def _sized(by_source: DataFrame) -> tuple[int, float]:
    """(bytes of the rates' table, greatest rate): two numbers."""
    size = F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 8 * F.size("mix_cdf") + 64
    row = by_source.agg(F.sum(size).alias("bytes"), F.max("mix_rate").alias("rate")).first()
    return row["bytes"] or 0, row["rate"] or 0.0


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs repeated to the target weights, in random order, with the columns of docs and copy (1, 2, ...)."""
    by_source = rates(docs, weights, source).withColumn("mix_parts", parts(F.col("mix_rate")))
    by_source = by_source.withColumn("mix_cdf", poisson_cdf(F.col("mix_rate") / F.col("mix_parts")))
    size, greatest = _sized(by_source)
    copy = free_name(docs, "copy")
    of = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    at = F.concat_ws(":", of(key), F.md5(of(text) if text in docs.columns else F.lit("")), of(source))
    # a document's own columns stay together in one, so that none clashes with those of the join
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"), docs[source].cast("string").alias("mix_own"), at.alias("mix_at"), F.monotonically_increasing_id().alias("mix_number"))
    left = left.withColumn("mix_u", uniform(seed, F.col("mix_at")))
    if size <= BROADCAST_BYTES:
        joined = left.join(F.broadcast(by_source), F.col("mix_own").eqNullSafe(F.col("mix_source")))
    else:
        salted = by_source.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = left.withColumn("mix_dealt", F.pmod(F.col("mix_number"), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, F.col("mix_own").eqNullSafe(F.col("mix_source")) & (F.col("mix_dealt") == F.col("mix_salt")))
    count = poisson_count(seed, F.col("mix_at"), F.col("mix_u"), F.col("mix_parts"), F.col("mix_cdf"))
    counted = joined.select("mix_row", "mix_at", "mix_number", count.alias("mix_count")).filter("mix_count > 0")
    first, last = F.lit(1), F.col("mix_count")
    if greatest > STAGED:
        blocks = counted.withColumn("mix_block", F.explode(F.sequence(F.lit(0), F.floor((last - 1) / STAGED).cast("int"))))
        counted = blocks.repartition("mix_number", "mix_block")
        first, last = F.col("mix_block") * STAGED + 1, F.least(last, (F.col("mix_block") + 1) * STAGED)
    copies = counted.select("mix_row", "mix_at", "mix_number", F.explode(F.sequence(first, last)).alias("mix_copy"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mix_at"), F.col("mix_copy").cast("string"), F.col("mix_number").cast("string"), F.lit("place")))
    shuffled = copies.select("mix_row", "mix_copy", place.alias("mix_place")).repartition("mix_place").sortWithinPartitions("mix_place")
    return shuffled.select("mix_row.*", F.col("mix_copy").alias(copy))
