"""Mix sources to target weights by Poisson replication.

Each source has a repetition rate: the size it should have over the size it has. A document's number of copies comes from
the Poisson distribution with that mean, inverted at a uniform number that a hash of seed and id gives: the same copies on
every run, no coordination between tasks, and totals that hit the targets up to sampling noise. A large mean is dealt into
equal parts, each drawn by a hash of its own: the sum of their counts is Poisson again, so that no source is too small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import fresh, materialize

#: The largest mean that one number is inverted at: from about 700 on, exp(-rate) loses its digits.
MOST_RATE = 500.0


def uniform(*parts) -> F.Column:
    """In [0, 1): the first 52 bits of an MD5 over the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_count(u: F.Column, rate: F.Column) -> F.Column:
    """The least k with u < P(X <= k), X Poisson with mean ``rate``; twelve deviations beyond the mean, k ends."""
    terms = (rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(u < s["cdf"], s).otherwise(
        F.struct((s["p"] * rate / i).alias("p"), (s["cdf"] + s["p"] * rate / i).alias("cdf"), i.cast("int").alias("k"))
    )
    return F.when(rate <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), terms), start, step)["k"])


def copy_count(seed: int, doc: F.Column, rate: F.Column) -> F.Column:
    """A Poisson count with mean ``rate`` for each ``doc``: the sum over as many parts as keep their means to MOST_RATE."""
    parts = F.ceil(rate / MOST_RATE).cast("int")
    one = lambda i: poisson_count(uniform(F.concat_ws(".", F.lit(str(seed)), i), doc), rate / parts)
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + one(i))
    return F.when(rate <= MOST_RATE, poisson_count(uniform(F.lit(str(seed)), doc), rate)).otherwise(many)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, exponent: float, total: float, source_col: str, text_col: str) -> DataFrame:
    """(source, rate): sizes in characters; a null source is the source ''. Sources without a weight get rate 0.

    Without ``weights``, the target share of a source goes with its size to the power ``exponent``.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(exponent))).otherwise(0.0))
    else:
        pairs = [F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))]
        weighed = sizes.withColumn("weight", F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(0.0), F.lit(0.0)))
    all_of = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rated = weighed.crossJoin(F.broadcast(all_of))  # a single row
    rate = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_size") * total / F.col("size")).otherwise(0.0)
    return rated.select("source", F.round(rate, 9).alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    total: float = 1.0,
    seed: int = 20,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The documents, each as often as its count says, in a random order, with ``copy_no`` (from 0) and ``mix_key``.

    ``weights``: target share of each source (null source: ''), else shares by size ** ``exponent``. ``total``: characters
    of the result over characters of the input. Rows that share an id share its count; null ids count as the id ''; null or
    empty texts follow their source's rate; sources of no characters get rate 0; an empty table stays empty. Columns of the
    input are kept; our own two get underscores where names clash.
    """
    rates = materialize(source_rates(docs, weights, exponent, total, source_col, text_col), "rates")
    key, rate, count, copy_no = (fresh(docs, x) for x in ("mix_source", "mix_rate", "mix_count", "copy_no"))
    order = fresh(docs, "mix_key")
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    joined = docs.withColumn(key, F.coalesce(F.col(source_col).cast("string"), F.lit(""))).join(rates.select(F.col("source").alias(key), F.col("rate").alias(rate)), key)
    counted = joined.withColumn(count, copy_count(seed, doc, F.col(rate))).filter(F.col(count) > 0)
    copies = counted.withColumn(copy_no, F.explode(F.sequence(F.lit(0), F.col(count) - 1))).withColumn(order, F.xxhash64(F.lit(seed), doc, F.col(copy_no)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.select(*docs.columns, copy_no, order).repartition(n, F.col(order)).sortWithinPartitions(order)
