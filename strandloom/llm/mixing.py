"""Mixing sources to target weights by Poisson replication.

Every source s gets the rate lambda_s = weight_s * target_rows / rows_s. A document is repeated n times, n being the
value at which the Poisson(lambda_s) distribution is inverted by a uniform number that a seeded hash of its id gives:
the same rows come out on every run and on every layout of the input. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rates above this are drawn as a sum of equal smaller Poisson draws, as exp(-rate) would underflow.
LARGEST_RATE = 256.0
#: Sources are broadcast up to this many; beyond, they are joined by a shuffle, each source's rows under SALTS keys.
BROADCAST_SOURCES, SALTS = 10_000, 64


def uniform(seed: int, part: Column, key: Column) -> Column:
    """In [0, 1) with 52 bits, from the MD5 of seed, part and key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), part.cast("string"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as 52 bits can tell from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("pmf"), first.alias("sum"), F.array(first).alias("cdf"))

    def step(acc, k):
        pmf = acc["pmf"] * rate / k.cast("double")
        total = acc["sum"] + pmf
        return F.struct(pmf.alias("pmf"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def source_rates(counts: DataFrame, weights: dict[str | None, float] | None, target_rows: int | None) -> DataFrame:
    """One row for each source that keeps any mass: _source, _draws, _cdf. counts: (_source, _rows) of all rows.

    Without weights all sources weigh the same. Weights need not sum to 1; a source that has none is left out.
    """
    if weights is None:
        weighted = counts.withColumn("_weight", F.lit(1.0))
    else:
        pick = F.lit(0.0)
        for name, w in weights.items():
            pick = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(pick)
        weighted = counts.withColumn("_weight", pick).where("_weight > 0")
    mass = weighted.agg(F.sum("_weight")).first()[0]  # sums of a table with a row for each source
    goal = float(target_rows) if target_rows is not None else float(counts.agg(F.sum("_rows")).first()[0] or 0)
    rate = F.col("_weight") / F.lit(mass or 1.0) * F.lit(goal) / F.col("_rows").cast("double")
    draws = F.greatest(F.lit(1), F.ceil(rate / LARGEST_RATE).cast("int"))
    return (
        weighted.select("_source", rate.alias("_rate"), draws.alias("_draws"))
        .select("_source", "_draws", poisson_cdf(F.col("_rate") / F.col("_draws")).alias("_cdf"))
    )


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    target_rows: int | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str | None = "copy",
) -> DataFrame:
    """docs repeated to the target weights and dealt out in a random order that the seed fixes.

    The result has the columns of docs, then copy_col (0, 1, ... of each document) unless that is None or taken.
    A null source is a source of its own (weights may name it by None). Rows that share an id share the count, a null
    id counts as the text 'null'. No rows give no rows; null, empty and long texts are columns like any other. target_rows
    defaults to the number of rows, as an expectation. Rows are counted once, by source; the counts are a small table.
    """
    names = docs.columns
    counts = materialize(docs.groupBy(F.col(source_col).cast("string").alias("_source")).agg(F.count(F.lit(1)).alias("_rows")), "sources")
    rates = source_rates(counts, weights, target_rows)
    own = [f"c{i}" for i in range(len(names))]  # docs may have columns of any name
    id_at, source_at = own[names.index(id_col)], own[names.index(source_col)]
    key = F.coalesce(F.col(id_at).cast("string"), F.lit("null"))
    same = F.col(source_at).cast("string").eqNullSafe(F.col("_source"))
    if counts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    else:  # one source may hold any share of the rows
        rates = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.pmod(F.xxhash64(F.lit(seed), key), F.lit(SALTS)) == F.col("_salt")
    numbers = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda i: uniform(seed, i, key))  # once a draw
    inverted = F.transform(numbers, lambda u: F.size(F.filter(F.col("_cdf"), lambda p: p <= u)))
    drawn = F.aggregate(inverted, F.lit(0), lambda n, k: n + k)
    out = docs.toDF(*own).join(rates, same).withColumn("_n", drawn)
    out = out.where("_n > 0").select(*own, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), key, F.col("_copy").cast("string")))
    out = out.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order")
    keep = [F.col("_copy").alias(copy_col)] if copy_col and copy_col not in names else []
    return out.select(*(F.col(c).alias(n) for c, n in zip(own, names)), *keep)


def oracle(seed: int = 42, table: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same rows in DuckDB's SQL, for equal weights."""
    return f"""
    WITH rates AS (
      SELECT source, (1.0::DOUBLE / count(*) OVER ()) * (sum(n) OVER ())::DOUBLE / n::DOUBLE AS rate
      FROM (SELECT source, count(*) AS n FROM {table} GROUP BY source)),
    steps AS (
      SELECT source, rate, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END AS pmf
      FROM rates, range(0, 2000) AS r(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
    cdfs AS (SELECT source, list(p ORDER BY k) AS cdf FROM
      (SELECT source, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS p FROM steps) GROUP BY source),
    drawn AS (
      SELECT d.*, len(list_filter(cdf, lambda p: p <= ('0x' || substr(md5('{seed}|1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS n
      FROM {table} d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source)
    SELECT {columns}, unnest(range(0, n))::INTEGER AS copy FROM drawn WHERE n > 0
    """
