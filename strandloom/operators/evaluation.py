"""Scores of clusterings and thresholds, and orders of variant lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import running_sums


def adjusted_rand_index(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row, ari, of the contingency table's sums over pairs."""
    pairs = lambda n: n * (n - 1) / 2
    table = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = table.agg(F.sum(pairs(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    of = lambda c: table.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(c + "_"))
    row = both.crossJoin(of(a)).crossJoin(of(b))  # single rows
    chance = F.try_divide(F.col(f"{a}_") * F.col(f"{b}_"), pairs(F.col("n")))
    return row.select(F.coalesce(F.try_divide(F.col("ab") - chance, (F.col(f"{a}_") + F.col(f"{b}_")) / 2 - chance), F.lit(1.0)).alias("ari"))


def best_threshold(scores: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """threshold, j: the cut-off `score <= threshold` of the largest Youden index; of equal ones the smallest.

    Cut-offs are summed up by value first; running sums over the distinct scores are made range by range.
    """
    cuts = scores.groupBy(F.col(score).alias("t")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    total = cuts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    upto = running_sums(cuts, ["t"], ["p", "n"])
    j = F.try_divide(F.col("p"), F.col("all_p")) - F.try_divide(F.col("n"), F.col("all_n"))
    rated = upto.join(F.broadcast(total)).select("t", j.alias("j"))  # one row
    return rated.agg(F.max_by(F.col("t"), F.struct("j", -F.col("t"))).alias("threshold"), F.max("j").alias("j"))


def round_robin(rows: DataFrame, groups: int, by: list[str], order: list[Column | str]) -> DataFrame:
    """rows dealt in turn, within each `by`, to `groups` parts: column part."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("part", ((turn - 1) % groups).cast("int"))


def blocks_of(rows: DataFrame, size: int, by: list[str], order: list[Column | str]) -> DataFrame:
    """Every `size` rows of a `by`, in order, make a block: column block, from 1."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("block", F.ceil(turn / size).cast("int"))


def zscore_exponential(matrix: DataFrame, cut: float | None = None) -> DataFrame:
    """exp of the z-score of the off-diagonal values, cut from above before if asked."""
    value = F.least(F.col("m"), F.lit(cut)) if cut is not None else F.col("m")
    off = matrix.where("i <> j").withColumn("v", value)
    stats = off.agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_sd"))
    return off.join(F.broadcast(stats)).select("i", "j", F.exp(F.try_divide(F.col("v") - F.col("_mean"), F.col("_sd"))).alias("value"))


def inertia_gaps(inertia: DataFrame) -> DataFrame:
    """(k, gap): how much one cluster more takes off the inertia."""
    return inertia.select("k", (F.lag("inertia").over(Window.orderBy("k")) - F.col("inertia")).alias("gap"))


def simulated_loci(spark, n: int, coverage: float, proportion: float, theta: float, scenario: str, seed: int = 1) -> DataFrame:
    """Base counts of n simulated loci with Poisson coverage: 'homozygous', 'heterozygous' or 'somatic' ones.

    Each locus draws its coverage by inverting the Poisson distribution, and its counts by drawing every base.
    """
    import math

    cdf, term, total = [], math.exp(-coverage), 0.0
    for k in range(int(coverage + 12 * math.sqrt(coverage) + 20)):
        total += term
        cdf.append(total)
        term *= coverage / (k + 1)
    u = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 52)) / float(1 << 52)
    size = F.size(F.filter(F.array(*(F.lit(c) for c in cdf)), lambda c: c <= u(F.lit("n"), F.col("id"))))
    draws = spark.range(n).withColumn("cov", size).where("cov > 0").withColumn("r", F.explode(F.sequence(F.lit(1), F.col("cov"))))
    share = {"homozygous": 0.0, "heterozygous": 0.5, "somatic": proportion / 2}[scenario]
    true = F.when(u(F.lit("b"), "id", "r") < share, 1).otherwise(0)
    other = F.pmod(true + 1 + F.floor(u(F.lit("o"), "id", "r") * 3), F.lit(4))
    base = F.when(u(F.lit("e"), "id", "r") < theta, other).otherwise(true).cast("int")
    return draws.select(F.lit(0).alias("chromosome_id"), F.col("id").alias("position"), F.col("r").cast("long").alias("read_id"), F.lit(0).alias("cell_id"), base.alias("base"))
