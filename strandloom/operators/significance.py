"""Which loci tell cells apart: base counts, coverage filters and a Bayesian test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCUS = ["chromosome_id", "position"]
COUNTS = ["n_a", "n_c", "n_g", "n_t"]

# Prior probabilities of a heterozygous locus and of a somatic mutation, and the thresholds of the
# log-ratio for a 10, 20, 30, 40 and 50 % share of mutated cells, by coverage bucket.
HETEROZYGOUS, MUTATED = 0.0005, 1e-6
THRESHOLDS = [
    [-1.64504967001201, -1.38868450353301, -1.38780664765677, -1.38779600211955, -1.3877952855556, -1.38779524274215, -1.38779524274142, -1.38779524274141, -1.3877952427414, -1.38779524274139, -1.38779524274138, -1.38779524274138, -1.38779524274138, -1.38779524274138, -1.38779524274139, -1.38780870444455, -1.38780870444455, -1.38780870444455, -1.38780870444455, -1.38780870444455],
    [-1.56013904495168, -1.38819451352203, -1.38781438946096, -1.38779659244035, -1.38779537799054, -1.3877952484612, -1.3877952427842, -1.38779524274906, -1.3877952427457, -1.38779524274275, -1.38780870444458, -1.38780870444459, -1.38780870444459, -1.38780870444469, -1.38780870444459, -1.42736056742577, -1.42736056742575, -6.19144172018466, -6.19144172018466, -14.1885779508362],
    [-1.47780038365618, -1.3885722463397, -1.38781428162649, -1.3877984410546, -1.38779548312685, -1.3877952855556, -1.38779524455204, -1.38779524331456, -1.38780873675669, -1.38780870687333, -1.42737804009806, -6.19144172131432, -14.1885779508648, -6.1914418045659, -30.1993093269287, -30.1993093268559, -30.1993093268539, -54.2154105288032, -62.2207775961199, -46.2100434614866],
    [-1.47780038365618, -1.38868450353301, -1.38782829051844, -1.3877984410546, -1.38779625512927, -1.38779556321717, -1.38780972304588, -1.3878087226245, -6.21747860711653, -22.1939432034943, -14.1886670526002, -22.1939422903721, -46.2100434614866, -54.2154105288069, -70.2261446634366, -62.2207775961199, -86.2368787980699, -110.25298000002, -118.258347067337, -102.247612932703],
    [-1.52859626647315, -1.38967447346712, -1.38787138908447, -1.38780282263764, -1.387805349423, -1.38882047800373, -1.49793700616569, -6.19975747800726, -22.197881249831, -38.2046765807324, -38.2046769835162, -70.2261446634383, -54.2154105303641, -78.2315117307532, -86.2368787980699, -118.258347067337, -126.263714134653, -134.26908120197, -158.28518240392, -158.28518240392],
]


def base_counts(obs: DataFrame, keys: list[str] = LOCUS) -> DataFrame:
    """n_a, n_c, n_g, n_t and coverage for each locus (or other keys): one shuffle of partial counts."""
    counts = [F.count_if(F.col("base") == i).alias(c) for i, c in enumerate(COUNTS)]
    return obs.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("coverage"))


def sorted_counts() -> Column:
    """The four counts, smallest first."""
    return F.array_sort(F.array(*COUNTS))


def with_sorted(df: DataFrame) -> DataFrame:
    s = sorted_counts()
    return df.withColumns({f"b{i + 1}": s[i] for i in range(4)})


def coverage_bucket(coverage: Column) -> Column:
    """Tens of coverage, half to even, from 0 to 19."""
    return F.greatest(F.lit(0), F.least(F.lit(19), F.bround(coverage / 10).cast("int") - 1))


def threshold(coverage: Column, proportion: int = 4) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in THRESHOLDS[proportion])), coverage_bucket(coverage) + 1)


def log_ratio(theta: float, null_prior: str = "reference") -> Column:
    """ln P(counts, homozygous) - ln P(counts), of columns b1 to b4 and coverage.

    null_prior 'reference' weighs the null hypothesis by the heterozygous prior, 'homozygous' by that of its name.
    """
    homo = 1 - HETEROZYGOUS - MUTATED
    b1, b2, b3, b4, cov = (F.col(c).cast("double") for c in ("b1", "b2", "b3", "b4", "coverage"))
    power = lambda x, n: F.pow(F.lit(x), n)
    null = b4 * math.log(1 - theta) + (cov - b4) * math.log(theta / 3) + (math.log(0.25) + math.log(HETEROZYGOUS if null_prior == "reference" else homo))
    evidence = (
        power(1 - theta, b4) * power(theta / 3, cov - b4) * homo
        + power(0.5 - theta / 3, b3 + b4) * power(theta / 3, b1 + b2) * HETEROZYGOUS
        + power(0.75 - 2 * theta / 3, b4) * power(0.25, b3) * power(theta / 3, b1 + b2) * (homo * MUTATED)
        + power(0.5 - theta, b4) * power(0.25, b2 + b3) * power(theta / 3, b1) * (HETEROZYGOUS * MUTATED)
        + power(1 - theta, cov) * (HETEROZYGOUS * MUTATED * MUTATED)
    )
    return null - F.when(evidence > 0, F.ln(evidence))


def pre_checks() -> Column:
    b = [F.col(f"b{i}") for i in range(1, 5)]
    return (F.col("coverage") >= 2) & (b[2] > 0) & (b[0] + b[1] + b[2] >= 5) & (b[3] >= 1.5 * b[2])


def significant_loci(obs: DataFrame, theta: float = 0.01, proportion: int = 4, null_prior: str = "reference", by: list[str] = []) -> DataFrame:  # noqa: B006
    """Loci with counts that pass the checks and the likelihood test; by: columns whose values are tested each for itself."""
    loci = with_sorted(base_counts(obs, [*by, *LOCUS])).where(pre_checks())
    test = log_ratio(theta, null_prior) < threshold(F.col("coverage"), proportion)
    return loci.where(test).select(*by, *LOCUS, *COUNTS, "coverage")


def keep_loci(obs: DataFrame, loci: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return obs.join(loci.select(*by, *LOCUS), [*by, *LOCUS], "left_semi")


def average_coverage(loci: DataFrame) -> DataFrame:
    return loci.agg(F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("avg_coverage"))


def pileup_loci(obs: DataFrame, min_different: int = 3, max_coverage: int = 100) -> DataFrame:
    """Loci of coverage 2 to max_coverage - 1 of which min_different bases differ from the most frequent one."""
    counts = base_counts(obs).where((F.col("coverage") >= 2) & (F.col("coverage") < max_coverage))
    return counts.where(F.col("coverage") - F.greatest(*COUNTS) >= min_different)


def cap_coverage(obs: DataFrame, max_coverage: int = 100) -> DataFrame:
    """Observations of loci covered max_coverage times at most."""
    return keep_loci(obs, obs.groupBy(*LOCUS).count().where(F.col("count") <= max_coverage))


def keep_positions(obs: DataFrame, positions: DataFrame, strict: bool = False) -> DataFrame:
    """Observations at listed positions; a chromosome without any is kept whole, unless strict."""
    listed = obs.join(positions, LOCUS, "left_semi")
    if strict:
        return listed
    return listed.unionByName(obs.join(positions.select("chromosome_id").distinct(), "chromosome_id", "left_anti").select(*obs.columns))


def log_factorial(n: Column) -> Column:
    """ln n!, exact sums to 170 and Stirling's series above."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(170)).cast("int"))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    x = n.cast("double")
    return F.when(n <= 170, small).otherwise((x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x))
