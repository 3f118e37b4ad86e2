"""Genotypes of clusters, lines of variants and scores of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import decode_base, first_allele, genotype, is_homozygous, same_genotype, second_allele
from ..session import with_checkpoints
from .significance import COUNTS, LOCUS, base_counts


def tagged(obs: DataFrame, labels: DataFrame) -> DataFrame:
    """obs with cluster_id; cells without label are in cluster 0."""
    return obs.join(labels, "cell_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)))


def cluster_counts(obs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts of each locus and cluster, and pooled ones where cluster_id is null: one pass, grouping sets.

    Cells without label are in cluster 0.
    """
    counts = [F.count_if(F.col("base") == i).alias(c) for i, c in enumerate(COUNTS)]
    keys = [F.col(c) for c in LOCUS]
    return tagged(obs, labels).groupingSets([[*keys, F.col("cluster_id")], keys], *keys, F.col("cluster_id")).agg(*counts, F.count(F.lit(1)).alias("coverage"))


def ranked(df: DataFrame) -> DataFrame:
    """Counts with their bases, smallest first, equal ones by base: c1 to c4 and g1 to g4."""
    order = F.array_sort(F.array(*(F.struct(F.col(c).alias("n"), F.lit(i).alias("g")) for i, c in enumerate(COUNTS))))
    df = df.withColumn("_o", order)
    return df.withColumns({f"c{k + 1}": F.col("_o")[k]["n"] for k in range(4)} | {f"g{k + 1}": F.col("_o")[k]["g"] for k in range(4)}).drop("_o")


def pooled_call(theta: float) -> Column:
    """The homozygous genotype of a locus as a whole, null if it isn't: of the first of the most frequent bases."""
    cov, most = F.col("coverage").cast("double"), F.greatest(*COUNTS)
    limit = F.round(cov * theta + F.sqrt(cov * theta * (1 - theta)))
    base = F.coalesce(*(F.when(F.col(c) == most, i) for i, c in enumerate(COUNTS)))
    return F.when((cov >= 9) & (cov - most <= limit), genotype(base, base))


def likely_genotype(theta: float, prior: float, pooled: Column) -> Column:
    """The genotype of a cluster's counts c1 to c4; null for none. pooled: whether the locus as a whole has a call."""
    c1, c2, c3, c4 = (F.col(f"c{k}").cast("double") for k in range(1, 5))
    cov = F.col("coverage").cast("double")
    top, second = F.col("g4"), F.col("g3")
    homo = c4 * math.log(1 - theta) + (cov - c4) * math.log(theta / 3)
    hetero = (c3 + c4) * math.log(0.5 - theta / 3) + (c1 + c2) * math.log(theta / 3) + math.log(prior)
    mean, sd = F.floor((c3 + c4) / 2), F.sqrt(0.25 * (c3 + c4))
    balanced = (cov > 15) & (F.abs(c4 - mean) <= sd) & (F.abs(c3 - mean) < sd)
    few = F.when((cov > 0) & (c4 >= cov - 1) & pooled, genotype(top, top))
    many = F.when(homo > hetero, F.when(c3 != c4, genotype(top, top))).when((hetero > homo) & (c2 != c3) & balanced, genotype(F.least(top, second), F.greatest(top, second)))
    return F.when(cov < 9, few).otherwise(many)


def genotypes(obs: DataFrame, labels: DataFrame, theta: float = 0.01, prior: float = 1e-3) -> DataFrame:
    """A row for each locus and cluster with coverage: counts, pooled counts (all_...), pooled call, the cluster's call.

    Clusters are counted, then gathered by locus, where their sums are the pooled counts: what comes after needs no shuffle.
    """
    own = base_counts(tagged(obs, labels), [*LOCUS, "cluster_id"])
    names = [*COUNTS, "coverage"]
    loci = own.groupBy(*LOCUS).agg(F.collect_list(F.struct("cluster_id", *names)).alias("_rows"), *(F.sum(c).alias(c) for c in names))
    loci = loci.withColumn("pooled", pooled_call(theta)).withColumnsRenamed({c: f"all_{c}" for c in names})
    rows = loci.withColumn("_r", F.explode("_rows")).select(*LOCUS, "pooled", *(f"all_{c}" for c in names), "_r.*")
    return ranked(rows).withColumn("genotype", likely_genotype(theta, prior, F.col("pooled").isNotNull()))


def with_agreement(calls: DataFrame) -> DataFrame:
    """agree: whether no cluster with coverage calls otherwise than the first called one, from that one on.

    The first call is that of the called cluster with the least id of 1 or more; the fold goes through clusters by id.
    """
    locus = Window.partitionBy(*LOCUS)  # the few clusters of a locus, which lie together already
    seq = F.array_sort(F.collect_list(F.struct("cluster_id", "genotype", "coverage")).over(locus))
    start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(True).alias("agree"))

    def step(acc, x):
        first = F.when(acc["first"].isNull() & (x["cluster_id"] >= 1), x["genotype"].cast("int")).otherwise(acc["first"])
        differs = first.isNotNull() & (x["coverage"] > 0) & ~same_genotype(x["genotype"], first)
        return F.struct(first.alias("first"), (acc["agree"] & ~differs).alias("agree"))

    return calls.withColumn("_seq", seq).withColumn("agree", F.aggregate("_seq", start, step)["agree"]).drop("_seq")


def differing_alleles(reference: Column, call: Column) -> Column:
    """array<struct<ref, alt>> of the alleles by which a call differs from a heterozygous reference."""
    r1, r2, a1, a2 = first_allele(reference), second_allele(reference), first_allele(call), second_allele(call)
    pair = lambda r, a: F.struct(decode_base(r).alias("ref"), decode_base(a).alias("alt"))
    one = lambda r, a: F.array(pair(r, a))
    return (
        F.when(a1 == r1, F.when(a2 == r2, F.slice(one(r2, a2), 1, 0)).otherwise(one(r2, a2)))
        .when(a1 == r2, F.when(a2 == r1, F.slice(one(r1, a2), 1, 0)).otherwise(one(r1, a2)))
        .when(a2 == r1, one(r2, a1))
        .when(a2 == r2, one(r1, a1))
        .otherwise(F.array(pair(r1, a1), pair(r2, a2)))
    )


def lines(df: DataFrame, call: str, counts: list[str] = COUNTS) -> DataFrame:
    """Explode calls that differ from `reference` into rows ref, alt, gt."""
    r, g = F.col("reference"), F.col(call)
    flat = F.struct(decode_base(second_allele(r)).alias("ref"), F.concat(decode_base(second_allele(g)), F.when(is_homozygous(g), "").otherwise(decode_base(first_allele(g)))).alias("alt"), F.when(is_homozygous(g), "1/1").otherwise("0/1").alias("gt"))
    het = F.transform(differing_alleles(r, g), lambda p: F.struct(p["ref"].alias("ref"), p["alt"].alias("alt"), F.lit("1/1").alias("gt")))
    rows = df.where(g.isNotNull() & ~same_genotype(g, r))
    return rows.withColumn("_line", F.explode(F.when(is_homozygous(r), F.array(flat)).otherwise(het))).select("*", "_line.ref", "_line.alt", "_line.gt").drop("_line")


def judged_calls(obs: DataFrame, labels: DataFrame, reference: DataFrame, theta: float = 0.01, prior: float = 1e-3) -> DataFrame:
    """genotypes() with agreement, at loci of the reference (their genotypes)."""
    return with_agreement(genotypes(obs, labels, theta, prior)).join(reference, LOCUS)


def cluster_lines(calls: DataFrame) -> DataFrame:
    """Lines of the clusters, at loci where they don't agree and other than the pooled call."""
    own = calls.where(~F.col("agree") & F.col("genotype").isNotNull() & ~same_genotype(F.col("genotype"), F.col("pooled")))
    return lines(own, "genotype").select(*LOCUS, "cluster_id", "ref", "alt", "gt", *COUNTS)


def common_lines(calls: DataFrame) -> DataFrame:
    """Lines of the loci as a whole, and of cells without cluster where the clusters agree."""
    pool = calls.select(*LOCUS, "reference", "pooled", *(F.col(f"all_{c}").alias(c) for c in COUNTS)).dropDuplicates(LOCUS).where("pooled is not null AND pooled <> reference")
    zero = calls.where("agree AND cluster_id = 0")
    return lines(pool, "pooled").select(*LOCUS, "ref", "alt", "gt", *COUNTS).unionAll(lines(zero, "genotype").select(*LOCUS, "ref", "alt", "gt", *COUNTS))


def variant_table(obs: DataFrame, labels: DataFrame, reference: DataFrame, theta: float = 0.01, prior: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines of the clusters, common lines, calls with agreement) of calls that are checkpointed, as all three are made of them."""
    with_checkpoints(obs.sparkSession)
    calls = judged_calls(obs, labels, reference, theta, prior).checkpoint()
    return cluster_lines(calls), common_lines(calls), calls


def cell_scores(obs: DataFrame, labels: DataFrame, calls: DataFrame) -> DataFrame:
    """The share of a cell's observations that, at loci where clusters disagree, are in no allele of its cluster."""
    known = calls.where("NOT agree AND genotype IS NOT NULL AND coverage > 9").select(*LOCUS, "cluster_id", "genotype")
    joined = tagged(obs, labels).join(known, [*LOCUS, "cluster_id"], "left")
    off = F.col("genotype").isNotNull() & (F.col("base") != first_allele(F.col("genotype"))) & (F.col("base") != second_allele(F.col("genotype")))
    return joined.groupBy("cell_id").agg((F.count_if(off) / F.count(F.lit(1))).alias("score"))
