"""Registered queries over the derived workload, and the same in DuckDB's SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import divide, em, evaluation, significance, similarity, spectral, variants
from ..operators.significance import COUNTS, LOCUS
from ..session import with_checkpoints
from . import workload

THETA, MUTATION, HOMOZYGOUS, PRIOR = 0.01, 0.01, 0.5, 1e-3
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, deep: bool = False):
    """Register a function of the observations under its name."""

    def add(f):
        _queries[f.__name__] = lambda spark, sf_dir: f(workload.observations(spark, sf_dir, deep))
        if sql is not None:
            _sql[f.__name__] = f"WITH {'RECURSIVE ' if 'power AS (' in sql else ''}{workload.sql(deep)} {sql}"
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Float sums depend on their order: both engines round them."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def positions(obs: DataFrame) -> DataFrame:
    return obs.where("position % 5 = 0 AND chromosome_id < 20").select(*LOCUS).distinct()


# ---- SQL parts ----
COUNT_SQL = "count(*) FILTER (base = 0) AS n_a, count(*) FILTER (base = 1) AS n_c, count(*) FILTER (base = 2) AS n_g, count(*) FILTER (base = 3) AS n_t, count(*) AS coverage"
_b = "b[1] AS b1, b[2] AS b2, b[3] AS b3, b[4] AS b4"
_T = THETA
_homo = 1 - significance.HETEROZYGOUS - significance.MUTATED
_het, _mut = significance.HETEROZYGOUS, significance.MUTATED
_ratio = f"""(b4 * ln({1 - _T}::DOUBLE) + (coverage - b4) * ln({_T / 3}::DOUBLE) + ({math.log(0.25) + math.log(_het)}::DOUBLE)
  - ln({_homo}::DOUBLE * pow({1 - _T}::DOUBLE, b4) * pow({_T / 3}::DOUBLE, coverage - b4)
     + {_het}::DOUBLE * pow({0.5 - _T / 3}::DOUBLE, b3 + b4) * pow({_T / 3}::DOUBLE, b1 + b2)
     + {_homo * _mut}::DOUBLE * pow({0.75 - 2 * _T / 3}::DOUBLE, b4) * pow(0.25::DOUBLE, b3) * pow({_T / 3}::DOUBLE, b1 + b2)
     + {_het * _mut}::DOUBLE * pow({0.5 - _T}::DOUBLE, b4) * pow(0.25::DOUBLE, b2 + b3) * pow({_T / 3}::DOUBLE, b1)
     + {_het * _mut * _mut}::DOUBLE * pow({1 - _T}::DOUBLE, coverage)))"""
_bucket = "greatest(0, least(19, round_even(coverage / 10.0, 0)::INTEGER - 1))"
_limits = "[" + ", ".join(f"{x}::DOUBLE" for x in significance.THRESHOLDS[4]) + "]"
LOCI_SQL = f""", counts AS (SELECT chromosome_id, position, {COUNT_SQL} FROM obs GROUP BY ALL),
  sorted AS (SELECT *, list_sort([n_a, n_c, n_g, n_t]) AS b FROM counts),
  ranked AS (SELECT * EXCLUDE (b), {_b} FROM sorted),
  checked AS (SELECT * FROM ranked WHERE coverage >= 2 AND b3 > 0 AND b1 + b2 + b3 >= 5 AND b4 >= 1.5 * b3),
  loci AS (SELECT * FROM checked WHERE {_ratio} < {_limits}[{_bucket} + 1])"""
KEPT_SQL = LOCI_SQL + ", kept AS (SELECT obs.* FROM obs SEMI JOIN loci USING (chromosome_id, position))"
MATES_SQL = KEPT_SQL + ", mates AS (SELECT chromosome_id, position, read_id, cell_id, min(base) AS base FROM kept GROUP BY ALL HAVING min(base) = max(base))"
PAIRS_SQL = MATES_SQL + """, pairs AS (SELECT a.chromosome_id, a.read_id AS read_a, b.read_id AS read_b, a.cell_id AS cell_a, b.cell_id AS cell_b,
    count(*) FILTER (a.base = b.base) AS x_s, count(*) FILTER (a.base <> b.base) AS x_d
  FROM mates a JOIN mates b ON a.chromosome_id = b.chromosome_id AND a.position = b.position AND a.read_id < b.read_id AND a.cell_id <> b.cell_id GROUP BY ALL)"""
_psd, _pds = similarity.probabilities(THETA)
_pss, _pdd = 1 - _psd, 1 - _pds
_A, _B, _a = 1 - HOMOZYGOUS - MUTATION / 2, HOMOZYGOUS + MUTATION / 2, 1 - MUTATION - HOMOZYGOUS
_w, _v = MUTATION / 2 * (_pss + _pds) + HOMOZYGOUS * _pss, MUTATION / 2 * (_psd + _pdd) + HOMOZYGOUS * _psd
_p = lambda x, n: f"pow({x!r}::DOUBLE, {n})"
_same = f"({_p(_pss, 'x_s')} * {_p(_psd, 'x_d')} + {_p(_A * _pds + _B * _pss, 'x_s')} * {_p(_A * _pdd + _B * _psd, 'x_d')})"
_diff = f"({_p(_a * _pss + _w, 'x_s')} * {_p(_a * _psd + _v, 'x_d')} + {_p(_a * _pds + _w, 'x_s')} * {_p(_a * _pdd + _v, 'x_d')})"
SCORES_SQL = PAIRS_SQL + f", scores AS (SELECT least(cell_a, cell_b) AS cell_i, greatest(cell_a, cell_b) AS cell_j, sum(ln({_diff}) - ln({_same})) AS m FROM pairs GROUP BY ALL)"
MATRIX_SQL = SCORES_SQL + """, cells AS (SELECT DISTINCT cell_id FROM obs), matrix AS (SELECT a.cell_id AS i, b.cell_id AS j, coalesce(m, 0) AS m
  FROM cells a CROSS JOIN cells b LEFT JOIN scores ON cell_i = least(a.cell_id, b.cell_id) AND cell_j = greatest(a.cell_id, b.cell_id))"""
NORMAL_SQL = MATRIX_SQL + ", normal AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE abs((SELECT max(m) FROM matrix)) - m END AS value FROM matrix)"
REFERENCE_SQL = "(SELECT DISTINCT chromosome_id, position, ((g << 3) | (CASE WHEN two THEN (position + 1) % 4 ELSE g END))::INTEGER AS reference FROM (SELECT *, (position // 4) % 5 = 0 AS two, (position % 4 + CASE WHEN (position // 4) % 5 <> 0 AND position % 7 = 0 THEN 2 ELSE 0 END) % 4 AS g FROM obs))"
CLUSTER_SQL = f""", tagged AS (SELECT *, CASE WHEN cell_id % 10 < 3 THEN 2 ELSE 1 END AS cluster_id FROM obs),
  by_cluster AS (SELECT chromosome_id, position, cluster_id, {COUNT_SQL} FROM tagged GROUP BY GROUPING SETS ((chromosome_id, position, cluster_id), (chromosome_id, position))),
  pools AS (SELECT chromosome_id, position, coverage AS all_coverage, n_a AS all_a, n_c AS all_c, n_g AS all_g, n_t AS all_t, CASE WHEN coverage >= 9 AND coverage - greatest(n_a, n_c, n_g, n_t) <= round(coverage * {_T}::DOUBLE + sqrt(coverage * {_T}::DOUBLE * {1 - _T}::DOUBLE))
    THEN (list_position([n_a, n_c, n_g, n_t], greatest(n_a, n_c, n_g, n_t)) - 1) * 9 END AS pooled FROM by_cluster WHERE cluster_id IS NULL),
  orders AS (SELECT *, list_sort([{{'n': n_a, 'g': 0}}, {{'n': n_c, 'g': 1}}, {{'n': n_g, 'g': 2}}, {{'n': n_t, 'g': 3}}]) AS o FROM by_cluster WHERE cluster_id IS NOT NULL),
  likely AS (SELECT *, o[1].n AS c1, o[2].n AS c2, o[3].n AS c3, o[4].n AS c4, o[4].g AS g4, o[3].g AS g3,
    o[4].n * ln({1 - _T}::DOUBLE) + (coverage - o[4].n) * ln({_T / 3}::DOUBLE) AS homo,
    (o[3].n + o[4].n) * ln({0.5 - _T / 3}::DOUBLE) + (o[1].n + o[2].n) * ln({_T / 3}::DOUBLE) + ({math.log(PRIOR)}::DOUBLE) AS het FROM orders),
  calls AS (SELECT l.chromosome_id, l.position, cluster_id, n_a, n_c, n_g, n_t, coverage, pooled, all_a, all_c, all_g, all_t, (CASE
      WHEN coverage < 9 THEN CASE WHEN coverage > 0 AND c4 >= coverage - 1 AND pooled IS NOT NULL THEN g4 * 9 END
      WHEN homo > het THEN CASE WHEN c3 <> c4 THEN g4 * 9 END
      WHEN het > homo AND c2 <> c3 AND coverage > 15 AND abs(c4 - (c3 + c4) // 2) <= sqrt(0.25 * (c3 + c4)) AND abs(c3 - (c3 + c4) // 2) < sqrt(0.25 * (c3 + c4))
        THEN (least(g3, g4) << 3) | greatest(g3, g4) END)::INTEGER AS genotype
    FROM likely l JOIN pools USING (chromosome_id, position)),
  firsts AS (SELECT chromosome_id, position, min(cluster_id) FILTER (genotype IS NOT NULL) AS f FROM calls GROUP BY ALL),
  agreed AS (SELECT c.chromosome_id, c.position, coalesce(bool_and(d.genotype IS NOT DISTINCT FROM c.genotype) FILTER (d.cluster_id >= c.cluster_id AND d.coverage > 0), true) AS agree
    FROM firsts JOIN calls c ON c.chromosome_id = firsts.chromosome_id AND c.position = firsts.position AND c.cluster_id = f JOIN calls d ON d.chromosome_id = c.chromosome_id AND d.position = c.position GROUP BY ALL),
  judged AS (SELECT calls.*, coalesce(agree, true) AS agree, reference FROM calls LEFT JOIN agreed USING (chromosome_id, position) JOIN {REFERENCE_SQL} USING (chromosome_id, position))"""


def _lines_sql(source: str, call: str, extra: str, where: str, counts: str = "n_a, n_c, n_g, n_t") -> str:
    name = lambda x: f"substr('ACGT', {x} + 1, 1)"
    r1, r2, a1, a2 = "(reference >> 3)", "(reference & 7)", f"({call} >> 3)", f"({call} & 7)"
    pair = lambda r, a: f"{{'r': {name(r)}, 'a': {name(a)}, 'g': '1/1'}}"
    return f"""SELECT chromosome_id, position, {extra} x.r AS ref, x.a AS alt, x.g AS gt, {counts} FROM (SELECT *, unnest(CASE
        WHEN {r1} = {r2} THEN [{{'r': {name(r2)}, 'a': {name(a2)} || CASE WHEN {a1} = {a2} THEN '' ELSE {name(a1)} END, 'g': CASE WHEN {a1} = {a2} THEN '1/1' ELSE '0/1' END}}]
        WHEN {a1} = {r1} THEN [{pair(r2, a2)}] WHEN {a1} = {r2} THEN [{pair(r1, a2)}] WHEN {a2} = {r1} THEN [{pair(r2, a1)}] WHEN {a2} = {r2} THEN [{pair(r1, a1)}]
        ELSE [{pair(r1, a1)}, {pair(r2, a2)}] END) AS x
      FROM {source} WHERE {where} AND {call} IS NOT NULL AND NOT (least({a1}, {a2}) = least({r1}, {r2}) AND greatest({a1}, {a2}) = greatest({r1}, {r2})))"""


_own_sql = _lines_sql("judged", "genotype", "cluster_id,", "NOT agree AND genotype IS DISTINCT FROM pooled")
_common_sql = _lines_sql("(SELECT DISTINCT chromosome_id, position, reference, pooled, all_a AS n_a, all_c AS n_c, all_g AS n_g, all_t AS n_t FROM judged)", "pooled", "", "pooled <> reference")


# ---- counts and filters ----
@query(f"SELECT chromosome_id, position, {COUNT_SQL} FROM obs GROUP BY ALL")
def base_counts_per_locus(obs):
    return significance.base_counts(obs)


@query(f"SELECT chromosome_id, position, {COUNT_SQL} FROM obs GROUP BY ALL HAVING coverage >= 2 AND coverage < 100 AND coverage - greatest(n_a, n_c, n_g, n_t) >= 3")
def locus_coverage_filter(obs):
    return significance.pileup_loci(obs)


@query("SELECT obs.* FROM obs SEMI JOIN (SELECT chromosome_id, position FROM obs GROUP BY ALL HAVING count(*) <= 30) USING (chromosome_id, position)")
def coverage_cap_read_filter(obs):
    return significance.cap_coverage(obs, 30)


@query("SELECT * FROM obs WHERE position % 5 = 0 OR chromosome_id >= 20")
def position_semi_join(obs):
    return significance.keep_positions(obs, positions(obs))


@query("SELECT * FROM obs WHERE cell_id % 10 < 3")
def cell_membership_semi_join(obs):
    return obs.join(workload.clones(obs).where("cluster_id = 2"), "cell_id", "left_semi").select(*obs.columns)


@query("SELECT DISTINCT chromosome_id, position FROM obs WHERE base = (position % 4 + 2) % 4 EXCEPT SELECT chromosome_id, position FROM obs WHERE base = (position % 4 + 2) % 4 AND cell_id % 10 >= 3")
def healthy_anti_join(obs):
    odd = obs.where("base = (position % 4 + 2) % 4")
    return odd.select(*LOCUS).distinct().join(odd.where("cell_id % 10 >= 3").select(*LOCUS), LOCUS, "left_anti")


@query("SELECT chromosome_id, position, read_id, cell_id // 4 AS group_id, base FROM obs")
def cell_grouping_remap(obs):
    groups = obs.sparkSession.range(40).selectExpr("cast(id AS int) AS cell_id", "cast(id div 4 AS int) AS group_id")
    return obs.join(groups, "cell_id").select("chromosome_id", "position", "read_id", "group_id", "base")


@query("SELECT DISTINCT cell_id, cell_id // 4 AS group_id, CASE WHEN (cell_id // 4) % 3 = 0 THEN 2 ELSE 1 END AS cluster_id FROM obs")
def group_label_fanout(obs):
    cells = workload.cells(obs).selectExpr("cell_id", "cast(cell_id div 4 AS int) AS group_id")
    labels = cells.select("group_id").distinct().selectExpr("group_id", "CASE WHEN group_id % 3 = 0 THEN 2 ELSE 1 END AS cluster_id")
    return cells.join(labels, "group_id").select("cell_id", "group_id", "cluster_id")


@query("SELECT position, read_id, (cell_id << 2) | base AS packed, cell_id, base FROM obs")
def pack_unpack(obs):
    packed = obs.select("position", "read_id", codecs.pack(F.col("cell_id"), F.col("base")).alias("packed"))
    return packed.select("*", codecs.unpack_cell(F.col("packed")).alias("cell_id"), codecs.unpack_base(F.col("packed")).alias("base"))


@query("SELECT position, read_id, base, substr('ACGT', base + 1, 1) AS name, base AS code FROM obs")
def base_codec(obs):
    named = obs.select("position", "read_id", "base", codecs.decode_base(F.col("base")).alias("name"))
    return named.withColumn("code", codecs.encode_base(F.lower("name")))


@query("SELECT DISTINCT chromosome_id, CASE chromosome_id WHEN 22 THEN 'X' WHEN 23 THEN 'Y' ELSE (chromosome_id + 1)::VARCHAR END AS name, chromosome_id AS id FROM obs")
def chromosome_codec(obs):
    named = obs.select("chromosome_id").distinct().withColumn("name", codecs.chromosome_name(F.col("chromosome_id")))
    return named.withColumn("id", codecs.chromosome_id(F.col("name")))


@query("SELECT chromosome_id, read_id, max(position) - min(position) AS length FROM obs GROUP BY ALL")
def fragment_lengths(obs):
    return obs.groupBy("chromosome_id", "read_id").agg((F.max("position") - F.min("position")).alias("length"))


@query("SELECT chromosome_id, max(length) AS max_length FROM (SELECT chromosome_id, read_id, max(position) - min(position) AS length FROM obs GROUP BY ALL) GROUP BY ALL")
def max_fragment_per_chromosome(obs):
    return fragment_lengths(obs).groupBy("chromosome_id").agg(F.max("length").alias("max_length"))


@query("SELECT count(DISTINCT cell_id) AS n_cells, max(cell_id) AS max_cell, count(DISTINCT (chromosome_id, read_id)) AS n_reads FROM obs")
def distinct_cells_reads(obs):
    return obs.agg(F.count_distinct("cell_id").alias("n_cells"), F.max("cell_id").alias("max_cell"), F.count_distinct("chromosome_id", "read_id").alias("n_reads"))


@query("""SELECT chromosome_id, position, count(*) AS coverage, string_agg(substr('ACGT', base + 1, 1), '' ORDER BY cell_id, read_id, base) AS bases,
  string_agg(cell_id::VARCHAR, ',' ORDER BY cell_id, read_id, base) AS cell_ids, string_agg(read_id::VARCHAR, ',' ORDER BY cell_id, read_id, base) AS read_ids FROM obs GROUP BY ALL""")
def pileup_text_rows(obs):
    from ..sources.pileup import text_rows

    return text_rows(obs)


@query("SELECT 'r' || read_id AS name, dense_rank() OVER (ORDER BY read_id) - 1 AS read_id FROM (SELECT DISTINCT read_id FROM obs)")
def read_dictionary(obs):
    from ..sources.pileup import read_names

    return read_names(obs.select(F.concat(F.lit("r"), "read_id").alias("name"), "read_id"), "name", "read_id")


@query(f"SELECT chromosome_id, position, coverage, {_bucket} AS bucket, {_limits}[{_bucket} + 1] AS threshold FROM (SELECT chromosome_id, position, count(*) AS coverage FROM obs GROUP BY ALL)")
def threshold_bucket(obs):
    loci = obs.groupBy(*LOCUS).agg(F.count(F.lit(1)).alias("coverage"))
    return loci.select("*", significance.coverage_bucket(F.col("coverage")).alias("bucket"), significance.threshold(F.col("coverage")).alias("threshold"))


@query(workload.SEGMENTS_SQL + """ SELECT p.contig, p.place AS position, host + place - b AS host_position FROM (SELECT DISTINCT chromosome_id::VARCHAR AS contig, position AS place FROM obs) p
  LEFT JOIN segments g ON p.contig = g.contig AND place >= b AND place < e""")
def genome_host_places(obs):
    from ..sources import genome

    contigs, events = workload.indels(obs)
    loci = obs.select(F.col("chromosome_id").cast("string").alias("contig"), F.col("position").alias("_at")).distinct()
    places = genome.host_places(loci, genome.segments(contigs, events), 100)
    return places.select("contig", F.col("_at").alias("position"), F.col("_host").alias("host_position"))


@query(workload.SEGMENTS_SQL + " SELECT contig, b AS first_place, e AS end_place, host AS host_place FROM segments WHERE e > b")
def genome_segments(obs):
    from ..sources import genome

    return genome.segments(*workload.indels(obs)).toDF("contig", "first_place", "end_place", "host_place")


def reference_bases(spark, sf_dir):
    """The genome is written in FASTA and read back; its letters at the loci of the observations."""
    from ..session import scratch
    from ..sources import genome

    path = scratch(spark, "genome")
    workload.genome_files(spark, sf_dir, path)
    return genome.reference_genotypes(spark, path, workload.observations(spark, sf_dir))


_queries["reference_bases"], _sql["reference_bases"] = reference_bases, f"WITH {workload.sql(False)} {workload.GENOME_SQL}"


def cigar_observations(spark, sf_dir):
    from ..sources import alignments

    return alignments.observations(workload.reads(spark, sf_dir)).drop("read_id")


_queries["cigar_observations"], _sql["cigar_observations"] = cigar_observations, workload.READS_SQL


# ---- significance ----
@query(LOCI_SQL + f" SELECT chromosome_id, position, round({_ratio}, 6) AS log_ratio FROM checked")
def locus_log_ratio(obs):
    loci = significance.with_sorted(significance.base_counts(obs)).where(significance.pre_checks())
    return loci.select(*LOCUS, F.round(significance.log_ratio(THETA), 6).alias("log_ratio"))


@query(LOCI_SQL + " SELECT chromosome_id, position, n_a, n_c, n_g, n_t, coverage FROM loci")
def significant_loci(obs):
    return significance.significant_loci(obs, THETA)


@query(LOCI_SQL + " SELECT chromosome_id, position, n_a, n_c, n_g, n_t, coverage FROM loci", deep=True)
def significant_loci_deep(obs):
    return significance.significant_loci(obs, THETA)


@query(LOCI_SQL + " SELECT round(coalesce(avg(coverage), 0), 6) AS avg_coverage FROM loci")
def avg_coverage(obs):
    return rounded(significance.average_coverage(significance.significant_loci(obs, THETA)), "avg_coverage")


def kept(obs: DataFrame) -> DataFrame:
    return significance.keep_loci(obs, significance.significant_loci(obs, THETA))


# ---- similarity ----
@query(MATES_SQL + " SELECT chromosome_id, position, read_id, cell_id, base FROM mates")
def mate_dedup(obs):
    return similarity.drop_mate_conflicts(kept(obs))


def pairs(obs: DataFrame) -> DataFrame:
    return similarity.cell_pairs(kept(obs))


@query(PAIRS_SQL + " SELECT * FROM pairs")
def read_pair_overlap(obs):
    return similarity.read_pairs(kept(obs))


@query(PAIRS_SQL + " SELECT x_s, x_d, count(*) AS n_pairs FROM pairs GROUP BY ALL")
def match_histogram(obs):
    return similarity.match_histogram(pairs(obs))


@query(SCORES_SQL + " SELECT cell_i, cell_j, round(m, 6) + 0.0 AS m FROM scores")
def pair_log_ratio_sum(obs):
    return rounded(scores(obs), "m")


def scores(obs: DataFrame) -> DataFrame:
    return similarity.pair_scores(pairs(obs), MUTATION, HOMOZYGOUS, THETA)


def matrix(obs: DataFrame) -> DataFrame:
    return similarity.dense(scores(obs), workload.cells(obs))


@query(NORMAL_SQL + " SELECT i, j, round(value, 6) + 0.0 AS value FROM normal")
def similarity_add_min(obs):
    return rounded(similarity.normalize(matrix(obs), "ADD_MIN"), "value")


@query(MATRIX_SQL + " SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE 1 / (1 + exp(m)) END, 6) + 0.0 AS value FROM matrix")
def similarity_exponentiate(obs):
    return rounded(similarity.normalize(matrix(obs), "EXPONENTIATE"), "value")


@query(MATRIX_SQL + " SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE m / (SELECT max(m) FROM matrix) END, 6) + 0.0 AS value FROM matrix")
def similarity_scale_max(obs):
    return rounded(similarity.normalize(matrix(obs), "SCALE_MAX_1"), "value")


@query(NORMAL_SQL + " SELECT i, round(sum(value), 4) + 0.0 AS degree FROM normal GROUP BY ALL")
def degrees(obs):
    return rounded(similarity.affinity(scores(obs), workload.cells(obs)).degrees, "degree", digits=4)


@query(NORMAL_SQL + """, d AS (SELECT i, CASE WHEN sum(value) > 0 THEN 1 / sqrt(sum(value)) ELSE 0 END AS s FROM normal GROUP BY ALL)
  SELECT n.i, n.j, round(CASE WHEN n.i = n.j THEN 1 ELSE 0 END - a.s * value * b.s, 6) + 0.0 AS value FROM normal n JOIN d a ON n.i = a.i JOIN d b ON n.j = b.i""")
def laplacian(obs):
    return rounded(similarity.full_laplacian(scores(obs), workload.cells(obs)), "value")


@query(MATRIX_SQL + """, s AS (SELECT avg(m) AS a, stddev_pop(m) AS d FROM matrix WHERE i <> j) SELECT i, j, round(exp((m - a) / d), 6) + 0.0 AS value FROM matrix, s WHERE i <> j""")
def zscore_preproc(obs):
    return rounded(evaluation.zscore_exponential(matrix(obs)), "value")


# ---- variants ----
@query(CLUSTER_SQL + " SELECT chromosome_id, position, cluster_id, n_a, n_c, n_g, n_t, coverage FROM by_cluster")
def cluster_base_counts(obs):
    return variants.cluster_counts(obs, workload.clones(obs))


@query(CLUSTER_SQL + " SELECT chromosome_id, position, pooled FROM pools")
def pooled_homozygous(obs):
    pooled = variants.cluster_counts(obs, workload.clones(obs)).where("cluster_id is null")
    return pooled.select(*LOCUS, variants.pooled_call(THETA).alias("pooled"))


@query(CLUSTER_SQL + " SELECT chromosome_id, position, cluster_id, genotype FROM calls")
def cluster_genotypes(obs):
    return variants.genotypes(obs, workload.clones(obs), THETA, PRIOR).select(*LOCUS, "cluster_id", "genotype")


def calls(obs: DataFrame) -> DataFrame:
    return variants.judged_calls(obs, workload.clones(obs), workload.reference(obs), THETA, PRIOR)


@query(CLUSTER_SQL + " " + _own_sql)
def variant_lines(obs):
    return variants.cluster_lines(calls(obs))


@query(CLUSTER_SQL + " " + _common_sql)
def common_variants(obs):
    return variants.common_lines(calls(obs))


@query(CLUSTER_SQL + """ SELECT cell_id, round(count(*) FILTER (genotype IS NOT NULL AND base <> (genotype >> 3) AND base <> (genotype & 7)) / count(*), 6) + 0.0 AS score
  FROM tagged LEFT JOIN (SELECT chromosome_id, position, cluster_id, genotype FROM judged WHERE NOT agree AND genotype IS NOT NULL AND coverage > 9) USING (chromosome_id, position, cluster_id) GROUP BY ALL""")
def cell_scores(obs):
    clones = workload.clones(obs)
    return rounded(variants.cell_scores(obs, clones, calls(obs)), "score")


@query(CLUSTER_SQL + f""" SELECT chromosome_id, position, ref, alt, row_number() OVER (ORDER BY chromosome_id, position, ref, alt, cluster_id) AS line FROM ({_own_sql})""")
def vcf_order(obs):
    from ..sources.vcf import ordered

    own = variants.cluster_lines(calls(obs)).select(*LOCUS, "ref", "alt", "cluster_id")
    return ordered(own, ["ref", "alt", "cluster_id"]).select(*LOCUS, "ref", "alt", "line")


@query(CLUSTER_SQL + f""" SELECT chromosome_id, position, ref, alt, ((row_number() OVER (PARTITION BY chromosome_id ORDER BY position, ref, alt, cluster_id) - 1) % 7)::INTEGER AS part FROM ({_own_sql})""")
def round_robin_split(obs):
    own = variants.cluster_lines(calls(obs))
    return evaluation.round_robin(own, 7, ["chromosome_id"], ["position", "ref", "alt", "cluster_id"]).select(*LOCUS, "ref", "alt", "part")


# ---- expectation maximization and clustering ----
_EM_SQL = KEPT_SQL + """, p AS (SELECT DISTINCT cell_id, CASE WHEN cell_id % 10 < 3 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS p FROM obs),
  w AS (SELECT chromosome_id, position, b AS base, sum(CASE WHEN base = b THEN 1 - p ELSE 0 END) AS wa, sum(CASE WHEN base = b THEN p ELSE 0 END) AS wb FROM kept JOIN p USING (cell_id), range(0, 4) r(b) GROUP BY ALL),
  s AS (SELECT *, greatest(wa / sum(wa) OVER l, 0.001) AS sa, greatest(wb / sum(wb) OVER l, 0.001) AS sb FROM w WINDOW l AS (PARTITION BY chromosome_id, position)),
  c AS (SELECT *, ln(sa / sum(sa) OVER l) AS la, ln(sb / sum(sb) OVER l) AS lb FROM s WINDOW l AS (PARTITION BY chromosome_id, position)),
  ll AS (SELECT cell_id, sum(la) AS ll_a, sum(lb) AS ll_b FROM kept JOIN c USING (chromosome_id, position, base) GROUP BY ALL), prior AS (SELECT avg(p) AS m FROM p)
  SELECT cell_id, round(1 - 1 / (1 + exp(greatest(-100, least(100, ll_b - ll_a))) * m / (1 - m)), 6) + 0.0 AS p, round(ll_a, 4) AS ll_a, round(ll_b, 4) AS ll_b FROM p JOIN ll USING (cell_id), prior"""


@query(_EM_SQL)
def em_one_step(obs):
    p = workload.cells(obs).selectExpr("cell_id", "CASE WHEN cell_id % 10 < 3 THEN 0.8D ELSE 0.3D END AS p")
    out = em.step(kept(obs), p).drop("before")
    return rounded(rounded(out, "p"), "ll_a", "ll_b", digits=4)


def _nodes(obs: DataFrame) -> tuple[DataFrame, dict[int, list[int]]]:
    """Scores and cells of all observations as a single node to divide."""
    own = scores(obs).select(F.lit(0).alias("node"), "cell_i", "cell_j", "m")
    return with_checkpoints(obs.sparkSession) and own.checkpoint(), {0: sorted(r[0] for r in workload.cells(obs).collect())}


# The second vector of the Laplacian in SQL: power iteration of I + D^-1/2 A D^-1/2 without its first vector, root degrees.
_FIEDLER_SQL = NORMAL_SQL + """, d AS MATERIALIZED (SELECT i, sum(value) AS d FROM normal GROUP BY i), t AS MATERIALIZED (SELECT sum(d) AS t FROM d),
  m AS MATERIALIZED (SELECT n.i, list(value / sqrt(a.d * b.d) - sqrt(a.d * b.d) / (SELECT t FROM t) + CASE WHEN n.i = n.j THEN 1 ELSE 0 END ORDER BY n.j) AS r FROM normal n JOIN d a ON n.i = a.i JOIN d b ON n.j = b.i GROUP BY n.i),
  rows AS MATERIALIZED (SELECT list(r ORDER BY i) AS r, list(i ORDER BY i) AS cells FROM m),
  power AS (SELECT 0 AS n, list_transform(range(1, len(cells) + 1), lambda x: sin(x::DOUBLE * x::DOUBLE)) AS v FROM rows
    UNION ALL SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT n, list_transform(r, lambda q: list_inner_product(q, v)) AS w FROM power, rows WHERE n < 1500)),
  last AS (SELECT v, list_transform(r, lambda q: list_inner_product(q, v)) AS w, cells FROM power, rows WHERE n = 1500),
  fiedler AS (SELECT unnest(cells) AS cell_id, unnest(list_transform(v, lambda x: x * sign(v[1]))) AS component, 2 - list_inner_product(v, w) AS eigenvalue FROM last)"""


@query(_FIEDLER_SQL + " SELECT cell_id, round(component, 5) + 0.0 AS component, round(eigenvalue, 6) + 0.0 AS eigenvalue FROM fiedler")
def fiedler_vector(obs):
    """The second eigenpair of the Laplacian, the sign being that of the first cell."""
    matrices = spectral.Matrices(*_nodes(obs))
    values, vectors = spectral.smallest_eigenpairs(matrices)[0]
    rows = [(c, float(v), float(values[1])) for c, v in zip(matrices.members[0], vectors[:, 1])]
    return rounded(rounded(obs.sparkSession.createDataFrame(rows, "cell_id int, component double, eigenvalue double"), "eigenvalue"), "component", digits=5)


@query(_FIEDLER_SQL + " SELECT cell_id, CASE WHEN component < 0 THEN 1 ELSE 0 END AS label FROM fiedler")
def spectral_labels(obs):
    """Two clusters by the sign of the second vector; the first cell is in cluster 0."""
    own, members = _nodes(obs)
    labels, _, _ = spectral.cluster_nodes(own, members, kind="FIEDLER")[0]
    return obs.sparkSession.createDataFrame([(c, int(x)) for c, x in zip(members[0], labels)], "cell_id int, label int")


@query("SELECT DISTINCT cell_id, CASE WHEN cell_id % 10 < 3 THEN 1 ELSE 2 END AS cluster_id FROM obs")
def divide_labels(obs):
    """The clusters are the planted clones, numbered by their first cell."""
    return divide.divide(obs, divide.Settings(theta=THETA, mutation=MUTATION, homozygous=HOMOZYGOUS, min_cluster_size=20))


@query("SELECT DISTINCT cell_id, CASE WHEN cell_id % 10 < 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM obs")
def em_refined(obs):
    """From an unsure start expectation maximization comes to the planted clones."""
    p = workload.cells(obs).selectExpr("cell_id", "CASE WHEN cell_id % 10 < 3 THEN 0.6D ELSE 0.4D END AS p")
    return rounded(em.refine(kept(obs), p), "p", digits=4)


# Mixtures of one and two Gaussians over the second vector in SQL, from its least and its largest component, five rounds.
_list = lambda f: f"list_sum(list_transform(range(1, len(x) + 1), lambda i: {f}))"
_moments = ", ".join(f"{_list(f'{r} * x[i] ** {k}')} AS {name}{k}" for name, r in (("a", "r[i]"), ("b", "(1 - r[i])")) for k in range(3))
_models = "a0 / n AS w1, a1 / a0 AS m1, a2 / a0 - (a1 / a0) ** 2 + 1e-10 AS v1, b0 / n AS w2, b1 / b0 AS m2, b2 / b0 - (b1 / b0) ** 2 + 1e-10 AS v2"
_density = lambda k: f"w{k} * exp(-0.5 * (x[i] - m{k}) ** 2 / v{k}) / sqrt(2 * pi() * v{k})"
_MIXTURE_SQL = _FIEDLER_SQL + f""", pts AS (SELECT list(component ORDER BY cell_id) AS x, count(*)::DOUBLE AS n, min(component) AS lo, max(component) AS hi FROM fiedler),
  em AS (SELECT 0 AS t, x, n, list_transform(x, lambda v: CASE WHEN abs(v - lo) <= abs(v - hi) THEN 1::DOUBLE ELSE 0::DOUBLE END) AS r FROM pts
    UNION ALL SELECT t + 1, x, n, list_transform(range(1, len(x) + 1), lambda i: {_density(1)} / ({_density(1)} + {_density(2)})) FROM (SELECT t, x, n, {_models} FROM (SELECT t, x, n, {_moments} FROM em WHERE t < 5))),
  two AS (SELECT n, {_list(f"ln({_density(1)} + {_density(2)})")} AS ll FROM (SELECT x, n, {_models} FROM (SELECT x, n, {_moments} FROM em WHERE t = 5))),
  one AS (SELECT n, {_list("-0.5 * (ln(2 * pi() * v) + (x[i] - m) ** 2 / v)")} AS ll FROM (SELECT x, n, list_avg(x) AS m, list_var_pop(x) + 1e-10 AS v FROM pts))
  SELECT 1 AS k, round(ll, 3) + 0.0 AS log_likelihood, round(2 * ln(n) - 2 * ll, 3) + 0.0 AS bic FROM one UNION ALL SELECT 2, round(ll, 3) + 0.0, round(5 * ln(n) - 2 * ll, 3) + 0.0 FROM two"""


@query(_MIXTURE_SQL)
def gmm_second_vector(obs):
    """Likelihood and BIC of mixtures of one and of two Gaussians over the second vector, started at its extremes."""
    matrices = spectral.Matrices(*_nodes(obs))
    vectors = spectral.smallest_eigenpairs(matrices)[0][1]
    x = vectors[:, 1:2]
    own = spectral.Points.of(obs.sparkSession, {0: (matrices.members[0], x)})
    fits = spectral.lockstep({0: spectral.mixtures(lambda v: v, len(x), {1: x[:1], 2: np.array([x.min(0), x.max(0)])})}, own.answers)[0]
    rows = [(k, f, float(spectral.information(f, k, len(x), 1))) for k, f in fits.items()]
    out = obs.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double")
    return rounded(out, "log_likelihood", "bic", digits=3)


@query()
def gmm_bic(obs):
    own, members = _nodes(obs)
    _, _, info = spectral.cluster_nodes(own, members)[0]
    rows = [(k, None if f is None else float(f), None if s is None else float(s)) for k, (f, s) in enumerate(zip(info["log_likelihoods"], info["scores"]), 1)]
    return obs.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double")


@query(""", t AS (SELECT (cell_id % 10 < 3)::INTEGER AS a, (cell_id % 7 < 3)::INTEGER AS b, count(*) AS n FROM (SELECT DISTINCT cell_id FROM obs) GROUP BY ALL),
  x AS (SELECT sum(n * (n - 1) / 2.0) AS ab, sum(n) AS n FROM t), y AS (SELECT sum(m * (m - 1) / 2.0) AS a FROM (SELECT a, sum(n) AS m FROM t GROUP BY a)), z AS (SELECT sum(m * (m - 1) / 2.0) AS b FROM (SELECT b, sum(n) AS m FROM t GROUP BY b))
  SELECT round((ab - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2.0 - a * b / (n * (n - 1) / 2.0)), 6) + 0.0 AS ari FROM x, y, z""")
def adjusted_rand_index(obs):
    labels = workload.cells(obs).selectExpr("cast(cell_id % 10 < 3 AS int) AS a", "cast(cell_id % 7 < 3 AS int) AS b")
    return rounded(evaluation.adjusted_rand_index(labels), "ari")


@query(LOCI_SQL + f""", r AS (SELECT round({_ratio}, 3) AS t, (position // 4) % 5 IN (1, 2) AS truth FROM ranked WHERE coverage >= 2),
  cuts AS (SELECT t, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM r GROUP BY t),
  j AS (SELECT t, sum(p) OVER o / (SELECT sum(p) FROM cuts)::DOUBLE - sum(n) OVER o / (SELECT sum(n) FROM cuts)::DOUBLE AS j FROM cuts WINDOW o AS (ORDER BY t))
  SELECT t AS threshold, round(j, 6) AS j FROM j ORDER BY j.j DESC, t LIMIT 1""", deep=True)
def youden_threshold(obs):
    loci = significance.with_sorted(significance.base_counts(obs)).where("coverage >= 2")
    scored = loci.select(F.round(significance.log_ratio(THETA), 3).alias("score"), F.expr("(position div 4) % 5 IN (1, 2)").alias("truth"))
    return rounded(evaluation.best_threshold(scored), "j")


@query("SELECT cell_id, clone, ceil(row_number() OVER (PARTITION BY clone ORDER BY cell_id) / 5)::INTEGER AS block FROM (SELECT DISTINCT cell_id, (cell_id % 10 < 3)::INTEGER AS clone FROM obs)")
def clone_blocks(obs):
    cells = workload.cells(obs).selectExpr("cell_id", "cast(cell_id % 10 < 3 AS int) AS clone")
    return evaluation.blocks_of(cells, 5, ["clone"], ["cell_id"])


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
