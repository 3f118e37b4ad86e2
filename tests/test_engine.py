"""Counts, likelihoods, clusters, genotypes and files on small cases with known results."""

import gzip
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import codecs
from strandloom import cli
from strandloom.operators import divide, em, evaluation, numbering, significance, similarity, spectral, variants
from strandloom.sources import alignments, bam, genome, lists, pileup, vcf

OBS = "chromosome_id int, position bigint, read_id bigint, cell_id int, base int"


def locus(counts, position=1):
    return [(0, position, i, i, b) for i, b in enumerate(b for b, n in enumerate(counts) for _ in range(n))]


@pytest.mark.parametrize("counts, theta, keep", [
    ((0, 51, 0, 1), 0.01, False), ((3, 44, 2, 3), 0.01, True), ((2, 0, 0, 57), 0.01, False), ((2, 39, 0, 0), 0.001, False),
    ((118, 0, 3, 0), 0.01, False), ((1, 0, 3, 0), 0.001, False), ((10, 90, 0, 0), 0.001, True), ((3, 0, 0, 0), 0.001, False),
    ((8, 92, 0, 0), 0.01, False), ((5, 195, 0, 0), 0.01, False), ((6, 144, 0, 0), 0.01, False), ((30, 120, 0, 0), 0.01, True), ((5, 45, 0, 0), 0.01, True),
])
def test_significance(spark, counts, theta, keep):
    obs = spark.createDataFrame(locus(counts), OBS)
    assert (significance.significant_loci(obs, theta).count() == 1) == keep


def test_null_prior_matters_and_log_factorial(spark):
    obs = spark.createDataFrame(locus((5, 45, 0, 0)), OBS)
    loci = significance.with_sorted(significance.base_counts(obs))
    a, b = (loci.select(significance.log_ratio(0.01, p)).first()[0] for p in ("reference", "homozygous"))
    assert b - a == pytest.approx(math.log((1 - 0.0005 - 1e-6) / 0.0005))
    got = spark.createDataFrame([(0,), (1,), (10,), (170,), (171,), (500,)], "n int").select(significance.log_factorial(F.col("n"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(n + 1) for n in (0, 1, 10, 170, 171, 500)], rel=1e-9)


def test_average_coverage_of_nothing(spark):
    assert significance.average_coverage(significance.significant_loci(spark.createDataFrame([], OBS))).first()[0] == 0


@pytest.mark.parametrize("s, d, same, diff", [(1, 0, -0.302201189, -0.305499117), (0, 1, -1.343960550, -1.334672232), (2, 0, -0.503428249, -0.511332628), (1, 1, -1.311302282, -1.294191641), (0, 2, -2.070868674, -2.070008068), (3, 1, -1.823035677, -1.771895229)])
def test_pair_likelihood(spark, s, d, same, diff):
    a, b = spark.createDataFrame([(s, d)], "s int, d int").select(*similarity.likelihoods(F.col("s"), F.col("d"), 0.01, 0.5, 0.01)).first()
    factor = math.log(0.5 * math.comb(s + d, s))
    assert (math.log(a) + factor, math.log(b) + factor) == pytest.approx((same, diff), abs=1e-8)


def test_read_pairs_and_mates(spark):
    rows = [(0, 1, 1, 1, 0), (0, 1, 2, 2, 0), (0, 2, 1, 1, 1), (0, 2, 2, 2, 3), (0, 3, 1, 1, 0), (0, 3, 1, 1, 2), (0, 3, 2, 2, 0), (0, 1, 3, 1, 0)]
    obs = similarity.drop_mate_conflicts(spark.createDataFrame(rows, OBS))
    pairs = {(r["read_a"], r["read_b"]): (r["x_s"], r["x_d"]) for r in similarity.read_pairs(obs).collect()}
    assert pairs == {(1, 2): (1, 1), (2, 3): (1, 0)}


def test_laplacian(spark):
    a = [[0, 0.5, 0.2], [0.5, 0, 0.5], [0.2, 0.5, 0]]
    want = [[1, -0.5976143, -0.28571429], [-0.5976143, 1, -0.5976143], [-0.28571429, -0.5976143, 1]]
    rows = spark.createDataFrame([(i, j, float(a[i][j])) for i in range(3) for j in range(3)], "i int, j int, value double")
    assert {(r["i"], r["j"]): round(r["value"], 6) for r in similarity.laplacian(rows).collect()} == {(i, j): round(want[i][j], 6) for i in range(3) for j in range(3)}


def simulated(clones, loci=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(loci):
        g = int(rng.integers(4))
        for c, clone in enumerate(clones):
            for _ in range(int(rng.poisson(1.0))):
                base = (g + clone) % 4 if p % 2 else g
                rows.append((p % 3, p, int(rng.integers(1 << 40)), c, base if rng.random() > 0.01 else int(rng.integers(4))))
    return rows


def test_divide_finds_planted_clones(spark):
    clones = [int(i % 3 == 1) for i in range(42)]
    obs = spark.createDataFrame(simulated(clones, 800), OBS).persist()
    labels = divide.divide(obs, divide.Settings(min_cluster_size=40))
    truth = labels.withColumn("truth", (F.col("cell_id") % 3 == 1).cast("int"))
    assert evaluation.adjusted_rand_index(truth, "cluster_id", "truth").first()[0] >= 0.9


def test_divide_finds_clones_where_reads_span_the_chromosome(spark):
    """Ids of reads come back along the chromosome, and heterozygous loci aren't in phase: only near loci tell of one fragment."""
    rng, n, reads = np.random.default_rng(8), 60_000, 200
    locus, read = rng.integers(0, 2000, n), rng.integers(0, reads, n)
    cell, g, kind, draw = read % 40, locus % 4, locus // 4 % 5, rng.random(n)
    other = np.where(kind == 0, draw < 0.5, np.isin(kind, (1, 2)) & (cell % 10 < 3))
    base = np.where(rng.random(n) < 0.02, (g + 2) % 4, (g + other) % 4)
    columns = (np.zeros(n), locus * 24, read, cell, base)
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    obs = spark.createDataFrame(pa.table([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns, types)], ["chromosome_id", "position", "read_id", "cell_id", "base"])).persist()
    labels = {r[0]: r[1] for r in divide.divide(obs, divide.Settings(min_cluster_size=20)).collect()}
    assert labels == {c: 1 if c % 10 < 3 else 2 for c in range(40)}


def test_division_is_numbered_depth_first(spark, monkeypatch):
    """The root in two, its first part in two: parts 3 and 4 are of the first; the share of tumour cells holds for the root."""
    used, plain, asked = [], significance.significant_loci, []
    monkeypatch.setattr(significance, "significant_loci", lambda obs, theta, proportion, by: used.append(proportion) or plain(obs, theta, 4, by=by))

    def clusters(scores, members, *_):
        asked.append(sorted(map(len, members.values())))
        return {k: ((np.arange(len(m)) >= len(m) // 2).astype(int), 2, {}) if len(m) > 4 else (np.zeros(len(m), int), 1, {}) for k, m in members.items()}

    monkeypatch.setattr(spectral, "cluster_nodes", clusters)
    rows = [(0, p, c * 100 + p, c, (p % 4 + (c + r) % 2) % 4) for p in range(30) for c in range(16) for r in range(2)]
    obs, seen = spark.createDataFrame(rows, OBS).persist(), []
    got = {r[0]: r[1] for r in divide.divide(obs, divide.Settings(min_cluster_size=4, proportion=1, least_coverage=0), seen.append).collect()}
    assert [got[c] for c in range(16)] == [3] * 4 + [4] * 4 + [5] * 4 + [6] * 4
    assert [x.marker for x in seen] == ["", "A", "B", "AA", "AB", "BA", "BB"] and used == [1, 4, 4] and asked == [[16], [8, 8], [4, 4, 4, 4]]
    assert {c for x in seen if x.marker == "AB" for c in x.cells} == {4, 5, 6, 7} and seen[1].loci.columns[:2] == ["chromosome_id", "position"]
    with pytest.raises(ValueError, match="more than 9 cells"):
        divide.divide(obs, divide.Settings(max_cells=9))
    assert divide.divide(obs.limit(0)).collect() == []


def test_numbers_in_ranges(spark):
    rows = [(i * 7 % 50, "k%02d" % (i % 23)) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string")
    got = {(r["a"], r["b"]): r["n"] for r in numbering.dense_numbers(df, ["a", "b"], "n").collect()}
    assert got == {key: n for n, key in enumerate(sorted(set(rows)))}
    sums = {r["b"]: r["a"] for r in numbering.running_sums(df.groupBy("b").agg(F.sum("a").alias("a")), ["b"], ["a"]).collect()}
    assert sums == {b: sum(x for x, c in rows if c <= b) for b in {b for _, b in rows}}
    assert numbering.dense_numbers(df.limit(0), ["a"], "n").collect() == []


def test_command_line_from_reads_to_variants(spark, tmp_path, monkeypatch, capsys):
    """Alignments, pileup, clusters, variants; then the same from a saved clustering, and text pileups converted."""
    monkeypatch.setattr(cli, "build_session", lambda *a: spark)
    rng, genome_ = np.random.default_rng(1), {c: "".join(np.random.default_rng(i).choice(list("ACGT"), 400)) for i, c in enumerate("12")}
    (tmp_path / "reads").mkdir()
    for cell in range(24):
        records = []
        for i in range(160):
            c, start = "12"[i % 2], int(rng.integers(0, 340))
            seq = list(genome_[c][start : start + 60])
            for at in range(60):
                if cell % 2 and (start + at) % 4 == 0:
                    seq[at] = "ACGT"[("ACGT".index(seq[at]) + 1) % 4]
                elif rng.random() < 0.002:
                    seq[at] = "ACGT"[rng.integers(4)]
            records.append((f"c{cell}r{i}", 0, c, start + 1, 60, [(60, "M")], "".join(seq), "J" * 60, 0))
        (tmp_path / f"reads/cell{cell:02d}_1.bam").write_bytes(bam_bytes(records, block=30_000))
    (tmp_path / "genome.fa").write_text("".join(f">{c}\n{s}\n" for c, s in genome_.items()))
    run = lambda *a: cli.main([str(x) for x in a])
    run("pileup", "-i", tmp_path / "reads", "-o", tmp_path / "bin", "--chromosomes", "1,2", "--max_coverage", 1000)
    assert sorted(p.name for p in (tmp_path / "bin").iterdir()) == ["cells.map", "chromosome_1.pileup.bin", "chromosome_2.pileup.bin"]
    assert (tmp_path / "bin/cells.map").read_text().startswith("cell00\t0\ncell01\t1\n")
    options = ("--max_coverage", 1000, "--min_cluster_size", 13, "--reference_genome", tmp_path / "genome.fa", "--seq_error_rate", 0.01, "--clustering_type", "SPECTRAL2")
    run("cluster", "-i", tmp_path / "bin", "-o", tmp_path / "out", "--chromosomes", "1,2", "--compute_read_stats", "--all_matrices", *options)
    assert "'cells': 24" in capsys.readouterr().out
    labels = (tmp_path / "out/clustering").read_text().split(",")
    assert len(labels) == 24 and len(set(labels[::2])) == len(set(labels[1::2])) == 1 and labels[0] != labels[1] and "0" not in labels
    for name in ("sim_mat_eigenvalues.csv", "sim_mat_eigenvectors.csv", "sim_mat_eigenvectors_norm.csv", "spectral_clustering", "significant_positions", "common.vcf", "scores"):
        assert (tmp_path / "out" / name).exists(), name
    assert lists.read_matrix(str(tmp_path / "out/sim_mat_eigenvalues.csv")).shape == (1, 20)
    changed = labels[1]
    lines_ = [x.split("\t") for x in (tmp_path / f"out/cluster_{changed}.vcf").read_text().splitlines() if x[0] != "#"]
    good = [x for x in lines_ if int(x[1]) % 4 == 1 and x[3] == genome_[x[0]][int(x[1]) - 1] and x[4][0] == "ACGT"[("ACGT".index(x[3]) + 1) % 4]]
    assert len(lines_) > 150 and len(good) >= 0.98 * len(lines_)
    assert [(int(x[0]), int(x[1])) for x in lines_] == sorted((int(x[0]), int(x[1])) for x in lines_)
    run("cluster", "-i", tmp_path / "bin", "-o", tmp_path / "again", "--chromosomes", "1,2", "--clustering", tmp_path / "out/clustering", *options)
    for kind in ("txt", "parquet"):  # the same clusters of pileups in any format
        run("pileup", "-i", tmp_path / "reads", "-o", tmp_path / kind, "--chromosomes", "1,2", "--max_coverage", 1000, "--format", kind, "--read_names")
        run("cluster", "-i", tmp_path / kind, "-o", tmp_path / f"{kind}_out", "--chromosomes", "1,2", *options[:4], *options[6:])
        assert (tmp_path / f"{kind}_out/clustering").read_text().split(",") == labels
        assert len({x.split("\t")[1] for f in (tmp_path / kind / "read_names.map").glob("part-*") for x in f.read_text().splitlines()}) > 2000
    plain = lambda f: [x for x in f.read_text().splitlines() if not x.startswith("##")]
    assert plain(tmp_path / f"again/cluster_{changed}.vcf") == plain(tmp_path / f"out/cluster_{changed}.vcf")
    (tmp_path / "t_22.pileup.txt").write_text(THREE)
    run("convert", "-i", tmp_path / "t_22.pileup.txt", "-o", tmp_path / "converted")
    assert (tmp_path / "converted/chromosome_22.pileup.bin").exists()
    for bad in (("--tumor_purity", "6"), ("--chromosomes", "1,Z"), ("--termination", "x"), ("--clustering_type", "x"), ("--normalization", "x")):
        with pytest.raises(SystemExit):
            run("cluster", "-i", tmp_path / "bin", "-o", tmp_path / "bad", *bad)
    with pytest.raises(ValueError, match="no pileup of chromosomes 7"):
        run("cluster", "-i", tmp_path / "bin", "-o", tmp_path / "bad", "--chromosomes", "7")


def test_small_files(spark, tmp_path):
    (tmp_path / "c").write_text("1,2,0,2\n")
    labels = lists.read_clustering(spark, str(tmp_path / "c"))
    assert {r[0]: r[1] for r in lists.group_labels(labels, lists.cell_grouping(spark, 2, None, 4)).collect()} == {0: 1, 1: 0}
    lists.write_clustering(labels, str(tmp_path / "d"))
    assert (tmp_path / "d").read_text() == "1,2,0,2"
    (tmp_path / "t.tsv").write_text("#x\nc1\tA\nc2\tB\n")
    assert [tuple(r) for r in lists.read_truth(spark, str(tmp_path / "t.tsv"), "cell string, clone string").collect()] == [("c1", "A"), ("c2", "B")]
    names = pileup.read_names(spark.createDataFrame([("b", 1), ("a", 2), ("b", 1)], "n string, o int"), "n", "o")
    pileup.write_read_names(names, str(tmp_path / "names"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "names")).collect()] == ["b\t0", "a\t1"]


def test_settings_are_checked():
    for bad in ({"kind": "x"}, {"normalization": "x"}, {"termination": "x"}, {"proportion": 9}):
        with pytest.raises(ValueError):
            divide.Settings(**bad)


@pytest.mark.parametrize("accumulate", [True, False])
@pytest.mark.parametrize("p, bases, want", [([0.9, 0.02, 0.03, 0.9], "CCGG", [0, 0, 1, 1]), ([0.9, 0.9, 0.03, 0.1], "GCGG", [0, 1, 0, 0])])
def test_em_limits(spark, p, bases, want, accumulate):
    rows = [(0, q, c, c, "ACGT".index(b)) for q in range(3) for c, b in enumerate(bases)]
    start = spark.createDataFrame(list(enumerate(p)), "cell_id int, p double")
    got = {r["cell_id"]: r["p"] for r in em.refine(spark.createDataFrame(rows, OBS), start, 1e-3, accumulate).collect()}
    assert [got[c] for c in range(4)] == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("counts, theta, pooled, want", [
    ((10, 0, 0, 0), 0.001, False, 0), ((1, 10, 0, 0), 0.001, False, 9), ((2, 10, 0, 0), 0.05, False, 9), ((10, 10, 0, 0), 0.05, False, 1),
    ((10, 13, 0, 0), 0.05, False, 1), ((5, 0, 0, 0), 0.05, False, None), ((5, 0, 0, 0), 0.05, True, 0),
])
def test_genotypes(spark, counts, theta, pooled, want):
    df = variants.ranked(spark.createDataFrame([(*counts, sum(counts))], "n_a int, n_c int, n_g int, n_t int, coverage int"))
    assert df.select(variants.likely_genotype(theta, 1e-3, F.lit(pooled))).first()[0] == want


@pytest.mark.parametrize("counts, want", [((10, 0, 0, 0), 0), ((1, 10, 0, 0), 9), ((2, 10, 0, 0), None), ((5, 5, 5, 5), None)])
def test_pooled_call(spark, counts, want):
    df = spark.createDataFrame([(*counts, sum(counts))], "n_a int, n_c int, n_g int, n_t int, coverage int")
    assert df.select(variants.pooled_call(0.05)).first()[0] == want


def variant_case(spark, rows, labels, reference):
    obs = spark.createDataFrame([(0, 1, i, c, "ACGT".index(b)) for i, (c, b) in enumerate(rows)], OBS)
    ref = spark.createDataFrame([(0, 1, reference)], "chromosome_id int, position bigint, reference int")
    own, common, _ = variants.variant_table(obs, spark.createDataFrame(labels, "cell_id int, cluster_id int"), ref, 0.01)
    line = lambda df: sorted((r["ref"], r["alt"], r["gt"]) for r in df.collect())
    return line(own), line(common)


def test_variants(spark):
    one = [(c, 1) for c in range(40)]
    assert variant_case(spark, [(c, "A") for c in range(40)], one, 1) == ([], [("C", "A", "1/1")])
    assert variant_case(spark, [(c, "C") for c in range(40)], one, 0) == ([], [("A", "C", "1/1")])
    assert variant_case(spark, [(c, "AC"[c % 2]) for c in range(40)], one, 1)[0] == []
    two = [(c, 1 if c < 20 else 2) for c in range(40)]
    own, _ = variant_case(spark, [(c, "G" if c < 20 else "T") for c in range(40)], two, 1)
    assert own and {x[2] for x in own} == {"1/1"}


def test_codecs(spark):
    letters = spark.createDataFrame([(c,) for c in "ACGTUacgtun-"], "c string").select(codecs.encode_base(F.col("c"))).collect()
    assert [r[0] for r in letters] == [0, 1, 2, 3, 3, 0, 1, 2, 3, 3, 5, 5]
    names = spark.createDataFrame([("1",), ("22",), ("X",), ("y",), ("0",), ("MT",)], "c string").select(codecs.chromosome_id(F.col("c"))).collect()
    assert [r[0] for r in names] == [0, 21, 22, 23, None, None]


THREE = "22\t1\t2\tCA\t1,3\tR1,R2\n22\t2\t3\tACT\t1, 3,2\tR1,R2,R3\n22\t3\t5\tAAACA\t1,2,3,9,4\tR1,R3,R2,R4,R5\n"


def test_text_and_binary_pileups(spark, tmp_path):
    path = tmp_path / "in_22.pileup.txt"
    path.write_text(THREE)
    obs = pileup.read_text(spark, str(path))
    rows = {(r["position"], r["cell_id"]): (r["base"], r["read_name"]) for r in obs.collect()}
    assert len(rows) == 10 and rows[2, 3] == (1, "R2") and rows[1, 1] == (1, "R1")
    assert pileup.statistics(obs).select("cells", "cell_count").first() == (5, 10)
    small = pileup.numbered_reads(obs.drop("read_name"))
    assert {r[0] for r in small.select("read_id").collect()} == set(range(5))
    files = pileup.write_binary(obs.drop("read_name"), str(tmp_path / "bin"))
    back = pileup.read_pileup(spark, str(tmp_path / "bin"), chromosomes=["22", "X"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, small.select(back.columns).collect()))
    assert [f.rsplit("/", 1)[1] for f in files] == ["chromosome_22.pileup.bin"]
    assert pileup.convert_text(spark, str(path), str(tmp_path / "converted")) and (tmp_path / "converted" / "chromosome_22.pileup.bin").read_bytes() == (tmp_path / "bin/chromosome_22.pileup.bin").read_bytes()
    with pytest.raises(ValueError, match="no pileup of chromosomes 3"):
        pileup.read_pileup(spark, str(tmp_path / "bin"), chromosomes=["3"])
    listed = spark.createDataFrame([(21, p) for p in (0, 2, 9, 11)], "chromosome_id int, position bigint")
    kept = pileup.read_pileup(spark, str(tmp_path / "bin"), positions=listed)
    assert {r[0] for r in kept.select("position").collect()} == {2}
    grouped = pileup.regroup(small, lists.cell_grouping(spark, 2, None, 20))
    assert sorted(r["cell_id"] for r in grouped.where("position = 3").collect()) == [0, 1, 1, 2, 4]
    pileup.write_text(small, str(tmp_path / "txt"))


SAM = "@HD\tVN:1.3\n@SQ\tSN:1\tLN:2\nr001\t163\t1\t1\t6\t5M\t=\t421\t425\tAAAAA\tJGCG8\tAS:i:-27\nr001\t83\t1\t421\t6\t5M\t=\t1\t-425\tCCCCC\t9CJJ=\tAS:i:-90\n"


def test_sam_pileup(spark, tmp_path):
    (tmp_path / "a_1.sam").write_text(SAM)
    (tmp_path / "b_1.sam").write_text(SAM.replace("AAAAA", "GGGGG").replace("CCCCC", "TTTTT"))
    reads = alignments.read_alignments(spark, [str(tmp_path / "a_1.sam"), str(tmp_path / "b_1.sam")])
    build = lambda **k: alignments.build_pileup(reads, **({"min_different": 1, "min_base_quality": 10, "min_map_quality": 6, "min_alignment_score": -100} | k))
    obs = build()
    assert obs.select("position").distinct().count() == 10 and obs.count() == 20
    assert build(min_map_quality=7).count() == 0 and build(min_different=3).count() == 0
    assert pileup.statistics(obs).select("max_fragment").first()[0] == 424


def test_cigar(spark):
    rows = [("2S3M1I2M1D1M2H", "xxACGtAATz"), ("3M2I", "ACGTT"), ("5H2M1N1M", "ACG")]
    df = spark.createDataFrame([(i, 10, c, s, "J" * len(s)) for i, (c, s) in enumerate(rows)], "id int, start bigint, cigar string, seq string, qual string")
    got = {}
    for r in alignments.explode_cigar(df).collect():
        got.setdefault(r["id"], []).append((r["position"], r["letter"]))
    assert sorted(got[0]) == [(10, "A"), (11, "C"), (12, "G"), (13, "A"), (14, "A"), (16, "T")]
    assert sorted(got[1]) == [(10, "A"), (11, "C"), (12, "G")] and sorted(got[2]) == [(10, "A"), (11, "C"), (13, "G")]


def bam_bytes(records, names=("1", "2"), block=200):
    """A BAM file of SAM-like records (name, flag, chromosome, start, mapq, [(n, op)], seq, qual, score), in small BGZF blocks."""
    raw = b"BAM\1" + struct.pack("<i", 3) + b"@x\n" + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000) for n in names)
    for name, flag, chromosome, start, mapq, cigar, seq, qual, score in records:
        ops = b"".join(struct.pack("<I", n << 4 | bam.CIGAR_LETTERS.index(op)) for n, op in cigar)
        codes = [bam.BASE_LETTERS.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", names.index(chromosome), start - 1, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes(ord(q) - 33 for q in qual) + b"NMC\1" + b"XZZabc\0" + b"ASi" + struct.pack("<i", score)
        raw += struct.pack("<i", len(body)) + body
    out = b""
    for i in range(0, len(raw), block):
        d = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = d.compress(raw[i : i + block]) + d.flush()
        out += struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(raw[i : i + block]), len(raw[i : i + block]))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def inflated(data):
    """The bytes of a series of gzip members."""
    out = b""
    while data:
        d = zlib.decompressobj(31)
        out += d.decompress(data)
        data = d.unused_data
    return out


READS_ = [("r%d" % i, 99, "12"[i % 2], 1 + i, 30 + i % 9, [(2, "S"), (3, "M"), (1, "I"), (2, "M")], "NNACGTAC"[: 8], "JJJJJJJJ", -i) for i in range(60)]


@pytest.mark.parametrize("gz", [False, True])
def test_bam_is_read_as_its_sam(spark, tmp_path, gz):
    sam = "".join("\t".join(map(str, (n, f, c, s, m, "".join(f"{k}{o}" for k, o in cigar), "*", 0, 0, q, u, f"AS:i:{a}"))) + "\n" for n, f, c, s, m, cigar, q, u, a in READS_)
    (tmp_path / "a_1.sam").write_text("@HD\n" + sam)
    data = bam_bytes(READS_)
    (tmp_path / "a_1.bam").write_bytes(gzip.compress(inflated(data)) if gz else data)
    both = [f(spark, str(tmp_path / n)).drop("path") for f, n in ((alignments.read_sam, "a_1.sam"), (alignments.read_bam, "a_1.bam"))]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect())) and both[1].count() == 60
    assert alignments.read_alignments(spark, [str(tmp_path / "a_1.bam")], ["2"]).count() == 30
    with pytest.raises(ValueError, match="not a BAM"):
        next(bam.bam_records(gzip.compress(b"SAM\1...")))
    with pytest.raises(ValueError, match="ends within"):
        list(bam.bam_records(gzip.compress(inflated(data)[:-3])))


def test_large_bam_takes_linear_time():
    import time

    records = [READS_[i % 60] for i in range(8000)]
    small, large, took = bam_bytes(records[:2000]), bam_bytes(records), []
    for data in (small, large):
        began = time.time()
        n = sum(1 for _ in bam.bam_records(data))
        took.append(time.time() - began)
    assert n == 8000 and took[1] < 12 * took[0]


def test_cells_of_files(spark, tmp_path):
    paths = []
    for name in ("a/c_1.sam", "b/c_1.sam", "b/sp ace+%41_1.sam"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(SAM)
        paths.append(str(tmp_path / name))
    (tmp_path / "b/z_1.bam").write_bytes(bam_bytes(READS_[:2]))
    paths.append(str(tmp_path / "b/z_1.bam"))
    reads = alignments.read_alignments(spark, paths)
    assert {r["cell_id"]: r["count"] for r in reads.groupBy("cell_id").count().collect()} == dict.fromkeys(range(4), 2)
    with pytest.raises(Exception, match="no cell"):
        alignments.with_cells(alignments.read_sam(spark, paths[:2]), paths[:1]).collect()
    assert [alignments.cell_name(p) for p in ("x/c_1.sam", "c.sam", "a_b_2.bam")] == ["c", "c", "a_b"]


CASES = [
    ("ACGT", [(0, 1, "I")], "CGT"), ("ACGT", [(2, 1, "I")], "ACT"), ("ACGT", [(0, 1, "D"), (2, 1, "I")], "NACT"), ("AAAA", [], "AAAA"),
    ("ACGT", [(0, 1, "I"), (2, 1, "D")], "CNGT"), ("AAAA", [(0, 1, "D")], "NAAAA"), ("AAAA", [(2, 1, "D")], "AANAA"),
    ("ACGT", [(1, 2, "I"), (2, 2, "D")], "ANNT"), ("ACGT", [(4, 2, "D")], "ACGTNN"), ("ACGT", [(3, 9, "I")], "ACG"), ("ACGTACGT", [(1, 1, "I"), (1, 2, "D"), (5, 1, "I"), (6, 1, "D")], "ANNGTANGT"),
]


@pytest.mark.parametrize("size", [3, 10_000])
def test_indel_map(spark, size):
    contigs = spark.createDataFrame([(str(i), len(seq)) for i, (seq, _, _) in enumerate(CASES)], "contig string, _n bigint")
    events = spark.createDataFrame([(str(i), k, *e) for i, (_, es, _) in enumerate(CASES) for k, e in enumerate(es)], "contig string, nr bigint, start_pos bigint, len bigint, tr string")
    assert {r[0]: r[1] for r in genome.mapped_lengths(contigs, events).collect()} == {str(i): len(w) for i, (_, _, w) in enumerate(CASES)}
    loci = spark.createDataFrame([(str(i), p) for i, (_, _, w) in enumerate(CASES) for p in range(len(w))], "contig string, _at bigint")
    got = {(r["contig"], r["_at"]): r["_host"] for r in genome.host_places(loci, genome.segments(contigs, events), size).collect()}
    for i, (seq, _, want) in enumerate(CASES):
        assert "".join("N" if got[str(i), p] is None else seq[got[str(i), p]] for p in range(len(want))) == want


def test_map_file(spark, tmp_path):
    line = "3\t1_paternal\t{}\t1\t11\t+\t{}\tx\n"
    (tmp_path / "m").write_text("#c\n\n" + line.format(11, "DEL") + line.format(1, "SEQ") + line.format(21, "INS"))
    assert [(r["contig"], r["start_pos"], r["len"], r["tr"]) for r in genome.read_map(spark, str(tmp_path / "m")).orderBy("nr").collect()] == [("1_paternal", 10, 3, "D"), ("1_paternal", 20, 3, "I")]
    (tmp_path / "m").write_text("3\t1_paternal\t11\n")
    with pytest.raises(Exception, match="8 columns"):
        genome.read_map(spark, str(tmp_path / "m")).collect()
    (tmp_path / "d.fa").write_text(">1_maternal\nACGTACGTAC\n>1_paternal\nACGTTTACGTAC\n")
    (tmp_path / "m").write_text("2\t1_paternal\t5\t1\t5\t+\tINS\tx\n")
    loci = spark.createDataFrame([(0, p) for p in range(0, 13)], "chromosome_id int, position bigint")
    got = {r["position"]: r["reference"] for r in genome.reference_genotypes(spark, str(tmp_path / "d.fa"), loci, str(tmp_path / "m")).collect()}
    assert got == {p + 1: 9 * "ACGT".index(c) for p, c in enumerate("ACGTACGTAC")}
    with pytest.raises(ValueError, match="different length"):
        genome.reference_genotypes(spark, str(tmp_path / "d.fa"), loci)


def test_reference_genome(spark, tmp_path):
    (tmp_path / "d.fa").write_text(">1_maternal\nAAAAA\nGGGGG\n>1_paternal\nCCCCC\nGGGGG\n>X_maternal\nTT\n>Y_paternal\nCC\n")
    loci = spark.createDataFrame([(0, 1), (0, 6), (0, 11), (22, 2), (23, 1)], "chromosome_id int, position bigint")
    got = {(r[0], r[1]): r[2] for r in genome.reference_genotypes(spark, str(tmp_path / "d.fa"), loci).collect()}
    assert got == {(0, 1): 1, (0, 6): 18, (22, 2): 27, (23, 1): 9}
    assert genome.is_diploid(genome.read_genome(spark, str(tmp_path / "d.fa"))[0])


def test_lists_and_evaluation(spark, tmp_path):
    (tmp_path / "p.vcf").write_text("#c\n1\t5\n2\t7\nMT\t1\nX\t9\n")
    assert sorted(map(tuple, lists.read_positions(spark, str(tmp_path / "p.vcf")).collect())) == [(0, 5), (1, 7), (22, 9)]
    (tmp_path / "g").write_text("0,0,0,1,1,1\n")
    assert [r[1] for r in lists.cell_grouping(spark, merge_file=str(tmp_path / "g")).orderBy("cell_id").collect()] == [0, 0, 0, 1, 1, 1]
    lists.write_matrix(np.eye(2), str(tmp_path / "m"))
    assert (lists.read_matrix(str(tmp_path / "m")) == np.eye(2)).all()
    same = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert evaluation.adjusted_rand_index(same).first()[0] == pytest.approx(1)
    cuts = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (2.5, False)], "score double, truth boolean")
    assert tuple(evaluation.best_threshold(cuts).first()) == (2.0, 1.0)
    line = spark.createDataFrame([(22, 3, "A", "C", "1/1", 1, 2, 3, 4)], "chromosome_id int, position bigint, ref string, alt string, gt string, n_a int, n_c int, n_g int, n_t int")
    assert vcf.format_lines(line).first()["value"].startswith("X\t3\t.\tA\tC\t")
    assert evaluation.simulated_loci(spark, 50, 20, 0.3, 0.01, "somatic").count() > 500
