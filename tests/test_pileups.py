"""Pile-ups written in any format are read back as they were; plans of the bucketed Parquet."""

import os

import pytest
from pyspark.sql import functions as F

from strandloom.operators import significance
from strandloom.sources import pileup

OBS = "chromosome_id int, position bigint, read_id bigint, cell_id int, base int"


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(c, p, (p * 7 + k) % 23, k % 6, (p + k) % 4) for c in (0, 4, 22) for p in range(1, 80, 3) for k in range(p % 9)]
    return spark.createDataFrame(rows, OBS).dropDuplicates(["chromosome_id", "position", "read_id", "cell_id"])


def plain(df, reads=True):
    return sorted(tuple(r) if reads else (r[0], r[1], r[3], r[4]) for r in df.select("chromosome_id", "position", "read_id", "cell_id", "base").collect())


@pytest.mark.parametrize("kind", ["bin", "txt", "parquet", "plain"])
def test_a_pileup_is_read_back(spark, obs, tmp_path, kind):
    folder = str(tmp_path / "a pile'up")
    if kind == "bin":
        pileup.write_binary(obs, folder)
    elif kind == "txt":
        pileup.write_text(obs, f"{folder}/pileup.txt")
    elif kind == "parquet":
        pileup.write_parquet(obs, f"{folder}/pileup.parquet", 4)
    else:
        obs.write.partitionBy("chromosome_id").parquet(f"{folder}/pileup.parquet")
    (tmp_path / "a pile'up/cells.map").write_text("x\t0\n")
    keep = kind in ("parquet", "plain")
    assert plain(pileup.read_pileup(spark, folder), keep) == plain(obs, keep)
    for source in (folder, f"file://{folder}"):
        got = pileup.read_pileup(spark, source, chromosomes=["5", "7", "X"])
        assert plain(got, keep) == plain(obs.where("chromosome_id IN (4, 22)"), keep)
    reads = lambda df: sorted(map(tuple, df.groupBy("chromosome_id", "cell_id").agg(F.count_distinct("read_id")).collect()))
    assert reads(got) == reads(obs.where("chromosome_id > 0"))
    if keep:
        assert pileup.read_pileup(spark, folder, chromosomes=["9"]).isEmpty()
    else:
        with pytest.raises(ValueError, match="no pileup of chromosomes 9"):
            pileup.read_pileup(spark, folder, chromosomes=["9"])
    assert plain(pileup.read_pileup(spark, folder, 3), keep) == plain(significance.cap_coverage(obs, 3), keep)


def test_nothing_that_tells_the_chromosome_is_an_error(spark, obs, tmp_path):
    pileup.write_binary(obs.where("chromosome_id = 4"), str(tmp_path / "b"))
    os.rename(tmp_path / "b/chromosome_5.pileup.bin", tmp_path / "b/mine.bin")
    with pytest.raises(Exception, match="nothing tells the chromosome"):
        pileup.read_pileup(spark, str(tmp_path / "b"), chromosomes=["5"]).collect()
    assert pileup.read_binary(spark, str(tmp_path / "b/mine.bin"), 4).count() == obs.where("chromosome_id = 4").count()
    (tmp_path / "t").mkdir()
    (tmp_path / "t/mine.txt").write_text("odd\t3\t1\tA\t0\tr\n")
    with pytest.raises(Exception, match="nothing tells the chromosome"):
        pileup.read_pileup(spark, str(tmp_path / "t")).collect()
    (tmp_path / "t/mine.txt").write_text("chr7\t3\t1\tA\t0\tr\n")
    assert [tuple(r)[:2] for r in pileup.read_pileup(spark, str(tmp_path / "t"), chromosomes=["7"]).collect()] == [(6, 3)]
    assert pileup.read_pileup(spark, str(tmp_path / "t"), chromosomes=["8"]).collect() == []
    (tmp_path / "e").mkdir()
    assert pileup.read_pileup(spark, str(tmp_path / "e")).collect() == []


def test_plans_over_bucketed_parquet(spark, obs, tmp_path):
    pileup.write_parquet(obs, str(tmp_path / "p"), 4)
    assert sorted(n for n in os.listdir(tmp_path / "p") if n[0] not in "._") == ["chromosome=0", "chromosome=22", "chromosome=4"]
    listed = spark.createDataFrame([(4, p) for p in range(40)], "chromosome_id int, position bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = pileup.read_parquet(spark, str(tmp_path / "p"), [4])
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        semi = rows.join(listed, significance.LOCUS, "left_semi")
        text = plan(semi)
        assert "chromosome#" in text.split("PartitionFilters: ")[1][:60]
        assert text.count("Exchange") == 1  # that of the list
        assert plain(semi) == plain(obs.where("chromosome_id = 4 AND position < 40"))
        loci = significance.significant_loci(rows)
        assert "Exchange" not in plan(loci) and "Exchange" not in plan(significance.keep_loci(rows, loci)) and "Exchange" not in plan(significance.cap_coverage(rows, 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dictionary_of_reads(spark, tmp_path):
    reads = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], "cell_id int, name string")
    seen = reads.where("name <> 'c'").select(F.lit(3).alias("chromosome_id"), F.lit(5).cast("bigint").alias("position"), F.xxhash64("cell_id", "name").alias("read_id"), "cell_id", F.lit(1).alias("base"))
    keys = {(r["name"], r["read_id"]) for r in pileup.read_dictionary(reads, seen, False).collect()}
    assert len(keys) == 3 and {k for _, k in keys} == {r["read_id"] for r in seen.collect()}
    numbers = pileup.read_dictionary(reads, seen, True).collect()
    assert sorted(r["read_id"] for r in numbers) == [0, 1, 2] and sorted(r["name"] for r in numbers) == ["a", "a", "b"] and {r["chromosome_id"] for r in numbers} == {3}
    pileup.write_read_names(pileup.read_dictionary(reads, seen, True), str(tmp_path / "n"))
    assert [r[0].split("\t")[1:] for r in spark.read.text(str(tmp_path / "n")).collect()] == [["0", "3"], ["1", "3"], ["2", "3"]]
