"""FASTA files in splits: the same contigs and letters wherever Spark cuts them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandloom.sources import genome


def fasta(rng, contigs, width, ends="\n"):
    text, want = ["comment before the first header", ""], []
    for i in range(contigs):
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(rng.choice([0, 1, 7, 500, 3000, 26_000])))
        want.append((f"c{i}", seq))
        text.append(f">c{i} some words > and more")
        text.extend(seq[k : k + width] + " " * rng.randrange(2) for k in range(0, len(seq), width))
        text.extend([""] * rng.randrange(2))
    return ends.join(text) + ends, want


def read(spark, path):
    contigs, pieces = genome.read_genome(spark, path)
    parts = {}
    for r in pieces.collect():
        parts.setdefault(r["nr"], []).append((r["start"], r["piece"]))
    out = []
    for r in contigs.orderBy("nr").collect():
        own = sorted(parts.get(r["nr"], []))
        seq = "".join(p for _, p in own)
        assert [s for s, _ in own] == [sum(len(p) for _, p in own[:k]) for k in range(len(own))] and len(seq) == r["_n"]
        assert all(len(p) < genome.CHUNK + 80 for _, p in own)
        out.append((r["contig"], seq))
    return out


@pytest.mark.parametrize("bytes_, ends", [(1 << 20, "\n"), (4096, "\n"), (513, "\r\n")])
def test_contigs_are_whole_wherever_files_are_cut(spark, tmp_path, bytes_, ends):
    text, want = fasta(random.Random(bytes_), 9, 60, ends)
    (tmp_path / "g.fa").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert read(spark, str(tmp_path / "g.fa")) == want
        if bytes_ == 4096:
            assert genome.read_bases(spark, str(tmp_path / "g.fa")).select("_block").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_a_folder_is_one_genome(spark, tmp_path):
    (tmp_path / "part-0").write_text(">a\nACG\n")
    (tmp_path / "part-1").write_text("TT\n>b\nG\n")
    (tmp_path / "part-2").write_text("C\n")
    assert read(spark, str(tmp_path)) == [("a", "ACGTT"), ("b", "GC")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/x.fa").write_text("")
    assert read(spark, str(tmp_path / "empty")) == []


def test_letters_at_any_place(spark, tmp_path):
    rng = random.Random(4)
    text, want = fasta(rng, 6, 70)
    (tmp_path / "g.fa").write_text(text)
    _, pieces = genome.read_genome(spark, str(tmp_path / "g.fa"))
    asked = [(i + 1, at) for i, (_, seq) in enumerate(want) for at in {0, len(seq) - 1, len(seq), *(rng.randrange(len(seq) + 1) for _ in range(40))}]
    got = genome.letters_at(spark.createDataFrame(asked, "nr bigint, _host bigint"), pieces, 1000).collect()
    assert sorted(map(tuple, got)) == sorted((nr, at, want[nr - 1][1][at]) for nr, at in asked if 0 <= at < len(want[nr - 1][1]))


def test_a_large_contig_takes_linear_time(spark, tmp_path):
    line = "".join(random.Random(1).choice("ACGT") for _ in range(80)) + "\n"
    loci = spark.range(0, 3_000_000, 1000).select(F.lit(0).alias("chromosome_id"), (F.col("id") + 1).alias("position"))
    took = []
    for n in (50_000, 400_000):
        (tmp_path / f"{n}.fa").write_text(">1\n" + line * n)
        began = time.time()
        assert genome.reference_genotypes(spark, str(tmp_path / f"{n}.fa"), loci).count() == 3000
        took.append(time.time() - began)
    assert took[1] < 30 and took[1] < 12 * took[0]
