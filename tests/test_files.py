"""The sink of ordered files: whole files or none, in order, whatever tasks do."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.sources import files, vcf


def test_rows_become_files_in_order(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("f"), F.col("id") % 3, F.lit(".txt")).alias("file"), "id", F.encode(F.concat(F.col("id").cast("string"), F.lit("\n")), "UTF-8").alias("data"))
    dealt = rows.repartitionByRange(7, "file", "id").sortWithinPartitions("file", "id")
    files.write_files(dealt, str(tmp_path / "out dir"), {"f1.txt": "head\n", "empty.txt": "alone\n"})
    for k in range(3):
        assert (tmp_path / f"out dir/f{k}.txt").read_text() == ("head\n" if k == 1 else "") + "".join(f"{i}\n" for i in range(k, 5000, 3))
    assert sorted(os.listdir(tmp_path / "out dir")) == ["empty.txt", "f0.txt", "f1.txt", "f2.txt"]
    files.write_files(dealt.where("file = 'f0.txt' AND id < 9"), f"file://{tmp_path}/out dir")  # replaced, the others stay
    assert (tmp_path / "out dir/f0.txt").read_text() == "0\n3\n6\n" and (tmp_path / "out dir/f2.txt").exists()
    files.write_files(dealt.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "f").write_text("old")
    rows = spark.range(100).repartitionByRange(4, "id").select(F.lit("f").alias("file"), F.when(F.col("id") == 80, F.raise_error(F.lit("lost"))).otherwise(F.encode(F.col("id").cast("string"), "UTF-8")).cast("binary").alias("data"))
    with pytest.raises(Exception, match="lost"):
        files.write_files(rows, str(tmp_path))
    assert os.listdir(tmp_path) == ["f"] and (tmp_path / "f").read_text() == "old"


def test_a_task_that_goes_on_after_the_end_leaves_nothing(tmp_path, monkeypatch):
    """The driver gives up before a task's first part, and between two of them."""
    monkeypatch.setattr(files.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 5))
    for before in (0, 1):
        writer = files.FilesSource({"path": str(tmp_path)}).writer(None, False)

        def batches(writer=writer, before=before):
            for k, name in enumerate("ab"):
                if k == before:
                    writer.abort([])
                yield pa.RecordBatch.from_pydict({"file": [name], "data": [b"x"]})

        with pytest.raises(OSError, match="closed"):
            writer.write(batches())
        assert os.listdir(tmp_path) == []


def test_only_the_parts_of_tasks_that_succeeded_count(tmp_path):
    writer = files.FilesWriter({"path": str(tmp_path)})
    hidden = tmp_path / writer.hidden
    hidden.mkdir()
    for name, text in (("0-1-0", "a"), ("0-7-0", "twice"), ("1-2-0", "b")):
        (hidden / name).write_text(text)
    written = [files.Written(1, [("x", f"{writer.hidden}/1-2-0")]), None, files.Written(0, [("x", f"{writer.hidden}/0-1-0")])]
    writer.commit(written)
    assert (tmp_path / "x").read_text() == "ab" and os.listdir(tmp_path) == ["x"]


def test_variant_files(spark, tmp_path):
    kinds = "chromosome_id int, position bigint, cluster_id int, ref string, alt string, gt string, n_a int, n_c int, n_g int, n_t int"
    lines = spark.createDataFrame([(c, p, k, "A", a, "1/1", 1, 2, 3, 4) for c in (0, 9, 22) for p in (30, 4, 100) for k in (1, 3) for a in "TC"], kinds).repartition(5)
    vcf.write_clusters(lines, lines.where("cluster_id = 1 AND position = 4").drop("cluster_id"), str(tmp_path), "ref.fa", [1, 2, 3])
    assert sorted(os.listdir(tmp_path)) == ["cluster_1.vcf", "cluster_2.vcf", "cluster_3.vcf", "common.vcf"]
    text = (tmp_path / "cluster_3.vcf").read_text().splitlines()
    assert text[0] == "##fileformat=VCFv4.2" and text[5].endswith("cluster-3") and (tmp_path / "cluster_2.vcf").read_text().count("\n") == 6
    assert [tuple(x.split("\t")[k] for k in (0, 1, 4)) for x in text[6:]] == [(c, p, a) for c in ("1", "10", "X") for p in ("4", "30", "100") for a in "CT"]
    assert [x.split("\t")[0] for x in (tmp_path / "common.vcf").read_text().splitlines()] == ["1", "1", "10", "10", "X", "X"]
