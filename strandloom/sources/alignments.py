"""Aligned reads: SAM text and BAM files, exploded along their CIGAR into observations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import chromosome_id, encode_base
from ..operators.significance import keep_loci, pileup_loci
from ..session import with_checkpoints
from .bam import SPLIT, read_regions


def read_sam(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(paths).select(decoded.alias("path"), "value").where(~F.startswith("value", F.lit("@")) & (F.col("value") != ""))
    f = F.split("value", "\t")
    score = F.regexp_extract(F.array_join(F.slice(f, 12, 1000), "\t"), r"(?:^|\t)AS:i:(-?\d+)", 1)
    return lines.where(F.size(f) >= 11).select(
        "path", f[0].alias("name"), f[1].cast("int").alias("flag"), f[2].alias("chromosome"), f[3].cast("bigint").alias("start"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"), F.coalesce(score.try_cast("int"), F.lit(0)).alias("score")
    )


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's file systems name it in full."""
    conf, whole = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs.Path(path)
    return whole.getFileSystem(conf).makeQualified(whole).toString()


def read_bam(spark: SparkSession, paths: list[str] | str, wanted: set[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Reads of BAM files, on the wanted references only if given: tasks read ranges of a file's blocks (see sources.bam)."""
    paths = [qualified(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    return read_regions(spark, paths, None if wanted is None else [(name, -1, 1 << 31) for name in sorted(wanted)], split)


def explode_cigar(reads: DataFrame) -> DataFrame:
    """A row for each reference position a read has a base at: position, base letter, quality.

    Operations carry where they begin in the reference and in the read; a match gives one row for each of its bases.
    Clipped bases, insertions and deletions give none.
    """
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), 1)
    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<ref:int,read:int,n:int>>").alias("out"))

    def step(acc, op):
        n, kind = F.regexp_extract(op, r"\d+", 0).cast("int"), F.substring(op, -1, 1)
        match = kind.isin("M", "=", "X")
        here = F.array(F.struct(acc["ref"].alias("ref"), acc["read"].alias("read"), n.alias("n")))
        return F.struct(
            (acc["ref"] + F.when(match | kind.isin("D", "N"), n).otherwise(0)).alias("ref"), (acc["read"] + F.when(match | kind.isin("I", "S"), n).otherwise(0)).alias("read"), F.when(match, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out")
        )

    runs = F.filter(F.aggregate(ops, start, step)["out"], lambda r: r["n"] > 0)
    spots = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda i: F.struct((r["ref"] + i).alias("ref"), (r["read"] + i).alias("read")))))
    rows = reads.withColumn("_s", F.explode(spots))
    at = F.col("_s.read") + 1
    return rows.select(*(c for c in reads.columns if c not in ("seq", "qual", "cigar")), (F.col("start") + F.col("_s.ref")).alias("position"), F.col("seq").substr(at, F.lit(1)).alias("letter"), (F.ascii(F.col("qual").substr(at, F.lit(1))) - 33).alias("quality"))


def plain_path(path: Column) -> Column:
    """A path as Spark reports it, which may be percent-encoded, without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def with_cells(reads: DataFrame, paths: list[str]) -> DataFrame:
    """cell_id: the place of the read's file in the sorted list of files, by whole path; a read of no such file is an error."""
    spark = reads.sparkSession
    files = spark.createDataFrame([(qualified(spark, p), i) for i, p in enumerate(sorted(paths))], "_file string, _cell int")
    files = F.broadcast(files.select(plain_path(F.col("_file")).alias("_file"), "_cell"))  # one row a file
    joined = reads.withColumn("_file", plain_path(F.col("path"))).join(files, "_file", "left")
    missing = F.raise_error(F.concat(F.lit("no cell for file "), F.col("path"))).cast("int")
    return joined.withColumn("cell_id", F.coalesce("_cell", missing)).drop("_file", "_cell")


def cell_name(path: str) -> str:
    """A file's name up to its last '_' or '.'."""
    stem = path.rsplit("/", 1)[-1]
    return re.sub(r"[_.][^_.]*$", "", stem) if "_" not in stem else stem[: stem.rindex("_")]


def observations(reads: DataFrame, min_base_quality: int = 30, min_map_quality: int = 30, min_alignment_score: int = 0) -> DataFrame:
    """obs of reads with cell_id. Read filters come before the reads are exploded. Mates share a name and so an id."""
    good = reads.where((F.col("mapq") >= min_map_quality) & (F.col("score") >= min_alignment_score))
    rows = explode_cigar(good.withColumn("chromosome_id", chromosome_id(F.regexp_replace("chromosome", "^chr", ""))))
    rows = rows.withColumn("base", encode_base(F.col("letter"))).where((F.col("base") < 4) & (F.col("quality") >= min_base_quality) & F.col("chromosome_id").isNotNull())
    return rows.select("chromosome_id", "position", F.xxhash64("cell_id", "name").alias("read_id"), "cell_id", "base")


def build_pileup(reads: DataFrame, min_different: int = 3, max_coverage: int = 100, min_base_quality: int = 30, min_map_quality: int = 30, min_alignment_score: int = 0) -> DataFrame:
    """Observations at informative loci, of reads with cells (see with_cells).

    The exploded reads are checkpointed: loci are counted first, and reads joined with them, of one pass over the files.
    """
    with_checkpoints(reads.sparkSession)
    obs = observations(reads, min_base_quality, min_map_quality, min_alignment_score).checkpoint()
    return keep_loci(obs, pileup_loci(obs, min_different, max_coverage))


def read_alignments(spark: SparkSession, paths: list[str], chromosomes: list[str] | None = None) -> DataFrame:
    """Reads of SAM and BAM files with their cells, on the given chromosomes only if named (with or without 'chr')."""
    wanted = None if chromosomes is None else {p + c for c in chromosomes for p in ("", "chr")}
    bam, sam = [p for p in paths if p.endswith(".bam")], [p for p in paths if not p.endswith(".bam")]
    frames = ([read_bam(spark, bam, wanted)] if bam else []) + ([read_sam(spark, sam)] if sam else [])
    both = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    if wanted is not None:
        both = both.where(F.col("chromosome").isin(*sorted(wanted)))
    return with_cells(both, paths)
