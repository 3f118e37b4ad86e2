"""Pileup files: text and binary, read to and written from observations."""

from __future__ import annotations

import re
import struct
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import CHROMOSOMES, chromosome_id, decode_base, encode_base
from ..operators.numbering import dense_numbers
from ..operators.significance import LOCUS, cap_coverage
from .files import write_files

OBS = "chromosome_id int, position bigint, read_id bigint, cell_id int, base int"
TEXT = "chromosome string, position bigint, coverage int, bases string, cell_ids string, read_ids string"


def file_names(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The path in full, and all files below it (or itself) in any of Spark's file systems; hidden ones (_x, .x) and maps (x.map) are left out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found, names, root = system.listFiles(where, True), [], system.makeQualified(where).toString()
    while found.hasNext():
        names.append(found.next().getPath().toString())
    return root, sorted(n for n in names if not any(part[0] in "_." or part.endswith(".map") for part in n[len(root) :].split("/") if part))


def discover(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """What pileups there are below a path: ('bin', files), ('txt', files) or ('parquet', folders); the first kind that is."""
    root, names = file_names(spark, path)
    for kind, ends in (("bin", (".bin",)), ("txt", (".pileup", ".txt")), ("parquet", (".parquet",))):
        if some := [n for n in names if n.endswith(ends)]:
            return kind, some if kind != "parquet" else sorted({re.split(r"/(?:[^/=]+=[^/]*/)*[^/]+$", n)[0] for n in some})
    return "txt", names if names == [root] else []


def chromosome_of_path(column=None):
    """From a folder chromosome_id=6, or a name like prefix_7.pileup.bin: what stands between the only '_' and the first '.'."""
    path = column if column is not None else F.col("_metadata.file_path")
    folder = F.nullif(F.regexp_extract(path, r"/chromosome_id=(\d+)/[^/]*$", 1), F.lit("")).cast("int")
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(folder, chromosome_id(F.nullif(F.regexp_extract(name, r"^[^_.]+_([^_.]+)\.", 1), F.lit(""))))


def chromosome_in_path(path: str) -> int | None:
    """As chromosome_of_path(), of a path at hand."""
    if m := re.search(r"/chromosome_id=(\d+)/[^/]*$", path):
        return int(m[1])
    m = re.match(r"[^_.]+_([^_.]+)\.", path.rsplit("/", 1)[-1])
    return CHROMOSOMES.index(m[1].upper()) if m and m[1].upper() in CHROMOSOMES else None


def _or_error(chromosome, path):
    return F.coalesce(chromosome, F.raise_error(F.concat(F.lit("nothing tells the chromosome of "), path)).cast("int"))


def read_text(spark: SparkSession, paths: list[str] | str, chromosome_from: str = "column") -> DataFrame:
    """Observations of text pileups. The read's key is its name and cell, so read_id is a hash of both.

    chromosome_from: 'column', 'file' (folder or name), or 'auto': the file, or else the column. It is an error if that names
    no chromosome. Bases other than A, C, G, T are dropped.
    """
    rows = spark.read.schema(TEXT).option("sep", "\t").option("quote", "").csv(paths)
    file, column = chromosome_of_path(), chromosome_id(F.regexp_replace(F.trim("chromosome"), "^chr", ""))
    own = _or_error({"file": file, "column": column, "auto": F.coalesce(file, column)}[chromosome_from], F.col("_metadata.file_path"))
    split = lambda c: F.transform(F.split(F.col(c), ","), lambda x: F.trim(x))
    bases = F.split(F.col("bases"), "")
    rows = rows.select(own.alias("chromosome_id"), "position", F.filter(bases, lambda b: b != "").alias("b"), split("cell_ids").alias("c"), split("read_ids").alias("r"))
    rows = rows.select("chromosome_id", "position", F.explode(F.arrays_zip("b", "c", "r")).alias("z"))
    cell, name, base = F.col("z.c").cast("int"), F.col("z.r"), F.col("z.b")
    out = rows.select("chromosome_id", "position", F.xxhash64(cell, name).alias("read_id"), cell.alias("cell_id"), encode_base(base).alias("base"), name.alias("read_name"))
    return out.where("base < 4")


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, read, packed cell and base) of all observations of a binary pileup."""
    at, positions, reads, packed = 0, [], [], []
    while at < len(data):
        position, n = struct.unpack_from("<IH", data, at)
        at += 6
        reads.append(np.frombuffer(data, "<u4", n, at))
        packed.append(np.frombuffer(data, "<u2", n, at + 4 * n))
        positions.append(np.full(n, position, np.int64))
        at += 6 * n
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(positions), join(reads).astype(np.int64), join(packed).astype(np.int32)


def encode(loci) -> bytes:
    """A binary pileup of (position, [(read, cell, base), ...]) in order."""
    out = []
    for position, rows in loci:
        n = len(rows)
        out.append(struct.pack("<IH", position, n))
        out.append(np.array([r for r, _, _ in rows], "<u4").tobytes())
        out.append(np.array([c << 2 | b for _, c, b in rows], "<u2").tobytes())
    return b"".join(out)


def read_binary(spark: SparkSession, paths: list[str] | str, chromosome: int | None = None) -> DataFrame:
    """Observations of binary pileups, a task for each few files; the chromosome is given, or the file tells it, or it is an error."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                position, read, packed = decode(batch.column(1)[i].as_py())
                own = np.full(len(position), batch.column(0)[i].as_py(), np.int32)
                for lo in range(0, len(position), 100_000):
                    s = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[s], position[s], read[s], (packed[s] >> 2).astype(np.int32), (packed[s] & 3).astype(np.int32))], ["chromosome_id", "position", "read_id", "cell_id", "base"])

    files = spark.read.format("binaryFile").load(paths)
    own = F.lit(chromosome) if chromosome is not None else _or_error(chromosome_of_path(F.col("path")), F.col("path"))
    return files.select(own.cast("int").alias("chromosome_id"), "content").mapInArrow(run, OBS)


#: Buckets of a Parquet pileup, where nothing else is asked for: the session's shuffle partitions.
LAYOUT = "_layout"


def write_parquet(obs: DataFrame, path: str, buckets: int | None = None) -> None:
    """A pileup in Parquet: a folder for each chromosome, loci dealt to sorted buckets, so that what is grouped or joined by
    locus later needs no shuffle. The number of buckets is noted in the folder, as Parquet files don't tell it.
    """
    spark = obs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"strandloom_pileup_{uuid.uuid4().hex}"
    rows = obs.select("chromosome_id", "position", "read_id", "cell_id", "base", F.col("chromosome_id").alias("chromosome"))
    dealt = rows.repartition(buckets, *LOCUS).write.partitionBy("chromosome").bucketBy(buckets, *LOCUS).sortBy(*LOCUS)
    dealt.format("parquet").option("path", path).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/{LAYOUT}")


def read_parquet(spark: SparkSession, path: str, chromosomes: list[int] | None = None) -> DataFrame:
    """Observations of a Parquet pileup, of which only the chromosomes' folders are read; of other Parquet files by their columns."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LAYOUT}")
    own = [tuple(c.split()) for c in OBS.split(", ")]
    if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        buckets = spark.read.schema("buckets int").json(f"{path}/{LAYOUT}").first()[0]
        table, keys, place = f"strandloom_pileup_{uuid.uuid4().hex}", ", ".join(LOCUS), path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({OBS}, chromosome int) USING parquet PARTITIONED BY (chromosome) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'")
        spark.catalog.recoverPartitions(table)
        rows = spark.table(table)
        return (rows if chromosomes is None else rows.where(F.col("chromosome").isin(chromosomes))).select(*(name for name, _ in own))
    rows = spark.read.parquet(path).select(*(F.col(name).cast(kind) for name, kind in own))
    return rows if chromosomes is None else rows.where(F.col("chromosome_id").isin(chromosomes))


def read_pileup(
    spark: SparkSession, path: str, max_coverage: int = 100, positions: DataFrame | None = None, groups: DataFrame | None = None, chromosome_from: str = "auto", chromosomes: list[str] | None = None
) -> DataFrame:
    """Observations of a file or folder in any of the formats: capped, at listed positions, of grouped cells.

    Files and folders of other chromosomes than those asked for are not opened; it is an error if there is nothing of any of
    those, and if nothing tells the chromosome of a file.
    """
    from ..operators.significance import keep_positions

    kind, files = discover(spark, path)
    wanted = None if chromosomes is None else [CHROMOSOMES.index(c) for c in chromosomes]
    if wanted is not None and kind != "parquet" and chromosome_from != "column":
        there = {f: chromosome_in_path(f) for f in files}
        files = [f for f, c in there.items() if c is None or c in wanted]
        if there and not files:
            raise ValueError(f"no pileup of chromosomes {', '.join(chromosomes)} in {path}")
    if not files:
        return spark.createDataFrame([], OBS)
    if kind == "parquet":
        obs = reduce(DataFrame.unionAll, [read_parquet(spark, f, wanted) for f in files])
    else:
        obs = read_binary(spark, files) if kind == "bin" else read_text(spark, files, chromosome_from).drop("read_name")
        if wanted is not None:
            obs = obs.where(F.col("chromosome_id").isin(wanted))
    obs = cap_coverage(obs, max_coverage)
    if positions is not None:
        obs = keep_positions(obs, positions)
    return obs if groups is None else regroup(obs, groups)


def regroup(obs: DataFrame, groups: DataFrame) -> DataFrame:
    """Observations of groups (cell_id, group_id) in the place of cells; unlisted cells are an error."""
    joined = obs.join(groups, "cell_id", "left")
    checked = F.coalesce("group_id", F.raise_error(F.concat(F.lit("no group for cell "), F.col("cell_id").cast("string"))).cast("int"))
    return joined.select("chromosome_id", "position", "read_id", checked.alias("cell_id"), "base")


def statistics(obs: DataFrame) -> DataFrame:
    """One row: distinct cells, largest cell id + 1, and the longest fragment."""
    length = obs.groupBy("chromosome_id", "read_id").agg((F.max("position") - F.min("position")).alias("n"))
    return obs.agg(F.count_distinct("cell_id").alias("cells"), (F.max("cell_id") + 1).alias("cell_count")).crossJoin(length.agg(F.max("n").alias("max_fragment")))


def text_rows(obs: DataFrame) -> DataFrame:
    """One row for each locus, observations in order of cell, read and base."""
    rows = F.array_sort(F.collect_list(F.struct("cell_id", "read_id", "base")))
    loci = obs.groupBy(*LOCUS).agg(F.count(F.lit(1)).alias("coverage"), rows.alias("o"))
    of = lambda f: F.transform("o", f)
    return loci.select(
        *LOCUS, "coverage", F.array_join(of(lambda x: decode_base(x["base"])), "").alias("bases"), F.array_join(of(lambda x: x["cell_id"].cast("string")), ",").alias("cell_ids"), F.array_join(of(lambda x: x["read_id"].cast("string")), ",").alias("read_ids")
    )


def write_text(obs: DataFrame, path: str) -> None:
    """Text pileups, a folder for each chromosome, loci in order, written range by range."""
    from ..functions.codecs import chromosome_name

    rows = text_rows(obs).withColumn("name", chromosome_name(F.col("chromosome_id")))
    rows = rows.repartitionByRange("chromosome_id", "position").sortWithinPartitions("chromosome_id", "position")
    line = F.concat_ws("\t", "name", "position", "coverage", "bases", "cell_ids", "read_ids")
    rows.select("chromosome_id", line.alias("value")).write.partitionBy("chromosome_id").text(path)


def read_numbers(obs: DataFrame) -> DataFrame:
    """(chromosome_id, cell_id, read_id, number): reads numbered from 0 within each chromosome; equal ids of one cell are one read."""
    numbers = dense_numbers(obs, ["chromosome_id", "cell_id", "read_id"], "number")
    first = numbers.groupBy("chromosome_id").agg(F.min("number").alias("_first"))  # 24 rows
    return numbers.join(F.broadcast(first), "chromosome_id").withColumn("number", F.col("number") - F.col("_first")).drop("_first")


def numbered_reads(obs: DataFrame) -> DataFrame:
    """obs with the reads' numbers as their ids."""
    numbered = obs.join(read_numbers(obs), ["chromosome_id", "cell_id", "read_id"])
    return numbered.select("chromosome_id", "position", F.col("number").alias("read_id"), "cell_id", "base")


def read_dictionary(reads: DataFrame, obs: DataFrame, numbered: bool) -> DataFrame:
    """(name, read_id) of reads (cell_id, name) that have observations: their keys in obs, or with `numbered` those of a
    binary pileup, which count from 0 within each chromosome (chromosome_id comes third)."""
    names = reads.select("cell_id", "name", F.xxhash64("cell_id", "name").alias("read_id")).distinct()
    if not numbered:
        return names.join(obs.select("cell_id", "read_id").distinct(), ["cell_id", "read_id"], "left_semi").select("name", "read_id")
    return names.join(read_numbers(obs), ["cell_id", "read_id"]).select("name", F.col("number").alias("read_id"), "chromosome_id")


def write_binary(obs: DataFrame, path: str) -> list[str]:
    """Binary pileups chromosome_<name>.pileup.bin, loci in order; returns the files.

    Loci are encoded and written range by range, and the parts of a chromosome put together at the end (see sources.files).
    Reads are numbered anew, as the format has 32 bits for them; more reads, 65,536 observations at a locus or cell ids from
    16,384 are errors.
    """
    rows = F.array_sort(F.collect_list(F.struct("cell_id", "read_id", "base"))).alias("o")
    loci = numbered_reads(obs).groupBy(*LOCUS).agg(rows).select(F.coalesce("chromosome_id", F.lit(0)).alias("chromosome_id"), "position", F.col("o.read_id").alias("r"), F.col("o.cell_id").alias("c"), F.col("o.base").alias("b"))

    def run(batches):
        for batch in batches:
            files, data = [], []
            for chromosome, position, reads, cells, bases in zip(*(c.to_pylist() for c in batch.columns)):
                if max(cells) >= 1 << 14 or max(reads) >= 1 << 32 or len(cells) >= 1 << 16:
                    raise ValueError("too many cells, reads or observations for a binary pileup")
                files.append(f"chromosome_{CHROMOSOMES[chromosome]}.pileup.bin")
                data.append(encode([(position, list(zip(reads, cells, bases)))]))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(data, pa.binary())], ["file", "data"])

    dealt = loci.repartitionByRange(*LOCUS).sortWithinPartitions(*LOCUS)
    write_files(dealt.mapInArrow(run, "file string, data binary"), path)
    return [n for n in file_names(obs.sparkSession, path)[1] if n.endswith(".pileup.bin")]


def convert_text(spark: SparkSession, paths: list[str] | str, path: str) -> list[str]:
    """Text pileups as binary ones in a folder; cells keep their ids."""
    return write_binary(read_text(spark, paths, "auto").drop("read_name"), path)


def read_names(reads: DataFrame, name: str, order: str) -> DataFrame:
    """(name, read_id): distinct names numbered from 0 in order; equal places in the order share a number."""
    distinct = reads.select(F.col(name).alias("name"), F.col(order).alias("_o")).distinct()
    return distinct.join(dense_numbers(distinct, ["_o"], "read_id"), "_o").select("name", "read_id")


def write_read_names(names: DataFrame, path: str) -> None:
    """name and number (and what other columns there are), tab-separated, by number."""
    rest = [F.col(c).cast("string") for c in names.columns if c not in ("name", "read_id")]
    names.repartitionByRange("read_id").sortWithinPartitions("read_id").select(F.concat_ws("\t", "name", F.col("read_id").cast("string"), *rest).alias("value")).write.text(path)
