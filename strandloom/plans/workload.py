"""Observations derived from lineitem: a base of a read of a cell at a locus, with planted clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLONE = "cell_id % 10 < 3"


def observations(spark: SparkSession, sf_dir: str, deep: bool = False) -> DataFrame:
    """obs(chromosome_id, position, read_id, cell_id, base). deep: five times fewer loci, five times the coverage."""
    p = "(l_partkey div 5)" if deep else "l_partkey"
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"{p} AS position", "l_orderkey % 1000 AS read_id", "l_suppkey", "l_quantity")
    rows = items.selectExpr("cast(position % 24 AS int) AS chromosome_id", "position", "read_id", "cast(read_id % 40 AS int) AS cell_id", "cast(position % 4 AS int) AS g", "(position div 4) % 5 AS class", "l_suppkey", "l_quantity")
    base = """CASE WHEN l_quantity <= 1 THEN (g + 2) % 4 WHEN class = 0 AND l_suppkey % 2 = 0 THEN (g + 1) % 4
      WHEN class IN (1, 2) AND cell_id % 10 < 3 THEN (g + 1) % 4 ELSE g END"""
    return rows.selectExpr("chromosome_id", "position", "read_id", "cell_id", f"cast({base} AS int) AS base")


def reference(obs: DataFrame) -> DataFrame:
    """The loci's reference genotypes: homozygous g, or g and g + 1 in class 0; g + 2 at every seventh other locus."""
    g, h = F.col("position") % 4, (F.col("position") + 1) % 4
    two = F.expr("(position div 4) % 5") == 0
    g = F.when(~two & (F.col("position") % 7 == 0), (g + 2) % 4).otherwise(g)
    code = F.shiftleft(g.cast("int"), 3).bitwiseOR(F.when(two, h).otherwise(g).cast("int"))
    return obs.select("chromosome_id", "position").distinct().withColumn("reference", code)


def clones(obs: DataFrame) -> DataFrame:
    """(cell_id, cluster_id): the planted clones, 1 and 2."""
    return obs.select("cell_id").distinct().selectExpr("cell_id", f"CASE WHEN {CLONE} THEN 2 ELSE 1 END AS cluster_id")


def cells(obs: DataFrame) -> DataFrame:
    return obs.select("cell_id").distinct()


#: The same observations in DuckDB's SQL.
SQL = """obs AS (
  SELECT chromosome_id, position, read_id, cell_id,
    (CASE WHEN l_quantity <= 1 THEN (g + 2) % 4 WHEN class = 0 AND l_suppkey % 2 = 0 THEN (g + 1) % 4
      WHEN class IN (1, 2) AND cell_id % 10 < 3 THEN (g + 1) % 4 ELSE g END)::INTEGER AS base
  FROM (SELECT (p % 24)::INTEGER AS chromosome_id, p AS position, l_orderkey % 1000 AS read_id, ((l_orderkey % 1000) % 40)::INTEGER AS cell_id,
      p % 4 AS g, (p // 4) % 5 AS class, l_suppkey, l_quantity
    FROM (SELECT {p} AS p, l_orderkey, l_suppkey, l_quantity FROM lineitem)))"""


def sql(deep: bool = False) -> str:
    return SQL.replace("{p}", "l_partkey // 5" if deep else "l_partkey")


#: CIGARs of made reads of 8 bases, and the (place in the reference, place in the read) of their matches.
CIGARS = {
    "8M": [(i, i) for i in range(8)],
    "2S3M1I2M": [(0, 2), (1, 3), (2, 4), (3, 6), (4, 7)],
    "3M2D5M": [(0, 0), (1, 1), (2, 2), (5, 3), (6, 4), (7, 5), (8, 6), (9, 7)],
    "1H1M1N2=5S": [(0, 0), (2, 1), (3, 2)],
}


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned reads of a few shapes, a row of lineitem each, with qualities and scores on either side of the filters."""
    made = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "concat('r', l_orderkey % 1000) AS name", "99 AS flag", "concat('chr', l_partkey % 22 + 1) AS chromosome", "l_partkey AS start", "cast(25 + l_orderkey % 10 AS int) AS mapq", "cast(l_linenumber % 4 AS int) AS pattern",
        "substr('ACGTNACGTNACGT', cast(l_partkey % 5 + 1 AS int), 8) AS seq", "repeat(chr(58 + l_suppkey % 10), 8) AS qual", "cast(l_orderkey % 7 - 3 AS int) AS score", "cast(l_orderkey % 40 AS int) AS cell_id",
    )
    return made.withColumn("cigar", F.array(*map(F.lit, CIGARS))[F.col("pattern")]).drop("pattern")


#: What the reads give after the filters of quality, in SQL.
READS_SQL = f"""SELECT (l_partkey % 22)::INTEGER AS chromosome_id, l_partkey + ref AS position, (l_orderkey % 40)::INTEGER AS cell_id,
    (strpos('ACGT', substr('ACGTNACGTNACGT', (l_partkey % 5 + 1 + spot)::INTEGER, 1)) - 1)::INTEGER AS base
  FROM lineitem JOIN (VALUES {", ".join(f"({k}, {ref}, {at})" for k, spots in enumerate(CIGARS.values()) for ref, at in spots)}) v(pattern, ref, spot) ON l_linenumber % 4 = pattern
  WHERE 25 + l_orderkey % 10 >= 30 AND 25 + l_suppkey % 10 >= 30 AND l_orderkey % 7 - 3 >= 0 AND substr('ACGTNACGTNACGT', (l_partkey % 5 + 1 + spot)::INTEGER, 1) <> 'N'"""


def indels(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contigs, events): a contig for each chromosome, an insertion or deletion at every 13th place that has reads."""
    contigs = obs.groupBy(F.col("chromosome_id").cast("string").alias("contig")).agg((F.max("position") + 10).alias("_n"))
    places = obs.where("position % 13 = 0").select("chromosome_id", "position").distinct()
    events = places.selectExpr("cast(chromosome_id AS string) AS contig", "position AS nr", "position AS start_pos", "position % 5 + 1 AS len", "CASE WHEN position % 2 = 0 THEN 'I' ELSE 'D' END AS tr")
    return contigs, events


#: Segments of those contigs, in SQL.
SEGMENTS_SQL = """, events AS (SELECT chromosome_id::VARCHAR AS contig, position AS s, CASE WHEN position % 2 = 0 THEN position % 5 + 1 ELSE 0 END AS ins, CASE WHEN position % 2 = 1 THEN position % 5 + 1 ELSE 0 END AS del
    FROM (SELECT DISTINCT chromosome_id, position FROM obs WHERE position % 13 = 0)),
  sums AS (SELECT *, sum(ins) OVER w AS si, sum(del) OVER w AS sd FROM events WINDOW w AS (PARTITION BY contig ORDER BY s)),
  copied AS (SELECT *, greatest(0, max(s - si + ins) OVER (PARTITION BY contig ORDER BY s)) AS c FROM sums),
  marks AS (SELECT contig, s, c + sd AS b, c + si AS host, c + sd - del AS o FROM copied UNION ALL SELECT DISTINCT chromosome_id::VARCHAR, -1, 0, 0, 0 FROM obs),
  lengths AS (SELECT chromosome_id::VARCHAR AS contig, max(position) + 10 AS n FROM obs GROUP BY ALL),
  segments AS (SELECT contig, b, coalesce(lead(o) OVER (PARTITION BY contig ORDER BY s), b + greatest(0, n - host)) AS e, host FROM marks JOIN lengths USING (contig))"""


def genome_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A genome in FASTA: a contig for each chromosome, a letter for each row of lineitem, a line for each order.

    The folder's files, in order of their names, are one genome: contigs go on from one file to the next.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("cast(l_partkey % 24 AS int) AS c", "l_orderkey AS o", "struct(l_linenumber, l_partkey, substr('ACGT', cast(l_suppkey % 4 + 1 AS int), 1) AS letter) AS x")
    lines = items.groupBy("c", "o").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["letter"]), "").alias("value"))
    heads = lines.select("c", F.lit(-1).cast("bigint").alias("o"), F.expr("concat('>chr', CASE c WHEN 22 THEN 'X' WHEN 23 THEN 'Y' ELSE cast(c + 1 AS string) END, ' made of lineitem')")).distinct()
    lines.unionAll(heads).repartitionByRange("c", "o").sortWithinPartitions("c", "o").select("value").write.text(path)


#: The letters of that genome as the loci's genotypes, in SQL.
GENOME_SQL = """, genome AS (SELECT (l_partkey % 24)::INTEGER AS chromosome_id, row_number() OVER (PARTITION BY l_partkey % 24 ORDER BY l_orderkey, l_linenumber, l_partkey) AS position, (l_suppkey % 4)::INTEGER AS g FROM lineitem)
  SELECT chromosome_id, position, (g * 9)::INTEGER AS reference FROM genome SEMI JOIN obs USING (chromosome_id, position)"""
