"""Variant files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import chromosome_name
from ..operators.significance import COUNTS, LOCUS
from .files import write_files


def preamble(reference: str, cluster: int) -> list[str]:
    head = ["##fileformat=VCFv4.2", f"##fileDate={time.ctime()}", "##source=strandloom", f"##reference={reference}", f"##cluster={cluster}"]
    return [*head, f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tcluster-{cluster}"]


def format_lines(lines: DataFrame) -> DataFrame:
    """value: the text of each line; counts of the four bases stand last."""
    counts = F.concat(*(x for c in COUNTS for x in (F.col(c).cast("string"), F.lit(" "))))
    text = F.concat_ws("\t", chromosome_name(F.col("chromosome_id")), F.col("position").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), "gt", counts)
    return lines.withColumn("value", text)


def write_clusters(lines: DataFrame, common: DataFrame, folder: str, reference: str, clusters: list[int]) -> None:
    """cluster_<id>.vcf for each cluster, and common.vcf, which has no preamble: one job, lines in order.

    The files of clusters without lines have the preamble alone.
    """
    own = format_lines(lines).select(F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"), F.lit(".vcf")).alias("file"), *LOCUS, "ref", "alt", "value")
    rows = own.unionAll(format_lines(common).select(F.lit("common.vcf"), *LOCUS, "ref", "alt", "value"))
    keys = ["file", *LOCUS, "ref", "alt", "value"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("file", F.encode(F.concat("value", F.lit("\n")), "UTF-8").alias("data"))
    heads = {f"cluster_{c}.vcf": "".join(x + "\n" for x in preamble(reference, c)) for c in clusters}
    write_files(dealt, folder, heads | {"common.vcf": ""})


def ordered(lines: DataFrame, ties: list[str]) -> DataFrame:
    """Lines in the order 1 to 22, X, Y, numbered: line.

    The number of a line is that of its chromosome's first plus its own, so each chromosome is ordered by itself.
    """
    sizes = lines.groupBy("chromosome_id").agg(F.count(F.lit(1)).alias("_n"))  # 24 rows
    before = sizes.select("chromosome_id", (F.sum("_n").over(Window.orderBy("chromosome_id")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("chromosome_id").orderBy("position", *ties))
    return lines.join(F.broadcast(before), "chromosome_id").withColumn("line", (own + F.col("_before")).cast("bigint")).drop("_before")
