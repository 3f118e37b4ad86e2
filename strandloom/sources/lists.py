"""Small tables: positions, groups of cells, clusterings, truths and dense matrices."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import chromosome_id
from .files import put


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome_id, position) of a VCF or other tab-separated list; rows of no known chromosome are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 2))
    rows = rows.select(chromosome_id(F.regexp_replace(F.trim(f[0]), "^chr", "")).alias("chromosome_id"), f[1].try_cast("bigint").alias("position"))
    return rows.where("chromosome_id IS NOT NULL AND position IS NOT NULL").distinct()


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    values = spark.read.option("wholetext", True).text(path)
    return values.select(F.posexplode(F.transform(F.filter(F.split("value", "[,\\s]+"), lambda x: x != ""), lambda x: x.cast("int"))).alias("cell_id", name))


def cell_grouping(spark: SparkSession, merge_count: int = 1, merge_file: str | None = None, max_cells: int = 10_000) -> DataFrame:
    """(cell_id, group_id): of a file with a group for each cell, or every merge_count cells."""
    if merge_file:
        return _numbered(spark, merge_file, "group_id")
    return spark.range(max_cells).selectExpr("cast(id AS int) AS cell_id", f"cast(id div {int(merge_count)} AS int) AS group_id")


def read_clustering(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, cluster_id) of comma-separated numbers, one for each cell."""
    return _numbered(spark, path, "cluster_id")


def write_clustering(labels: DataFrame, path: str) -> None:
    """Comma-separated cluster ids by cell; cells without label are 0."""
    rows = {r["cell_id"]: r["cluster_id"] for r in labels.collect()}  # a few thousand cells
    put(path, ",".join(str(rows.get(c, 0)) for c in range(max(rows, default=-1) + 1)))


def spread_groups(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Labels of groups as labels of their cells."""
    return groups.join(labels.withColumnRenamed("cell_id", "group_id"), "group_id").select("cell_id", "cluster_id")


def read_matrix(path: str, sep: str | None = ",") -> np.ndarray:
    with open(path) as f:
        rows = [[float(x) for x in line.strip().split(sep) if x.strip()] for line in f if line.strip()]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows of different length")
    return np.array(rows)


def write_matrix(matrix: np.ndarray, path: str) -> None:
    put(path, "".join(",".join(repr(float(x)) for x in row) + "\n" for row in np.atleast_2d(matrix)))


def write_positions(loci: DataFrame, path: str) -> None:
    """chromosome and position, tab-separated, in order."""
    from ..functions.codecs import chromosome_name

    rows = loci.repartitionByRange("chromosome_id", "position").sortWithinPartitions("chromosome_id", "position")
    rows.select(F.concat_ws("\t", chromosome_name(F.col("chromosome_id")), "position").alias("value")).write.text(path)


def read_truth(spark: SparkSession, path: str, names: str) -> DataFrame:
    """A tab-separated truth table, e.g. names='cell string, clone string'."""
    return spark.read.schema(names).option("sep", "\t").option("comment", "#").csv(path)


#: Fixed value: stands in a level's list of labels for cells that aren't in it.
OUTSIDE = 16383


def write_level(level, folder: str, all_matrices: bool = False) -> None:
    """What a node of the tree of clusters was divided by, in files named after its marker.

    Significant positions (a folder of text), eigenvalues (the first 20), with all_matrices raw eigenvectors, normalised
    eigenvectors, centroids where there are any, and comma-separated labels by cell before and after refinement.
    """
    name = lambda what, ends="": os.path.join(folder, f"{what}{level.marker}{ends}")
    write_positions(level.loci, name("significant_positions"))
    write_matrix(level.info["eigenvalues"][:20], name("sim_mat_eigenvalues", ".csv"))
    if all_matrices:
        write_matrix(level.info["eigenvectors"], name("sim_mat_eigenvectors", ".csv"))
    for key, what in (("vectors", "sim_mat_eigenvectors_norm"), ("centroids", "centroids")):
        if key in level.info:
            write_matrix(level.info[key], name(what, ".csv"))
    for what, values in (("spectral_clustering", level.labels), ("expectation_maximization", level.refined)):
        if values is not None:
            own = dict(zip(level.cells, values))
            put(name(what), ",".join(str(own.get(c, OUTSIDE)) for c in range(max(level.cells) + 1)))


def group_labels(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Labels of cells as labels of their groups: that of a group's first cell."""
    first = groups.join(labels, "cell_id").groupBy("group_id").agg(F.min_by("cluster_id", "cell_id").alias("cluster_id"))
    return first.select(F.col("group_id").alias("cell_id"), "cluster_id")
