"""Recursive division of cells into clusters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_checkpoints
from . import em, significance, similarity, spectral


@dataclass(frozen=True)
class Settings:
    theta: float = 0.01
    mutation: float = 0.01
    homozygous: float = 0.5
    proportion: int = 4
    normalization: str = "ADD_MIN"
    kind: str = "SPECTRAL6"
    termination: str = "BIC"
    min_cluster_size: int = 100
    expectation_maximization: bool = False
    least_coverage: float = 9.0
    #: Cells of an experiment; the driver holds a few dozen numbers for each.
    max_cells: int = 10_000
    seed: int = 0
    #: Plain k-means with spread starts in the place of the weighted one.
    plain_kmeans: bool = False
    #: Positions of a fragment; what a read has beyond them is another one's. 0: reads are fragments, however long.
    max_fragment: int = 1000

    def __post_init__(self) -> None:
        for name, allowed in (("normalization", ("ADD_MIN", "EXPONENTIATE", "SCALE_MAX_1")), ("kind", ("FIEDLER", "SPECTRAL2", "SPECTRAL6")), ("termination", ("AIC", "BIC"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if not 0 <= self.proportion <= 4:
            raise ValueError("proportion must be 0 to 4")
        if self.max_fragment < 0:
            raise ValueError("max_fragment must be 0 or more")


@dataclass(frozen=True)
class Level:
    """One node of the tree: marker is '' for the root, then a letter for each step down ('A' for the first cluster)."""

    marker: str
    cells: list[int]
    loci: DataFrame  # significant ones
    labels: list[int]  # of the cells, from 0
    clusters: int
    info: dict  # of spectral.cluster_nodes()
    refined: list[float] | None  # probabilities of the second cluster after expectation maximization


def divide(obs: DataFrame, settings: Settings = Settings(), watch: Callable[[Level], None] | None = None) -> DataFrame:
    """(cell_id, cluster_id): 0 for cells of no cluster.

    All nodes of a level are divided together, by the same jobs, so that their number follows the depth of the tree and not
    its nodes. Clusters are numbered depth first: a cluster's parts come before the next cluster. The share of tumour cells
    holds for the root; below it clusters are taken to be of equal size. obs should be persisted. watch is called for each
    node that was looked at, level by level.
    """
    spark, s = with_checkpoints(obs.sparkSession), settings
    all_cells = sorted(r[0] for r in obs.select("cell_id").distinct().limit(s.max_cells + 1).collect())
    if len(all_cells) > s.max_cells:
        raise ValueError(f"more than {s.max_cells} cells")
    longest = similarity.longest_fragment(obs)
    cut = 0 < s.max_fragment <= longest
    tree: dict[str, tuple[list[int], list[int], int, list[str]]] = {}  # marker: cells, their parts, how many, parts to divide
    level = {"": all_cells} if all_cells else {}
    while level:
        markers = list(level)
        frame = spark.createDataFrame([(c, k) for k, m in enumerate(markers) for c in level[m]], "cell_id int, node int")
        own = obs.join(F.broadcast(frame), "cell_id")  # at most max_cells ids
        loci = significance.significant_loci(own, s.theta, s.proportion if "" in level else 4, by=["node"]).checkpoint()
        coverage = {r[0]: r[1] for r in loci.groupBy("node").agg(F.avg("coverage")).collect()}
        members = {k: level[m] for k, m in enumerate(markers) if coverage.get(k, 0.0) >= s.least_coverage}
        kept = significance.keep_loci(own.where(F.col("node").isin(list(members))), loci, ["node"]).checkpoint() if members else None
        found = {}
        if members:
            fragments, span = (similarity.cut_fragments(kept, s.max_fragment, "node"), s.max_fragment - 1) if cut else (kept, longest)
            scores = similarity.pair_scores(similarity.cell_pairs(fragments, span, "node"), s.mutation, s.homozygous, s.theta).checkpoint()
            found = spectral.cluster_nodes(scores, members, s.normalization, s.kind, s.termination, s.seed, s.plain_kmeans)
        soft = _refined(kept, members, found, s) if s.expectation_maximization else {}
        below: dict[str, list[int]] = {}
        for k, cells in members.items():
            labels, parts, info = found[k]
            marker, refined = markers[k], None
            own_parts = [int(x) for x in labels]
            if k in soft:
                refined = [soft[k][c] for c in cells]
                own_parts = [round(p) if abs(p - round(p)) <= 0.05 else -1 for p in refined]
            if parts > 1:
                names = [marker + chr(ord("A") + x) for x in range(parts)]
                split = {n: [c for c, y in zip(cells, own_parts) if y == x] for x, n in enumerate(names)}
                large = [n for n in names if len(split[n]) >= s.min_cluster_size and len(cells) - len(split[n]) >= s.min_cluster_size]
                below |= {n: split[n] for n in large}
                tree[marker] = (cells, own_parts, parts, large)
            if watch:
                watch(Level(marker, cells, loci.where(F.col("node") == k).drop("node"), [int(x) for x in labels], parts, info, refined))
        level = below
    labels, next_id, work = dict.fromkeys(all_cells, 0), 1, [""]
    while work:
        marker = work.pop()
        if marker in tree:
            cells, parts, k, large = tree[marker]
            labels.update({c: next_id + x if x >= 0 else 0 for c, x in zip(cells, parts)})
            next_id += k
            work += large[::-1]
    return spark.createDataFrame(sorted(labels.items()), "cell_id int, cluster_id int")


def _refined(kept: DataFrame | None, members: dict[int, list[int]], found: dict, s: Settings) -> dict[int, dict[int, float]]:
    """Probabilities of the second cluster after expectation maximization, for the nodes that were divided in two."""
    two = [k for k in members if found[k][1] == 2]
    if not two:
        return {}
    start = kept.sparkSession.createDataFrame([(k, c, float(x)) for k in two for c, x in zip(members[k], found[k][0])], "node int, cell_id int, p double")
    out: dict[int, dict[int, float]] = {k: {} for k in two}
    for r in em.refine(kept.where(F.col("node").isin(two)), start, s.theta, by=["node"]).collect():  # a row a cell
        out[r["node"]][r["cell_id"]] = r["p"]
    return out
