"""Similarity of cells: how often reads of two cells agree where they overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_checkpoints
from .significance import LOCUS

PAIR = ["chromosome_id", "read_a", "read_b"]
#: Positions of a window at least; coverage is capped, so that this bounds its rows. Pairs that are counted at once.
WIDTH, MOST_PAIRS = 100_000, 2_000_000
#: Where fragments are long, positions that a task goes through; observations that it counts at once; pairs that it holds.
STRETCH, MOST_ROWS, MOST_HELD = 4_000_000, 20_000, 1_000_000


def drop_mate_conflicts(obs: DataFrame) -> DataFrame:
    """One observation of each read and locus; those whose mates disagree go."""
    grouped = obs.groupBy(*LOCUS, "read_id", "cell_id").agg(F.min("base").alias("base"), F.max("base").alias("_other"))
    return grouped.where("base = _other").drop("_other")


def longest_fragment(obs: DataFrame) -> int:
    """Positions between the first and the last observation of a read, at most."""
    spans = obs.groupBy("chromosome_id", "read_id").agg((F.max("position") - F.min("position")).alias("n"))
    return int(spans.agg(F.max("n")).first()[0] or 0)


def cut_fragments(obs: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """obs with a new read every `most` positions from a read's first one on; what is shorter keeps its id.

    Scores take the loci that two reads share to be of one molecule each, in phase: that holds for fragments as they are
    sequenced, and not for what bears one id along a chromosome. by: a column whose values are looked at apart.
    """
    read = Window.partitionBy(*([by] if by else []), "chromosome_id", "read_id", "cell_id")
    part = F.floor((F.col("position") - F.min("position").over(read)) / most)
    return obs.withColumn("read_id", F.when(part > 0, F.xxhash64("read_id", part)).otherwise(F.col("read_id")))


def _windows(obs: DataFrame, longest: int | None) -> tuple[DataFrame, int]:
    """obs with _window, and the windows' width.

    A window has the observations from its longest fragment before its start to as far behind its end, so that all loci two
    reads share are in the window of the first one of them, which owns the pair. Chromosomes that are no wider than a window
    are one each, whatever the fragments are.
    """
    if longest is None:
        edges = obs.groupBy("chromosome_id").agg(F.min("position").alias("a"), F.max("position").alias("b")).agg(F.min("a"), F.max("b")).first()
        if edges[0] is None or edges[1] // WIDTH == edges[0] // WIDTH:
            return obs.withColumn("_window", F.floor(F.col("position") / WIDTH)), WIDTH
        longest = longest_fragment(obs)
    width = max(WIDTH, 4 * longest)
    at = F.sequence(F.floor((F.col("position") - longest) / width), F.floor((F.col("position") + longest) / width))
    return obs.withColumn("_window", F.explode(at)), width


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, number = np.unique(values, return_inverse=True)
    return distinct, number.astype(np.int64)


def pairs_of_loci(position: np.ndarray, read: np.ndarray, cell: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
    """(reads, their cells), and (a, b, x_s, x_d, first common locus) of the pairs of these by number; the read of a is the lesser.

    Loci at which a read's mates disagree don't count for it. Pairs are counted in slices of loci, MOST_PAIRS at a time.
    """
    order = np.lexsort((cell, read, position))
    position, read, cell, base = position[order], read[order], cell[order], base[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(read)), bool), (np.diff(position) != 0) | (np.diff(read) != 0) | (np.diff(cell) != 0)]))
    if len(new):
        agree = np.minimum.reduceat(base, new) == np.maximum.reduceat(base, new)
        new = new[agree]
    position, read, cell, base = position[new], read[new], cell[new], base[new]
    reads, r = _ranks(read)
    cells, c = _ranks(cell)
    m = max(1, len(cells))
    who, own = _ranks(r * m + c)  # a read of a cell
    n = len(who)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(position)), bool), np.diff(position) != 0]))
    sizes = np.diff(np.append(starts, len(position)))
    load = np.cumsum(sizes * (sizes - 1) // 2)
    kept: list[tuple[np.ndarray, ...]] = []
    for lo, hi in _slices(load):
        a, b = starts[lo], starts[hi - 1] + sizes[hi - 1]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, step = np.arange(a, b), 1
        while len(at):
            at = at[at + step < b]
            at = at[position[at + step] == position[at]]
            left.append(at)
            right.append(at + step)
            step += 1
        i, j = np.concatenate(left), np.concatenate(right)
        ok = (r[i] != r[j]) & (c[i] != c[j])
        i, j = i[ok], j[ok]  # in order of reads, as the rows of a locus are
        same = base[i] == base[j]
        kept.append(_summed(own[i] * n + own[j], same.astype(np.int64), (~same).astype(np.int64), position[i]))
        if sum(len(k[0]) for k in kept[1:]) > MOST_PAIRS:
            kept = [_merged(kept)]
    pair, *sums = _merged(kept) if kept else (np.zeros(0, np.int64),) * 4
    return reads[who // m], cells[who % m], pair // max(1, n), pair % max(1, n), *sums


def pairs_of_window(position: np.ndarray, read: np.ndarray, cell: np.ndarray, base: np.ndarray, first: int, end: int) -> tuple[np.ndarray, ...]:
    """(read_a < read_b, cell_a, cell_b, x_s, x_d) of the pairs of reads whose first common locus is from first to before end."""
    counts = PairCounts()
    counts.add(position, read, cell, base)
    return counts.pairs(first, end)


class PairCounts:
    """Counts of pairs of reads, of observations that come in pieces of whole loci. What is held is a row a pair."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, int], int] = {}  # of a read of a cell
        self.parts = [(np.zeros(0, np.int64),) * 4]

    def add(self, position: np.ndarray, read: np.ndarray, cell: np.ndarray, base: np.ndarray) -> None:
        reads, cells, a, b, x_s, x_d, where = pairs_of_loci(position, read, cell, base)
        number = np.array([self.numbers.setdefault(k, len(self.numbers)) for k in zip(reads.tolist(), cells.tolist())], np.int64)
        if len(a):
            self.parts.append((number[a] << 31 | number[b], x_s, x_d, where))
        if sum(len(p[0]) for p in self.parts[1:]) > max(MOST_HELD // 4, len(self.parts[0][0])):
            self.parts = [_merged(self.parts)]

    def held(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def pairs(self, first: int | None = None, end: int | None = None) -> tuple[np.ndarray, ...]:
        """As pairs_of_window(); without first and end of all pairs. Nothing is held any more."""
        pair, x_s, x_d, where = _merged(self.parts)
        if first is not None:
            mine = (where >= first) & (where < end)
            pair, x_s, x_d = pair[mine], x_s[mine], x_d[mine]
        who = np.array(list(self.numbers), np.int64).reshape(-1, 2)
        a, b = pair >> 31, pair & (1 << 31) - 1
        self.__init__()
        return who[a, 0], who[b, 0], who[a, 1], who[b, 1], x_s, x_d


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return _summed(*(np.concatenate(x) for x in zip(*parts)))


def _slices(load: np.ndarray):
    """Ranges of loci with about MOST_PAIRS pairs together, by the running sum of their pairs; a locus is in one of them."""
    lo = 0
    while lo < len(load):
        before = load[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(load, before + MOST_PAIRS, "right")))
        yield lo, hi
        lo = hi


def _summed(pair: np.ndarray, x_s: np.ndarray, x_d: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums by pair, and the first place of each."""
    order = np.argsort(pair, kind="stable")
    pair, x_s, x_d, where = pair[order], x_s[order], x_d[order], where[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), np.diff(pair) != 0]))
    if not len(new):
        return pair, x_s, x_d, where
    return pair[new], np.add.reduceat(x_s, new), np.add.reduceat(x_d, new), np.minimum.reduceat(where, new)


def _dealt(obs: DataFrame, longest: int | None) -> tuple[DataFrame, int, bool]:
    """obs with _window, the windows' width, and whether a pair's loci may lie in several windows.

    Windows with overhang are as wide as fragments ask for, so that fragments beyond a quarter of WIDTH would make them grow
    with the chromosomes. Those are dealt to stretches instead, without overhang, and a pair's counts are summed over them.
    """
    if longest is None:
        ends = obs.groupBy("chromosome_id", "read_id").agg(F.min("position").alias("a"), F.max("position").alias("b"))
        first, last, longest = ends.agg(F.min("a"), F.max("b"), F.max(F.col("b") - F.col("a"))).first()
        if first is None or last // WIDTH == first // WIDTH:
            return obs.withColumn("_window", F.floor(F.col("position") / WIDTH)), WIDTH, False
    if 4 * longest > WIDTH:
        return obs.withColumn("_window", F.floor(F.col("position") / STRETCH)), STRETCH, True
    return *_windows(obs, longest), False


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """(keys, columns) of stretches of rows with equal keys, the first columns."""
    for batch in batches:
        columns = [np.asarray(c).astype(np.int64) for c in batch.columns]
        new = np.any([np.diff(c) != 0 for c in columns[:keys]], axis=0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield tuple(int(c[a]) for c in columns[:keys]), [c[a:b] for c in columns[keys:]]


def _in_windows(obs: DataFrame, longest: int | None, make: Callable, whole: str, by: str | None = None) -> tuple[DataFrame, bool]:
    """Pairs by window, as rows: make(keys, pairs) with the columns `whole`, where each pair lies in one window; rows of pairs
    that are to be summed where not. And whether they are.

    Tasks read a window's observations in order of position and hold a row a pair, but never the window. obs is shuffled once.
    """
    keys = [*([by] if by else []), "chromosome_id", "_window"]
    placed = obs.where("chromosome_id IS NOT NULL AND position IS NOT NULL")
    dealt, width, split = _dealt(placed.select(*keys[:-1], "position", "read_id", "cell_id", "base"), longest)

    def run(batches):
        key, counts, held = None, PairCounts(), []

        def count(end):
            """All loci but the last, which may go on, unless the window ends."""
            nonlocal held
            columns = [np.concatenate(c) for c in zip(*held)]
            at = len(columns[0]) if end else int(np.searchsorted(columns[0], columns[0][-1]))
            if at:
                counts.add(*(c[:at] for c in columns))
            held = [] if end else [[c[at:] for c in columns]]

        def rows():
            pairs = counts.pairs(*(() if split else (key[-1] * width, (key[-1] + 1) * width)))
            table = (pair_rows if split else make)(key, pairs)
            yield from table.to_batches(max_chunksize=100_000)

        for now, columns in _runs(batches, len(keys)):
            if key is not None and now != key:
                count(True)
                yield from rows()
            key = now
            held.append(columns)
            if sum(len(c[0]) for c in held) >= MOST_ROWS:
                count(False)
                if split and counts.held() > MOST_HELD:
                    yield from rows()
        if key is not None:
            count(True)
            yield from rows()

    def pair_rows(key, pairs):
        names = [*keys[:-1], *PAIR[1:], "cell_a", "cell_b", "x_s", "x_d"]
        own = [pa.array(np.full(len(pairs[0]), k, np.int32)) for k in key[:-1]]
        return pa.table([*own, *(pa.array(c.astype(np.int32) if k in (2, 3) else c) for k, c in enumerate(pairs))], names)

    ddl = "".join(f"{k} int, " for k in keys[:-1]) + "read_a bigint, read_b bigint, cell_a int, cell_b int, x_s bigint, x_d bigint" if split else whole
    # A fixed number of partitions: as rows are few beside the pairs made of them, they would be united into few tasks.
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.select(*keys, "position", "read_id", "cell_id", "base").repartition(parts, *keys).sortWithinPartitions(*keys, "position").mapInArrow(run, ddl)
    if split:
        found = found.groupBy(*keys[:-1], *PAIR[1:], "cell_a", "cell_b").agg(F.sum("x_s").alias("x_s"), F.sum("x_d").alias("x_d"))
    return found, split


def read_pairs(obs: DataFrame, longest: int | None = None) -> DataFrame:
    """(x_s, x_d): loci where two reads of different cells have the same base, and a different one; mates that disagree don't count.

    longest: positions that a fragment spans at most, which saves a pass over obs.
    """

    def make(key, pairs):
        a, b, cell_a, cell_b, x_s, x_d = pairs
        columns = [np.full(len(a), key[0], np.int32), a, b, cell_a.astype(np.int32), cell_b.astype(np.int32), x_s, x_d]
        return pa.table([pa.array(c) for c in columns], [*PAIR, "cell_a", "cell_b", "x_s", "x_d"])

    return _in_windows(obs, longest, make, "chromosome_id int, read_a bigint, read_b bigint, cell_a int, cell_b int, x_s bigint, x_d bigint")[0]


def cell_pairs(obs: DataFrame, longest: int | None = None, by: str | None = None) -> DataFrame:
    """(cell_i < cell_j, x_s, x_d, n): how many pairs of reads of two cells have these counts, summed within each window at least.

    by: a column of numbers; only observations of equal value are paired, and it comes first in the result.
    """

    def make(key, pairs):
        *_, cell_a, cell_b, x_s, x_d = pairs
        keys = (np.minimum(cell_a, cell_b), np.maximum(cell_a, cell_b), x_s, x_d)
        order = np.lexsort(keys)
        rows = [k[order] for k in keys]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), np.any([np.diff(k) != 0 for k in rows], axis=0)]))
        n = np.diff(np.append(new, len(order)))
        columns = [pa.array(rows[0][new].astype(np.int32)), pa.array(rows[1][new].astype(np.int32)), pa.array(rows[2][new]), pa.array(rows[3][new]), pa.array(n)]
        names = ["cell_i", "cell_j", "x_s", "x_d", "n"]
        return pa.table([pa.array([key[0]] * len(n), pa.int32()), *columns], [by, *names]) if by else pa.table(columns, names)

    own = [by] if by else []
    found, split = _in_windows(obs, longest, make, (f"{by} int, " if by else "") + "cell_i int, cell_j int, x_s bigint, x_d bigint, n bigint", by)
    if not split:
        return found
    cells = found.select(*own, F.least("cell_a", "cell_b").alias("cell_i"), F.greatest("cell_a", "cell_b").alias("cell_j"), "x_s", "x_d")
    return cells.groupBy(*own, "cell_i", "cell_j", "x_s", "x_d").agg(F.count(F.lit(1)).alias("n"))


def match_histogram(pairs: DataFrame) -> DataFrame:
    """Of cell_pairs(): pairs of reads by their counts."""
    return pairs.groupBy("x_s", "x_d").agg(F.sum("n").alias("n_pairs"))


def probabilities(theta: float) -> tuple[float, float]:
    """Of seeing different bases: where the bases are the same, and the same where they differ."""
    return 2 * theta * (1 - theta) + 2 * theta * theta / 3, 2 * (1 - theta) * theta / 3 + 2 * theta * theta / 9


def likelihoods(s: Column, d: Column, mutation: float, homozygous: float, theta: float) -> tuple[Column, Column]:
    """P(x_s, x_d) for reads of cells with the same and with different genotypes, without the common factor.

    Binomial sums over hidden matches have a closed form: powers of mixed probabilities.
    """
    psd, pds = probabilities(theta)
    pss, pdd = 1 - psd, 1 - pds
    power = lambda x, n: F.pow(F.lit(x), n.cast("double"))
    a, b = 1 - homozygous - mutation / 2, homozygous + mutation / 2
    same = power(pss, s) * power(psd, d) + power(a * pds + b * pss, s) * power(a * pdd + b * psd, d)
    c = 1 - mutation - homozygous
    w, v = mutation / 2 * (pss + pds) + homozygous * pss, mutation / 2 * (psd + pdd) + homozygous * psd
    different = power(c * pss + w, s) * power(c * psd + v, d) + power(c * pds + w, s) * power(c * pdd + v, d)
    return same, different


def pair_scores(pairs: DataFrame, mutation: float = 0.01, homozygous: float = 0.5, theta: float = 0.01) -> DataFrame:
    """(cell_i < cell_j, m) of cell_pairs(): sum over read pairs of ln P(different) - ln P(same); a column before them stays."""
    same, different = likelihoods(F.col("x_s"), F.col("x_d"), mutation, homozygous, theta)
    return pairs.groupBy(*(c for c in pairs.columns if c not in ("x_s", "x_d", "n"))).agg(F.sum(F.col("n") * (F.ln(different) - F.ln(same))).alias("m"))


def dense(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """Both halves of the matrix; pairs of cells without overlap and the diagonal are 0.

    The result itself has cells x cells rows, of the few thousand cells of an experiment. The scores, half as many, are
    checkpointed: normalization and degrees read the matrix several times.
    """
    with_checkpoints(scores.sparkSession)
    scores = scores.checkpoint()
    i, j = cells.select(F.col("cell_id").alias("i")), cells.select(F.col("cell_id").alias("j"))
    both = scores.select(F.col("cell_i").alias("i"), F.col("cell_j").alias("j"), "m").unionAll(scores.select(F.col("cell_j"), F.col("cell_i"), "m"))
    return i.crossJoin(j).join(both, ["i", "j"], "left").select("i", "j", F.coalesce("m", F.lit(0.0)).alias("m"))


def normalize(matrix: DataFrame, how: str = "ADD_MIN") -> DataFrame:
    """ADD_MIN: minus m, raised to be 0 at least; EXPONENTIATE: 1 / (1 + e^m); SCALE_MAX_1: m over its maximum."""
    off = F.col("i") != F.col("j")
    if how == "EXPONENTIATE":
        value = 1 / (1 + F.exp(F.col("m")))
        return matrix.select("i", "j", F.when(off, value).otherwise(0.0).alias("value"))
    if how not in ("ADD_MIN", "SCALE_MAX_1"):
        raise ValueError(f"no such normalization: {how}")
    edge = matrix.agg(F.max("m").alias("_max"))  # one row
    joined = matrix.join(F.broadcast(edge))
    value = F.abs(F.col("_max")) - F.col("m") if how == "ADD_MIN" else F.try_divide(F.col("m"), F.col("_max"))
    return joined.select("i", "j", F.when(off, value).otherwise(0.0).alias("value"))


def similarity(obs: DataFrame, cells: DataFrame, how: str = "ADD_MIN", mutation: float = 0.01, homozygous: float = 0.5, theta: float = 0.01) -> DataFrame:
    return normalize(dense(pair_scores(cell_pairs(obs), mutation, homozygous, theta), cells), how)


def degrees(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("i").agg(F.sum("value").alias("degree"))


def laplacian(matrix: DataFrame) -> DataFrame:
    """I - D^-1/2 A D^-1/2; a cell of degree 0 has 1 on the diagonal and 0 elsewhere."""
    return scaled(matrix, degrees(matrix))


def scaled(matrix: DataFrame, degree: DataFrame) -> DataFrame:
    """The Laplacian of a matrix with degrees (i, degree), a row a cell."""
    d = degree.withColumn("scale", F.when(F.col("degree") > 0, 1 / F.sqrt("degree")).otherwise(0.0))
    left, right = d.select("i", F.col("scale").alias("_l")), d.select(F.col("i").alias("j"), F.col("scale").alias("_r"))
    value = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - F.col("_l") * F.col("value") * F.col("_r")
    return matrix.join(left, "i").join(right, "j").select("i", "j", value.alias("value"))


@dataclass(frozen=True)
class Affinity:
    """A normalised matrix without its zeros: entries (i, j, value) of both halves for cells that overlap, `rest` for all other
    pairs of different cells, and degrees (i, degree). What is normal is told by scores, of which there are half as many.
    """

    entries: DataFrame
    degrees: DataFrame
    rest: float
    cells: int


def affinity(scores: DataFrame, cells: DataFrame, how: str = "ADD_MIN") -> Affinity:
    """scores: (cell_i, cell_j, m), checkpointed here; cells: (cell_id). As normalize(), degrees and all, in one pass over scores."""
    with_checkpoints(scores.sparkSession)
    scores = scores.checkpoint()
    top = max(0.0, scores.agg(F.max("m")).first()[0] or 0.0)  # the diagonal is 0
    n = cells.count()
    if how == "ADD_MIN":
        value, rest = F.lit(top) - F.col("m"), top
    elif how == "EXPONENTIATE":
        value, rest = 1 / (1 + F.exp("m")), 0.5
    elif how == "SCALE_MAX_1":
        value, rest = (F.col("m") / F.lit(top) if top else F.lit(0.0)), 0.0
    else:
        raise ValueError(f"no such normalization: {how}")
    half = scores.select(F.col("cell_i").alias("i"), F.col("cell_j").alias("j"), value.alias("value"))
    both = half.unionAll(half.select(F.col("j"), F.col("i"), "value"))
    own = both.groupBy("i").agg(F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    all_ = cells.select(F.col("cell_id").alias("i")).join(own, "i", "left")
    degree = F.coalesce("_sum", F.lit(0.0)) + F.lit(float(rest)) * (F.lit(n - 1) - F.coalesce("_n", F.lit(0)))
    return Affinity(both, all_.select("i", degree.alias("degree")), float(rest), n)


def full_laplacian(scores: DataFrame, cells: DataFrame, how: str = "ADD_MIN") -> DataFrame:
    """All cells x cells entries of the Laplacian. Degrees come from the scores, so that the matrix is made once."""
    own = affinity(scores, cells, how)
    i, j = cells.select(F.col("cell_id").alias("i")), cells.select(F.col("cell_id").alias("j"))
    value = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.coalesce("value", F.lit(own.rest)))
    matrix = i.crossJoin(j).join(own.entries, ["i", "j"], "left").select("i", "j", value.alias("value"))
    return scaled(matrix, own.degrees)
