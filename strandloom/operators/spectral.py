"""Spectral clustering without a dense matrix: smallest eigenpairs, k-means and Gaussian mixtures as Spark jobs, of many nodes at once.

A node is a set of cells that is to be divided. All nodes of a level are worked on side by side: an algorithm is a generator
that asks for products of its matrix, or for sums over its points, and a job answers the questions of all nodes together. So
the number of jobs follows the slowest node and not how many there are. What the driver holds is a row for each cell (vectors
of cells times a few dozen columns) and sums, whose size depends on dimensions and clusters only; entries of matrices and
points stay in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import with_checkpoints

#: Cells whose vectors are sent to tasks and held by the driver: 64 columns of so many are 512 MB.
MOST_CELLS = 1_000_000
#: Eigenpairs that clustering looks at, those that are found, and clusters that a node is divided into at most.
PAIRS, FOUND, MOST_CLUSTERS = 7, 20, 4
#: Residuals that the former and the others may have; an eigenvalue's error is of the order of its square.
TOLERANCE, LOOSE = 1e-9, 1e-6
#: The second coordinate weighs more where clusters are told apart.
WEIGHTS = np.array([1.0, 1.2])


def lockstep(work: dict[Any, Generator], answer: Callable[[dict], dict]) -> dict:
    """What the generators return; each round answers the questions of all that still go on in one call."""
    results, asked = {}, {}

    def resume(key, step):
        try:
            asked[key] = step()
        except StopIteration as end:
            results[key] = end.value

    for key, g in work.items():
        resume(key, lambda: next(g))  # noqa: B023
    while asked:
        answers, asked = answer(asked), {}
        for key, value in answers.items():
            resume(key, lambda: work[key].send(value))  # noqa: B023
    return results


class Matrices:
    """D^-1/2 A D^-1/2 of every node, A being a normalised similarity, as rows of packed entries that are written once.

    scores: (node, cell_i, cell_j, m) of pairs of cells of a node, checkpointed; members: the sorted cells of each node.
    Pairs without score share one value (rest), which is left to arithmetic.
    """

    def __init__(self, scores: DataFrame, members: dict[int, list[int]], how: str = "ADD_MIN"):
        spark = self.spark = with_checkpoints(scores.sparkSession)
        total = sum(map(len, members.values()))
        if total > MOST_CELLS:
            raise ValueError(f"{total} cells; vectors are held for {MOST_CELLS} at most")
        self.members = members
        top = {r[0]: max(0.0, r[1]) for r in scores.groupBy("node").agg(F.max("m")).collect()}  # a row a node; the diagonal is 0
        self.top = {k: top.get(k, 0.0) for k in members}
        if how not in ("ADD_MIN", "EXPONENTIATE", "SCALE_MAX_1"):
            raise ValueError(f"no such normalization: {how}")
        self.rest = {k: t if how == "ADD_MIN" else 0.5 if how == "EXPONENTIATE" else 0.0 for k, t in self.top.items()}
        ends = np.cumsum([0, *map(len, members.values())])
        self.at = {k: slice(a, b) for k, a, b in zip(members, ends, ends[1:])}
        cells = np.concatenate([np.zeros(0, np.int64), *(np.array(m, np.int64) for m in members.values())])
        order = np.argsort(cells)
        sent = spark.sparkContext.broadcast((cells[order], order, self.top, self.rest))  # MOST_CELLS at most

        def pack(batches):
            sorted_cells, place, tops, rests = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                i, j = (place[np.searchsorted(sorted_cells, np.asarray(batch.column(k)))].astype(np.int32) for k in (1, 2))
                m, node = np.asarray(batch.column(3)), batch.column(0).to_pylist()
                high, rest = (np.array([d[x] for x in node]) for d in (tops, rests))
                with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                    value = high - m if how == "ADD_MIN" else 1 / (1 + np.exp(m)) if how == "EXPONENTIATE" else np.where(high != 0, m / high, 0.0)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([one(i), one(j), one(value - rest)], ["i", "j", "value"])

        both = scores.select("node", "cell_i", "cell_j", "m").unionAll(scores.select("node", "cell_j", "cell_i", "m"))
        dealt = both.repartitionByRange("cell_i")  # a row's entries lie in one task
        self.entries = dealt.mapInArrow(pack, "i array<int>, j array<int>, value array<double>").checkpoint()
        self.size = total
        ones = self._times(np.ones((total, 1)))[:, 0]
        self.degree = {k: ones[s] + self.rest[k] * (len(members[k]) - 1) for k, s in self.at.items()}
        self.scale = {k: np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0.0) for k, d in self.degree.items()}

    def _times(self, w: np.ndarray) -> np.ndarray:
        """Entries times a block of vectors: tasks send the sums of their rows, a row a cell."""
        sent, (_, b) = self.spark.sparkContext.broadcast(w), w.shape

        def multiply(batches):
            rows, sums = np.zeros(0, np.int64), np.zeros((0, b))
            for batch in batches:
                i, j, value = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
                both = np.concatenate([rows, i.astype(np.int64)])
                parts = np.concatenate([sums, value[:, None] * sent.value[j]])
                rows, at = np.unique(both, return_inverse=True)
                sums = np.zeros((len(rows), b))
                np.add.at(sums, at, parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * b, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(rows), lists], ["row", "sums"])

        out = np.zeros(w.shape)
        for batch in self.entries.mapInArrow(multiply, "row bigint, sums array<double>").toArrow().to_batches():
            np.add.at(out, np.asarray(batch.column(0)), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, b))
        sent.unpersist()
        return out

    def products(self, blocks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """The product of each node's matrix with its block, in one job."""
        w = np.zeros((self.size, max(b.shape[1] for b in blocks.values())))
        for k, b in blocks.items():
            w[self.at[k], : b.shape[1]] = self.scale[k][:, None] * b
        out = self._times(w)
        answer = {}
        for k, b in blocks.items():
            own = w[self.at[k], : b.shape[1]]
            answer[k] = self.scale[k][:, None] * (out[self.at[k], : b.shape[1]] + self.rest[k] * (own.sum(0) - own))
        return answer


def _new_columns(block: np.ndarray, basis: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of what block adds to basis."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > least]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def largest_pairs(degree: np.ndarray, k: int, most_columns: int = 64, rounds: int = 300, seed: int = 0):
    """Asks for products of a matrix with blocks; returns its k largest eigenvalues and vectors: block Lanczos with restarts.

    The Krylov space grows by the residuals of the wanted pairs, kept orthogonal to all before. At most_columns columns it
    restarts with the best vectors found. Root degrees, the known vector of eigenvalue 1, and k random vectors start it.
    """
    n, rng, root = len(degree), np.random.default_rng(seed), np.sqrt(np.maximum(degree, 0))
    k = min(k, n)
    basis = _new_columns(np.column_stack([root if root.any() else np.ones(n), rng.normal(size=(n, k))]), np.zeros((n, 0)))[:, : k + 1]
    product = yield basis
    for _ in range(rounds):
        theta, y = np.linalg.eigh(basis.T @ product)
        theta, y = theta[::-1], y[:, ::-1]
        own = y[:, :k]
        residual = product @ own - (basis @ own) * theta[: own.shape[1]]
        wrong = np.linalg.norm(residual, axis=0) > np.where(np.arange(own.shape[1]) < PAIRS, TOLERANCE, LOOSE)
        if own.shape[1] == k and not wrong.any():
            break
        block = _new_columns(residual[:, wrong], basis) if wrong.any() else np.zeros((n, 0))
        if block.shape[1] == 0:  # nothing to add: the space is closed
            if basis.shape[1] >= k:
                break
            block = _new_columns(rng.normal(size=(n, k)), basis)
        if basis.shape[1] + block.shape[1] > most_columns and basis.shape[1] > 2 * k:
            basis, product = basis @ y[:, : 2 * k], product @ y[:, : 2 * k]
        more = yield block
        basis, product = np.column_stack([basis, block]), np.column_stack([product, more])
    theta, y = np.linalg.eigh(basis.T @ product)
    return theta[::-1][:k], basis @ y[:, ::-1][:, :k]


def smallest_eigenpairs(matrices: Matrices, k: int = FOUND, seed: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each node the k smallest eigenvalues of its Laplacian I - D^-1/2 A D^-1/2, and vectors in columns, signs fixed."""
    found = lockstep({node: largest_pairs(matrices.degree[node], k, seed=seed) for node in matrices.members}, matrices.products)
    return {node: (1 - theta, signed(vectors)) for node, (theta, vectors) in found.items()}


def signed(vectors: np.ndarray, tiny: float = 1e-9) -> np.ndarray:
    """Columns with the sign by which their first component that isn't 0 is positive."""
    out = vectors.copy()
    for c in range(out.shape[1]):
        some = np.flatnonzero(np.abs(out[:, c]) > tiny)
        if len(some) and out[some[0], c] < 0:
            out[:, c] = -out[:, c]
    return out


class Points:
    """Points (node, cell_id, x) whose tasks answer questions: a question is a function of the node's cells and points in a
    task that gives numbers, which are summed over tasks, and rows, which are gathered."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    @staticmethod
    def of(spark: SparkSession, rows: dict[int, tuple[list[int], np.ndarray]]) -> Points:
        """Of each node its cells and a matrix with a row for each."""
        node = np.concatenate([np.full(len(c), k, np.int32) for k, (c, _) in rows.items()])
        cells = np.concatenate([np.array(c, np.int32) for c, _ in rows.values()])
        lists = pa.array([x for _, (_, m) in rows.items() for x in m.tolist()], pa.list_(pa.float64()))
        return Points(spark.createDataFrame(pa.table({"node": node, "cell_id": cells, "x": lists})))

    def answers(self, questions: dict[int, Callable]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            rows: dict[int, list] = {}
            for batch in batches:
                node, cells = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                for k in np.unique(node).tolist():
                    if k not in questions:
                        continue
                    at = np.flatnonzero(node == k)
                    x = np.array(batch.column(2).take(pa.array(at)).to_pylist(), float)
                    s, r = questions[k](cells[at], x)
                    sums[k] = sums[k] + s if k in sums else s
                    rows.setdefault(k, []).extend(r.tolist())
            if sums:
                columns = [pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64())), pa.array([rows[k] for k in sums], pa.list_(pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "s", "r"])

        out: dict[int, tuple[np.ndarray, list]] = {}
        for r in self.frame.mapInArrow(run, "node int, s array<double>, r array<array<double>>").collect():  # a row a node and task
            s, rows = out.get(r["node"], (0.0, []))
            out[r["node"]] = s + np.array(r["s"]), rows + r["r"]
        return {k: (out[k][0], np.array(out[k][1])) for k in questions}


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(2)


def _sum_of(f: Callable) -> Callable:
    return lambda cells, x: (f(x), np.zeros((0, 0)))


def uniform(cells: np.ndarray, seed: int, part: int) -> np.ndarray:
    """In [0, 1), by a hash of the cell's id."""
    h = cells.astype(np.uint64) + np.uint64((seed * 1_000_003 + part + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def candidates(view: Callable, k: int, seed: int = 0, rounds: int = 4):
    """k-means|| : asks for points that lie far from each other; returns them, and how many points are nearest to each.

    The first is that of the least hash. A few rounds draw some 2k points each, those far from the ones so far more often.
    """

    def first(cells, x):
        least = int(np.lexsort((cells, uniform(cells, seed, 0)))[0])
        return np.zeros(1), np.column_stack([uniform(cells, seed, 0)[least : least + 1], view(x[least : least + 1])])

    _, drawn = yield first
    found = drawn[np.argmin(drawn[:, 0]), 1:][None]
    cost, _ = yield _sum_of(lambda x: np.array([_distances(view(x), found).min(1).sum()]))
    for r in range(1, rounds + 1):
        if cost[0] <= 1e-300:
            break

        def far(cells, x, own=found, total=cost[0]):
            x = view(x)
            d = _distances(x, own).min(1)
            return np.zeros(1), x[uniform(cells, seed, r) < np.minimum(1.0, 2.0 * k * d / total)]  # noqa: B023

        _, drawn = yield far
        if len(drawn):
            found = np.unique(np.concatenate([found, drawn]), axis=0)
        cost, _ = yield _sum_of(lambda x, own=found: np.array([_distances(view(x), own).min(1).sum()]))
    weight, _ = yield _sum_of(lambda x: np.bincount(_distances(view(x), found).argmin(1), minlength=len(found)).astype(float))
    return found, weight


def _chosen(found: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator | None) -> np.ndarray:
    """k of the candidates: the heaviest and then the farthest by weight, or drawn by these."""
    own = [int(weight.argmax() if rng is None else rng.choice(len(found), p=weight / weight.sum()))]
    while len(own) < min(k, len(found)):
        cost = _distances(found, found[own]).min(1) * np.maximum(weight, 1e-9)
        if cost.sum() <= 0:
            break
        own.append(int(cost.argmax() if rng is None else rng.choice(len(found), p=cost / cost.sum())))
    return found[own]


def kmeans(view: Callable, ks: list[int], iterations: int = 100, tries: int = 6, seed: int = 0):
    """Asks for sums and sizes of clusters; returns for each k (centres, inertia), of the try with the least inertia.

    All tries of all k go on side by side. Ties go to the lower cluster, an empty cluster keeps its centre.
    """
    found, weight = yield from candidates(view, max(ks), seed)
    d = found.shape[1]
    runs = [(k, _chosen(found, weight, k, None if t == 0 else np.random.default_rng((seed, t, k)))) for k in ks for t in range(tries if k > 1 else 1)]
    centres, inertia, live = [c for _, c in runs], [np.inf] * len(runs), list(range(len(runs)))
    for _ in range(iterations):
        now = [centres[i] for i in live]

        def statistics(x, now=now):
            x, parts = view(x), []
            for c in now:
                near = _distances(x, c)
                out = np.zeros((len(c), d + 1))
                np.add.at(out, near.argmin(1), np.column_stack([x, np.ones(len(x))]))
                parts += [out.ravel(), [near.min(1).sum()]]
            return np.concatenate(parts)

        total, _ = yield _sum_of(statistics)
        at, still = 0, []
        for i in live:
            n = len(centres[i])
            out, inertia[i] = total[at : at + n * (d + 1)].reshape(n, d + 1), float(total[at + n * (d + 1)])
            at += n * (d + 1) + 1
            new = np.where(out[:, d:] > 0, out[:, :d] / np.maximum(out[:, d:], 1), centres[i])
            if not np.allclose(new, centres[i], rtol=0, atol=1e-12):
                centres[i] = new
                still.append(i)
        live = still
        if not live:
            break
    best: dict[int, tuple[np.ndarray, float]] = {}
    for (k, _), c, value in zip(runs, centres, inertia):
        if k not in best or value < best[k][1] * (1 - 1e-12):
            best[k] = (c, value)
    return best


def mixtures(view: Callable, n_all: int, starts: dict[int, np.ndarray], rounds: int = 5, floor: float = 1e-10):
    """Asks for moments; returns log-likelihoods of Gaussian mixtures with full covariances, by number of components.

    The start are the clusters of the nearest centres. All mixtures go on side by side: in a round tasks send, for each
    component, the sums of its responsibilities, of the points and of their outer products, and the log-likelihood. None if
    a component collapses or there are fewer points (n_all) than components.
    """
    d = max((c.shape[1] for c in starts.values()), default=0)
    out: dict[int, float | None] = dict.fromkeys(starts)
    live = {k: c for k, c in starts.items() if n_all >= k and len(c) == k}
    if not live or not d:
        return out
    shift = np.mean(next(iter(live.values())), 0)
    centres = {k: c - shift for k, c in live.items()}
    width = {k: k * (1 + d + d * d) + 1 for k in live}

    def moments(x, r):
        return np.concatenate([r.sum(0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x).ravel()])

    def hard(x, own):
        r = np.zeros((len(x), len(own)))
        r[np.arange(len(x)), _distances(x, own).argmin(1)] = 1
        return np.append(moments(x, r), 0.0)

    def fitted(k, total):
        size, sums, squares = total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d : -1].reshape(k, d, d)
        everything = squares.sum(0) / n_all - np.outer(sums.sum(0), sums.sum(0)) / n_all**2
        weight, mean, spread = np.maximum(size, 1e-12) / n_all, np.empty((k, d)), np.empty((k, d, d))
        for c in range(k):
            s = max(size[c], 1e-12)
            mean[c] = sums[c] / s if size[c] > 0 else centres[k][c]
            spread[c] = (squares[c] / s - np.outer(mean[c], mean[c]) if size[c] > 1 else everything) + floor * np.eye(d)
        return weight, mean, spread

    def soft(x, model):
        weight, mean, inverse, logdet = model
        logp = np.empty((len(x), len(weight)))
        for c in range(len(weight)):
            off = x - mean[c]
            logp[:, c] = np.log(weight[c]) - 0.5 * (logdet[c] + d * np.log(2 * np.pi) + np.einsum("ni,ij,nj->n", off, inverse[c], off))
        top = logp.max(1, keepdims=True)
        row = top[:, 0] + np.log(np.exp(logp - top).sum(1))
        return np.append(moments(x, np.exp(logp - row[:, None])), row.sum())

    def summed(f, models):
        total, _ = yield _sum_of(lambda x: np.concatenate([f(view(x) - shift, m) for m in models.values()]))
        edges = np.cumsum([0, *(width[k] for k in models)])
        return {k: total[a:b] for k, a, b in zip(models, edges, edges[1:])}

    totals = yield from summed(hard, centres)
    for step in range(rounds + 1):
        models = {}
        for k, total in totals.items():
            weight, mean, spread = fitted(k, total)
            signs, logdet = np.linalg.slogdet(spread)
            if (signs > 0).all():
                models[k] = (weight, mean, np.linalg.inv(spread), logdet)
        if not models:
            break
        totals = {k: t for k, t in (yield from summed(soft, models)).items() if np.isfinite(t[-1])}
        if step == rounds:
            out.update({k: float(t[-1]) for k, t in totals.items()})
    return out


def parameters(k: int, d: int) -> int:
    return k * d * (d + 1) // 2 + k * d + k - 1


def information(log_likelihood: float, k: int, n: int, d: int, how: str = "BIC") -> float:
    p = parameters(k, d)
    return 2 * p - 2 * log_likelihood if how == "AIC" else p * np.log(n) - 2 * log_likelihood


def choose_clusters(inertia: list[float], most: int = MOST_CLUSTERS) -> int:
    """2, and one more while the drop of the inertia stays above 0.75 of the drop before. inertia: of 1 to most + 1 clusters."""
    gaps = [a - b for a, b in zip(inertia, inertia[1:])]
    k = 2
    while k < most and gaps[k - 1] > 0.75 * gaps[k - 2]:
        k += 1
    return k


def weighted(x: np.ndarray) -> np.ndarray:
    return x * np.append(WEIGHTS, np.ones(max(0, x.shape[1] - len(WEIGHTS))))[: x.shape[1]]


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def numbered(labels: np.ndarray) -> np.ndarray:
    """Labels in the order in which they come up first."""
    _, first, at = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[at]


def _divided(values: np.ndarray, vectors: np.ndarray, kind: str, termination: str, seed: int, plain_kmeans: bool):
    """Asks about a node's points, the rows of its eigenvectors; returns (labels, clusters, info)."""
    info: dict = {"eigenvalues": values, "eigenvectors": vectors}
    vectors = vectors[:, :PAIRS]
    n, d = vectors.shape
    used = lambda x: x[:, 1:6]
    likely = []
    if d > 1:
        starts = yield from kmeans(used, list(range(1, MOST_CLUSTERS + 1)), tries=1, seed=seed)
        fits = yield from mixtures(used, n, {k: c for k, (c, _) in starts.items()})
        likely = [fits[k] for k in sorted(fits)]
    scores = [None if f is None else information(f, k, n, min(5, d - 1), termination) for k, f in enumerate(likely, 1)]
    info |= {"scores": scores, "log_likelihoods": likely}
    rest = [s for s in scores[1:] if s is not None]
    if not scores or scores[0] is None or not rest or scores[0] <= min(rest):
        return np.zeros(n, int), 1, info
    if kind == "FIEDLER":
        return numbered((vectors[:, 1] < 0).astype(int)), 2, info
    first = lambda x: weighted(x[:, :3])
    drops = yield from kmeans(first, list(range(1, MOST_CLUSTERS + 2)), seed=seed)
    k = choose_clusters([drops[c][1] for c in sorted(drops)])
    width = 3 if kind == "SPECTRAL2" else PAIRS
    rows = (lambda x: unit_rows(x[:, :width])) if plain_kmeans else (lambda x: weighted(unit_rows(x[:, :width])))
    centroids, _ = (yield from kmeans(rows, [k], seed=seed))[k]
    info["vectors"] = unit_rows(vectors[:, :width])
    if plain_kmeans:
        info["centroids"] = centroids
    return numbered(_distances(rows(vectors), centroids).argmin(1)), k, info


def cluster_nodes(
    scores: DataFrame, members: dict[int, list[int]], normalization: str = "ADD_MIN", kind: str = "SPECTRAL6", termination: str = "BIC", seed: int = 0, plain_kmeans: bool = False
) -> dict[int, tuple[np.ndarray, int, dict]]:
    """For each node (labels of its sorted cells, number of clusters (1: leave it whole), what led to them).

    scores: (node, cell_i, cell_j, m), checkpointed. Labels are numbered by their least cell; info has eigenvalues and
    -vectors, scores and log-likelihoods by number of components, the rows that were clustered, and centroids.
    """
    if kind not in ("FIEDLER", "SPECTRAL2", "SPECTRAL6"):
        raise ValueError(f"no such clustering: {kind}")
    single = {k: (np.zeros(len(m), int), 1, {}) for k, m in members.items() if len(m) < 2}
    many = {k: m for k, m in members.items() if len(m) > 1}
    if not many:
        return single
    matrices = Matrices(scores, many, normalization)
    pairs = smallest_eigenpairs(matrices, seed=seed)
    points = Points.of(matrices.spark, {k: (many[k], pairs[k][1][:, :PAIRS]) for k in many})
    points.frame.persist()
    out = lockstep({k: _divided(*pairs[k], kind, termination, seed, plain_kmeans) for k in many}, points.answers)
    points.frame.unpersist()
    return single | out
