"""Eigenpairs, k-means and mixtures of many nodes against dense numpy, and clusters of made matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import em, spectral

SCORES = "node int, cell_i int, cell_j int, m double"


def normalized(m, how):
    if how == "EXPONENTIATE":
        out = 1 / (1 + np.exp(m))
    else:
        top = m.max()
        out = abs(top) - m if how == "ADD_MIN" else m / top if top else np.zeros_like(m)
    np.fill_diagonal(out, 0)
    return out


def dense_laplacian(a):
    d = a.sum(1)
    scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return np.eye(len(a)) - scale[:, None] * a * scale[None]


def symmetric(a):
    a = np.tril(a, -1)
    return a + a.T


def nodes_of(spark, matrices, density=1.0, seed=0):
    """Scores whose ADD_MIN is the matrix (entries are 0 at least), cells 3k + 1 of each node, and the members."""
    rng, rows, members, at = np.random.default_rng(seed), [], {}, 0
    for k, a in enumerate(matrices):
        members[k] = [3 * c + 1 for c in range(at, at + len(a))]
        at += len(a)
        rows += [(k, members[k][i], members[k][j], -float(a[i, j])) for i in range(len(a)) for j in range(i + 1, len(a)) if a[i, j] or rng.random() < density / 2]
    return spark.createDataFrame(rows, SCORES), members


@pytest.mark.parametrize("how", ["ADD_MIN", "EXPONENTIATE", "SCALE_MAX_1"])
def test_eigenpairs_are_those_of_the_dense_matrix(spark, how):
    """Nodes of several sizes at once, one of them in two parts that nothing links, one with cells that overlap none."""
    rng, ms = np.random.default_rng(5), []
    for n in (2, 3, 25, 90):
        m = symmetric(rng.normal(size=(n, n)) - (0 if how == "ADD_MIN" else -3 if how == "SCALE_MAX_1" else 1))
        m[np.abs(m) < 0.5] = 0
        if n == 25 and how == "SCALE_MAX_1":
            m[:10, 10:] = m[10:, :10] = 0
        if n == 90:
            m[80:] = m[:, 80:] = 0
        ms.append(m)
    if how == "SCALE_MAX_1":
        ms = [np.abs(m) for m in ms]
    at, rows, members = 0, [], {}
    for k, m in enumerate(ms):
        members[k] = list(range(at, at + len(m)))
        at += len(m)
        rows += [(k, members[k][i], members[k][j], float(m[i, j])) for i in range(len(m)) for j in range(i + 1, len(m)) if m[i, j]]
    matrices = spectral.Matrices(spark.createDataFrame(rows, SCORES), members, how)
    for k, (values, vectors) in spectral.smallest_eigenpairs(matrices).items():
        dense = dense_laplacian(normalized(ms[k].copy(), how))
        want = np.linalg.eigvalsh(dense)[: spectral.FOUND]
        assert values == pytest.approx(want, abs=1e-6), k
        residual = dense @ vectors - vectors * values
        assert np.abs(residual[:, : spectral.PAIRS]).max() < 1e-6 and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-8)
        first = [c[np.flatnonzero(np.abs(c) > 1e-9)[0]] for c in vectors.T]
        assert min(first) > 0


def test_jobs_follow_the_slowest_node_and_not_their_number(spark):
    rng = np.random.default_rng(2)
    ms = [symmetric(rng.random((20, 20))) for _ in range(12)]
    asked = []
    for some in (ms[:1], ms):
        matrices = spectral.Matrices(*nodes_of(spark, some))
        plain, count = matrices.products, []
        matrices.products = lambda blocks, plain=plain, count=count: count.append(len(blocks)) or plain(blocks)
        spectral.smallest_eigenpairs(matrices)
        asked.append(len(count))
    assert asked[1] <= asked[0] + 2
    with pytest.raises(ValueError, match="vectors are held"):
        before, spectral.MOST_CELLS = spectral.MOST_CELLS, 10
        try:
            spectral.Matrices(*nodes_of(spark, ms[:1]))
        finally:
            spectral.MOST_CELLS = before


def points(spark, *rows):
    at = np.cumsum([0, *map(len, rows)])
    return spectral.Points.of(spark, {k: (list(range(a, b)), r) for k, (r, a, b) in enumerate(zip(rows, at, at[1:]))})


def plain_kmeans(x, k, tries=30):
    best, rng = np.inf, np.random.default_rng(0)
    for _ in range(tries):
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(100):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        best = min(best, ((x - c[own]) ** 2).sum())
    return best


def test_kmeans_reaches_the_least_inertia_of_plain_kmeans(spark):
    rng = np.random.default_rng(1)
    planted = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 2))])
    few, same = np.array([[1.0, 2, 3], [4, 5, 6]]), np.ones((9, 3))
    own = points(spark, planted, few, same)
    got = spectral.lockstep({k: spectral.kmeans(lambda x: x, [1, 2, 3, 5]) for k in range(3)}, own.answers)
    for k in (1, 2, 3):
        assert got[0][k][1] == pytest.approx(plain_kmeans(planted, k), rel=1e-6)
    assert got[0][5][1] <= 1.1 * plain_kmeans(planted, 5)
    assert got[1][2][1] == 0 and got[1][5][1] == 0 and got[1][1][1] == pytest.approx(13.5) and got[2][3][1] == pytest.approx(0)
    labels = spectral._distances(planted, got[0][3][0]).argmin(1)
    assert spectral.numbered(labels).tolist() == [0] * 40 + [1] * 40 + [2] * 40
    weighted = spectral.lockstep({0: spectral.kmeans(spectral.weighted, [2])}, own.answers)[0][2][1]
    assert weighted == pytest.approx(plain_kmeans(planted * [1, 1.2, 1], 2), rel=1e-6)


def plain_mixture(x, centres, rounds=5, floor=1e-10):
    n, d = x.shape
    k = len(centres)
    r = np.eye(k)[((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)]
    for step in range(rounds + 1):
        size = r.sum(0)
        mean = (r.T @ x) / size[:, None]
        logp = np.empty((n, k))
        for c in range(k):
            off = x - mean[c]
            spread = (off.T * r[:, c]) @ off / size[c] + floor * np.eye(d)
            logp[:, c] = np.log(size[c] / n) - 0.5 * (np.linalg.slogdet(spread)[1] + d * np.log(2 * np.pi) + np.einsum("ij,ij->i", off @ np.linalg.inv(spread), off))
        row = np.logaddexp.reduce(logp, axis=1)
        r = np.exp(logp - row[:, None])
    return row.sum()


def test_mixtures_have_the_likelihood_of_plain_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, s, (60, 5)) for c, s in ((0, 1), (2, 0.5), (-3, 2))]) + 7
    y = rng.normal(size=(50, 2))
    starts = {0: {k: x[[5, 70, 130, 20][:k]] for k in (1, 2, 3, 4)}, 1: {1: y[:1], 2: y[:2], 60: y}}
    own = points(spark, x, y)
    got = spectral.lockstep({k: spectral.mixtures(lambda p: p, len(m), starts[k]) for k, m in enumerate((x, y))}, own.answers)
    for k in (1, 2, 3, 4):
        assert got[0][k] == pytest.approx(plain_mixture(x, starts[0][k]), rel=1e-9)
    assert got[1][1] == pytest.approx(plain_mixture(y, y[:1]), rel=1e-9) and got[1][60] is None
    assert spectral.parameters(2, 5) == 2 * 15 + 10 + 1
    assert spectral.information(-10.0, 2, 100, 5) == pytest.approx(41 * np.log(100) + 20) and spectral.information(-10.0, 1, 9, 5, "AIC") == 60


@pytest.mark.parametrize("kind, how, plain", [("FIEDLER", "BIC", False), ("SPECTRAL2", "AIC", True), ("SPECTRAL2", "BIC", False), ("SPECTRAL6", "BIC", True), ("SPECTRAL6", "AIC", False)])
def test_clusters_of_matrices(spark, kind, how, plain):
    """Cells that are alike, two and three groups of cells, zeros and a single cell, side by side."""
    rng = np.random.default_rng(3)
    whole = [symmetric(1 + rng.uniform(-1e-3, 1e-3, (100, 100))) for _ in range(3)]
    two = rng.integers(0, 6, (100, 100)).astype(float)
    two[:50, :50], two[50:, 50:] = rng.integers(100, 201, (2, 50, 50))
    three = rng.integers(0, 6, (99, 99)).astype(float) + 20 * (rng.random((99, 99)) < 0.8)
    for g in range(3):
        three[33 * g : 33 * g + 33, 33 * g : 33 * g + 33] = rng.integers(100, 201, (33, 33))
    scores, members = nodes_of(spark, [*whole, symmetric(two), symmetric(three), np.zeros((99, 99)), np.zeros((1, 1))])
    out = spectral.cluster_nodes(scores, members, "ADD_MIN", kind, how, plain_kmeans=plain)
    assert [out[k][1] for k in range(3)].count(1) >= 2
    labels, k, info = out[3]
    assert k == 2 and labels.tolist() == [0] * 50 + [1] * 50
    assert len(info["eigenvalues"]) == 20 and (kind == "FIEDLER") == ("vectors" not in info) and ("centroids" in info) == (plain and kind != "FIEDLER")
    if kind != "FIEDLER":
        labels, k, _ = out[4]
        assert k in (2, 3) and all(min(abs(np.sum(labels == c) - n) for n in (33, 66)) < 2 for c in range(k))
    assert len(out[5][0]) == 99 and out[5][1] >= 1 and out[6][1] == 1
    with pytest.raises(ValueError, match="no such clustering"):
        spectral.cluster_nodes(scores, members, kind="x")


def test_refinement_of_nodes_is_that_of_each(spark):
    rng = np.random.default_rng(6)
    rows = [(p % 2, p, c * 50 + p, c, int((p + (c % 2) * (p % 3 == 0)) % 4 if rng.random() > 0.05 else rng.integers(4)), c // 10) for p in range(60) for c in range(20) for _ in range(2)]
    obs = spark.createDataFrame(rows, "chromosome_id int, position bigint, read_id bigint, cell_id int, base int, node int")
    start = spark.createDataFrame([(c // 10, c, 0.7 if c % 2 else 0.4 + 0.01 * (c // 10)) for c in range(20)], "node int, cell_id int, p double")
    both = {r["cell_id"]: r["p"] for r in em.refine(obs, start, by=["node"]).collect()}
    for node in (0, 1):
        alone = em.refine(obs.where(F.col("node") == node).drop("node"), start.where(F.col("node") == node).drop("node")).collect()
        assert {r["cell_id"]: both[r["cell_id"]] for r in alone} == pytest.approx({r["cell_id"]: r["p"] for r in alone})
    assert len(both) == 20 and all((both[c] > 0.5) == bool(c % 2) for c in both)
