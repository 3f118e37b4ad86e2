"""Pairs of reads by windows with overhang, and what is made of their scores, against plain Python and dense matrices."""

import random
from collections import defaultdict

import numpy as np
import pytest

from strandloom.operators import similarity
from test_spectral import dense_laplacian, normalized

OBS = "chromosome_id int, position bigint, read_id bigint, cell_id int, base int"


def made_reads(seed, reads=120, span=400, longest=30):
    rng, rows = random.Random(seed), []
    for r in range(reads):
        chromosome, start, cell = rng.randrange(2), rng.randrange(span), rng.randrange(8)
        for p in range(start, start + rng.randrange(1, longest + 1)):
            if rng.random() < 0.4:
                rows.append((chromosome, p, r, cell, rng.randrange(2)))
                if rng.random() < 0.1:  # the mate, which may disagree
                    rows.append((chromosome, p, r, cell, rng.randrange(2)))
    return rows


def brute_pairs(rows):
    bases, out = defaultdict(set), defaultdict(lambda: [0, 0])
    for c, p, r, cell, b in rows:
        bases[c, p, r, cell].add(b)
    loci = defaultdict(list)
    for (c, p, r, cell), b in bases.items():
        if len(b) == 1:
            loci[c, p].append((r, cell, min(b)))
    for (c, _), own in loci.items():
        for r, cell, b in own:
            for s, other, d in own:
                if r < s and cell != other:
                    out[c, r, s, cell, other][int(b != d)] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("width, most, longest", [(10**6, 10**6, None), (40, 10**6, None), (40, 50, 30), (7, 3, 200)])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, width, most, longest):
    monkeypatch.setattr(similarity, "WIDTH", width)
    rows = made_reads(width)
    dealt = similarity._windows(spark.createDataFrame(rows, OBS), longest)[0]
    assert dealt.select("chromosome_id", "_window").distinct().count() > (2 if width < 1000 else 1)
    obs, want = spark.createDataFrame(rows, OBS).repartition(5), brute_pairs(rows)
    got = similarity.read_pairs(obs, longest).collect()
    assert len(got) == len(want)
    assert {tuple(r)[:5]: tuple(r)[5:] for r in got} == want
    cells = defaultdict(int)
    for (_, _, _, a, b), (s, d) in want.items():
        cells[min(a, b), max(a, b), s, d] += 1
    summed = similarity.cell_pairs(obs, longest).groupBy("cell_i", "cell_j", "x_s", "x_d").sum("n").collect()
    assert {tuple(r)[:4]: r[4] for r in summed} == dict(cells)


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_slices_of_loci_make_no_difference(monkeypatch, most):
    monkeypatch.setattr(similarity, "MOST_PAIRS", most)
    rows = [r for r in made_reads(5) if r[0] == 0]
    position, read, cell, base = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
    got = similarity.pairs_of_window(position, read, cell, base, 0, 10**6)
    assert {tuple(int(x) for x in r[:4]): tuple(int(x) for x in r[4:]) for r in zip(*got)} == {k[1:]: v for k, v in brute_pairs(rows).items()}
    assert [len(x) for x in similarity.pairs_of_window(*(np.zeros(0, np.int64),) * 4, 0, 9)] == [0] * 6


def test_pairs_of_nothing(spark):
    none = spark.createDataFrame([], OBS)
    assert similarity.read_pairs(none).collect() == [] and similarity.cell_pairs(none, 5).collect() == [] and similarity.longest_fragment(none) == 0


@pytest.mark.parametrize("how", ["ADD_MIN", "EXPONENTIATE", "SCALE_MAX_1"])
@pytest.mark.parametrize("top", [2.0, -1.0])
def test_affinity_is_the_dense_one(spark, how, top):
    rng, n = np.random.default_rng(3), 7
    m = np.zeros((n, n))
    rows = [(i, j, float(rng.normal()) - 3 + top) for i in range(n - 1) for j in range(i + 1, n - 1) if rng.random() < 0.7]
    for i, j, x in rows:
        m[i, j] = m[j, i] = x
    scores = spark.createDataFrame(rows, "cell_i int, cell_j int, m double")
    cells = spark.range(n).selectExpr("cast(id AS int) AS cell_id")
    want = normalized(m.copy(), how)
    own = similarity.affinity(scores, cells, how)
    assert [r["degree"] for r in own.degrees.orderBy("i").collect()] == pytest.approx(list(want.sum(1)))
    got = np.zeros((n, n))
    for r in similarity.full_laplacian(scores, cells, how).collect():
        got[r["i"], r["j"]] = r["value"]
    assert np.allclose(got, dense_laplacian(want))
    with pytest.raises(ValueError, match="no such"):
        similarity.affinity(scores, cells, "x")


@pytest.mark.parametrize("width, longest, fragments, split", [(40, None, 200, True), (40, 200, 200, True), (120, 30, 30, False)])
@pytest.mark.parametrize("most", [5, 10**6])
def test_no_window_is_held_whole(spark, monkeypatch, capsys, width, longest, fragments, split, most):
    """Long fragments don't widen windows: tasks go through them in order, and counts of stretches are summed."""
    for name, value in (("WIDTH", width), ("STRETCH", 50), ("MOST_ROWS", most), ("MOST_HELD", most)):
        monkeypatch.setattr(similarity, name, value)
    rows = made_reads(7, longest=fragments)
    obs, want = spark.createDataFrame(rows, OBS).repartition(5), brute_pairs(rows)
    pairs = similarity.read_pairs(obs, longest)
    pairs.explain()
    assert "InArrow" in (plan := capsys.readouterr().out) and "FlatMapGroups" not in plan  # a group would be held whole
    assert ("sum(x_s" in plan) == split
    got = pairs.collect()
    assert len(got) == len(want) and {tuple(r)[:5]: tuple(r)[5:] for r in got} == want
    cells = defaultdict(int)
    for (_, _, _, a, b), (s, d) in want.items():
        cells[min(a, b), max(a, b), s, d] += 1
    noted = similarity.cell_pairs(obs.selectExpr("*", "7 AS node"), longest, "node").groupBy("node", "cell_i", "cell_j", "x_s", "x_d").sum("n").collect()
    assert {tuple(r)[1:5]: r[5] for r in noted} == dict(cells) and {r[0] for r in noted} == {7}


@pytest.mark.parametrize("most", [7, 40, 10**6])
def test_long_reads_are_cut_to_fragments(spark, most):
    """From a read's first position on; nodes apart; what is short stays as it is."""
    rows = made_reads(9, longest=90)
    first = defaultdict(lambda: 10**9)
    for c, p, r, cell, _ in rows:
        first[c, r, cell] = min(first[c, r, cell], p)
    part = lambda c, p, r, cell: (p - first[c, r, cell]) // most
    cut = similarity.cut_fragments(spark.createDataFrame([(*r, 3) for r in rows], OBS + ", node int").repartition(5), most, "node").persist()
    reads = {(c, r, cell, part(c, p, r, cell)) for c, p, r, cell, _ in rows}
    ids = {tuple(r) for r in cut.select("chromosome_id", "read_id", "cell_id").distinct().collect()}
    assert cut.count() == len(rows) and len(ids) == len(reads) and {r[:3] for r in reads} <= ids
    want = defaultdict(int)
    for (_, _, _, a, b), (s, d) in brute_pairs([(c, p, r * 1000 + part(c, p, r, cell), cell, b) for c, p, r, cell, b in rows]).items():
        want[min(a, b), max(a, b), s, d] += 1
    got = similarity.cell_pairs(cut, min(most - 1, 90), "node").groupBy("cell_i", "cell_j", "x_s", "x_d").sum("n").collect()
    assert {tuple(r)[:4]: r[4] for r in got} == dict(want)


def test_counts_hold_a_row_a_pair():
    counts = similarity.PairCounts()
    for p in range(300):
        counts.add(np.full(4, p), np.array([3, 1, 2, 2]), np.array([0, 1, 2, 2]), np.array([p % 2, 0, 1, 1]))
        assert counts.held() <= 3 * 300
    assert {tuple(int(x) for x in r) for r in zip(*counts.pairs())} == {(1, 2, 1, 2, 0, 300), (1, 3, 1, 0, 150, 150), (2, 3, 2, 0, 150, 150)}
    assert counts.held() == 0 and [len(x) for x in counts.pairs(0, 9)] == [0] * 6
