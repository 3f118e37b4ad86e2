"""Soft assignment of cells to two clusters by expectation maximization."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_checkpoints
from .significance import LOCUS


def centres(obs: DataFrame, p: DataFrame, theta: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Log probability of every base at every locus, for clusters a and b: log_a, log_b.

    Weights are normalised, raised to theta at least and normalised again; where a cluster has none they are even.
    """
    weights = obs.join(few(p), "cell_id").groupBy(*by, *LOCUS).agg(
        *(F.sum(F.when(F.col("base") == i, w).otherwise(0.0)).alias(f"{n}{i}") for n, w in (("a", 1 - F.col("p")), ("b", F.col("p"))) for i in range(4))
    )
    out = []
    for n in "ab":
        total = sum((F.col(f"{n}{i}") for i in range(1, 4)), F.col(f"{n}0"))
        share = [F.greatest(F.try_divide(F.col(f"{n}{i}"), total), F.lit(theta)) for i in range(4)]
        norm = sum(share[1:], share[0])
        out.append(F.array(*(F.when(total > 0, F.ln(s / norm)).otherwise(math.log(0.25)) for s in share)).alias(f"log_{n}"))
    return weights.select(*by, *LOCUS, *out)


#: Cells whose probabilities are sent to all tasks; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def few(p: DataFrame) -> DataFrame:
    """p, a row a cell, broadcast if it is small."""
    return F.broadcast(p) if p.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else p


def step(obs: DataFrame, p: DataFrame, theta: float = 1e-3, by: list[str] = []) -> DataFrame:  # noqa: B006
    """One round: (cell_id, p, ll_a, ll_b, before) with the new probability of cluster b. p: (cell_id, p[, ll_a, ll_b]).

    by: columns of obs and p; cells of equal values are divided among themselves.
    """
    if "ll_a" not in p.columns:
        p = p.withColumns({"ll_a": F.lit(0.0), "ll_b": F.lit(0.0)})
    c = centres(obs, p.select("cell_id", "p"), theta, by)
    pick = lambda n: F.sum(F.element_at(f"log_{n}", F.col("base") + 1))
    seen = obs.join(c, [*by, *LOCUS]).groupBy("cell_id").agg(pick("a").alias("_a"), pick("b").alias("_b"))
    prior = p.groupBy(*by).agg(F.avg("p").alias("_prior"))  # one row, or one a node
    both = p.join(seen, "cell_id", "left")
    both = both.join(F.broadcast(prior), by) if by else both.join(F.broadcast(prior))
    both = both.withColumns({"ll_a": F.col("ll_a") + F.coalesce("_a", F.lit(0.0)), "ll_b": F.col("ll_b") + F.coalesce("_b", F.lit(0.0))})
    odds = F.exp(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("ll_b") - F.col("ll_a"))))
    new = F.when(F.col("_prior") >= 1, 1.0).otherwise(1 - 1 / (1 + odds * F.try_divide(F.col("_prior"), 1 - F.col("_prior"))))
    return both.select(*by, "cell_id", new.alias("p"), "ll_a", "ll_b", F.col("p").alias("before"))


def refine(obs: DataFrame, p: DataFrame, theta: float = 1e-3, accumulate: bool = True, most: int = 100, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, cell_id, p) after rounds until no probability moves by 0.01. accumulate: log-likelihoods add up over the rounds.

    With `by`, each node stops when none of its own cells moves. obs (checkpointed once: every round reads it twice) and every
    round's probabilities lie in the shared folder, so that plans don't grow.
    """
    with_checkpoints(obs.sparkSession)
    obs, done, still = obs.select(*by, *LOCUS, "cell_id", "base").checkpoint(), [], None
    for _ in range(most):
        p = step(obs if still is None else obs.join(F.broadcast(still), by, "left_semi"), p if accumulate else p.select(*by, "cell_id", "p"), theta, by).checkpoint()
        moved = p.where(F.abs(F.col("p") - F.col("before")) >= 0.01)
        if not by:
            if moved.isEmpty():
                break
        else:  # nodes that have come to rest leave the rounds
            still = moved.select(*by).distinct().checkpoint()
            done.append(p.join(F.broadcast(still), by, "left_anti"))
            p = p.join(F.broadcast(still), by, "left_semi")
            if still.isEmpty():
                break
        p = p.drop("before")
    for rest in done:
        p = p.select(*by, "cell_id", "p").unionAll(rest.select(*by, "cell_id", "p"))
    return p.select(*by, "cell_id", "p")
