"""Language-model scores: a hidden Markov model over words, beside add-one unigrams.

Words of the training documents are counted by a shuffle; those with at least 1 / 2^14 of all tokens (so at most 2^14 of
them) are symbols of their own, all others are one symbol, whose share is dealt to its words by their counts. Baum-Welch
runs over the whole texts of all training documents, whose symbols are written once: every task adds up its expected counts,
a shuffle adds up those of the tasks, and the driver gets one row for each symbol. A text's score is the scaled forward
recursion over the whole text.

Forward and backward recursion go through many texts at once, position by position. So that a long text doesn't go alone,
it is cut into blocks; a block's effect on any state is a small matrix, the product of its steps, and the matrices of the
blocks before and behind give each block the exact state at its edges.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, crc_remainder, forget, materialize, slices

STATES, ROUNDS, SEED = 4, 3, 17
FREQUENT = 1 << 14
#: Positions that training goes through at a time; the blocks of a text are linked exactly.
BLOCK = 256
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    out = text.lower().split()
    out.append(END)
    return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over the training rows of (_id, _held, _text)."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
        for batch in batches:
            for part in slices(batch, 0):
                for text in byte_texts(part.column(0)):
                    counts.update(tokens(text))
                if len(counts) > 400_000:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    return docs.where("not _held").select("_text").mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("c"))


def start_model(share: np.ndarray, states: int = STATES, seed: int = SEED) -> dict[str, np.ndarray]:
    """Emissions near the symbols' shares, a transition matrix that tends to stay."""
    rng = np.random.default_rng(seed)
    emit = share * rng.uniform(0.5, 1.5, (states, len(share)))
    move = rng.uniform(0.5, 1.0, (states, states)) + 2 * np.eye(states)
    return {"start": np.full(states, 1 / states), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def time_major(lengths: np.ndarray) -> np.ndarray:
    """How many sequences, sorted by falling length, go on at each position."""
    return np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")


def expected_counts(model: dict, sequences: list[np.ndarray], block: int = BLOCK) -> tuple[dict, float]:
    """Exact Baum-Welch counts of start, move and emit over whole sequences, and the log-likelihood."""
    move, table = model["move"], np.ascontiguousarray(model["emit"].T)
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    flat, states = np.concatenate(sequences), len(move)
    pieces = -(-sizes // block)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * block
    length = np.minimum(block, np.repeat(sizes, pieces) - nth * block)
    alpha, scale = np.empty((len(flat), states)), np.empty(len(flat))

    def falling(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[np.argsort(-length[rows], kind="stable")]
        return rows, time_major(length[rows])

    def forward(rows: np.ndarray, before: np.ndarray, fresh: bool) -> None:
        order = np.argsort(-length[rows], kind="stable")
        rows, before = rows[order], before[order]
        for t, n in enumerate(time_major(length[rows])):
            at = begin[rows[:n]] + t
            a = (before[:n] if t == 0 and fresh else before[:n] @ move) * table[flat[at]]
            c = a.sum(1)
            a /= c[:, None]
            alpha[at], scale[at] = a, c
            before = a

    first, later = np.flatnonzero(nth == 0), np.flatnonzero(nth > 0)
    forward(first, np.tile(model["start"], (len(first), 1)), True)
    behind = np.ones((len(nth), states))  # what follows a block makes of each state at its end
    if len(later):
        effect = np.empty((len(nth), states, states))
        rows, alive = falling(later)
        product = np.tile(np.eye(states), (len(rows), 1, 1))
        for t, n in enumerate(alive):
            step = (product[:n] @ move) * table[flat[begin[rows[:n]] + t]][:, None, :]
            product[:n] = step / step.sum((1, 2))[:, None, None]
        effect[rows] = product
        before = np.empty((len(nth), states))
        ends = begin + length - 1
        before[later[nth[later] == 1]] = alpha[ends[later[nth[later] == 1] - 1]]
        by_place = [later[nth[later] == k] for k in range(1, int(nth.max()) + 1)]
        for rows in by_place[1:]:
            out = np.einsum("ni,nij->nj", before[rows - 1], effect[rows - 1])
            before[rows] = out / out.sum(1, keepdims=True)
        forward(later, before[later], False)
        for rows in by_place[::-1]:
            out = np.einsum("nij,nj->ni", effect[rows], behind[rows])
            behind[rows - 1] = out / (out * alpha[ends[rows - 1]]).sum(1, keepdims=True)
    gamma, moved = np.empty_like(alpha), np.zeros_like(move)
    rows, alive = falling(np.arange(len(nth)))
    beta = np.zeros((0, states))
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        beta = np.concatenate([beta, behind[rows[len(beta) : n]]])
        at = begin[rows[:n]] + t
        gamma[at] = alpha[at] * beta
        if t == 0:
            linked = nth[rows[:n]] > 0
            at, beta = at[linked], beta[linked]
        ahead = table[flat[at]] * beta / scale[at, None]
        moved += move * (alpha[at - 1].T @ ahead)
        beta = ahead @ move.T
    k = model["emit"].shape[1]
    emit = np.stack([np.bincount(flat, gamma[:, s], k) for s in range(states)])
    return {"start": gamma[begin[first]].sum(0), "move": moved, "emit": emit}, float(np.log(scale).sum())


def maximized(counts: dict, share: np.ndarray) -> dict[str, np.ndarray]:
    """The model of the counts, a little smoothed so that every symbol stays possible."""
    start, move, emit = counts["start"] + 0.01, counts["move"] + 0.01, counts["emit"] + share
    return {"start": start / start.sum(), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def log10_forward(model: dict, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each whole sequence."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order], np.int64)
    flat = np.concatenate([sequences[i] for i in order])
    begin = np.cumsum(lengths) - lengths
    move, table = model["move"], np.ascontiguousarray(model["emit"].T)
    total, a = np.zeros(len(order)), np.tile(model["start"], (len(order), 1))
    for t, n in enumerate(time_major(lengths)):
        a = (a if t == 0 else a[:n] @ move) * table[flat[begin[:n] + t]]
        c = a.sum(1)
        a /= c[:, None]
        total[:n] += np.log10(c)
    out = np.empty(len(order))
    out[order] = total
    return out


class Symbols(dict):
    """token -> symbol; any other token is the last symbol."""

    def __missing__(self, token: bytes) -> int:
        return self.rare

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def symbols_of(frequent: list[bytes]) -> Symbols:
    out = Symbols((w, i) for i, w in enumerate(frequent))
    out.rare = len(frequent)
    return out


def training_symbols(docs: DataFrame, frequent: list[bytes]) -> DataFrame:
    """(ids): the symbols of each training document as 16-bit numbers; FREQUENT is less than so many."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        code = symbols_of(sent.value)
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([code.encode(tokens(t)).astype(np.uint16).tobytes() for t in byte_texts(part.column(0))], pa.binary())], ["ids"])

    return docs.where("not _held").select("_text").mapInArrow(run, "ids binary")


def baum_welch_round(symbols: DataFrame, model: dict) -> tuple[dict, float]:
    """The expected counts of all training documents, and their log-likelihood."""
    sent = symbols.sparkSession.sparkContext.broadcast(model)
    states, k = model["emit"].shape

    def run(batches):
        own = sent.value
        total = {n: np.zeros_like(v) for n, v in own.items()}
        likelihood, some, size = 0.0, [], 0

        def add() -> None:
            nonlocal likelihood, some, size
            if some:
                got, ll = expected_counts(own, some)
                likelihood += ll
                for n, v in got.items():
                    total[n] += v
            some, size = [], 0

        for batch in batches:
            for ids in batch.column(0):
                some.append(np.frombuffer(ids.as_py(), np.uint16).astype(np.int32))
                size += len(some[-1])
                if size > 500_000:
                    add()
        add()
        rows = np.concatenate([total["emit"].T, total["move"], total["start"][None], np.full((1, states), likelihood)])
        at = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(rows[at, s]) for s in range(states))], ["row", *(f"s{s}" for s in range(states))])

    got = symbols.mapInArrow(run, "row bigint, " + ", ".join(f"s{s} double" for s in range(states)))
    rows = np.zeros((k + states + 2, states))
    for r in got.groupBy("row").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).collect():
        rows[r["row"]] = r[1:]
    return {"emit": rows[:k].T, "move": rows[k : k + states], "start": rows[k + states]}, float(rows[k + states + 1, 0])


SCORED = "kind int, uid bigint, _id {id}, _held boolean, n bigint, known bigint, base double, score double, token binary, uids array<bigint>, times array<int>"


def first_scores(docs: DataFrame, frequent: list[bytes], counts: list[int], model: dict, id_type: str) -> DataFrame:
    """Rows of kind 0: documents with what the frequent words give; of kind 1: rare words with their documents.

    A rare word is sent once for all the documents of some megabytes of text, not once for each.
    """
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts, model))

    def run(batches):
        words, c, own = sent.value
        code, known = symbols_of(words), np.array([*(int(x > 0) for x in c), 0], np.int64)
        logs = np.log10(np.array([*c, 0], float) + 1)
        task, uid = TaskContext.get().partitionId(), 0
        schema = None
        for batch in batches:
            for part in slices(batch, 2, 16_000_000):
                ids, rare, doc = [], [], []
                for i, text in enumerate(byte_texts(part.column(2))):
                    ws = tokens(text)
                    ids.append(own_ids := code.encode(ws))
                    odd = np.flatnonzero(own_ids == code.rare).tolist()
                    rare += [ws[j] for j in odd]
                    doc += [i] * len(odd)
                m = len(ids)
                lengths = np.fromiter(map(len, ids), np.int64, m)
                flat, owner = np.concatenate(ids), np.repeat(np.arange(m), lengths)
                base, n_known = np.bincount(owner, logs[flat], m), np.bincount(owner, known[flat], m).astype(np.int64)
                score = log10_forward(own, ids)
                uids = (task << 36) + uid + np.arange(m)
                uid += m
                if schema is None:
                    schema = pa.schema([("kind", pa.int32()), ("uid", pa.int64()), ("_id", part.schema.field(0).type), ("_held", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("token", pa.binary()), ("uids", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
                none = lambda k, n: pa.nulls(n, schema.field(k).type)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(uids), part.column(0), part.column(1), pa.array(lengths), pa.array(n_known), pa.array(base), pa.array(score), *(none(k, m) for k in (8, 9, 10))], schema=schema)
                if rare:
                    number: dict[bytes, int] = {}
                    at = np.fromiter((number.setdefault(w, len(number)) for w in rare), np.int64, len(rare))
                    pair, times = np.unique(at * m + np.array(doc), return_counts=True)
                    edge = np.searchsorted(pair // m, np.arange(len(number) + 1))
                    lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), v) for v in (pa.array(uids[pair % m]), pa.array(times, pa.int32()))]
                    k = len(number)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), *(none(j, k) for j in range(1, 8)), pa.array(list(number), pa.binary()), *lists], schema=schema)

    return docs.select("_id", "_held", "_text").mapInArrow(run, SCORED.format(id=id_type))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(id as text) modulo folds isn't `held` are learnt from. A null text is empty: its end is its
    only token. Repeated rows repeat, and count as often; a null id counts as 'null'. Very long texts are learnt and scored
    whole. With nothing to learn from, both scores are 0; no documents give no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), (crc_remainder(id_col, folds) == held).alias("_held"), F.col(text_col).cast("string").alias("_text"))
    table = materialize(count_tokens(rows), "tokens")
    total, distinct = table.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    top = table.where((F.col("c") >= max(1, total / FREQUENT)) | (F.length("token") == 0)).collect() if total else []
    known = {bytes(r["token"]): r["c"] for r in top}
    known.setdefault(END, 0)
    frequent = sorted(known)
    counts = [known[w] for w in frequent]
    rare_tokens, rare_words = total - sum(counts), distinct - sum(c > 0 for c in counts)
    share = (np.array([*counts, rare_tokens], float) + 0.5) / (total + 0.5 * (len(counts) + 1))
    model = start_model(share)
    if total:
        symbols = materialize(training_symbols(rows, frequent), "symbols")
        for _ in range(rounds):
            model = maximized(baum_welch_round(symbols, model)[0], share)
        forget(symbols)
    else:
        model["emit"] = np.ones((STATES, 2))
    made = materialize(first_scores(rows, frequent, counts, model, id_type), "scores")
    words = made.where("kind = 1").select("token", "uids", "times").join(table, "token", "left")
    pairs = words.select(F.coalesce("c", F.lit(0)).alias("c"), F.explode(F.arrays_zip("uids", "times")).alias("p"))
    times = F.col("p.times")
    rest = pairs.groupBy(F.col("p.uids").alias("uid")).agg(F.sum(times * F.log10(F.col("c") + 1)).alias("r"), F.sum(times).alias("rn"), F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("rk"))
    out = made.where("kind = 0").join(rest, "uid", "left")
    zero = F.lit(0)
    r, rn = F.coalesce("r", F.lit(0.0)), F.coalesce("rn", zero)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rk", zero)).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + r - F.col("n") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("score") + r - rn * float(np.log10(rare_tokens + rare_words + 1))).alias("score"),
    )
