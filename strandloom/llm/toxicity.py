"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by all thresholds theta_0 < theta_1 < ... The features
are a few hundred words and beginnings of words that set toxic documents apart, as 1 + log(count). The result is the expected grade.

Grades of the labelled documents: 0 where toxic is 0. Toxic ones are dealt to 1, 2 and 3 by what a model says of them that
has not seen them: the sample is cut in two halves (copies stay together), a two-grade model of each half, with features of
its own, rates the toxic documents of the other, and the thirds of that rating are the grades.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, plain_words, slices

#: Labelled documents in the training sample, of either label, at most (about so many labels are drawn for it).
SAMPLE_DOCS = 3000
MOST_FEATURES, LEAST_G2 = 400, 24.0
GRADES = 4


def copy_group(words: list[bytes]) -> bytes:
    """The same for texts that are copies, and mostly for near copies: the smallest hash of five words."""
    return min((hashlib.blake2b(b" ".join(words[i : i + 5]), digest_size=8).digest() for i in range(max(1, len(words) - 4))), default=b"")


def signs(word: bytes) -> list[bytes]:
    """Features of a word: itself, and its beginnings of 4 to 9 bytes (marked by a '^')."""
    return [word, *(b"^" + word[:n] for n in range(4, min(10, len(word))))]


def g2(a: np.ndarray, n: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Log-likelihood ratio of a word in a of the toxic and n of all groups; negative where it is rarer in toxic ones."""
    table = [(a, n * toxic / total), (n - a, n * (total - toxic) / total), (toxic - a, (total - n) * toxic / total), (total - toxic - n + a, (total - n) * (total - toxic) / total)]
    value = sum(2 * np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0) for o, e in table)
    return np.where(a * total >= n * toxic, value, -value)


def choose_features(docs: list[tuple[bytes, dict[bytes, int], bool]]) -> list[bytes]:
    """Words whose presence depends on the label, of (group, words, toxic); copies, which share a group, count once."""
    seen, n, a = set(), Counter(), Counter()
    groups = [0, 0]
    for group, words, t in docs:
        if (group, t) in seen:
            continue
        seen.add((group, t))
        own = {f for w in words for f in signs(w)}
        n.update(own)
        groups[t] += 1
        if t:
            a.update(own)
    names = [w for w, k in n.items() if k >= 5]
    if not names or not all(groups):
        return []
    value = g2(np.array([a[w] for w in names], float), np.array([n[w] for w in names], float), groups[1], sum(groups))
    order = sorted(range(len(names)), key=lambda i: (-abs(value[i]), names[i]))[:MOST_FEATURES]
    return [names[i] for i in order if abs(value[i]) >= LEAST_G2]


class WordFeatures(dict):
    """word -> numbers of its features (the word and its beginnings), remembered up to a fixed number of words."""

    LIMIT = 400_000

    def __init__(self, index: dict[bytes, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = tuple(self.index[f] for f in signs(word) if f in self.index)
        return found

    def of(self, words: dict[bytes, int]) -> dict[int, float]:
        total: Counter[int] = Counter()
        for w, k in words.items():
            for j in self[w]:
                total[j] += k
        return {j: 1 + float(np.log(k)) for j, k in total.items()}


def fit(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 600, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean negative log-likelihood; steps of the thresholds stay positive."""
    w, raw = np.zeros(x.shape[1]), np.concatenate([[1.0], np.zeros(grades - 2)])
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, raw)]
    rows = np.arange(len(y))
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        below = 1 / (1 + np.exp(-np.clip(theta[None] - (x @ w)[:, None], -40, 40)))
        cdf = np.concatenate([np.zeros((len(y), 1)), below, np.ones((len(y), 1))], 1)
        p = np.maximum(cdf[rows, y + 1] - cdf[rows, y], 1e-12)
        slope = cdf * (1 - cdf)
        up, down = slope[rows, y + 1] / p, slope[rows, y] / p
        gw = x.T @ ((up - down) / len(y)) + ridge * w
        gt = np.zeros(grades + 1)
        np.add.at(gt, y + 1, -up / len(y))
        np.add.at(gt, y, down / len(y))
        gt = np.cumsum(gt[1:grades][::-1])[::-1]
        for j, (param, g) in enumerate(((w, gw), (raw, gt * np.concatenate([[1.0], np.exp(raw[1:])])))):
            m, v = state[j]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def features(names: list[bytes], docs: list[dict[bytes, int]]) -> np.ndarray:
    found, x = WordFeatures({w: i for i, w in enumerate(names)}), np.zeros((len(docs), len(names)), np.float32)
    for row, words in zip(x, docs):
        for j, v in found.of(words).items():
            row[j] = v
    return x


def grades(docs: list[tuple[bytes, dict[bytes, int], bool]]) -> np.ndarray:
    """0 for documents that aren't toxic, 1 to GRADES - 1 for the others, by a model of the other half (1 if it can't tell)."""
    toxic = np.array([t for _, _, t in docs])
    half = np.array([sum(group) % 2 for group, _, _ in docs])
    out = toxic.astype(np.int64)
    for h in (0, 1):
        mine, rest = np.flatnonzero(toxic & (half == h)), [d for d, x in zip(docs, half) if x != h]
        names = choose_features(rest)
        if not len(mine) or not names:
            continue
        w, _ = fit(features(names, [words for _, words, _ in rest]), np.array([int(t) for _, _, t in rest]), 2, 200)
        rating = features(names, [docs[i][1] for i in mine]) @ w
        cuts = np.quantile(rating, np.arange(1, GRADES - 1) / (GRADES - 1))
        out[mine] = 1 + np.searchsorted(cuts, rating, side="left")
    return out


def train(docs: list[tuple[bytes, dict[bytes, int], bool]]) -> dict | None:
    """Features, weights and thresholds; None if the labels don't tell anything."""
    names = choose_features(docs)
    if not names:
        return None
    w, theta = fit(features(names, [words for _, words, _ in docs]), grades(docs), GRADES)
    return {"index": {n: i for i, n in enumerate(names)}, "w": w, "theta": theta}


def above(model: dict, docs: list[list[bytes]]) -> np.ndarray:
    """(documents, thresholds): P(grade > k)."""
    found = model.setdefault("found", WordFeatures(model["index"]))
    s = np.array([sum(model["w"][j] * v for j, v in found.of(Counter(words)).items()) for words in docs], float)
    return 1 / (1 + np.exp(np.clip(model["theta"][None] - s[:, None], -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str, most: int) -> list[tuple[bytes, dict[bytes, int], bool]]:
    """(group, words with counts, toxic) of `most` documents of either label at most; no text is shuffled or collected.

    A hash draws about `most` labelled ids, which are broadcast to the scan. Of the different texts with those ids, as ids
    may repeat, those of the smallest hashes are taken.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isin(0, 1)).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(F.col(toxic_col).cast("int")).alias("t"))
    counts = {r[0]: r[1] for r in known.groupBy("t").count().collect()}
    rate = {t: int(2**30 * min(1.0, most / max(1, counts.get(t, 0)))) for t in (0, 1)}
    picked = known.where(F.pmod(F.xxhash64(F.lit(21), "id"), F.lit(2**30)) < F.when(F.col("t") == 1, rate[1]).otherwise(rate[0]))
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.join(F.broadcast(picked), "id").select("t", "text", F.xxhash64("text").alias("h"))  # about 2 * most ids

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1):
                words = [plain_words(t) for t in byte_texts(part.column(1))]
                tally = [Counter(w) for w in words]
                columns = [part.column(0), part.column(2), pa.array([copy_group(w) for w in words], pa.binary()), pa.array([b" ".join(c) for c in tally], pa.binary()), pa.array([np.array(list(c.values()), np.int32).tobytes() for c in tally], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["t", "h", "g", "words", "n"])

    rows = own.mapInArrow(count, "t int, h bigint, g binary, words binary, n binary").dropDuplicates(["t", "h"])
    out = [r for t in (0, 1) for r in rows.where(F.col("t") == t).orderBy("h").limit(most).collect()]
    known: dict[bytes, bytes] = {}  # a word is held once, however many documents have it
    words = lambda r: [known.setdefault(w, w) for w in bytes(r["words"]).split()]
    return [(bytes(r["g"]), dict(zip(words(r), np.frombuffer(bytes(r["n"]), np.int32).tolist())), bool(r["t"])) for r in sorted(out, key=lambda r: (r["t"], r["h"]))]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """A row for each document: id, severity (expected grade), grade, p_toxic, toxic (p_toxic of 0.5 or more).

    Null and empty texts have no features and get the base rate; repeated rows repeat, and count once in training. Very long
    texts are read whole. Labels other than 0 and 1, of a null id or without document don't count; an id labelled both ways
    is toxic. Ids may be of any type. If nothing can be learned all is 0; no documents give no rows.
    """
    rows = training_rows(docs, labels, id_col, text_col, toxic_col, sample_docs)
    model = docs.sparkSession.sparkContext.broadcast(train(rows))

    def score(batches):
        for batch in batches:
            for part in slices(batch, 1):
                words = [plain_words(t) for t in byte_texts(part.column(1))]
                p = above(model.value, words) if model.value else np.zeros((len(words), GRADES - 1))
                columns = [p.sum(1), (p >= 0.5).sum(1).astype(np.int32), p[:, 0].copy(), p[:, 0] >= 0.5]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], ["_id", "severity", "grade", "p_toxic", "toxic"])

    ddl = f"_id {docs.schema[id_col].dataType.simpleString()}, severity double, grade int, p_toxic double, toxic boolean"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(score, ddl).withColumnRenamed("_id", id_col)
