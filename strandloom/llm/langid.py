"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A forward and a backward GRU read the bytes, a softmax over both states labels every position, and a document's
probabilities are the mean over all its positions. Long texts are read in windows; both directions start CONTEXT bytes
outside a window (or at the text's edge), so that states at its positions have read as much of the text as in training.
Training is backpropagation through time with Adam, on the driver, on stretches from all over the texts of a bounded sample
of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, crc_remainder, slices

HIDDEN = 8
#: Bytes of a stretch that training reads; what a direction reads before a window's first position; bytes of a window.
LENGTH = CONTEXT = 64
WINDOW = 448
#: Labelled documents in the sample, for each language, about, and stretches of each, from hashed places of the whole text.
SAMPLE_DOCS, STRETCHES = 600, 16
#: How often languages are drawn is broadcast up to this many of them, some ten times what the world has.
BROADCAST_LANGUAGES = 100_000


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def start_model(classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters of both directions: a table of byte inputs G, recurrent U, bias; and the output layer.

    Rows of G, U and b are the update gate z, the reset gate r and the candidate n, of HIDDEN units each.
    """
    rng = np.random.default_rng(seed)
    model = {"V": rng.normal(0, 0.3, (classes, 2 * HIDDEN)), "c": np.zeros(classes)}
    for d in "fb":
        model |= {f"G{d}": rng.normal(0, 0.3, (256, 3 * HIDDEN)), f"U{d}": rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)), f"q{d}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gradients(model: dict, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients of a batch: bytes x (T, B), class y (B), mask (T, B) of positions that count."""
    T, B = x.shape
    H, grad, saved, states = HIDDEN, {k: np.zeros_like(v) for k, v in model.items()}, {}, {}
    for d in "fb":
        G, U, q = model[f"G{d}"], model[f"U{d}"], model[f"q{d}"]
        h, hs, keep = np.zeros((B, H), np.float32), np.zeros((T, B, H), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a = G[x[t]] + q
            s = _sigmoid(a[:, : 2 * H] + h @ U[: 2 * H].T)
            z, r = s[:, :H], s[:, H:]
            n = np.tanh(a[:, 2 * H :] + (r * h) @ U[2 * H :].T)
            new = h + mask[t][:, None] * z * (n - h)
            keep.append((t, h, z, r, n))
            h = hs[t] = new
        saved[d], states[d] = keep, hs
    both = np.concatenate([states["f"], states["b"]], 2)
    logits = both @ model["V"].T + model["c"]
    e = np.exp(logits - logits.max(2, keepdims=True))
    p = e / e.sum(2, keepdims=True)
    weight = mask / mask.sum()
    loss = -float((np.log(p[:, np.arange(B), y] + 1e-9) * weight).sum())
    dl = p.copy()
    dl[:, np.arange(B), y] -= 1
    dl *= weight[:, :, None]
    grad["V"] = np.einsum("tbc,tbh->ch", dl, both)
    grad["c"] = dl.sum((0, 1))
    dboth = dl @ model["V"]
    for d, lo in (("f", 0), ("b", H)):
        U, dh = model[f"U{d}"], np.zeros((B, H), np.float32)
        for t, h, z, r, n in reversed(saved[d]):
            dh = dh + dboth[t, :, lo : lo + H]
            m = mask[t][:, None]
            dn = dh * m * z * (1 - n * n)
            dz = dh * m * (n - h) * z * (1 - z)
            drh = dn @ U[2 * H :]
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            np.add.at(grad[f"G{d}"], x[t], da)
            grad[f"q{d}"] += da.sum(0)
            grad[f"U{d}"][: 2 * H] += da[:, : 2 * H].T @ h
            grad[f"U{d}"][2 * H :] += dn.T @ (r * h)
            dh = dh * (1 - m * z) + drh * r + da[:, : 2 * H] @ U[: 2 * H]
    return loss, grad


def train(texts: list[bytes], classes: list[int], n_classes: int, steps: int = 260, batch: int = 160, length: int = LENGTH, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on random windows; every class is drawn as often as any other."""
    model, rng = start_model(n_classes, seed), np.random.default_rng(seed)
    of = [[i for i, c in enumerate(classes) if c == k and texts[i]] for k in range(n_classes)]
    of = [(k, rows) for k, rows in enumerate(of) if rows]
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    for step in range(1, steps + 1 if of else 1):
        x, mask, y = np.zeros((length, batch), np.uint8), np.zeros((length, batch), np.float32), np.zeros(batch, np.int64)
        for j in range(batch):
            y[j], rows = of[rng.integers(len(of))]
            text = texts[rows[rng.integers(len(rows))]]
            at = rng.integers(max(1, len(text) - length + 1))
            piece = np.frombuffer(text[at : at + length], np.uint8)
            x[: len(piece), j], mask[: len(piece), j] = piece, 1
        _, grad = gradients(model, x, y, mask)
        rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] = (model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def halved(model: dict) -> dict:
    """Gate rows halved, so that one tanh serves gates and candidate alike."""
    out = {"V": model["V"], "c": model["c"][:, None]}
    for d in "fb":
        half = np.ones(3 * HIDDEN, np.float32)
        half[: 2 * HIDDEN] = 0.5
        out |= {f"G{d}": np.ascontiguousarray((model[f"G{d}"] + model[f"q{d}"]) * half), f"U{d}": np.ascontiguousarray(model[f"U{d}"] * half[:, None])}
    return out


def window_probabilities(fast: dict, x: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of the positions' probabilities for windows x (T, B) of the given lengths, (classes, B).

    Of each window the positions from first to before last count, the others are context. Windows are sorted by falling
    length: at any position those that go on are the first ones.
    """
    T, B = x.shape
    H, states = HIDDEN, []
    live = np.searchsorted(-lengths, -np.arange(T), "left").tolist()
    G, U, h = fast["Gf"], fast["Uf"], np.zeros((H, B), np.float32)
    for t in range(T):
        n = live[t]
        h = _step(G, U, x[t, :n], h[:, :n])
        states.append(h)
    out = np.zeros((len(fast["c"]), B), np.float32)
    G, U, h = fast["Gb"], fast["Ub"], np.zeros((H, 0), np.float32)
    Vf, Vb = np.ascontiguousarray(fast["V"][:, :H]), np.ascontiguousarray(fast["V"][:, H:])
    lead, tail = int(first.max()), int(last.min())
    for t in range(T - 1, -1, -1):
        n = live[t]
        if h.shape[1] < n:
            h = np.concatenate([h, np.zeros((H, n - h.shape[1]), np.float32)], 1)
        h = _step(G, U, x[t, :n], h)
        if t < lead or t >= tail:
            counts = (first[:n] <= t) & (t < last[:n])
            if not counts.any():
                continue
        else:
            counts = None
        e = Vf @ states[t]
        e += Vb @ h
        e += fast["c"]
        e -= e.max(0)
        np.exp(e, e)
        e /= e.sum(0)
        out[:, :n] += e if counts is None else e * counts
    return out


def _step(G: np.ndarray, U: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    H = HIDDEN
    a = G.take(x, 0).T
    s = U[: 2 * H] @ h
    s += a[: 2 * H]
    np.tanh(s, s)
    s *= 0.5
    s += 0.5
    n = U[2 * H :] @ (s[H:] * h)
    n += a[2 * H :]
    np.tanh(n, n)
    n -= h
    n *= s[:H]
    n += h
    return n


def document_probabilities(fast: dict, texts: list[bytes], most: int = 1024) -> np.ndarray:
    """(documents, classes): the mean over all bytes of every text; rows of empty texts are 0."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    pieces = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(sizes) - sizes)[owner]
    low, high = nth * WINDOW, np.minimum((nth + 1) * WINDOW, sizes[owner])
    start, end = np.maximum(low - CONTEXT, 0), np.minimum(high + CONTEXT, sizes[owner])
    order = np.argsort(start - end, kind="stable")
    data = np.concatenate([data, np.zeros(WINDOW + 2 * CONTEXT, np.uint8)])
    total = np.zeros((len(texts), len(fast["c"])))
    for i in range(0, len(order), most):
        rows = order[i : i + most]
        length = (end - start)[rows]
        x = data[(begin + start)[rows] + np.arange(length[0])[:, None]]
        np.add.at(total, owner[rows], window_probabilities(fast, x, length, (low - start)[rows], (high - start)[rows]).T)
    return total / np.maximum(1, sizes)[:, None]


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_rule, most_docs: int) -> tuple[list[str], list[bytes], list[int]]:
    """Languages, and stretches of about most_docs texts of each, which hashes of the ids pick out of all labelled rows.

    The stretches of a text begin anywhere in it. The driver gets one row for each language and the sample; no text is
    shuffled up to BROADCAST_LANGUAGES languages.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & train_rule)
    known = known.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col)).alias("h"))  # many rows may share a null id
    counts = sorted(tuple(r) for r in known.groupBy("l").agg(F.count(F.lit(1))).collect())
    langs = [name for name, _ in counts]
    rate = docs.sparkSession.createDataFrame([(name, int(min(1.0, most_docs / n) * 2**30)) for name, n in counts], "l string, rate bigint")
    if len(counts) <= BROADCAST_LANGUAGES:
        rate = F.broadcast(rate)
    drawn = known.join(rate, "l").where(F.pmod("h", F.lit(2**30)) < F.col("rate"))
    room = F.greatest(F.lit(1), F.length("t") - LENGTH + 1)
    places = F.transform(F.sequence(F.lit(1), F.lit(STRETCHES)), lambda i: (1 + F.pmod(F.xxhash64(i, "h"), room)).cast("int"))
    stretches = F.array_distinct(F.transform(places, lambda at: F.col("t").substr(at, F.lit(LENGTH))))
    rows = drawn.select(F.explode(stretches).alias("t"), "l").distinct().collect()
    rows = sorted((r["l"], r["t"]) for r in rows)
    number = {name: i for i, name in enumerate(langs)}
    return langs, [t.encode() for _, t in rows], [number[name] for name, _ in rows]


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, sample_docs: int = SAMPLE_DOCS, keep: bool = False
) -> DataFrame:
    """A row for each document: id, held_out, lang_pred, score. With keep, the columns of docs come first instead of id.

    The model learns from documents with a language whose crc32(id as text) modulo folds isn't `held`; a prediction
    sees the text alone. score is the mean probability of lang_pred over all bytes. A text that is null or has no letter
    (of any alphabet) gets 'und' and 0, and so do all if there's nothing to learn from. Repeated rows repeat; a null id
    counts as 'null'. Very long texts are read whole; of equal probabilities the language that sorts first is predicted.
    No documents give no rows. Columns may have any names.
    """
    out = crc_remainder(id_col, folds) == held
    langs, texts, classes = labelled_sample(docs, id_col, text_col, lang_col, ~out, sample_docs)
    fast = docs.sparkSession.sparkContext.broadcast((langs, halved(train(texts, classes, len(langs)))) if langs else ([], None))

    def predict(batches):
        names, model = fast.value
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            for part in slices(batch, at):
                texts = byte_texts(part.column(at))
                letters = [has_letter(t.decode()) for t in texts]
                p = document_probabilities(model, texts) if names else np.zeros((len(texts), 1))
                best = p.argmax(1)
                lang = [names[b] if ok and names else "und" for ok, b in zip(letters, best)]
                score = [min(1.0, float(p[i, b])) if ok and names else 0.0 for i, (ok, b) in enumerate(zip(letters, best))]
                rest = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang), pa.array(score)], [n for n in batch.schema.names if n != "_text"] + ["_lang", "_score"])

    kept = docs.columns if keep else [id_col]
    inner = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)), out.alias("_held"), F.col(text_col).cast("string").alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema if f.name != "_text") + ", _lang string, _score double"
    done = inner.mapInArrow(predict, ddl)
    return done.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)), F.col("_held").alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def in_known_language(
    docs: DataFrame, least_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """The documents whose text isn't 'und' to identify() and whose score is least_score or more, all columns as they were.

    Columns of docs may have the names of identify()'s results. If there's nothing to learn from, no document stays. Null
    and empty texts go, every one of repeated rows stays or goes, long texts are judged whole; no documents give none.
    """
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    at = {n: c for n, c in zip(names, own)}
    named = identify(docs.toDF(*own), at[id_col], at[text_col], at[lang_col], folds, held, sample_docs, keep=True)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select(*own).toDF(*names)
