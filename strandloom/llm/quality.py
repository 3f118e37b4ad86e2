"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted texts and the whole corpus.

Words and word pairs are hashed into a fixed number of buckets. The corpus' multinomial counts all documents, the target's
a bounded sample of those labelled good. A document's score is the mean of log target - log corpus over its n-grams;
documents below a fixed threshold fail, as do those that break the plain rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, mixed, slices, sums, windows_hashed

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Trusted documents of which the target's counts are made, about (a hash of the id picks them).
TRUSTED_SAMPLE = 20_000
#: Mean log ratio an n-gram that a document must reach.
THRESHOLD = -0.15
SPACES, SYMBOLS = " \t\n\r\x0b\f", "#*$%&|<>"
REPEAT = 8

_words = WordHashes()


def ngram_buckets(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of consecutive texts, and the number of the text each belongs to."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[1:] == text[:-1]
    pairs = windows_hashed(hashes, 2)[inside] if len(hashes) > 1 else np.zeros(0, np.uint64)
    buckets = np.concatenate([mixed(hashes), pairs]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([text, text[1:][inside]])


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and the number of words of each."""
    split = [t.split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    return np.concatenate([np.zeros(0, np.uint64), *(_words.array(w) for w in split)]), lengths


def trusted_ids(labels: DataFrame, id_col: str, quality_col: str, most: int) -> np.ndarray:
    """Hashes of the ids of about `most` documents labelled good, or of all if there are fewer."""
    good = labels.where(F.col(quality_col) == 1).where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("id")).distinct()
    n = good.count()
    if n > most:
        good = good.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return np.unique(np.array([r[0] for r in good.collect()], np.int64))


def bucket_ratios(docs: DataFrame, trusted: np.ndarray, id_col: str, text_col: str) -> np.ndarray:
    """log target - log corpus of every bucket. Tasks send sums of buckets; the driver gets one row for each bucket."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                hashes, lengths = hashed_words(byte_texts(part.column(1)))
                buckets, text = ngram_buckets(hashes, lengths)
                good = np.isin(np.asarray(part.column(0)), trusted)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[good[text]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("id"), F.col(text_col).cast("string")).mapInArrow(count, "bucket int, raw bigint, target bigint")
    total = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[total["bucket"]], target[total["bucket"]] = total["raw"], total["target"]
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    return share(target) - share(raw)


def repeated_words(hashes: np.ndarray, lengths: np.ndarray, size: int = REPEAT) -> np.ndarray:
    """For each text, its words in windows of `size` words that occur twice or more in that text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    windows = windows_hashed(hashes, size)
    if not len(windows):
        return np.zeros(len(lengths), np.int64)
    owner = text[: len(windows)]
    whole = np.flatnonzero(owner == text[size - 1 :])
    if not len(whole):
        return np.zeros(len(lengths), np.int64)
    keys = mixed(windows[whole] + owner[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1], [False]])
    starts = whole[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), lengths)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    threshold: float = THRESHOLD,
    trusted_sample: int = TRUSTED_SAMPLE,
) -> DataFrame:
    """A row for each document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    A null text has no words and fails as every text of under 20 words; its llr is 0. Repeated rows repeat, and count as
    often. Very long texts are counted whole; a score that equals the threshold is kept. Ids may be of any type, labels of a
    null id or without document don't count. Without any trusted document all n-grams of the corpus weigh about alike and
    only the plain rules decide. No documents give no rows.
    """
    trusted = trusted_ids(labels, id_col, quality_col, trusted_sample)
    ratios = docs.sparkSession.sparkContext.broadcast(bucket_ratios(docs, trusted, id_col, text_col))
    verdict = bool(len(trusted))
    names = ["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]

    def score(batches):
        table = ratios.value
        for batch in batches:
            for part in slices(batch, 1):
                raw = byte_texts(part.column(1))
                texts = [x.decode() for x in raw]
                hashes, lengths = hashed_words(raw)
                buckets, text = ngram_buckets(hashes, lengths)
                total = np.bincount(text, table[buckets], len(raw))
                llr = total / np.maximum(1, np.bincount(text, minlength=len(raw)))
                repeats = repeated_words(hashes, lengths)
                chars = [len(t) - sum(map(t.count, SPACES)) for t in texts]
                symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
                failed = (lengths < 20) | (100 * repeats > 30 * lengths)
                kept = ~failed & ((llr >= threshold) | (not verdict))
                columns = [lengths, np.array(chars, np.int64), np.array(symbols, np.int64), np.array([duplicate_lines(t) for t in texts], np.int64), repeats, failed, kept, llr]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names)

    ddl = f"_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, llr double"
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(score, ddl).withColumnRenamed("_id", id_col)
