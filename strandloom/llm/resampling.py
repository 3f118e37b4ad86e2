"""Importance resampling towards a target corpus, by postings inverted into buckets.

Features (runs of 1 to N words) are hashed into BUCKETS buckets. Every document gives a posting (bucket, document, count)
for each of its buckets; a task inverts the postings of some documents at a time and packs them by range of buckets. A
shuffle brings the postings of a range together with both corpora's counts for its buckets. There the buckets' gains, log
ratios of their smoothed shares, are computed, every posting contributes count times gain, and the contributions are summed
by document. Documents are dealt to blocks of bounded size, and a range's postings of each block are a group of their own,
so that buckets that every document has make no group large.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import dense_numbers
from .common import byte_texts, forget, materialize, plain_words, slices

BUCKETS, WORDS, SEED = 10_000, 1, 2024
#: Documents with fewer words are not drawn; of the others this share is.
LEAST_WORDS, PERCENT = 20, 10
#: Ranges of buckets, and documents of a block, about: a group has the postings of one range and one block.
RANGES, BLOCK_DOCUMENTS = 16, 50_000
#: Documents whose postings are inverted together: so many bytes of texts; a longer text is inverted alone.
SLICE = 4_000_000


class _Buckets(dict):
    """feature (bytes) -> bucket, remembered up to a fixed number of features."""

    LIMIT = 400_000

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[feature] = n = zlib.crc32(feature) % self.buckets
        return n


_known: dict[int, _Buckets] = {}


def features(words: list[bytes], most: int) -> list[bytes]:
    """All runs of 1 to `most` consecutive words, joined by one space."""
    return words + [b" ".join(words[i : i + n]) for n in range(2, most + 1) for i in range(len(words) - n + 1)]


def postings(texts: DataFrame, words: int, buckets: int) -> DataFrame:
    """For rows (_id, _row, _text), rows of two sorts.

    (_id, _row, n_words, n_features) of a document; (_range, _base, _bucket, _place, _count) of a range of buckets and some
    documents: lists of postings in order of their buckets, the document being _row = _base + _place.
    """

    def run(batches):
        known = _known.setdefault(buckets, _Buckets(buckets))
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                rows = np.asarray(part.column(1))
                n_words, n_features, keys, counts = [], [], [], []
                for text in byte_texts(part.column(2)):
                    own = plain_words(text)
                    all_ = features(own, words)
                    n_words.append(len(own))
                    n_features.append(len(all_))
                    k, c = np.unique(np.fromiter(map(known.__getitem__, all_), np.int32, len(all_)), return_counts=True)
                    keys.append(k)
                    counts.append(c)
                n = len(rows)
                none = [pa.nulls(n, t) for t in LISTS]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *none], NAMES)
                base = int(rows.min())
                place = np.repeat(rows - base, [len(k) for k in keys])
                key, count = np.concatenate(keys), np.concatenate(counts)
                order = np.argsort(key, kind="stable")
                key, place, count = key[order], place[order], count[order]
                own, begin = np.unique(key * RANGES // buckets, return_index=True)
                offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key, place, count)]
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, part.column(0).type), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.array(own.astype(np.int32)), pa.array(np.full(n, base)), *lists], NAMES)

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.select("_id", "_row", "_text").mapInArrow(run, f"_id {kind}, _row bigint, n_words bigint, n_features bigint, _range int, _base bigint, _bucket array<int>, _place array<int>, _count array<int>")


NAMES = ["_id", "_row", "n_words", "n_features", "_range", "_base", "_bucket", "_place", "_count"]
LISTS = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]


def bucket_counts(table: DataFrame) -> DataFrame:
    lists = table.where("_range is not null").select(F.inline(F.arrays_zip("_bucket", "_count"))).toDF("_bucket", "_n")
    return lists.groupBy("_bucket").agg(F.sum("_n").alias("_n"))


def gains(own: np.ndarray, all_own: int, target: np.ndarray, all_target: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of a bucket's share of the target over its share of the corpus, each with one added to every bucket."""
    share = (target + 1).astype(float) * float(all_own + buckets) / ((own + 1).astype(float) * float(all_target + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def gumbel(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u by the id's SHA-256; a null id counts as the text 'null'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, words: int, buckets: int, block: int) -> DataFrame:
    """(_id, _row, n_words, n_features, weight); _row numbers the rows of docs, in no order."""
    rows = docs.select(docs[id_col].alias("_id"), F.monotonically_increasing_id().alias("_row"), docs[text_col].cast("string").alias("_text"))
    table = materialize(postings(rows, words, buckets), "postings")
    own_rows, lists = table.where("_row is not null"), table.where("_range is not null")
    aim = target.select(F.lit(0).alias("_id"), F.monotonically_increasing_id().alias("_row"), target[target_text].cast("string").alias("_text"))
    zero = F.lit(0).cast("bigint")
    both = bucket_counts(table).select("_bucket", F.col("_n").alias("_own"), zero.alias("_aim")).unionAll(bucket_counts(postings(aim, words, buckets)).select("_bucket", zero, "_n"))
    counts = materialize(both.groupBy("_bucket").agg(F.sum("_own").alias("_own"), F.sum("_aim").alias("_aim")), "counts")  # a row a bucket
    all_own, all_aim = (int(x or 0) for x in counts.agg(F.sum("_own"), F.sum("_aim")).first())
    blocks = max(1, -(-own_rows.count() // block))
    dealt = lists.select("_range", F.pmod(F.xxhash64("_base"), F.lit(blocks)).cast("int").alias("_block"), "_base", "_bucket", "_place", "_count")
    corpora = counts.select(F.floor(F.col("_bucket").cast("bigint") * RANGES / buckets).cast("int").alias("_range"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), "_bucket", "_own", "_aim")

    def contributions(left: pa.Table, right: pa.Table) -> pa.Table:
        of = np.zeros(buckets, np.int64)
        of[np.asarray(right["_bucket"])] = gains(np.asarray(right["_own"]), all_own, np.asarray(right["_aim"]), all_aim, buckets)
        flat = lambda name: left[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.asarray(pc.list_value_length(left["_place"])).astype(np.int64)
        row = np.repeat(np.asarray(left["_base"]), size) + flat("_place")
        row, at = np.unique(row, return_inverse=True)
        total = np.zeros(len(row), np.int64)
        np.add.at(total, at, flat("_count") * of[flat("_bucket")])
        return pa.table([row, total], ["_row", "_part"])

    met = dealt.groupBy("_range", "_block").cogroup(corpora.groupBy("_range", "_block")).applyInArrow(contributions, "_row bigint, _part bigint")
    total = met.groupBy("_row").agg(F.sum("_part").alias("_total"))
    out = own_rows.select("_id", "_row", "n_words", "n_features").join(total, "_row", "left")
    mean = F.when(F.col("n_features") > 0, F.floor(F.col("_total") / F.col("n_features"))).otherwise(zero)
    out = materialize(out.select("_id", "_row", "n_words", "n_features", mean.alias("weight")), "weights")
    forget(table, counts)
    return out


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", words: int = WORDS, buckets: int = BUCKETS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, block: int = BLOCK_DOCUMENTS,
) -> DataFrame:
    """A row for each document: id, n_features, weight, score, rank; rank is null for those that aren't drawn.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. weight is the floored mean
    of the gains of a document's features (0 without any), score adds a Gumbel number that the seed and the id fix. Of the
    documents with least_words words or more, percent of a hundred are drawn, highest scores first, which is sampling
    without replacement by exp(weight / 1000); ties go to the smaller id, null last, and then to either. Null and empty
    texts have no words. Repeated rows are documents of their own. An empty target has a count of 0 in every bucket; no
    documents give no rows. Texts are read whole; columns of docs may have any names.
    """
    all_ = weights(docs, target, id_col, text_col, target_text, words, buckets, block).withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed))
    may = all_.where(F.col("n_words") >= least_words).select((-F.col("score")).alias("_low"), F.col("_id").isNull().alias("_null"), "_id", "_row")
    drawn = percent * may.count() // 100
    order = dense_numbers(may, ["_low", "_null", "_id", "_row"], "rank").where(F.col("rank") < drawn).select("_row", (F.col("rank") + 1).alias("rank"))
    return all_.join(order, "_row", "left").select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


#: The same in DuckDB's SQL; CRC-32 by a table of 256 entries that a rule makes.
ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS x FROM benchmark),
own AS MATERIALIZED (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY ALL),
aim AS MATERIALIZED (SELECT x, count(*) AS n FROM bw GROUP BY x),
v AS MATERIALIZED (SELECT x, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(x))), 2), lambda i: ('0x' || substr(hex(encode(x)), i, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) % 10000 AS k FROM (SELECT DISTINCT x FROM own UNION SELECT x FROM aim), crc),
s AS (SELECT k, sum(n) AS s FROM own JOIN v USING (x) GROUP BY k), t AS (SELECT k, sum(n) AS t FROM aim JOIN v USING (x) GROUP BY k),
g AS MATERIALIZED (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM own) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM aim), 0) + 10000)::DOUBLE)))::BIGINT AS g FROM s FULL JOIN t USING (k)),
m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM own JOIN v USING (x) JOIN g USING (k) GROUP BY doc_id),
d AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM d WHERE n_words >= 20)
SELECT d.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM d LEFT JOIN r USING (doc_id)
"""
