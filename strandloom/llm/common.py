"""Helpers shared by the text operators: shared scratch folders, stable hashes and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: [^\x20\x09-\x0D]+ as Java and SQL write it; bytes.split() without arguments splits the same way.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session may leave it unset, a cluster may not."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/strandloom"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no result reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables of the text operators in the shared folder, once their results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strandloom")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bits of a key filter at most: 32 MB to broadcast. Beyond some 30 million keys it only lets more rows pass.
MOST_FILTER_BITS = 1 << 28


def key_filter(keys: DataFrame, name: str) -> np.ndarray:
    """A filter for the values of a string column: one bit by hash, some ten for each key, MOST_FILTER_BITS at most."""
    size = 1 << 20
    n = keys.count()
    while size < MOST_FILTER_BITS and size < 10 * n:
        size *= 2
    h = F.pmod(F.xxhash64(F.col(name)), F.lit(size))
    rows = keys.select(h.alias("h")).groupBy(F.floor(F.col("h") / 32768).alias("k")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in rows.collect():  # one for each 4 KB of the filter
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["k"] * 4096 : r["k"] * 4096 + len(own)] = own
    return out


def may_hold(bits: np.ndarray, keys: list[str | None]) -> np.ndarray:
    """Which keys the filter lets pass: all that it was made of, and few others; null never."""
    h = np.fromiter((0 if k is None else xxhash.xxh64_intdigest(k, 42) % (len(bits) * 8) for k in keys), np.int64, len(keys))
    there = np.fromiter((k is not None for k in keys), bool, len(keys))
    return there & ((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1).astype(bool)


def split_by_filter(df: DataFrame, key: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The rows whose key the filter lets pass, and the others; neither is shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(bits)  # MOST_FILTER_BITS at most
    at = df.columns.index(key)

    def part(wanted: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(may_hold(sent.value, batch.column(at).to_pylist()) == wanted))

        return df.mapInArrow(run, df.schema)

    return part(True), part(False)


def crc_remainder(id_col: str, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % divisor


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows_hashed(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out = mixed(out + h[i : len(h) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return out


def arrow_rows(schema: pa.Schema, size: int = 2000):
    """A collector of rows that yields a record batch whenever it has enough of them."""
    return _Rows(schema, size)


class _Rows:
    def __init__(self, schema: pa.Schema, size: int):
        self.schema, self.size, self.rows = schema, size, []

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
            self.rows = []


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts take about most_bytes together; a longer text is a run of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    run = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, of which some may be 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


#: ASCII letters in lower case, everything else of ASCII that is no letter or digit as a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.translate(_PLAIN).split()
