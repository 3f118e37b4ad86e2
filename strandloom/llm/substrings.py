"""Removal of repeated passages: every word of a window of WINDOW words that has occurred before.

Anchors are short windows at the positions of a difference cover: of any two positions modulo PERIOD, some shift of at most
PERIOD - 1 takes both onto the cover, so that two equal passages of WINDOW words share an anchor of WINDOW - PERIOD + 1
words that lies at the same place in either. Only anchors are counted over all documents; a passage that holds an anchor of
another one is extended to the whole windows around it, and these are compared by 80 bits. Both passes send one row for
each key that a task has seen, so that frequent passages are small, and no group is ever held in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, forget, materialize, mixed, slices

WINDOW = 20
# Perfect difference sets by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Repeated anchors that a filter of 32 MB is made of and sent to all tasks; beyond so many they are joined by a shuffle.
MOST_FILTER_KEYS = 20_000_000
FILTER_BITS, PROBES = 1 << 28, 3
#: Bytes of texts that are hashed at once; a longer text is hashed alone.
SLICE, BLOCK = 8_000_000, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_rng = np.random.default_rng(2027)
_LETTER = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407))


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The period of a window and its difference cover: the longest period that leaves anchors of a third of the window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= max(2, window // 3))
    return period, COVERS[period]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, BLOCK + 1)
            one = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
            self.up, self.down = one(_BASE), one(pow(_BASE, -1, 1 << 64))
        return self.up, self.down


_powers = _Powers()


class Words:
    """The words of some texts, as places in one buffer: starts, ends, and for each text the number of its first word."""

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        space = _SPACE[self.buffer]
        before = np.concatenate([np.ones(1, bool), space[:-1]]) if len(space) else space
        self.starts, self.ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        self.first = np.searchsorted(self.starts, begin)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word: a polynomial of its letters' random numbers, by running sums over blocks of whole words."""
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            low = self.starts[at]
            end = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK, "right")))
            size = int(self.ends[end - 1] - low)
            up, down = _powers.upto(size + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[self.buffer[low : low + size]] * up[:size])])
            a, b = self.starts[at:end] - low, self.ends[at:end] - low
            out[at:end] = mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            at = end
        return out

    def offsets(self) -> np.ndarray:
        """For each word its number within its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def left(self) -> np.ndarray:
        """For each word how many words of its text there are from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """For each text its kept words, joined by single spaces."""
        edge = np.zeros(len(self.buffer) + 1, np.int8)
        np.add.at(edge, self.starts[keep], 1)
        np.add.at(edge, self.ends[keep] + 1, -1)  # the byte behind a word, made a space, goes with it
        taken = self.buffer.copy()
        taken[self.ends] = 32
        taken = taken[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
        size = np.where(keep, self.ends - self.starts + 1, 0)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[self.first]
        return [taken[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def runs(h: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes, put together from runs of powers of two."""
    join = lambda a, b: mixed(a * odd + b)
    out, size, power, width = None, 0, h, 1
    while True:
        if n & width:
            out, size = (power, width) if out is None else (join(out[: len(h) - size - width + 1], power[size : len(h) - width + 1]), size + width)
        if size == n or len(h) < n:
            return out if len(h) >= n else h[:0]
        power, width = join(power[: len(h) - 2 * width + 1], power[width : len(h) - width + 1]) if len(h) >= 2 * width else power[:0], 2 * width


def anchors(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places among all words, hashes) of the anchors of texts that have a window."""
    period, places = cover(window)
    size = window - period + 1
    on = np.zeros(period, bool)
    on[list(places)] = True
    at = words.offsets()
    ok = on[at % period] & (words.left() >= size) & (words.left() + at >= window)
    at = np.flatnonzero(ok)
    return at, runs(h, size, _ODD[0])[at]


def filter_of(keys: DataFrame, name: str) -> np.ndarray:
    """FILTER_BITS bits at most, of which each key sets PROBES; keys are hashes. Made of one row for each 4 KB of the filter."""
    size = 1 << 23
    while size < min(FILTER_BITS, 16 * keys.count()):
        size *= 2
    shift = 64 - size.bit_length() + 1
    spots = [F.shiftrightunsigned(F.shiftleft(name, 21 * i), shift) for i in range(PROBES)]
    spot = keys.select(F.explode(F.array(*spots)).alias("h"))
    rows = spot.groupBy(F.floor(F.col("h") / 32768).alias("k")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in rows.collect():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["k"] * 4096 : r["k"] * 4096 + len(own)] = own
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    out = np.ones(len(h), bool)
    for i in range(PROBES):
        spot = (h << np.uint64(21 * i)) >> shift
        out &= ((bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return out


def ranks(ids: pa.Array, keys: np.ndarray) -> np.ndarray:
    """The order of the rows by id, null last, then key; equal rows are equal."""
    by_id = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
    order = np.lexsort((keys, by_id))
    step = np.concatenate([np.zeros(1, np.int64), ((np.diff(by_id[order]) != 0) | (np.diff(keys[order]) != 0)).astype(np.int64)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def find_repeats(rows: DataFrame, window: int, most_filter_keys: int) -> DataFrame:
    """(_id, _k, _at, _gone): starts of the windows that have occurred before, one (_at) or several (_gone) a row.

    rows: _id, _k (a hash of the text), _text. Documents come in the order of _id and _k.
    """
    period, _ = cover(window)
    spark = rows.sparkSession

    def count(batches):
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                words = Words(byte_texts(part.column(0)))
                _, own = anchors(words, words.hashes(), window)
                own, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["_anchor", "_n"])

    counted = rows.select("_text").mapInArrow(count, "_anchor bigint, _n int")
    twice = materialize(counted.groupBy("_anchor").agg(F.sum("_n").alias("_n")).where("_n > 1").select("_anchor"), "anchors")
    sent = None
    if twice.count() <= most_filter_keys:
        sent = spark.sparkContext.broadcast(filter_of(twice, "_anchor"))  # 32 MB at most
        marked = rows
        forget(twice)
    else:
        marked = _marks(rows, twice, window)
    ddl = f"_w bigint, _c smallint, _id {rows.schema['_id'].dataType.simpleString()}, _k bigint, _at int, _gone binary"  # packed: lists that are null are slow to write

    def spread(batches):
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                yield from _windows(part, window, period, None if sent is None else sent.value)

    route = F.coalesce("_w", F.xxhash64("_id", "_k"))
    dealt = marked.mapInArrow(spread, ddl).repartition(route).sortWithinPartitions("_w", "_c", F.asc_nulls_last("_id"), "_k", "_at")
    return dealt.mapInArrow(later, ddl.split(", ", 2)[2])


def _marks(rows: DataFrame, twice: DataFrame, window: int) -> DataFrame:
    """rows with _marks, the repeated anchors of each, by joins: one row for each document and anchor."""
    ddl = f"_id {rows.schema['_id'].dataType.simpleString()}, _k bigint, _anchor bigint"

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                words = Words(byte_texts(part.column(2)))
                at, own = anchors(words, words.hashes(), window)
                doc = np.searchsorted(words.first, at, "right") - 1
                pair = np.unique(np.rec.fromarrays([doc, own]))
                doc = pa.array(pair.f0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(pair.f1.view(np.int64))], ["_id", "_k", "_anchor"])

    own = rows.select("_id", "_k", "_text").mapInArrow(run, ddl).join(twice, "_anchor", "left_semi")
    lists = own.groupBy("_id", "_k").agg(F.collect_set("_anchor").alias("_marks")).select(F.col("_id").alias("_i"), F.col("_k").alias("_j"), "_marks")
    joined = rows.join(lists, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_j")), "left")
    return joined.select(*rows.columns, F.coalesce("_marks", F.array().cast("array<bigint>")).alias("_marks"))


def _windows(part: pa.RecordBatch, window: int, period: int, bits: np.ndarray | None):
    """The windows around repeated anchors: of each the first in this part, and the starts of those that it makes repeats.

    bits: a filter of repeated anchors; without one they are listed for each row.
    """
    keys = np.asarray(part.column(1))
    order = ranks(part.column(0), keys)
    _, first = np.unique(order, return_index=True)
    if len(first) < len(order):  # equal rows are one document
        first.sort()
        part, keys, order = part.take(pa.array(first)), keys[first], order[first]
    words = Words(byte_texts(part.column(2)))
    h = words.hashes()
    at, own = anchors(words, h, window)
    if bits is not None:
        known = passes(bits, own)
    else:
        doc = np.searchsorted(words.first, at, "right") - 1
        marks = part.column(3)
        known = np.zeros(len(at), bool)
        for d in np.unique(doc).tolist():
            known[doc == d] = np.isin(own[doc == d].view(np.int64), np.asarray(marks[d].values))
    near = np.zeros(len(h) + 1, np.int64)
    near[at[known] + 1] = 1
    near = np.cumsum(near)
    start = np.flatnonzero(words.left() >= window)
    start = start[near[start + period] > near[start]]
    if not len(start):
        return
    doc = np.searchsorted(words.first, start, "right") - 1
    place = start - words.first[doc]
    w, c = runs(h, window, _ODD[0])[start], runs(h, window, _ODD[1])[start].view(np.int64).astype(np.int16)
    by = np.lexsort((place, order[doc], c, w))
    new = np.concatenate([np.ones(1, bool), (np.diff(w[by]) != 0) | (np.diff(c[by]) != 0)])
    first, gone = np.sort(by[new]), np.sort(by[~new])
    columns = [part.column(0), part.column(1)]
    lead = pa.array(doc[first])
    yield pa.RecordBatch.from_arrays(
        [pa.array(w[first].view(np.int64)), pa.array(c[first]), *(x.take(lead) for x in columns), pa.array(place[first].astype(np.int32)), pa.nulls(len(first), pa.binary())],
        ["_w", "_c", "_id", "_k", "_at", "_gone"],
    )
    if len(gone):
        own, begin = np.unique(doc[gone], return_index=True)
        lists = pa.array([x.tobytes() for x in np.split(place[gone].astype("<i4"), begin[1:])], pa.binary())
        lead, n = pa.array(own), len(own)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int16()), *(x.take(lead) for x in columns), pa.nulls(n, pa.int32()), lists], ["_w", "_c", "_id", "_k", "_at", "_gone"])


def later(batches):
    """Of windows in order of their hashes and documents, all but the first of each hash; lists of repeats pass."""
    carry = None
    for batch in batches:
        there = np.asarray(pc.is_valid(batch.column(0)))
        if not there.all():
            lists = batch.filter(pa.array(~there))
            yield pa.RecordBatch.from_arrays(lists.columns[2:], lists.schema.names[2:])
            batch = batch.filter(pa.array(there))
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        w, c = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        new = np.concatenate([np.ones(1, bool), (np.diff(w) != 0) | (np.diff(c) != 0)])
        first = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
        ids = np.asarray(pc.fill_null(batch.column(2).dictionary_encode().indices, -1))
        k, at = np.asarray(batch.column(3)), np.asarray(batch.column(4))
        other = (ids != ids[first]) | (k != k[first]) | (at != at[first])
        out = batch.filter(pa.array(other))
        if out.num_rows:
            yield pa.RecordBatch.from_arrays(out.columns[2:], out.schema.names[2:])
        carry = batch.slice(int(first[-1]), 1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_filter_keys: int = MOST_FILTER_KEYS) -> DataFrame:
    """A row for each document: id, n_words, n_removed, kept_text.

    A word goes if it is covered by a window of `window` words that also starts earlier: in a document of a smaller id, or
    earlier in the same one. Windows are judged on the texts as given. kept_text is the words that stay, joined by single
    spaces. Words are what stands between ASCII white space, as written. Null and empty texts have no words and an empty
    kept_text. Null ids come last; rows that share an id come in the order of a hash of their texts, and rows equal in id
    and text are one document, so that each of them gets the same result. Long texts are read whole. No documents give no
    rows; columns of docs may have any names.
    """
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_k"), text.alias("_text"))
    gone = find_repeats(rows, window, most_filter_keys)
    kind = rows.schema["_id"].dataType.simpleString()
    null = lambda t: F.lit(None).cast(t)
    both = gone.select("_id", "_k", F.lit(0).alias("_doc"), "_at", "_gone", null("string").alias("_text"))
    both = both.unionAll(rows.select("_id", "_k", F.lit(1), null("int"), null("binary"), "_text"))
    dealt = both.repartition("_id", "_k").sortWithinPartitions(F.asc_nulls_last("_id"), "_k", "_doc")  # a document behind its repeats
    out = dealt.mapInArrow(lambda batches: _clean(batches, window), f"_id {kind}, n_words bigint, n_removed bigint, kept_text string")
    return out.withColumnRenamed("_id", id_col)


def _clean(batches, window: int):
    """Rows _id, n_words, n_removed, kept_text of sorted rows _id, _k, _doc, _at, _gone, _text; equal documents share the starts."""
    key, held = None, np.zeros(0, np.int64)  # the document that the last row was of, and its starts so far
    for batch in batches:
        for part in slices(batch, 5, SLICE):
            n = part.num_rows
            k, doc = np.asarray(part.column(1)), np.asarray(part.column(2)) == 1
            ids = np.asarray(pc.fill_null(part.column(0).dictionary_encode().indices, -1))
            new = np.concatenate([np.zeros(1, bool), (np.diff(ids) != 0) | (np.diff(k) != 0)])
            new[0] = key != (part.column(0)[0].as_py(), int(k[0]))
            group = np.cumsum(new)
            several = np.asarray(pc.fill_null(pc.binary_length(part.column(4)), 0)).astype(np.int64) // 4
            packed = np.frombuffer(b"".join(part.column(4).drop_null().to_pylist()), "<i4").astype(np.int64)
            single = np.asarray(pc.is_valid(part.column(3)))
            start = np.concatenate([held, np.asarray(part.column(3).drop_null()).astype(np.int64), packed])
            owner = np.concatenate([np.zeros(len(held), np.int64), group[single], np.repeat(group, several)])
            order = np.argsort(owner, kind="stable")
            start, owner = start[order], owner[order]
            key, held = (part.column(0)[n - 1].as_py(), int(k[n - 1])), start[owner == group[-1]]
            if not doc.any():
                continue
            texts = part.filter(pa.array(doc))
            words = Words(byte_texts(texts.column(5)))
            low, high = np.searchsorted(owner, group[doc]), np.searchsorted(owner, group[doc], "right")
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            at = start[at] + np.repeat(words.first[:-1], size)
            cut = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(cut, at, 1)
            np.add.at(cut, at + window, -1)
            keep = np.cumsum(cut[:-1]) == 0
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(~keep)])
            kept = pa.array(words.joined(keep), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts.column(0), pa.array(words.counts), pa.array(np.diff(total[words.first])), kept], ["_id", "n_words", "n_removed", "kept_text"])


#: The digest columns of the query in DuckDB's SQL, by grouping all windows.
ORACLE = r"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
h AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE nth > 1),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
