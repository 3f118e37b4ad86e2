"""Benchmark decontamination: passages within a word edit distance of a benchmark item.

A passage matches an item of W words if it can be made of it by at most d = RATE * W edits of whole words (case and
punctuation don't count). Windows of an item's size are embedded by CGK random walks: the walk copies the word it stands on
and moves on by a random bit of (step, word), so that few edits leave most of the walk alike. Samples of a few places of
the walks are hash keys. Items of similar size are a bucket; for each bucket so many samples, of so few places, are drawn
that the target recall is reached at distance d for its items, as measured on edited copies of them. Where no number of
samples reaches it, as for very long items whose walks part for good, every window of the lossless filter below is a
candidate. What shares a key is verified by an exact edit distance.

A window can only match if W - 1 - 2d of the item's pairs of neighbouring words are in a stretch of W + d words. Only
windows where that many pairs of items of that size are in such a stretch are embedded: this loses nothing. Items of a
single word have no pairs; they match where the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_texts, mixed, plain_words, slices

RATE, RECALL = 0.15, 0.999
#: Walks, and what is tried for a bucket of items, cheapest first: places of a sample and number of samples.
WALKS, PLANS = 16, ((3, 64), (3, 256), (2, 256), (1, 128))
#: Sizes of a bucket's items differ by this factor at most; so many edited items measure its recall.
BUCKET, MEASURED = 1.25, 160
#: Items in one pass over the documents, and their bytes: what is broadcast is bounded, more items take more passes.
PASS_ITEMS, PASS_BYTES = 20_000, 16_000_000
#: Words embedded at a time.
CHUNK_WORDS = 400_000


def edits(words: int, rate: float = RATE) -> int:
    return min(int(rate * words), max(0, (words - 2) // 2))


def least_distance(item: list, text: list) -> tuple[int, int]:
    """The edit distance of item to the nearest stretch of text, and where that ends: bit-parallel, a column a step."""
    size = len(item)
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << size - 1
    pv, mv, score, best, end = full, 0, size, size, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def embed(windows: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of rows of word numbers, three times as long; -2 where a walk has left its window."""
    n, width = windows.shape
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, 3 * width), np.int64)
    for step in range(3 * width):
        word = out[:, step] = np.where(at < sizes, windows[rows, np.minimum(at, width - 1)], -2)
        bit = mixed(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * WALKS + walk + 1)) >> np.uint64(63)
        at += bit.astype(np.int64)
    return out


def sampled(windows: np.ndarray, sizes: np.ndarray, places: int, tables: int, rng_seed: int = 1) -> np.ndarray:
    """(windows, tables): the hash of the size and the sampled places of a walk for each table."""
    spots, rows = np.random.default_rng(rng_seed).random((tables, places)), np.arange(len(windows))
    out = np.empty((len(windows), tables), np.uint64)
    for w in range(min(WALKS, tables)):
        walk = embed(windows, sizes, w)
        for t in range(w, tables, WALKS):
            h = mixed(sizes.astype(np.uint64) + np.uint64(1000 * (t + 1)))
            for u in spots[t]:
                h = mixed(h * np.uint64(31) + walk[rows, (u * 2 * sizes).astype(np.int64)].astype(np.uint64))
            out[:, t] = h
    return out


def padded(items: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(items), max(map(len, items))), -2, np.int64)
    for row, item in zip(out, items):
        row[: len(item)] = item
    return out


def keys(windows: np.ndarray, sizes: np.ndarray, plan: tuple[int, int]) -> np.ndarray:
    """sampled() in runs of some windows, as a walk takes three numbers a word."""
    step = max(1, CHUNK_WORDS // windows.shape[1])
    parts = [sampled(windows[i : i + step], sizes[i : i + step], *plan) for i in range(0, len(windows), step)]
    return np.concatenate(parts) if parts else np.zeros((0, plan[1]), np.uint64)


def edited(item: np.ndarray, times: int, rng: np.random.Generator) -> np.ndarray:
    """An item after random deletions, insertions and replacements, cut or filled to its size as a window would be."""
    words = item.tolist()
    for _ in range(times):
        at, kind = int(rng.integers(len(words))), int(rng.integers(3))
        words[at : at + (kind != 1)] = [] if kind == 0 and len(words) > 1 else [-1]
    return np.array((words + [-1] * len(item))[: len(item)])


def walks_alike(items: list[np.ndarray], rate: float) -> np.ndarray:
    """(walks, items): the share of sampled places that the walks of items and of edited copies have alike.

    The longest items are taken, edited as much as allowed.
    """
    rng = np.random.default_rng(5)
    longest = sorted(items, key=len)[-MEASURED:]
    some = [longest[i % len(longest)] for i in range(max(16, min(MEASURED, CHUNK_WORDS // 8 // len(longest[-1]))))]
    sizes = np.array([len(c) for c in some])
    mine, other = padded(some), padded([edited(c, edits(len(c), rate), rng) for c in some])
    alike = [embed(mine, sizes, w) == embed(other, sizes, w) for w in range(WALKS)]
    return np.array([[row[: 2 * n].mean() for row, n in zip(a, sizes)] for a in alike])


def chance_of_keys(alike: np.ndarray, plan: tuple[int, int]) -> float:
    """The mean chance that edited items share a key with their items, over any draw of the samples.

    A sample hits with the share of places alike, to the power of its places; samples are independent, so that few edited
    items tell small chances of a miss.
    """
    places, tables = plan
    times = np.array([len(range(w, tables, WALKS)) for w in range(WALKS)])
    return float(1 - ((1 - alike**places) ** times[:, None]).prod(0).mean())


def plan_for(items: list[np.ndarray], rate: float, recall: float) -> tuple[int, int] | None:
    """The cheapest plan that reaches the recall for these items, None if none does."""
    alike = walks_alike(items, rate)
    return next((plan for plan in PLANS if chance_of_keys(alike, plan) >= recall), None)


class Matcher:
    """Items of one pass, ready for search."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float = RATE, recall: float = RECALL):
        words = [(id_, plain_words(text)) for id_, text in items]
        self.items = sorted(((id_, w) for id_, w in words if w), key=lambda x: len(x[1]))
        self.number = {w: i for i, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.rate = rate
        if not self.items:
            return
        coded = [np.array([self.number[w] for w in ws], np.int64) for _, ws in self.items]
        size = np.array([len(c) for c in coded])
        self.width = int(size.max())
        self.gap = self.width + edits(self.width, rate) + 1
        self.single: dict[int, list[int]] = {}
        for i in np.flatnonzero(size == 1):
            self.single.setdefault(int(coded[i][0]), []).append(int(i))
        # buckets of items, by size: (largest size, plan); for each plan the sorted keys and their items
        self.buckets: list[tuple[int, tuple[int, int] | None]] = []
        made: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        lo = int((size < 2).sum())
        while lo < len(coded):
            hi = int(np.searchsorted(size, size[lo] * BUCKET, "right"))
            plan = plan_for(coded[lo:hi], rate, recall)
            if plan:
                flat = keys(padded(coded[lo:hi]), size[lo:hi], plan)
                made.setdefault(plan, []).append((flat.ravel(), lo + np.arange(flat.size) // plan[1]))
            self.buckets.append((int(size[hi - 1]), plan))
            lo = hi
        self.index: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for plan, parts in made.items():
            flat, owner = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(flat, kind="stable")
            self.index[plan] = (flat[order], owner[order])
        self.repeats: dict[int, int] = {}
        for c in coded:
            twice = len(c) - 1 - len(set(zip(c[:-1].tolist(), c[1:].tolist())))
            self.repeats[len(c)] = max(self.repeats.get(len(c), 0), twice)
        # every pair of neighbouring words, with the sizes of the items it is in and its places there
        long = [c for c in coded if len(c) > 1]
        pair = np.concatenate([np.zeros(0, np.int64), *(c[:-1] * len(self.number) + c[1:] for c in long)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.full(len(c) - 1, len(c)) for c in long)])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c) - 1) for c in long)])
        owner = np.repeat(np.flatnonzero(size > 1), size[size > 1] - 1)
        order = np.lexsort((owner, place, sizes, pair))
        table = np.stack([pair, sizes, place], 1)[order]
        fresh = np.concatenate([[True], (table[1:] != table[:-1]).any(1)]) if len(table) else np.zeros(0, bool)
        self.pair_size, self.pair_place, self.pair_owner = table[fresh, 1], table[fresh, 2], owner[order]
        self.owner_first = np.append(np.flatnonzero(fresh), len(table))  # the items of each entry
        self.pairs, self.pair_first, self.pair_count = np.unique(table[fresh, 0], return_index=True, return_counts=True)

    def windows(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, starts, spots, entries) of the windows that may match, sizes in order: each begins where a pair of it stands as in an item.

        The entries are those of the pairs' table that gave a window. If the text lacks the item's first words, a start is
        in the gap before the text.
        """
        both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        if not len(both) or not len(self.pairs):
            return
        key = codes[both] * len(self.number) + codes[both + 1]
        spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        there = self.pairs[spot] == key
        both, spot = both[there], spot[there]
        n = self.pair_count[spot]
        entry = np.repeat(self.pair_first[spot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(both, n)
        order = np.lexsort((at, self.pair_size[entry]))
        at, entry = at[order], entry[order]
        size, place = self.pair_size[entry], self.pair_place[entry]
        pair_at, pair_of = np.full(len(codes), -1, np.int64), np.full(len(codes), -1, np.int64)
        pair_of[both] = spot
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(size)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            own = int(size[lo])
            d = edits(own, self.rate)
            spots, back = np.unique(at[lo:hi], return_inverse=True)
            need = max(1, own - 1 - 2 * d)
            if len(spots) < need:
                continue
            k = np.flatnonzero(spots[need - 1 :] - spots[: len(spots) - need + 1] <= own + d - 2)
            if not len(k):
                continue
            # the same pair over and over counts as often as an item has it: at least so many must differ
            pair_at[spots] = pair_of[spots]
            good = []
            for some in np.array_split(k, -(-len(k) * own // CHUNK_WORDS)):
                stretch = np.sort(pair_at[np.minimum(spots[some][:, None] + np.arange(own + d - 1), len(codes) - 1)], 1)
                differ = (np.diff(stretch, axis=1) != 0).sum(1) + (stretch[:, 0] >= 0)
                good.append(some[differ >= need - self.repeats[own]])
            pair_at[spots] = -1
            k = np.concatenate(good)
            edge = np.zeros(len(spots) + 1, np.int64)
            np.add.at(edge, k, 1)
            np.add.at(edge, k + need, -1)
            inside = (np.cumsum(edge[:-1]) > 0)[back]
            if inside.any():
                yield own, (at[lo:hi] - place[lo:hi])[inside], at[lo:hi][inside], entry[lo:hi][inside]

    def search(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end word) of the best match of each text and item that match."""
        if not self.items:
            return []
        get = self.number.get
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths + self.gap) - lengths  # a gap before each text and after the last one
        codes = np.full(int((lengths + self.gap).sum()) + self.gap, -1, np.int64)
        for at, words in zip(begin, texts):
            codes[at : at + len(words)] = [get(w, -1) for w in words]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if self.single:
            for at in np.flatnonzero(np.isin(codes, list(self.single))).tolist():
                text = int(np.searchsorted(begin, at, "right")) - 1
                for item in self.single[int(codes[at])]:
                    found.setdefault((text, item), (0, at - int(begin[text]) + 1))
        bucket = 0
        sampled_: dict[tuple[int, int], list[np.ndarray]] = {}
        candidates: set[tuple[int, int, int]] = set()
        for own, starts, spots, entries in self.windows(codes):
            while self.buckets[bucket][0] < own:
                bucket += 1
            plan = self.buckets[bucket][1]
            text_of = np.searchsorted(begin, spots, "right") - 1
            if plan is None:
                first, last = self.owner_first[entries], self.owner_first[entries + 1]
                candidates.update((int(x), int(t), int(s)) for a, b, t, s in zip(first, last, text_of, starts) for x in self.pair_owner[a:b])
            else:
                both = np.unique(text_of * (2 * len(codes)) + starts + len(codes))
                sampled_.setdefault(plan, []).append(np.stack([both // (2 * len(codes)), both % (2 * len(codes)) - len(codes), np.full(len(both), own)]))
        for plan, parts in sampled_.items():
            candidates |= self.sharing(codes, *np.concatenate(parts, 1), plan)
        self.verify(texts, begin, candidates, found)
        return [(text, item, *v) for (text, item), v in sorted(found.items())]

    def sharing(self, codes: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray, plan: tuple[int, int]) -> set[tuple[int, int, int]]:
        """(item, text, start) of windows that share a key with an item; windows come by rising size, some at a time."""
        hashes, owner = self.index[plan]
        out: set[tuple[int, int, int]] = set()
        lo = 0
        while lo < len(size):
            # what is embedded together is about as wide, and bounded
            hi = int(np.searchsorted(size, 4 * size[lo], "right"))
            hi = min(hi, lo + max(1, CHUNK_WORDS // int(size[hi - 1])))
            some, own = start[lo:hi], size[lo:hi]
            width = int(own[-1])
            k = keys(codes[np.clip(some[:, None] + np.arange(width), 0, len(codes) - 1)], own, plan).ravel()
            a, b = np.searchsorted(hashes, k, "left"), np.searchsorted(hashes, k, "right")
            for i in np.flatnonzero(b > a):
                w = lo + i // plan[1]
                out.update((int(item), int(text[w]), int(start[w])) for item in owner[a[i] : b[i]])
            lo = hi
        return out

    def verify(self, texts, begin: np.ndarray, candidates: set[tuple[int, int, int]], best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds the best exact match of the candidates (item, text, start) to best."""
        done: tuple[int, int, int] = (-1, -1, -1)
        for item, text, start in sorted(candidates):
            words = self.items[item][1]
            d = edits(len(words), self.rate)
            lo = max(0, start - int(begin[text]) - d)
            hi = lo + len(words) + 3 * d + 1
            if done[:2] == (item, text) and hi <= done[2]:
                continue
            hi += len(words)  # covers the windows that come next, which overlap with this one
            done = (item, text, hi)
            distance, end = least_distance(words, texts[text][lo:hi])
            if distance <= d and (distance, lo + end) < best.get((text, item), (d + 1, 0)):
                best[text, item] = (distance, lo + end)


def passes(benchmark: DataFrame, item_col: str, text_col: str, rate: float, recall: float) -> Iterator[Matcher]:
    """Matchers for all items, some at a time; the driver never holds more than one pass's items."""
    some: list[tuple[object, bytes]] = []
    size = 0
    for row in benchmark.where(F.col(text_col).isNotNull()).select(item_col, F.col(text_col).cast("string")).toLocalIterator():
        some.append((row[0], row[1].encode()))
        size += len(some[-1][1])
        if len(some) >= PASS_ITEMS or size >= PASS_BYTES:
            yield Matcher(some, rate, recall)
            some, size = [], 0
    if some:
        yield Matcher(some, rate, recall)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, recall: float = RECALL
) -> DataFrame:
    """A row for each document and item that it has a passage of: id, item, edit_distance, item_words, end_word.

    The best match counts, the first of equal ones; end_word is where it ends, in words without punctuation. Null and
    empty texts and items match nothing, an item of one word matches every text that has the word. A null item id or
    document id is kept. Repeated documents and repeated items give repeated rows, empty tables none. Texts are searched
    whole, whatever their length, and so are items.
    """
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (benchmark, item_col)))
    item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    names = (id_col, item_col if item_col != id_col else f"{item_col}_item", "edit_distance", "item_words", "end_word")
    out = None
    for matcher in passes(benchmark, item_col, item_text_col, rate, recall):
        sent = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches, sent=sent):
            items = sent.value.items
            for batch in batches:
                for part in slices(batch, 1):
                    found = sent.value.search([plain_words(t) for t in byte_texts(part.column(1))])
                    if found:
                        text, item, distance, end = zip(*found)
                        columns = [pa.array([items[i][0] for i in item], item_arrow), pa.array(distance, pa.int32()), pa.array([len(items[i][1]) for i in item], pa.int32()), pa.array(end, pa.int32())]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text, pa.int32())), *columns], list("abcde"))

        one = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"a {id_type}, b {item_type}, c int, d int, e int")
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"a {id_type}, b {item_type}, c int, d int, e int")
    return out.toDF(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """The documents without passage of any item, all columns as they were; nothing is shuffled.

    Nulls, empty and long texts, repeats and empty tables are as in leaks(): a null or empty text stays, every one of
    repeated documents stays or goes, and without items all documents stay. Columns may have any names.
    """
    at, names = docs.columns.index(text_col), docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for matcher in passes(benchmark, item_col, item_text_col, rate, recall):
        sent = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches, sent=sent):
            for batch in batches:
                for part in slices(batch, at):
                    hit = {t for t, *_ in sent.value.search([plain_words(t) for t in byte_texts(part.column(at))])}
                    yield part.filter(pa.array([i not in hit for i in range(part.num_rows)])) if hit else part

        inner = inner.mapInArrow(run, inner.schema)
    return inner.toDF(*names)
