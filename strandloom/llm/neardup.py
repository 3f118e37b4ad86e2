"""Documents of similar word n-grams: a MinHash LSH forest joined with itself, verified exactly.

Copies (equal sets of word 5-grams) are one node. A node has TREES signatures of LEVELS min-hashes; sorted, the signatures
of a tree are a trie, and nodes below the same prefix are candidates. The first round takes whole signatures as prefixes.
Its verified links tell how many links of every degree of similarity there must be (a link of similarity s is found with a
known chance), and so how many are still missing; prefixes are shortened, round by round, until the target recall is
reached. A round only compares nodes on different branches below a shortened prefix: the others have met before.

Nodes under a prefix are compared in blocks of bounded size with their full sets; pairs live in arrays inside a task and
never become rows: a task sends for each node its number of links and the links of a spanning forest, which give the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, forget, key_filter, materialize, mixed, slices, split_by_filter, windows_hashed

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
TREES, LEVELS = 16, 8
#: Nodes of equal prefix are cut into blocks of at most about so many shingles and nodes.
BLOCK_SHINGLES, BLOCK_NODES = 1_000_000, 1024
#: Rows that are compared at once, about: two blocks.
RUN_ROWS = 2 * BLOCK_NODES
#: Links are counted by similarity in steps of 0.01; recall is looked at in bands of so many steps.
STEPS, BAND = 100, 5

_hashes = WordHashes()
_hashes.LIMIT = 100_000  # workers are used again by other stages, which need memory too


def shingles(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one n-gram, an empty one has none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _hashes.array(words)
    return np.unique(windows_hashed(h, n if len(h) >= n else len(h)))


def digest(own: np.ndarray) -> str | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, TREES * LEVELS) bytes of min-hashes; no set may be empty."""
    rng = np.random.default_rng(99)
    multiplier = rng.integers(1 << 62, 1 << 63, TREES * LEVELS, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), TREES * LEVELS), np.uint8)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = mixed(flat)
    for i, m in enumerate(multiplier):
        v = flat * m
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = (mixed(np.minimum.reduceat(v, starts)) >> np.uint64(40)).astype(np.uint8)
    return out


def recall_at(similarity: np.ndarray | float, depth: int, trees: int = TREES):
    """The chance that a pair shares a prefix of this depth in one of the trees."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def least_agreement(threshold: float) -> float:
    """Pairs whose signatures agree in a smaller share of places are no candidates: at the threshold, 7 deviations off.

    A link is lost by this with a chance of 1e-11 or less.
    """
    return threshold - 7 * float(np.sqrt(threshold * (1 - threshold) / (TREES * LEVELS)))


def missing(found: np.ndarray, depth: int, now: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated links, and those of them that depth `depth` would miss, by band of similarity.

    found: links by steps of similarity that depth `now` and longer prefixes gave, each with the chance of recall_at().
    """
    steps = np.arange(STEPS + 1)
    low = np.maximum(steps / STEPS, threshold)
    total = found / recall_at(low, now)
    band = np.minimum((low * STEPS + 1e-9).astype(int), STEPS - 1) // BAND
    return np.bincount(band, total), np.bincount(band, total * (1 - recall_at(low, depth)))


def enough(found: np.ndarray, depth: int, now: int, threshold: float, recall: float) -> bool:
    """Whether prefixes of this depth reach the recall: in every band that has links, and in all bands together.

    Together, every band is given one link that nobody has seen, so that empty bands aren't taken on trust.
    """
    if depth <= 1:
        return True
    total, lost = missing(found, depth, now, threshold)
    edges = np.maximum(np.arange(len(total)) * BAND / STEPS, threshold)[int(threshold * STEPS + 1e-9) // BAND :]
    unseen = float((1 / recall_at(edges, depth) - 1).sum())
    return bool((lost <= (1 - recall) * total).all()) and lost.sum() + unseen <= (1 - recall) * max(1.0, total.sum())


def next_depth(found: np.ndarray, now: int, threshold: float, recall: float) -> int:
    """The longest prefix that reaches the recall, as far as the links found up to now tell; now if that is it."""
    return next(d for d in range(now, 0, -1) if enough(found, d, now, threshold, recall))


def nodes_of(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """For each document: digest of its set (null if empty), size of it, signature and set; other columns stay in front."""
    names = [c for c in docs.columns if c != text_col]
    docs = docs.select(*names, F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(names)):
                sets = [shingles(t.split(), words) for t in byte_texts(part.column(len(names)))]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full]) if full else ()):
                    sig[i] = row.tobytes()
                own = [s.tobytes() if len(s) else None for s in sets]
                columns = [pa.array([digest(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sig, pa.binary()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + columns, [*names, "_node", "_size", "_sig", "_set"])
        _hashes.clear()

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text"), "_node string, _size int, _sig binary, _set binary"])
    return docs.mapInArrow(run, ddl)


def grouped(batches: Iterator[pa.RecordBatch], largest: int) -> Iterator[pa.RecordBatch]:
    """Batches that never end inside a run of rows of equal first column. The runs are bounded by the blocks' size.

    A batch has RUN_ROWS rows, or the rows of a single run: what is compared at once takes memory by its pairs. largest: the
    number of the column that takes most bytes.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        for part in slices(batch, largest, 32_000_000):
            key = part.column(0)
            other = np.flatnonzero(np.asarray(pc.not_equal(key, key[part.num_rows - 1])))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (rest and not rest[-1].column(0)[rest[-1].num_rows - 1].equals(key[0])):
                ready = pa.Table.from_batches([*rest, part.slice(0, cut)]).combine_chunks()
                if ready.num_rows:
                    yield from _runs(ready.to_batches()[0])
                rest = []
            rest.append(part.slice(cut))
    if rest:
        yield from _runs(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about RUN_ROWS rows, cut where the first column changes."""
    key, n = batch.column(0), batch.num_rows
    starts = np.append(np.flatnonzero(np.asarray(pc.not_equal(key.slice(1), key.slice(0, n - 1)))) + 1, n) if n > 1 else np.array([n])
    low = 0
    while low < n:
        k = int(np.searchsorted(starts, low + RUN_ROWS, "right")) - 1
        high = int(starts[k]) if k >= 0 and starts[k] > low else int(starts[np.searchsorted(starts, low, "right")])
        yield batch.slice(low, high - low)
        low = high


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def candidate_pairs(
    group: np.ndarray, block: np.ndarray, pair: np.ndarray, tree: np.ndarray, sig: np.ndarray, depth: int, below: int, agreement: float
) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) to be verified here, of all groups of a batch at once.

    A pair belongs to the first tree in which it shares a prefix of this depth, and to the two blocks it lies in. Pairs
    that share a longer prefix of `below` levels anywhere, on a common branch, have been found at that depth before.
    """
    at = np.arange(len(group))
    step, left, right = 1, [], []
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at + step] == group[at]]
        for some in np.array_split(at, max(1, len(at) // 20_000)):
            j = some + step
            ok = (pair[some] == 0) | (block[some] != block[j])
            some, j = some[ok], j[ok]
            same = sig[some] == sig[j]
            ok = same.mean(1) >= agreement
            some, j, same = some[ok], j[ok], same[ok].reshape(-1, TREES, LEVELS)
            first = same[:, :, :depth].all(2).argmax(1) == tree[some]
            if below <= LEVELS:
                first &= ~same[:, :, :below].all(2).any(1)
            left.append(some[first])
            right.append(j[first])
        step += 1
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets' pairs (i, j), all of one group."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((owner, column))
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), np.float32)
    heavy = np.flatnonzero(count > 32)
    spot = np.full(len(count), -1)
    spot[heavy] = np.arange(len(heavy))
    in_heavy = spot[column] >= 0
    ho, hc = owner[in_heavy], spot[column[in_heavy]]
    for lo in range(0, len(heavy), 2048):
        part = (hc >= lo) & (hc < lo + 2048)
        block = np.zeros((n, min(2048, len(heavy) - lo)), np.float32)
        block[ho[part], hc[part] - lo] = 1
        total += block @ block.T
    lo_owner, lo_column = owner[~in_heavy], column[~in_heavy]
    at = np.arange(len(lo_owner))
    step = 1
    while len(at):
        at = at[at + step < len(lo_owner)]
        at = at[lo_column[at + step] == lo_column[at]]
        np.add.at(total, (lo_owner[at], lo_owner[at + step]), 1)
        step += 1
    return np.maximum(total[i, j], total[j, i]).astype(np.int64)


def members(nodes: DataFrame, depth: int, below: int) -> DataFrame:
    """(_group, _pair, _block, _tree, _node, _sig) of nodes under prefixes that fork above `below` levels, in pairs of blocks.

    A prefix whose nodes all go on along one branch of that length has nothing new to compare and is left out.
    """
    key = lambda n: f"xxhash64(t, substring(_sig, t * {LEVELS} + 1, {n}))"
    branch = "_node" if below > LEVELS else key(below)
    prefix = F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(t AS tree, {key(depth)} AS prefix, {branch} AS branch))")
    keyed = nodes.select("_node", "_size", F.explode(prefix).alias("p")).select("_node", "_size", "p.tree", "p.prefix", "p.branch")
    load = F.greatest(F.sum("_size") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_NODES)
    forks = keyed.groupBy("tree", "prefix").agg(F.min("branch").alias("a"), F.max("branch").alias("b"), F.ceil(load).cast("int").alias("blocks")).where("a <> b")
    cut = keyed.select("_node", "tree", "prefix").join(forks.select("tree", "prefix", "blocks"), ["tree", "prefix"]).withColumn("b", F.pmod(F.xxhash64("_node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("b", "o"), F.greatest("b", "o")
    group = F.concat_ws(":", F.col("tree"), F.hex("prefix"), low, high)
    cut = cut.select(group.alias("_group"), (low != high).cast("int").alias("_pair"), F.col("b").alias("_block"), F.col("tree").alias("_tree"), "_node")
    return cut.join(nodes.select("_node", "_sig"), "_node")


def node_sets(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_node, _set) of the wanted nodes; a filter of bounded size spares the shuffle most of the others' sets."""
    some, _ = split_by_filter(table.select("_node", "_set"), "_node", key_filter(wanted, "_node"))
    return some.groupBy("_node").agg(F.first("_set").alias("_set"))


def link_round(table: DataFrame, nodes: DataFrame, threshold: float, depth: int, below: int) -> DataFrame:
    """What the tasks find at one depth, rows of three sorts.

    (_node, null, _links): links of a node; (_node, _other): a link of a spanning forest; (_step, _found): how many links
    of a similarity, in steps, a group of prefixes has.
    """
    spread = members(nodes, depth, below)
    names = ["_group", "_pair", "_block", "_tree", "_node", "_sig"]
    agreement = least_agreement(threshold)

    def columns(batch: pa.RecordBatch):
        text = batch.column(0).to_pylist()
        change = np.fromiter((i > 0 and text[i] != text[i - 1] for i in range(len(text))), bool, len(text))
        pair, block, tree = (np.asarray(batch.column(i)) for i in (1, 2, 3))
        return np.cumsum(change), block, pair, tree, matrix(batch.column(5), TREES * LEVELS)

    def narrow(batches):
        for batch in grouped(batches, 5):
            i, j = candidate_pairs(*columns(batch), depth, below, agreement)
            used = np.unique(np.concatenate([i, j]))
            if len(used):
                yield batch.take(pa.array(used))

    def verify(batches):
        for batch in grouped(batches, 6):
            group, *rest = columns(batch)
            i, j = candidate_pairs(group, *rest, depth, below, agreement)
            sets = [np.frombuffer(s, np.uint64) for s in batch.column(6).to_pylist()]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            common = np.zeros(len(i), np.int64)
            order = np.argsort(group[i], kind="stable")
            i, j = i[order], j[order]
            edge = [0, *(np.flatnonzero(np.diff(group[i])) + 1), len(i)]
            for lo, hi in zip(edge, edge[1:]):
                if hi > lo:
                    base = np.searchsorted(group, group[i[lo]])
                    top = np.searchsorted(group, group[i[lo]], "right")
                    common[lo:hi] = overlaps(sets[base:top], i[lo:hi] - base, j[lo:hi] - base)
            union = size[i] + size[j] - common
            good = common >= threshold * union - 1e-9
            i, j, similar = i[good], j[good], (common / np.maximum(union, 1))[good]
            if not len(i):
                continue
            nodes_ = batch.column(4).to_pylist()
            parent = list(range(len(sets)))

            def root(a: int) -> int:
                while parent[a] != a:
                    parent[a] = parent[parent[a]]
                    a = parent[a]
                return a

            ties = []
            for at in range(0, len(i), 50_000):
                for a, b in zip(i[at : at + 50_000].tolist(), j[at : at + 50_000].tolist()):
                    ra, rb = root(a), root(b)
                    if ra != rb:
                        parent[ra] = rb
                        ties.append((a, b))
            copies = np.asarray(batch.column(7)).astype(np.int64)
            links = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
            found = np.bincount((similar * STEPS + 1e-9).astype(int), minlength=STEPS + 1)
            has, steps = np.flatnonzero(links).tolist(), np.flatnonzero(found).tolist()
            n, t, k = len(has), len(ties), len(steps)
            columns_ = [
                [nodes_[x] for x in has] + [nodes_[a] for a, _ in ties] + [None] * k, [None] * n + [nodes_[b] for _, b in ties] + [None] * k,
                [int(links[x]) for x in has] + [0] * (t + k), [None] * (n + t) + steps, [0] * (n + t) + [int(found[x]) for x in steps],
            ]
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns_, types)], ["_node", "_other", "_links", "_step", "_found"])

    schema = "_group string, _pair int, _block int, _tree int, _node string, _sig binary"
    spread = spread.select(*names).repartition("_group").sortWithinPartitions("_group", "_sig")
    used = materialize(spread.mapInArrow(narrow, schema), "candidates")
    sets = node_sets(table, used.select("_node").distinct())
    full = used.join(sets, "_node").join(nodes.select("_node", "_copies"), "_node").select(*names, "_set", "_copies")
    full = full.repartition("_group").sortWithinPartitions("_group", "_sig")
    done = materialize(full.mapInArrow(verify, "_node string, _other string, _links bigint, _step int, _found bigint"), "links")
    forget(used)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(_node, _root): the smallest node of each component, by alternating large and small stars.

    Each round is written to the shared folder; a sum over the edges tells when nothing changes any more.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges, old = materialize(small.where("a <> b").distinct(), "stars"), edges
        forget(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            out = edges.select(F.col("a").alias("_node"), F.col("b").alias("_root"))
            out.scratch_path = edges.scratch_path
            return out
        before = now


def all_rounds(table: DataFrame, nodes: DataFrame, threshold: float, recall: float) -> list[tuple[int, DataFrame]]:
    """(depth, result of link_round()) for whole signatures first, then for shorter prefixes until the recall is reached."""
    depth, below, found, rounds = LEVELS, LEVELS + 1, np.zeros(STEPS + 1), []
    while True:
        rounds.append((depth, link_round(table, nodes, threshold, depth, below)))
        for r in rounds[-1][1].where("_step is not null").groupBy("_step").agg(F.sum("_found")).collect():  # at most STEPS + 1 rows
            found[r[0]] += r[1]
        shorter = next_depth(found, depth, threshold, recall)
        if shorter == depth:
            return rounds
        depth, below = shorter, depth


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """A row for each document: id, class_id, n_links, n_copies, is_first.

    Links are pairs of rows whose sets of word n-grams have a Jaccard similarity of threshold or more; words are what
    stands between white space, as written. class_id is the smallest id among the documents that links connect, n_links
    the number of other rows linked to this one, n_copies of rows with an equal set (itself among them). is_first is true
    for one row of each class. A text of fewer words than n is one n-gram; null and blank texts have none, are linked to
    nothing and a class of their own each. Repeated rows are copies of each other. Null ids count as the largest. A very
    long text is one set like any other; the order of equal signatures does not matter. No documents give no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    table = materialize(nodes_of(rows, "_t", words), "nodes")
    nodes = table.where("_node is not null").groupBy("_node").agg(F.count(F.lit(1)).alias("_copies"), F.min("_id").alias("_least"), F.first("_size").alias("_size"), F.first("_sig").alias("_sig"))
    nodes = materialize(nodes, "classes")
    rounds = [r for _, r in all_rounds(table, nodes, threshold, recall)]
    both = rounds[0]
    for more in rounds[1:]:
        both = both.unionAll(more)
    links = both.where("_other IS NULL AND _node IS NOT NULL").groupBy("_node").agg(F.sum("_links").alias("_links"))
    roots = components(both.where("_other IS NOT NULL").select(F.col("_node").alias("a"), F.col("_other").alias("b")))
    grouped_ = nodes.select("_node", "_copies", "_least").join(links, "_node", "left").join(roots, "_node", "left")
    grouped_ = materialize(grouped_.withColumn("_root", F.coalesce("_root", "_node")), "groups")
    least = grouped_.where("_links is not null").groupBy("_root").agg(F.min("_least").alias("_class"))
    known = grouped_.join(least, "_root", "left").select("_node", "_copies", F.coalesce("_class", "_least").alias("_class"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"))
    rest = table.where("_node is null").select("_id", F.col("_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    out = table.select("_id", "_node").where("_node is not null").join(known, "_node")
    out = out.select("_id", F.col("_class").alias("class_id"), F.col("_links").alias("n_links"), F.col("_copies").alias("n_copies")).unionAll(rest)
    out = materialize(out.select(F.col("_id").alias(id_col), "class_id", "n_links", "n_copies", F.col("_id").eqNullSafe(F.col("class_id")).alias("is_first")), "judged")
    forget(table, nodes, grouped_, roots, *rounds)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each class of jaccard_classes(), that with the smallest id; all columns as they were.

    Of rows that repeat its id and text one stays. Rows with a null id stay if their class has no other id. Where rows
    share an id but not the text, all of them stay if one of them is the first of its class. Null, blank and very long
    texts and empty tables are as in jaccard_classes(). Columns may have any names.
    """
    names = docs.columns
    judged = jaccard_classes(docs, id_col, text_col, words, threshold, recall).select(F.col(id_col).alias("_drop"), "is_first")
    first = judged.where("is_first").select(F.col("_drop").alias("_keep"))
    drop = judged.where("NOT is_first").select("_drop").distinct()
    drop = materialize(drop.join(first, F.col("_drop").eqNullSafe(F.col("_keep")), "left_anti"), "dropped")
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    bits = key_filter(drop.select(key(F.col("_drop")).alias("_key")), "_key")
    inner = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_key", key(F.col(f"c{names.index(id_col)}")))
    maybe, never = split_by_filter(inner, "_key", bits)  # no text of those that surely stay is shuffled
    at = f"c{names.index(id_col)}"
    kept = maybe.join(drop, F.col(at).eqNullSafe(F.col("_drop")), "left_anti").unionAll(never).drop("_key")
    if first.where(F.col("_keep").isNotNull()).groupBy("_keep").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([at, f"c{names.index(text_col)}"])
    return kept.toDF(*names)


#: The same in DuckDB's SQL, by comparing all documents that have a word 5-gram in common.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [md5_number(array_to_string(w, ' '))]
  ELSE list_transform(range(1, len(w) - 3), lambda i: md5_number(array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
g AS (SELECT s, count(*) AS copies, min(doc_id) AS least FROM (SELECT doc_id, list_sort(s) AS s FROM n WHERE len(s) > 0) GROUP BY s),
h AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM g),
e AS (SELECT k, len(s) AS size, unnest(s) AS x FROM h),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
r AS (SELECT k AS a, k AS b FROM h UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS k, min(h.least) AS class_id FROM r JOIN h ON r.b = h.k GROUP BY r.a),
m AS (SELECT h.k, h.copies - 1 + coalesce(sum(o.copies), 0) AS n_links FROM h LEFT JOIN l ON l.a = h.k LEFT JOIN h o ON o.k = l.b GROUP BY h.k, h.copies)
SELECT n.doc_id, coalesce(class_id, n.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(copies, 1)::BIGINT AS n_copies, coalesce(class_id, n.doc_id) = n.doc_id AS is_first
FROM n LEFT JOIN h ON h.s = list_sort(n.s) LEFT JOIN c ON c.k = h.k LEFT JOIN m ON m.k = h.k
"""
