"""Tokens of two tokenizers over the same bytes, put side by side.

A tokenizer is a byte-level BPE (A) or a model of pieces (B). Every byte of a text gets a label: no token ends there, one of
A, one of B, or one of both. A regular expression cuts the labels behind each byte where both end; the labels of a cut tell
how many tokens of either make a group. Each label but 'none' ends a stretch that one token of A and one of B share: a link.
Links are counted by pair of ids over all documents, and each document's links are held against these counts.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, forget, materialize, mixed, slices

SPACE = "▁"
# Fixed value: how the byte-level vocabulary's tokenizer cuts a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labels of a byte: no end, an end of A, of B, of both; and what reaches up to the next end of both.
LABELS, SPAN = np.frombuffer(b".abc", np.uint8), re.compile(rb"[^c]*c")
#: Ranges of pairs, and documents of a block, about: a group has the links of one range and one block.
RANGES, BLOCK_DOCUMENTS = 16, 50_000
#: Bytes of texts that are encoded at once, and whose links are packed together; a longer text is done alone.
SLICE = 2_000_000


def byte_characters() -> dict[str, int]:
    """character -> byte in byte-level vocabularies: printable Latin-1 stands for itself, the others for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces:
    """The bytes of ids, in one buffer."""

    def __init__(self, of: dict[int, bytes]):
        self.size = np.zeros(max(of) + 1, np.int64)
        for i, b in of.items():
            self.size[i] = len(b)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(of.get(i, b"") for i in range(len(self.size))), np.uint8)
        text = [str(i).encode() for i in range(len(self.size))]
        self.decimal = {end: np.array([t + end for t in text], object) for end in (b",", b"|", b";")}

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one behind the other."""
        size = self.size[ids]
        shift = self.at[ids] - (np.cumsum(size) - size)
        return self.bytes[np.repeat(shift, size) + np.arange(size.sum())]


class ByteLevel(_Pieces):
    """A byte-level BPE of a tokenizers file, of which special tokens are left out: their strings are plain text.

    Where every merge makes the next id, ranks are ids, and the merges are left to the faster of two public libraries.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_characters()
        super().__init__({i: bytes(byte[c] for c in t) for t, i in model["vocab"].items() if all(c in byte for c in t)})
        special = {t["content"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pre = spec["pre_tokenizer"] or {}
        ranked = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)) and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if ranked:
            import tiktoken

            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            encoder = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [np.asarray(encoder.encode_to_numpy(t, disallowed_special=())).astype(np.int64) for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda texts: [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceModel(_Pieces):
    """A model of pieces, which adds the space in front itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        text = lambda i: model.id_to_piece(i)
        super().__init__({i: bytes([int(text(i)[3:5], 16)]) if model.is_byte(i) else text(i).replace(SPACE, " ").encode() for i in range(model.get_piece_size())})
        self.encode = lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)]


_loaded: dict[tuple[type, str], _Pieces] = {}


def load(kind: type, path: str):
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


class Aligned:
    """Texts that both tokenizers keep byte by byte: ids of either, labels of the bytes, groups and links.

    valid: the texts' numbers. first_a, first_b, first_group, first_link: where each text's own begin, and the end of all.
    """

    def __init__(self, texts: list[str | None], a: ByteLevel, b: PieceModel):
        some = [i for i, t in enumerate(texts) if t]
        whole = [" " + texts[i] for i in some]
        own_a, own_b, data = a.encode(whole), b.encode([texts[i] for i in some]), [t.encode() for t in whole]
        good = [k for k, d in enumerate(data) if a.size[own_a[k]].sum() == b.size[own_b[k]].sum() == len(d)]
        if good:
            expected = np.frombuffer(b"".join(data[k] for k in good), np.uint8)
            same = (a.joined(np.concatenate([own_a[k] for k in good])) == expected) & (b.joined(np.concatenate([own_b[k] for k in good])) == expected)
            edges = np.cumsum([0, *(len(data[k]) for k in good)])
            good = [k for k, ok in zip(good, np.logical_and.reduceat(same, edges[:-1])) if ok]
        self.valid = [some[k] for k in good]
        none = np.zeros(0, np.int64)
        self.a, self.b = np.concatenate([none, *(own_a[k] for k in good)]), np.concatenate([none, *(own_b[k] for k in good)])
        edges = np.cumsum([0, *(len(data[k]) for k in good)])
        label = np.zeros(edges[-1], np.uint8)
        label[np.cumsum(a.size[self.a]) - 1] |= 1
        label[np.cumsum(b.size[self.b]) - 1] |= 2
        # each text ends in a label of both, so that no cut reaches over it
        cuts = np.fromiter(map(len, SPAN.findall(LABELS[label].tobytes())), np.int64)
        ends = np.cumsum(cuts)
        upto = lambda flags: np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
        ends_a, ends_b = upto(label & 1), upto(label >> 1)
        self.n_a, self.n_b = np.diff(ends_a[np.append(0, ends)]), np.diff(ends_b[np.append(0, ends)])
        spot = np.flatnonzero(label)
        self.link_a, self.link_b = self.a[ends_a[spot]], self.b[ends_b[spot]]
        self.first_a, self.first_b = ends_a[edges], ends_b[edges]
        self.first_group, self.first_link = np.searchsorted(ends, edges, "right"), np.searchsorted(spot, edges)
        self.tokens = a, b

    def groups(self) -> list[bytes]:
        """Each text's groups in decimal: ids of A by comma, a bar, ids of B by comma, groups by semicolon."""
        out = []
        text_a, text_b = (t.decimal[b","].take(x) for t, x in zip(self.tokens, (self.a, self.b)))
        last_a, last_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        text_a[last_a - 1] = self.tokens[0].decimal[b"|"].take(self.a[last_a - 1])
        text_b[last_b - 1] = self.tokens[1].decimal[b";"].take(self.b[last_b - 1])
        all_ = np.empty(len(text_a) + len(text_b), object)
        group = np.arange(len(self.n_a))
        all_[np.arange(len(text_a)) + np.repeat((last_b - self.n_b)[group], self.n_a)] = text_a  # behind B's ids of the groups before
        all_[np.arange(len(text_b)) + np.repeat(last_a[group], self.n_b)] = text_b
        edge = self.first_a + self.first_b
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            out.append(b"".join(all_[lo:hi].tolist())[:-1])
        return out

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each text's own begin, pairs of linked ids, how many links of the text hold each): distinct by text."""
        n = np.diff(self.first_link)
        text = np.repeat(np.arange(len(n)), n)
        key = self.link_a * width + self.link_b
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), (np.diff(key) != 0) | (np.diff(text) != 0)]))
        return np.searchsorted(text[new], np.arange(len(n) + 1)), key[new], np.diff(np.append(new, len(key)))


def token_table(docs: DataFrame, byte_level: str, pieces: str, id_col: str, text_col: str, detail: bool) -> DataFrame:
    """Rows of two sorts.

    (_id, _row, n_a, n_b, n_groups, n_links, groups (with detail) or groups_sha256) of a document; (_range, _base, _pair,
    _place, _n) of a range of pairs and some documents: lists of pairs in order, of the document _row = _base + _place, and
    how many of its links hold each. A pair is A's id times 2^32 plus B's.
    """
    rows = docs.select(docs[id_col].alias("_id"), F.monotonically_increasing_id().alias("_row"), docs[text_col].cast("string").alias("_text"))
    last = "groups" if detail else "groups_sha256"
    names = ["_id", "_row", "n_a", "n_b", "n_groups", "n_links", last, "_range", "_base", "_pair", "_place", "_n"]
    lists = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        a, b = load(ByteLevel, byte_level), load(PieceModel, pieces)
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                own = Aligned([t.decode() for t in byte_texts(part.column(2))], a, b)
                n = np.zeros((4, part.num_rows), np.int64)
                n[:, own.valid] = [np.diff(x) for x in (own.first_a, own.first_b, own.first_group, own.first_link)]
                text = [b""] * part.num_rows
                for i, g in zip(own.valid, own.groups()):
                    text[i] = g if detail else hashlib.sha256(g).hexdigest().encode()
                head = [part.column(0), part.column(1), *(pa.array(x) for x in n), pa.array(text, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*head, *(pa.nulls(part.num_rows, t) for t in lists)], names)
                begin, pair, count = own.pairs(1 << 32)
                rows_ = np.asarray(part.column(1))
                base = int(rows_.min())
                place = np.repeat(rows_[own.valid] - base, np.diff(begin))
                group = (mixed(pair.view(np.uint64)) % np.uint64(RANGES)).astype(np.int64)
                order = np.lexsort((pair, group))
                pair, place, count, group = pair[order], place[order], count[order], group[order]
                ranges, first = np.unique(group, return_index=True)
                offsets, k = pa.array(np.append(first, len(pair)).astype(np.int32)), len(ranges)
                packed = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pair, place.astype(np.int32), count.astype(np.int32))]
                none = [pa.nulls(k, c.type) for c in head]
                yield pa.RecordBatch.from_arrays([*none, pa.array(ranges.astype(np.int32)), pa.array(np.full(k, base)), *packed], names)

    ddl = f"_id {rows.schema['_id'].dataType.simpleString()}, _row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, {last} string, _range int, _base bigint, _pair array<bigint>, _place array<int>, _n array<int>"
    return rows.mapInArrow(run, ddl)


def pair_counts(table: DataFrame) -> DataFrame:
    """(_range, _pair, n_pair, is_best): links of each pair of ids in all documents, and whether no pair of its B id has more."""
    links = table.where("_range is not null").select("_range", F.inline(F.arrays_zip("_pair", "_n"))).toDF("_range", "_pair", "_n")
    counts = links.groupBy("_range", "_pair").agg(F.sum("_n").alias("n_pair"))
    counts = materialize(counts.withColumn("_b", F.col("_pair").bitwiseAND(F.lit((1 << 32) - 1))), "pairs")
    best = counts.groupBy("_b").agg(F.max("n_pair").alias("_most"))
    out = materialize(counts.join(best, "_b").select("_range", "_pair", "n_pair", (F.col("n_pair") == F.col("_most")).alias("is_best")), "best")
    forget(counts)
    return out


def _held(left: pa.Table, right: pa.Table) -> pa.Table:
    """(_row, _best, _sum) of packed links and the counts of their range."""
    known = np.asarray(right["_pair"].combine_chunks())
    order = np.argsort(known)
    known, total, best = known[order], np.asarray(right["n_pair"].combine_chunks())[order], np.asarray(right["is_best"].combine_chunks())[order]
    flat = lambda name: left[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.asarray(pc.list_value_length(left["_place"])).astype(np.int64)
    row, at = np.unique(np.repeat(np.asarray(left["_base"]), size) + flat("_place"), return_inverse=True)
    n, of = flat("_n"), np.searchsorted(known, flat("_pair"))
    sums = np.zeros((2, len(row)), np.int64)
    np.add.at(sums[0], at, n * best[of])
    np.add.at(sums[1], at, n * total[of])
    return pa.table([row, *sums], ["_row", "_best", "_sum"])


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", detail: bool = False, block: int = BLOCK_DOCUMENTS) -> DataFrame:
    """A row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (with detail: groups).

    A encodes a space and the text, B the text, to which it adds the space; special tokens' strings are plain text. Byte
    offsets where tokens of both end cut them into groups. Links are pairs of tokens whose bytes overlap; n_best counts
    those whose pair of ids has the highest count, over all documents, of its B id (ties included), count_sum sums the
    counts of all links. groups reads a1,a2|b1;a3|b2,b3. Null and empty texts, and those that either tokenizer doesn't give
    back byte by byte, have no tokens: zeros and ''. Long texts are read whole. Repeated rows are documents of their own
    and count so; ids may be null. No documents give no rows; columns of docs may have any names.

    byte_level, pieces: files that every executor can read under these names.
    """
    table = materialize(token_table(docs, byte_level, pieces, id_col, text_col, detail), "tokens")
    own, counts = table.where("_row is not null").drop("_range", "_base", "_pair", "_place", "_n"), pair_counts(table)
    blocks = max(1, -(-own.count() // block))
    links = table.where("_range is not null").select("_range", F.pmod(F.xxhash64("_base"), F.lit(blocks)).cast("int").alias("_block"), "_base", "_pair", "_place", "_n")
    spread = counts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = links.groupBy("_range", "_block").cogroup(spread.groupBy("_range", "_block")).applyInArrow(_held, "_row bigint, _best bigint, _sum bigint")
    sums = met.groupBy("_row").agg(F.sum("_best").alias("_best"), F.sum("_sum").alias("_sum"))
    out = own.join(sums, "_row", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("_best", zero).alias("n_best"), F.coalesce("_sum", zero).alias("count_sum"), own.columns[6])
