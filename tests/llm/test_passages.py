"""Substring removal, importance resampling and token alignment, against plain Python and SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from strandloom.llm import alignment, resampling, substrings
from strandloom.llm.queries import BYTE_LEVEL, PIECES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
tokenizers_there = pytest.mark.skipif(not os.path.exists(BYTE_LEVEL), reason="no tokenizer files")
WS = re.compile("[^\x20\x09-\x0d]+")


@tables
@pytest.mark.parametrize("name", ["op11_substrings", "op12_resampling"])
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(got.fetchall(), key=repr)


# substrings


@pytest.mark.parametrize("period", [p for p in substrings.COVERS])
def test_cover_has_a_common_shift_for_every_two_residues(period):
    d = set(substrings.COVERS[period])
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in d and (j + s) % period in d for s in range(period))


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 20, 50])
def test_anchors_fit_into_their_window(window):
    period, places = substrings.cover(window)
    assert window - period + 1 >= 1 and max(places) < period
    assert substrings.cover(20) == (13, (0, 1, 3, 9))


def test_words_are_those_of_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é \t\n\x0b\x1c") for _ in range(rng.randrange(60))).encode() for _ in range(300)]
    words = substrings.Words(texts)
    assert words.counts.tolist() == [len(t.split()) for t in texts]
    assert words.joined(np.ones(len(words.starts), bool)) == [b" ".join(t.split()) for t in texts]
    keep = np.array([rng.random() < 0.5 for _ in words.starts], bool)
    flat, at, want = [w for t in texts for w in t.split()], 0, []
    for t in texts:
        n = len(t.split())
        want.append(b" ".join(w for w, k in zip(flat[at : at + n], keep[at : at + n]) if k))
        at += n
    assert words.joined(keep) == want
    by_hash = {}
    for w, h in zip(flat, words.hashes().tolist()):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(flat))


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    alone = substrings.Words([b"one", b"x" * 3000, "é€".encode()]).hashes()
    monkeypatch.setattr(substrings, "BLOCK", 64)  # a word longer than a block is a block
    many = substrings.Words([b"zz one " + b"x" * 3000 + b" q " + "é€".encode()]).hashes()
    assert many[[1, 2, 4]].tolist() == alone.tolist()


def test_runs_are_equal_where_words_are():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 4, 500).astype(np.uint64) * np.uint64(0x123456789ABCDEF)
    for n in (1, 2, 3, 7, 8, 13, 20):
        got = substrings.runs(h, n, substrings._ODD[0])
        assert len(got) == len(h) - n + 1
        seen = {}
        for i, g in enumerate(got.tolist()):
            assert seen.setdefault(g, h[i : i + n].tobytes()) == h[i : i + n].tobytes()
        assert len(seen) == len({h[i : i + n].tobytes() for i in range(len(got))})
    assert len(substrings.runs(h[:5], 6, substrings._ODD[0])) == 0


def brute_removal(rows, window):
    """kept text by (id, text): documents by id, null last, then by the engine's hash of the text."""
    first, out = {}, {}
    for i, k, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if (i, text) in out:
            continue
        words = WS.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            own = tuple(words[s : s + window])
            if first.setdefault(own, (i, k, s)) != (i, k, s):
                gone.update(range(s, s + window))
        out[i, text] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


def odd_documents(rng, n=120):
    pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(12)] + ["é", "Ünï", "#"]
    text = lambda k: [rng.choice(pool) + (str(rng.randrange(30)) if rng.random() < 0.4 else "") for _ in range(k)]
    passages = [text(rng.randrange(5, 60)) for _ in range(6)]
    docs = []
    for i in range(n):
        words = text(rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)[rng.randrange(3) :]
        docs.append((rng.choice([i, i, i, i // 3, None]), rng.choice([" ", "  ", "\n", " \t"]).join(words)))
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a " * 500), (7, docs[7][1]), docs[8], docs[8], (None, docs[9][1]), (2000, " ".join(text(4000)))]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("window,most_filter_keys", [(20, 10**6), (20, 0), (5, 10**6), (3, 0), (40, 10**6), (1, 10**6)])
def test_removal_is_that_of_brute_force(spark, window, most_filter_keys):
    docs = odd_documents(random.Random(window))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, _text string").repartition(5)
    k = {r[0]: r[1] for r in df.selectExpr("text", "xxhash64(coalesce(text, ''))").collect()}
    want = brute_removal([(i, k[t], t) for i, t in docs], window)
    got = substrings.remove_repeats(df, window=window, most_filter_keys=most_filter_keys).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *want[i, t]) for i, t in docs), key=repr)


def test_removal_with_text_ids_and_odd_columns(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([("b", "x " + passage, 1, 2), ("a", passage + " y", 3, 4), ("c", None, 5, 6)], "`my id` string, `_k` string, _id int, _w int")
    got = {r[0]: tuple(r)[1:] for r in substrings.remove_repeats(df, "my id", "_k").collect()}
    assert got == {"a": (26, 0, passage + " y"), "b": (26, 25, "x"), "c": (0, 0, "")}


def test_removal_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert substrings.remove_repeats(empty).collect() == []


def test_a_passage_that_all_documents_share_is_kept_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.range(3000).selectExpr("id AS doc_id", f"concat('own', id, ' {passage} tail', id) AS text").repartition(8)
    got = substrings.remove_repeats(df).groupBy("n_removed").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 1, 60: 2999}


# resampling


def brute_weights(docs, target, words, buckets, least, percent, seed):
    def features(text):
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return own, [" ".join(own[i : i + n]) for n in range(1, words + 1) for i in range(len(own) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in docs:
        own, f = features(text)
        weight = math.floor(sum(gain(bucket(x)) for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(own)])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = n + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("words,block", [(1, 100_000), (2, 7)])
def test_resampling_is_that_of_brute_force(spark, words, block):
    rng = random.Random(5)
    docs = [(i, t) for n, (i, t) in enumerate(odd_documents(rng, 90))] + [(5000 + i, "the the The ÉTÉ-12") for i in range(200)]
    docs = list({(i, t): (i, t) for i, t in docs if i is not None}.values()) + [(None, "a b c")]  # rows equal in id and score may come in either order
    ids = Counter(i for i, _ in docs)
    docs = [d for d in docs if ids[d[0]] == 1]
    target = ["the aa ab", None, "", "ÉTÉ 12 the"]
    left = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, _row int").repartition(4)
    right = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(left, right, words=words, buckets=97, least_words=3, percent=30, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_weights(docs, target, words, 97, 3, 30, 2024), key=repr)


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(docs, none, least_words=1, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert len({tuple(r)[:4] for r in got if r["doc_id"] == 1}) == 1
    assert resampling.resample(docs.limit(0), none).collect() == []


# alignment


def brute_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE_LEVEL), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    byte = alignment.byte_characters()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, links = [], []
    for i, text in docs:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(byte[c] for c in a.id_to_token(x)) for x in ids_a], [piece(x) for x in ids_b]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        groups, own, pa_, pb = [], [], 0, 0
        at_a = at_b = 0
        ga, gb = [], []
        while pa_ < len(ids_a) or pb < len(ids_b):
            end_a, end_b = at_a + len(bytes_a[pa_]), at_b + len(bytes_b[pb])
            own.append((ids_a[pa_], ids_b[pb]))
            if end_a <= end_b:
                ga.append(ids_a[pa_])
            if end_b <= end_a:
                gb.append(ids_b[pb])
            if end_a == end_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
            if end_a <= end_b:
                pa_, at_a = pa_ + 1, end_a
            if end_b <= end_a:
                pb, at_b = pb + 1, end_b
        rows.append((i, len(ids_a), len(ids_b), len(groups), ";".join(groups)))
        links.append(own)
    counts = Counter(p for own in links for p in own)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, na, nb, ng, len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), g) for (i, na, nb, ng, g), own in zip(rows, links)]


ODD_TEXTS = [
    None, "", " ", "  two  spaces\n\n\tand tabs ", "plain words, and some more.", "<|endoftext|> and </s> <s> <unk>", "▁ is a piece", "naïve café — 漢字かな 🤯👩‍👩‍👧", "\x00\x01null", "a" * 5000, "1234567890" * 30,
    "é combining", " nbsp em", "don't can't we'll I'd", "x\r\ny\rz", "ﬁ ligature Å", "﻿bom", "plain words, and some more.",
]


@tokenizers_there
@pytest.mark.parametrize("block", [100_000, 2])
def test_alignment_is_that_of_brute_force(spark, block):
    docs = list(enumerate(ODD_TEXTS)) + [(None, "plain words"), (3, "  two  spaces\n\n\tand tabs "), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id int, text string, _pairs string, n_a int").repartition(3)
    want = brute_alignment(docs)
    assert sum(w[1] == 0 for w in want) >= 3 and sum(w[1] > 0 for w in want) > 10
    got = alignment.align(df, BYTE_LEVEL, PIECES, detail=True, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    digests = alignment.align(df, BYTE_LEVEL, PIECES, block=block).select("doc_id", "n_a", "groups_sha256").collect()
    assert sorted(map(tuple, digests), key=repr) == sorted(((w[0], w[1], hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for w in want), key=repr)


@tokenizers_there
@tables
def test_alignment_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for w in brute_alignment(docs)]
    got = entry.queries()["op13_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@tokenizers_there
def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(empty, BYTE_LEVEL, PIECES).collect() == []
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id int, text string"), BYTE_LEVEL, PIECES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@tokenizers_there
def test_both_encoders_of_the_byte_level_vocabulary_agree(monkeypatch, tmp_path):
    import json

    with open(BYTE_LEVEL, encoding="utf-8") as f:
        spec = json.load(f)
    fast = alignment.ByteLevel(BYTE_LEVEL)
    swapped = spec["model"]["vocab"]
    swapped["!"], swapped['"'] = swapped['"'], swapped["!"]  # of base letters, which merges don't name by number
    plain = tmp_path / "plain.json"
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [spec["pre_tokenizer"]]}  # a shape that isn't known to be ranked
    swapped["!"], swapped['"'] = swapped['"'], swapped["!"]
    plain.write_text(json.dumps(spec))
    slow = alignment.ByteLevel(str(plain))
    texts = [" " + t for t in ODD_TEXTS if t]
    assert [x.tolist() for x in fast.encode(texts)] == [x.tolist() for x in slow.encode(texts)]
