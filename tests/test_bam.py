"""Splits and regions of BAM files: every record is read once, and only the blocks of a region are."""

import io
import random
import struct

import pytest

from strandloom.sources import alignments, bam
from test_engine import bam_bytes

NAMES = ("1", "2", "X")


def sorted_records(n, seed=1, longest=40, lengths=(900, 900, 900)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randrange(1, longest)
        ref = rng.randrange(3)
        start = rng.randrange(1, lengths[ref])
        rows.append((f"read{i}/{'x' * rng.randrange(30)}", 99, NAMES[ref], start, 30, [(size, "M")], "".join(rng.choice("ACGT") for _ in range(size)), "J" * size, rng.randrange(-20, 20)))
    return sorted(rows, key=lambda r: (NAMES.index(r[2]), r[3]))


def bin_of(begin, end):
    end -= 1
    for first, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def bai_bytes(data):
    """The index of a sorted file, as the format describes it."""
    raw = bam.Blocks(io.BytesIO(data))
    names = bam.header(raw)
    refs = [({}, {}) for _ in names]
    while raw.more():
        begin = raw.tell()
        record = raw.take(struct.unpack("<i", raw.take(4))[0])
        end = raw.tell() if raw.more() else (len(data) - 28) << 16
        ref, pos, l_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", record)
        ops = struct.unpack_from(f"<{n_cigar}I", record, 32 + l_name)
        stop = pos + sum(o >> 4 for o in ops)
        chunks, linear = refs[ref]
        own = chunks.setdefault(bin_of(pos, stop), [])
        if own and own[-1][1] == begin:
            own[-1][1] = end
        else:
            own.append([begin, end])
        for w in range(pos >> 14, (stop - 1 >> 14) + 1):
            linear.setdefault(w, begin)
    out = b"BAI\1" + struct.pack("<i", len(refs))
    for chunks, linear in refs:
        out += struct.pack("<i", len(chunks) + 1)
        for number, own in chunks.items():
            out += struct.pack("<Ii", number, len(own)) + b"".join(struct.pack("<QQ", *c) for c in own)
        out += struct.pack("<IiQQQQ", 37450, 2, 0, 0, 0, 0)
        n = max(linear, default=-1) + 1
        out += struct.pack("<i", n)
        last = 0
        for w in range(n):
            last = linear.get(w, last)
            out += struct.pack("<Q", last)
    return out


def plain(records):
    return sorted((n, f, c, s, m, "".join(f"{k}{o}" for k, o in cigar), q, u, a) for n, f, c, s, m, cigar, q, u, a in records)


def ranges(data, cuts, index=None, regions=None):
    edges = [0, *cuts, len(data)]
    parts = [bam.Range(io.BytesIO(data), len(data), a, b, index, regions) for a, b in zip(edges, edges[1:])]
    return parts, [list(p) for p in parts]


@pytest.mark.parametrize("block", [150, 700, 20_000])
@pytest.mark.parametrize("indexed", [False, True])
def test_ranges_have_every_record_once(block, indexed):
    records = sorted_records(800)
    data = bam_bytes(records, NAMES, block)
    index = bam.Index(bai_bytes(data)) if indexed else None
    rng = random.Random(block)
    for n in (0, 1, 2, 5, 30):
        cuts = sorted(rng.randrange(len(data)) for _ in range(n))
        _, got = ranges(data, cuts, index)
        assert sorted(r for part in got for r in part) == plain(records)
    for cut in range(0, len(data), max(1, len(data) // 97)):
        _, got = ranges(data, [cut], index)
        assert sum(map(len, got)) == 800
        assert [r[0] for part in got for r in part] == [r[0] for r in records]


@pytest.mark.parametrize("longest", [3, 5000])
def test_ranges_of_short_and_long_records(longest):
    records = sorted_records(150, 7, longest)
    data = bam_bytes(records, NAMES, 300)
    _, got = ranges(data, [len(data) * k // 7 for k in range(1, 7)])
    assert [r[0] for part in got for r in part] == [r[0] for r in records]


@pytest.mark.parametrize("cuts", [0, 3])
def test_a_region_reads_only_its_blocks(cuts):
    records = sorted_records(3000, 3, lengths=(400_000, 900_000, 200_000))
    data = bam_bytes(records, NAMES, 600)
    index = bam.Index(bai_bytes(data))
    places = [len(data) * k // (cuts + 1) for k in range(1, cuts + 1)]
    for name, begin, end in (("2", 300_000, 320_000), ("2", 0, 5), ("1", 399_000, 1 << 31), ("X", -1, 1 << 31), ("9", 0, 1000)):
        parts, got = ranges(data, places, index, [(name, begin, end)])
        want = [r for r in records if r[2] == name and r[3] - 1 < end and r[3] - 1 + len(r[6]) > begin]
        assert sorted(r for part in got for r in part) == plain(want)
        if end - begin < 50_000:
            whole = bam.Range(io.BytesIO(data), len(data), 0, len(data))
            assert len(list(whole)) == 3000 and sum(p.raw.blocks for p in parts) < whole.raw.blocks / 8 + 2 * len(parts)
    _, got = ranges(data, places, index, [("2", 300_000, 320_000), ("2", 310_000, 330_000), ("1", 0, 20_000)])  # those that overlap give no read twice
    want = [r for r in records if (r[2] == "2" and r[3] - 1 < 330_000 and r[3] - 1 + len(r[6]) > 300_000) or (r[2] == "1" and r[3] - 1 < 20_000)]
    assert sorted(r for part in got for r in part) == plain(want)


def test_a_region_without_index_filters():
    records = sorted_records(300)
    data = bam_bytes(records, NAMES, 400)
    _, got = ranges(data, [len(data) // 2], None, [("2", 100, 200)])
    assert sorted(r for part in got for r in part) == plain([r for r in records if r[2] == "2" and r[3] - 1 < 200 and r[3] - 1 + len(r[6]) > 100])


@pytest.mark.parametrize("indexed", [False, True])
def test_several_tasks_read_one_file(spark, tmp_path, indexed):
    records = sorted_records(2500, 9, lengths=(300_000, 300_000, 300_000))
    data = bam_bytes(records, NAMES, 900)
    (tmp_path / "c a_1.bam").write_bytes(data)
    (tmp_path / "d_1.bam").write_bytes(bam_bytes(records[:10], NAMES, 900))
    if indexed:
        (tmp_path / "c a_1.bam.bai").write_bytes(bai_bytes(data))
    paths = [str(tmp_path / "c a_1.bam"), str(tmp_path / "d_1.bam")]
    df = alignments.read_bam(spark, paths, split=len(data) // 5)
    assert df.rdd.getNumPartitions() >= 5
    from pyspark.sql import functions as F

    tasks = df.where(F.col("path").contains("c a")).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 and sum(r[1] for r in tasks) == 2500
    assert df.drop("path").distinct().count() == 2500 and df.count() == 2510
    assert {r[0] for r in alignments.read_alignments(spark, paths, ["X"]).select("chromosome").distinct().collect()} == {"X"}
    assert alignments.read_alignments(spark, paths, ["x", "X"]).count() == sum(r[2] == "X" for r in records + records[:10])


def test_small_files_share_a_task_and_faults_are_told(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"c{i:02d}_1.bam").write_bytes(bam_bytes(sorted_records(5, i), NAMES))
    paths = sorted(str(p) for p in tmp_path.iterdir())
    df = alignments.read_bam(spark, paths)
    assert df.rdd.getNumPartitions() == 1 and df.count() == 100 and df.select("path").distinct().count() == 20
    (tmp_path / "c00_1.bam").write_bytes(b"no archive at all")
    with pytest.raises(Exception, match="not a BAM"):
        df.count()
    (tmp_path / "c00_1.bam").write_bytes(bam_bytes(sorted_records(50), NAMES)[:400])
    with pytest.raises(Exception, match="BAM file ends|incomplete|Error"):
        df.count()
    with pytest.raises(Exception, match="gone.bam"):
        alignments.read_bam(spark, [str(tmp_path / "gone.bam")]).count()
    with pytest.raises(ValueError, match="not a BAI"):
        bam.Index(b"BAX\1")
