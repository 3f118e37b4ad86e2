"""BAM files as a data source: ranges of bytes become tasks, regions are found by their index.

A BAM file is a series of compressed blocks (BGZF). A virtual offset is a block's place in the file times 65,536 plus a place
in the decompressed block. A task gets a range of bytes and yields the records that start in blocks of it. Where its first
record starts is told by the index (BAI) if there is one, as all tasks read the same known starts; otherwise the task looks for
the first block, and in it for the first place from which on records follow each other. Files are opened by pyarrow's file
systems, so they may lie in a local or mounted folder, HDFS, S3 or GCS, and may have any size.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READS = "path string, name string, flag int, chromosome string, start bigint, mapq int, cigar string, seq string, qual string, score int"
SCHEMA = pa.schema([("path", pa.string()), ("name", pa.string()), ("flag", pa.int32()), ("chromosome", pa.string()), ("start", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("score", pa.int32())])
# The letters of the format's CIGAR operations and bases, those that use up reference, and the first bytes of a block.
CIGAR_LETTERS, BASE_LETTERS, ON_REFERENCE, BLOCK_START = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", "MDN=X", b"\x1f\x8b\x08\x04"
#: Compressed bytes of a task, and rows of a batch.
SPLIT, ROWS = 128 << 20, 10_000
#: So many records in a row must be sound where a task looks for a record's start.
SOUND = 24
END = 1 << 63


def block_size(head: bytes) -> int | None:
    """Bytes of the block that starts with head, by its size field; None if head is no start of a BGZF block."""
    if len(head) < 18 or head[:4] != BLOCK_START:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 6 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


class Blocks:
    """The decompressed bytes of a file from some block on; holds one block and what a read needs.

    Other gzip files than BGZF are read in pieces, as a single block. blocks counts what was decompressed.
    """

    def __init__(self, file, at: int = 0):
        self.file, self.blocks, self.plain = file, 0, None
        self.seek(at << 16)

    def seek(self, virtual: int) -> None:
        self.held, self.at, self.base, self.here, self.next = b"", 0, 0, virtual >> 16, virtual >> 16  # base: where in held the block starts
        if virtual & 0xFFFF:
            self.held = self._load() or b""
            self.at = virtual & 0xFFFF

    def _load(self) -> bytes | None:
        if self.plain is not None:
            return self._piece()
        self.file.seek(self.next)
        head = self.file.read(18)
        if not head:
            return None
        extra = 12 + int.from_bytes(head[10:12], "little")
        head += self.file.read(max(0, extra - 18))
        size = block_size(head)
        self.here, self.blocks = self.next, self.blocks + 1
        if size is None:
            if self.next or head[:2] != BLOCK_START[:2]:
                raise ValueError("not a BAM file")
            self.file.seek(0)
            self.plain = zlib.decompressobj(31)
            return self._piece()
        self.next += size
        return zlib.decompress(self.file.read(size - extra)[:-8], -15)

    def _piece(self) -> bytes | None:
        while True:
            data = self.plain.unconsumed_tail or self.plain.unused_data or self.file.read(1 << 20)
            if not data:
                return None
            if self.plain.eof:
                self.plain = zlib.decompressobj(31)
            if out := self.plain.decompress(data, 1 << 24):
                return out

    def more(self) -> bool:
        """Whether there is another byte; then it is in held."""
        while self.at == len(self.held):
            loaded = self._load()
            if loaded is None:
                return False
            self.held, self.at, self.base = loaded, 0, 0
        return True

    def tell(self) -> int:
        """The virtual offset of the next byte, after more()."""
        return self.here << 16 | min(self.at - self.base, 0xFFFF)

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            loaded = self._load()
            if loaded is None:
                raise ValueError("a BAM file ends within a record")
            self.base = len(self.held) - self.at
            self.held, self.at = self.held[self.at :] + loaded, 0
        self.at += n
        return self.held[self.at - n : self.at]


def header(raw: Blocks) -> list[str]:
    """Names of the references; raw is left at the first record."""
    number = lambda: struct.unpack("<i", raw.take(4))[0]
    if raw.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    raw.take(number())
    names = []
    for _ in range(number()):
        names.append(raw.take(number())[:-1].decode())
        number()
    return names


class Index:
    """A BAI index: chunks by reference and bin, the linear index, and all starts of records that either names."""

    def __init__(self, data: bytes):
        if data[:4] != b"BAI\1":
            raise ValueError("not a BAI index")
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.linear: list[np.ndarray] = []
        starts, at = [np.zeros(0, np.uint64)], 8
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            own = {}
            n_bins, at = struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(n_bins):
                number, n = struct.unpack_from("<Ii", data, at)
                pairs = np.frombuffer(data, "<u8", 2 * n, at + 8).reshape(-1, 2)
                if number != 37450:  # that one counts reads
                    own[number] = [(int(a), int(b)) for a, b in pairs]
                    starts.append(pairs[:, 0])
                at += 8 + 16 * n
            n, at = struct.unpack_from("<i", data, at)[0], at + 4
            self.linear.append(np.frombuffer(data, "<u8", n, at))
            starts.append(self.linear[-1])
            self.bins.append(own)
            at += 8 * n
        self.starts = np.unique(np.concatenate(starts))
        self.starts = self.starts[self.starts > 0]

    def chunks(self, reference: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that hold all records over the places begin to before end."""
        if reference >= len(self.bins):
            return []
        last = max(begin, min(end, 1 << 29) - 1)
        numbers = [0]
        for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
            numbers.extend(range(first + (begin >> shift), first + (last >> shift) + 1))
        linear = self.linear[reference]
        least = int(linear[min(begin >> 14, len(linear) - 1)]) if len(linear) else 0
        own = self.bins[reference]
        wanted = own.keys() if len(numbers) > len(own) else numbers
        inside = set(numbers)
        return [(max(a, least), b) for n in wanted if n in inside for a, b in own.get(n, ()) if b > least]

    def cut(self, at: int) -> int:
        """The first known start of a record in a block from byte `at` on."""
        k = int(np.searchsorted(self.starts, np.uint64(at << 16)))
        return int(self.starts[k]) if k < len(self.starts) else END


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def first_block(file, at: int, size: int) -> int | None:
    """The place of the first block that starts at byte `at` or later; two more must follow it, or the file's end."""

    def follows(place: int, more: int) -> bool:
        if place == size:
            return True
        file.seek(place)
        n = block_size(file.read(64))
        return n is not None and place + n <= size and (more == 0 or follows(place + n, more - 1))

    while at < size:
        file.seek(at)
        data = file.read(1 << 17)
        spot = data.find(BLOCK_START)
        while spot >= 0:
            if follows(at + spot, 2):
                return at + spot
            spot = data.find(BLOCK_START, spot + 1)
        at += max(1, len(data) - 3)
    return None


def _sound(data: bytes, at: int, references: int) -> int | None:
    """Where the record at this place ends if all its fields are sound; None if not. It may end behind the data."""
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (32 < size < 1 << 28 and l_seq >= 0 and l_name > 1 and least <= size and -1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1):
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(file, at: int, size: int, references: int) -> int:
    """The virtual offset of the first record that starts in a block from byte `at` on; END if there is none."""
    block = first_block(file, at, size)
    if block is None:
        return END
    raw, data, edges = Blocks(file, block), b"", []
    ended, tried = False, 0
    while True:
        goal = max(1 << 18, 2 * len(data))
        while not ended and len(data) < goal:
            raw.at = len(raw.held)
            if ended := not raw.more():
                break
            edges.append((len(data), raw.here))
            data += raw.held
        for start in range(tried, len(data) - 36 + 1):
            spot, n = start, 0
            while n < SOUND and spot is not None and spot + 36 <= len(data):
                spot, n = _sound(data, spot, references), n + 1
            if spot is None or (ended and n < SOUND and spot != len(data)):
                continue
            if not ended and n < SOUND:  # that was too little to tell
                tried = start
                break
            begin, here = next(e for e in reversed(edges) if e[0] <= start)
            return here << 16 | start - begin
        else:
            tried = max(0, len(data) - 35)
        if ended:
            return END


def _score(raw: bytes, at: int, end: int) -> int:
    sizes = {65: 1, 99: 1, 67: 1, 115: 2, 83: 2, 105: 4, 73: 4, 102: 4}
    forms = {99: "b", 67: "B", 115: "<h", 83: "<H", 105: "<i", 73: "<I"}
    while at < end:
        tag, kind = raw[at : at + 2], raw[at + 2]
        at += 3
        if tag == b"AS" and kind in forms:
            return struct.unpack_from(forms[kind], raw, at)[0]
        if kind in (90, 72):
            at = raw.index(b"\0", at) + 1
        elif kind == 66:
            at += 5 + sizes[raw[at]] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            at += sizes[kind]
    return 0


Regions = dict[int, list[tuple[int, int]]]


def records(raw: Blocks, names: list[str], stop: int = END, regions: Regions | None = None):
    """(name, flag, chromosome, 1-based start, mapping quality, cigar, bases, qualities, alignment score) up to an offset.

    regions: 0-based half-open ranges by reference; records that touch none are stepped over.
    """
    while raw.more() and (raw.plain is not None or raw.tell() < stop):
        record = raw.take(struct.unpack("<i", raw.take(4))[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", record)
        if regions is not None and ref not in regions:
            continue
        p = 32 + l_name
        name = record[32 : p - 1].decode()
        ops = struct.unpack_from(f"<{n_cigar}I", record, p)
        if regions is not None:
            end = pos + max(1, sum(o >> 4 for o in ops if CIGAR_LETTERS[o & 15] in ON_REFERENCE))
            if not any(a < end and pos < b for a, b in regions[ref]):
                continue
        p += 4 * n_cigar
        packed = record[p : p + (l_seq + 1) // 2]
        seq = "".join(BASE_LETTERS[b >> 4] + BASE_LETTERS[b & 15] for b in packed)[:l_seq]
        p += (l_seq + 1) // 2
        qual = "".join(chr(min(q, 93) + 33) for q in record[p : p + l_seq])
        chromosome = names[ref] if ref >= 0 else "*"
        yield name, flag, chromosome, pos + 1, mapq, "".join(f"{o >> 4}{CIGAR_LETTERS[o & 15]}" for o in ops) or "*", seq, qual, _score(record, p + l_seq, len(record))


def bam_records(data: bytes, wanted: set[str] | None = None):
    """The records of a whole file in memory, on the wanted references only if given."""
    raw = Blocks(io.BytesIO(data))
    names = header(raw)
    yield from records(raw, names, regions=None if wanted is None else {i: [(-1, 1 << 31)] for i, n in enumerate(names) if n in wanted})


class Range:
    """The records of a file that start in blocks from byte lo to before hi, in the regions (name, begin, end) if given."""

    def __init__(self, file, size: int, lo: int, hi: int, index: Index | None = None, regions: list[tuple[str, int, int]] | None = None):
        self.file, self.size, self.lo, self.hi, self.index, self.regions = file, size, lo, hi, index, regions
        self.raw = Blocks(file)

    def __iter__(self):
        raw = self.raw
        names = header(raw)
        number = {n: i for i, n in enumerate(names)}
        own: Regions | None = None
        if self.regions is not None:
            own = {}
            for name, begin, end in self.regions:
                if name in number:
                    own.setdefault(number[name], []).append((begin, end))
        if raw.plain is not None:  # can't be split: the first range has it all
            if self.lo == 0:
                yield from records(raw, names, regions=own)
            return
        first = raw.tell() if raw.more() else END
        if self.index is None:
            start = first if self.lo == 0 else max(first, first_record(self.file, self.lo, self.size, len(names)))
            ranges = [(start, END if self.hi >= self.size else self.hi << 16)]
        else:
            start = first if self.lo == 0 else max(first, self.index.cut(self.lo))
            stop = END if self.hi >= self.size else max(first, self.index.cut(self.hi))
            ranges = [(start, stop)]
            if own is not None:
                chunks = merged([c for ref, parts in own.items() for begin, end in parts for c in self.index.chunks(ref, max(0, begin), end)])
                ranges = [(max(a, start), min(b, stop)) for a, b in chunks]
        for a, b in ranges:
            if a < b and a < END:
                raw.seek(a)
                yield from records(raw, names, b, own)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path or URI, and the path in it."""
    if re.match("file:", path) or not re.match(r"[a-zA-Z][\w+.-]*:", path):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def load_index(path: str) -> Index | None:
    """The index beside a file: x.bam.bai or x.bai."""
    system, inner = file_system(path)
    for name in (f"{inner}.bai", re.sub(r"\.bam$", ".bai", inner)):
        if name != inner and system.get_file_info(name).type == fs.FileType.File:
            with system.open_input_file(name) as f:
                return Index(f.read())
    return None


class Part(InputPartition):
    """Ranges (path, lo, hi, size) of one task."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("splitbytes", SPLIT))
        self.regions = json.loads(options["regions"]) if "regions" in options else None

    def partitions(self) -> list[Part]:
        """Files cut into ranges of about split bytes; small files share a task."""
        out, room = [], 0
        for path in self.paths:
            system, inner = file_system(path)
            info = system.get_file_info(inner)
            if info.type != fs.FileType.File:
                raise FileNotFoundError(path)
            n = max(1, -(-info.size // self.split))
            for k in range(n):
                one = (path, info.size * k // n, info.size * (k + 1) // n, info.size)
                if one[2] - one[1] > room:
                    out.append([])
                    room = self.split
                out[-1].append(one)
                room -= one[2] - one[1]
        return [Part(ranges) for ranges in out]

    def read(self, partition: Part):
        rows: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
        for path, lo, hi, size in partition.ranges:
            index = load_index(path) if self.regions is not None or (lo, hi) != (0, size) else None
            system, inner = file_system(path)
            with io.BufferedReader(system.open_input_file(inner), 1 << 17) as file:
                for record in Range(file, size, lo, hi, index, self.regions):
                    rows.append((path, *record))
                    if len(rows) == ROWS:
                        yield pack()
                        rows = []
        if rows:
            yield pack()


class BamSource(DataSource):
    """spark.read.format('bam'): options path or paths (JSON list), regions (JSON list of name, begin, end; 0-based, half open), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_regions(spark: SparkSession, paths: list[str], regions: list[tuple[str, int, int]] | None = None, split: int = SPLIT) -> DataFrame:
    """Reads of the files that touch the regions; all reads without regions. With an index only the regions' blocks are read."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("paths", json.dumps(paths)).option("splitBytes", str(split))
    return (reader if regions is None else reader.option("regions", json.dumps(regions))).load()
