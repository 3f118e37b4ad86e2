"""Secret scans through nested encodings.

A text is a first layer. Each layer is scanned for secrets, then unwrapped: percent escapes, Unicode escapes, base64 runs
and the compressed data in any of them give new layers, until no new one comes up. Bytes are decompressed until nothing in
them is compressed any more; those that aren't UTF-8 are layers of Latin-1 characters, those that look like UTF-16 are read
as such as well. A layer knows how its characters lie in the layer above, so that a secret of any layer is reported where it
lies in the text. What a compressed stream gives is one place in the text, so a long one is looked through in chunks.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_rows

# The patterns of the three kinds of secrets, and the fewest characters that each needs.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "api")

#: Runs that may be base64; access keys and hex strings lie within such runs as well.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64: runs of 12 and more, the last of any length, one below the other or with escaped line ends between,
#: indented or not.
FOLDED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]{2,})+={0,2}")
LINE_END = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
#: What a layer of bytes must have so that it can hold secrets or further layers: all patterns above start with one of these.
ACTIVE = re.compile(rb"[A-Za-z0-9+/_-]{16}|%[0-9a-f]{2}|\\[ux]|&#[x0-9]|password|passwd|secret|token|api", re.I)
#: Compressed streams behind other bytes (in an archive, or a later member).
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: The first byte of zlib's header, for any window; the second is checked. Behind other bytes a stream must end as it should.
ZLIB = re.compile(rb"[\x08\x18\x28\x38\x48\x58\x68\x78]")
PADDING = re.compile(rb"\x00*")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]")
#: Decompressed data come in chunks of so many bytes, or more where a run of characters or a stream within goes on; each
#: begins with the end of the one before.
CHUNK, OVERLAP = 32_000_000, 1_000_000
#: What may go on in the next chunk: all but blanks and control characters.
UNBROKEN = bytes([10, 13, *range(33, 127)])


class Layer:
    """A text; above, the layer that it was unwrapped from, and up(a, b), where characters a to b lie there."""

    __slots__ = ("text", "above", "up")

    def __init__(self, text: str, above: Layer | None = None, up: Callable[[int, int], tuple[int, int]] | None = None):
        self.text, self.above, self.up = text, above, up

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The span in the first text of characters a to b of this one."""
        layer = self
        while layer.above is not None:
            a, b = layer.up(a, b)
            layer = layer.above
        return a, b


class Pieces:
    """Runs of characters that each stand for `step` characters of the layer above, from `start` on."""

    def __init__(self):
        self.at, self.start, self.step, self.size = array("q"), array("q"), array("q"), 0

    def add(self, n: int, start: int, step: int) -> None:
        if n:
            if not (self.at and self.step[-1] == step and self.start[-1] + (self.size - self.at[-1]) * step == start):
                self.at.append(self.size)
                self.start.append(start)
                self.step.append(step)
            self.size += n

    def up(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        return self.start[i] + (a - self.at[i]) * self.step[i], self.start[j] + (b - self.at[j]) * self.step[j]


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand in a text as it is.

    A maximal run of hex digits, or of what may follow AKIA, is long enough or holds no match at all, so the length can
    be part of those two patterns. For assignments it can't: a short value ends the match that it belongs to.
    """
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for run in RUN.finditer(text):
        a, b = run.span()
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(found)


def _zlib_header(head: bytes) -> bool:
    """Whether these are zlib's two bytes: deflate, a window of 32K at most, no dictionary, and a multiple of 31."""
    return len(head) > 1 and head[0] & 15 == 8 and head[0] >> 4 < 8 and not head[1] & 32 and (head[0] << 8 | head[1]) % 31 == 0


def _decompressor(head: bytes):
    """A decompressor for a stream with these first bytes, and how many bytes it takes at a time; None if it is none."""
    if head[:2] == b"\x1f\x8b" or _zlib_header(head):
        return zlib.decompressobj(47), 1 << 16
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor(), 1 << 16
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(), 1 << 16
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj(), 1 << 10  # it takes no limit, few bytes give little
    return None


def _stream(data: bytes, at: int) -> Iterator[tuple[bytes, int, bool]]:
    """(output, place behind what was read, whether the stream has ended) of the compressed stream at a place, in steps.

    A stream that is damaged farther on ends there.
    """
    made = _decompressor(data[at : at + 6])
    if made is None:
        return
    d, step = made
    limit = [] if step == 1 << 10 else [1 << 20]
    try:
        while not d.eof:
            piece = data[at : at + step] if getattr(d, "needs_input", True) else b""
            out = d.decompress(piece, *limit)
            if not piece and not out:
                return
            at += len(piece) - len(d.unused_data) - len(getattr(d, "unconsumed_tail", b""))
            yield out, at, d.eof
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def _members(data: bytes, at: int) -> Iterator[bytes]:
    """The output of the compressed streams that follow each other from a place on."""
    end, ended = at, True
    while ended:
        ended = False
        for out, end, ended in _stream(data, end):
            if out:
                yield out
        end = PADDING.match(data, end).end()


def _goes_on(data: bytes) -> bool:
    """Whether the end of data lies within a run of characters or a compressed stream that begins before the overlap."""
    edge = len(data) - OVERLAP
    if len(data.rstrip(UNBROKEN)) < edge:
        return True
    for m in MAGIC.finditer(data, 0, edge):
        end, ended = 0, True
        for _, end, ended in _stream(data, m.start()):
            pass
        if not ended and end >= len(data):
            return True
    return False


def inflate(data: bytes, at: int = 0) -> Iterator[bytes]:
    """What the compressed streams from a place on give, in chunks that begin with the end of the one before."""
    held, limit = bytearray(), CHUNK
    for out in _members(data, at):
        held += out
        if len(held) >= limit:
            chunk = bytes(held)
            if _goes_on(chunk):
                limit += CHUNK
            else:
                yield chunk
                del held[: len(held) - OVERLAP]
                limit = len(held) + CHUNK
    if held:
        yield bytes(held)


def readable(data: bytes) -> str | None:
    """data as text, if it is UTF-8 of mostly printable characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and len(CONTROL.findall(text)) * 20 <= len(text) else None


def byte_places(text: str, code: str, every: int = 2048) -> Callable[[int], int]:
    """From a place in the text to that in its bytes: the bytes up to every 2048th character are noted, when first asked."""
    noted: list[int] = []

    def place(i: int) -> int:
        if not noted:
            noted.extend(itertools.accumulate((len(text[k : k + every].encode(code)) for k in range(0, len(text), every)), initial=0))
        k = i // every
        return noted[k] + len(text[k * every : i].encode(code))

    return place


def readings(data: bytes) -> Iterator[tuple[str, Callable[[int], int] | None]]:
    """data as texts that may hold something, and from a place in the text to the byte (None: the same).

    UTF-8, or characters of one byte each where it isn't that, and UTF-16 where every other byte is mostly 0.
    """
    for first, code in ((1, "utf-16-le"), (0, "utf-16-be")):
        half = data[first::2]
        if len(half) >= 8 and half.count(0) * 2 > len(half):
            wide = data[: len(data) // 2 * 2].decode(code, "replace")
            yield wide, byte_places(wide, code)
            break
    text = readable(data)
    if text is None and ACTIVE.search(data):
        try:
            text = data.decode()
        except UnicodeDecodeError:
            yield data.decode("latin-1"), None
    if text is not None:
        yield text, None if text.isascii() else byte_places(text, "utf-8")


def _whole(data: bytes, at: int, window: int) -> bytes | None:
    """The output of a deflate stream from a place on if it ends as it should: with its checksum, or, without a header, with the data."""
    d = zlib.decompressobj(window)
    try:
        out = d.decompress(data[at:] if at else data)
    except zlib.error:
        return None
    return out if d.eof and out and (window > 0 or not d.unused_data) else None


def _packed(layer: Layer, data: bytes, a: int, b: int) -> list[Layer]:
    """The layers of what data gives, decompressed until nothing in it is compressed, all at the span a to b of the layer."""
    out: list[Layer] = []
    work, seen = [data], set()
    while work:
        data = work.pop()
        some = itertools.chain.from_iterable(inflate(data, at) for at in (0, *(m.start() for m in MAGIC.finditer(data, 1))))
        hidden = (_whole(data, m.start(), 15) for m in ZLIB.finditer(data, 1) if _zlib_header(data[m.start() : m.start() + 2]))
        for got in itertools.chain(some, hidden, [_whole(data, 0, -15)] if len(data) >= 12 else []):
            if got and (key := hashlib.sha256(got).digest()) not in seen:
                seen.add(key)
                work.append(got)
                out += [Layer(text, layer, lambda *_: (a, b)) for text, _ in readings(got)]
    return out


def _escapes(layer: Layer, pattern: re.Pattern) -> list[Layer]:
    """The whole layer with all escapes of one sort replaced, and layers from compressed or wide bytes among them."""
    text, parts, pieces, extra, at = layer.text, [], Pieces(), [], 0
    high: tuple[int, int, int] | None = None  # the first half of a surrogate pair, with its place

    def put(c: str, start: int, step: int) -> None:
        parts.append(c)
        pieces.add(len(c), start, step)

    def lone() -> None:
        nonlocal high
        if high is not None:
            put("\ufffd", high[1], high[2] - high[1])
            high = None

    for m in pattern.finditer(text):
        if m.start() > at or high is None or m[0][:1] != "\\":
            lone()
        put(text[at : m.start()], at, 1)
        at, s = m.end(), m[0]
        if s[0] == "%" or s[:2] == "\\x":
            lone()
            step = 3 if s[0] == "%" else 4
            data = bytes.fromhex(s.replace("%" if step == 3 else "\\x", ""))
            if len(data) >= 10:
                extra += _packed(layer, data, m.start(), m.end())
                extra += _wide(layer, data, lambda i, j, a=m.start(), step=step: (a + i * step, a + j * step))
            try:
                here = data.decode()
            except UnicodeDecodeError:
                here = data.decode("latin-1")
                put(here, m.start(), step)
                continue
            if here.isascii():
                put(here, m.start(), step)
                continue
            spot = m.start()
            for c in here:
                n = len(c.encode()) * step
                put(c, spot, n)
                spot += n
            continue
        code = int(s[3:-1], 16) if s[:3] in ("&#x", "&#X", "\\u{") else int(s[2:-1]) if s[0] == "&" else int(s[2:], 16)
        if 0xDC00 <= code < 0xE000 and high is not None:
            put(chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00), high[1], m.end() - high[1])
            high = None
            continue
        lone()
        if 0xD800 <= code < 0xDC00:
            high = (code, m.start(), m.end())
        else:
            put(chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "\ufffd", m.start(), m.end() - m.start())
    if not at:
        return []
    lone()
    put(text[at:], at, 1)
    return [Layer("".join(parts), layer, pieces.up), *extra]


def _wide(layer: Layer, data: bytes, place: Callable[[int, int], tuple[int, int]]) -> list[Layer]:
    """The UTF-16 reading of bytes, if they have one; place(i, j) is where bytes i to j lie in the layer."""
    return [Layer(t, layer, lambda a, b, to=to: place(to(a), to(b))) for t, to in readings(data) if to is not None and len(t) * 2 <= len(data) + 1 and "\0" not in t[:8]]


def _base64(layer: Layer) -> list[Layer]:
    """What base64 in the layer gives: runs, decoded from each of their first four characters, as other characters may stand
    right before the encoded ones (a path, a prefix), and lines of it put together."""
    text, out = layer.text, []

    def decode(lines: list[tuple[int, int]], skip: int) -> None:
        digits = "".join([text[a:b] for a, b in lines]).translate(_DIGITS)[skip:]
        if len(digits) % 4 == 1:
            digits = digits[:-1]
        if len(digits) < 8:
            return
        try:
            data = base64.b64decode(digits + "=" * (-len(digits) % 4))
        except (binascii.Error, ValueError):
            return
        before = [0, *itertools.accumulate(b - a for a, b in lines)]

        def digit(i: int) -> int:
            k = bisect_right(before, i + skip) - 1
            return lines[k][0] + i + skip - before[k]

        def place(i: int, j: int) -> tuple[int, int]:
            """Byte i is in digits 8i // 6 to (8i + 7) // 6."""
            return digit(8 * i // 6), digit((8 * j - 1) // 6) + 1

        out.extend(_packed(layer, data, digit(0), digit(len(digits) - 1) + 1))
        out.extend(Layer(t, layer, (lambda a, b, to=to: place(to(a), to(b))) if to else place) for t, to in readings(data))

    for run in RUN.finditer(text):
        for skip in range(4):
            decode([run.span()], skip)
    for run in FOLDED.finditer(text) if "\n" in text or "\\n" in text else ():
        lines, at = [], run.start()
        for end in LINE_END.finditer(text, *run.span()):
            lines.append((at, end.start()))
            at = end.end()
        lines.append((at, run.end()))
        for block in _blocks(lines):
            for skip in range(4):
                decode(block, skip)
    return out


def _blocks(lines: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Lines that may be one encoding: of equal width but for a shorter last one, and those with the line before them, which
    a name or a prefix may have made shorter or longer."""
    size = [b - a for a, b in lines]
    start = 0
    while start < len(lines) - 1:
        end = start + 1
        while end < len(lines) and size[end] == size[start]:
            end += 1
        stop = end + 1 if end < len(lines) and size[end] < size[start] else end
        if stop - start > 1:
            yield lines[start:stop]
        if start:
            yield lines[start - 1 : stop]
        start = end


#: The URL-safe digits as the others, without padding and line ends.
_DIGITS = str.maketrans("-_", "+/", "=\r\n")


def unwrap(layer: Layer) -> list[Layer]:
    """The layers one step below."""
    text, out = layer.text, _base64(layer)
    for pattern, there in ((PERCENT, "%" in text), (ESCAPE, "\\" in text or "&#" in text)):
        if there:
            out += _escapes(layer, pattern)
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (start, kind, end), and the number of layers.

    A layer that comes up again at the same place (as a self-reproducing archive would) is not followed again.
    """
    base = find(text)
    spans, seen = set(base), set()
    work = [Layer(text)]
    while work:
        layer = work.pop()
        if layer.above is not None and not layer.text:
            continue
        key = (hashlib.sha256(layer.text.encode("utf-8", "replace")).digest(), *layer.span(0, len(layer.text))) if layer.above is not None else None
        if key in seen:
            continue
        seen.add(key)
        if layer.above is not None:
            for a, kind, b in find(layer.text):
                start, end = layer.span(a, b)
                spans.add((start, kind, end))
        work += unwrap(layer)
    return base, sorted(spans), len(seen)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with every span replaced, overlapping ones by a single mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """A row for each document: id, n_assign, n_access, n_hex, base_sha256, spans, n_spans, n_layers.

    The counts and base_sha256 are of secrets in the plain text; spans also has those of deeper layers. A null text is
    empty and has no spans; repeated rows give repeated results, no documents none. Very long texts and layers are scanned
    whole. Of spans that begin alike the kinds stand in order. With redacted, a column of that name has the text without
    its secrets (null for null).
    """
    id_type = docs.schema[id_col].dataType
    names = [("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string"), ("n_spans", "bigint"), ("n_layers", "bigint")]
    more = [("redacted", "string")] if redacted else []
    kinds = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches):
        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("_id", batch.schema.field(0).type), *((n, kinds[t]) for n, t in names + more)])
                out = arrow_rows(schema)
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                base, spans, layers = scan(raw or "")
                of = [sum(1 for s in base if s[1] == k) for k in range(3)]
                row = (id_, *of, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), layers)
                yield from out.add(*row, *([raw and redact(raw, spans)] if redacted else []))
        if schema is not None:
            yield from out.flush()

    ddl = f"_id {id_type.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in names + more)
    return docs.select(id_col, text_col).mapInArrow(run, ddl).withColumnRenamed("_id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The documents with the secrets of all layers replaced in text_col, other columns as they were.

    length_col, if docs have it, becomes the length of a text that changed. A null text stays null, an empty one empty; very
    long texts are scanned whole; repeated rows stay repeated, no documents give none. Overlapping secrets are replaced by
    one mark. Columns may have any names.
    """
    names = docs.columns
    at, length = names.index(text_col), names.index(length_col) if length_col in names else None
    inner = docs.withColumn(text_col, docs[text_col].cast("string")).toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            columns = list(batch.columns)
            new = [t and redact(t, scan(t)[1], mark) for t in texts]
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                sizes = [n if a == b else len(b) for n, a, b in zip(columns[length].to_pylist(), texts, new)]
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return inner.mapInArrow(run, inner.schema).toDF(*names)
