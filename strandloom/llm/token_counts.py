"""Token counts of a unigram tokenizer, without making the tokens.

The vocabulary's pieces are found by an Aho-Corasick automaton, and dynamic programming carries the best score and the
number of pieces up to every position. No piece goes on past a space into a word or over a line end, so the best way
through a text is that of its words: every word's count is remembered.
"""

from __future__ import annotations

import math
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: What the best path loses for a character that no piece covers, below the lowest score; as the tokenizers have it.
UNKNOWN_PENALTY = 10.0


def fields(data: bytes):
    """(number, wire type, value, start, end) of a protocol buffer's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        start = at
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value, start, at


def read_vocabulary(path: str) -> dict:
    """Pieces and flags of a tokenizer model file: normal pieces with their scores, byte fallback, dummy prefix."""
    pieces, min_score, byte_fallback = {}, None, False
    dummy, squeeze = True, True
    with open(path, "rb") as f:
        model = f.read()
    for number, _, value, *_ in fields(model):
        if number == 1:
            piece = {n: v for n, _, v, *_ in fields(value)}
            score, kind = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, 1)
            byte_fallback |= kind == 6
            if kind in (1, 4):
                pieces[piece[1].decode()] = score
            if kind == 1:
                min_score = score if min_score is None else min(min_score, score)
        elif number == 3:
            spec = {n: v for n, _, v, *_ in fields(value)}
            dummy, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            if spec.get(2):
                raise ValueError("vocabularies with a table of character rules aren't supported")
    return {"pieces": pieces, "min_score": min_score or 0.0, "byte_fallback": byte_fallback, "dummy": dummy, "squeeze": squeeze}


class Counter(dict):
    """word -> number of tokens, remembered up to a fixed number of words."""

    LIMIT = 600_000
    LONGEST = 64

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.unknown = vocabulary["min_score"] - UNKNOWN_PENALTY
        self.bytes, self.dummy, self.squeeze = (vocabulary[k] for k in ("byte_fallback", "dummy", "squeeze"))
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary["pieces"].items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        inner = [p for p in vocabulary["pieces"] if SPACE in p.lstrip(SPACE) or "\n" in p[1:] or "\n" in p[:-1]]
        if inner:
            raise ValueError(f"pieces that go over the end of a word: {inner[:5]}")
        self.first_of_word = re.compile(f"{SPACE}*[^{SPACE}]*")
        self.alone = {p for p in vocabulary["pieces"] if len(p) == 1}
        self.pairs = {p[i : i + 2] for p in vocabulary["pieces"] for i in range(len(p) - 1)}

    def parts(self, word: str) -> list[str]:
        """word, cut between any two characters that stand side by side in no piece: no path goes across."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def known(self, word: str) -> int:
        """As viterbi(), where every character is a piece: pieces alone lead to the end."""
        score, count = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
        for last, (size, own) in self.automaton.iter(word):
            start = last + 1 - size
            value = score[start] + own
            if value > score[last + 1]:
                score[last + 1] = value
                count[last + 1] = count[start] + 1
        return count[-1]

    def viterbi(self, word: str) -> int:
        """The number of pieces on the best path.

        Into a position, a longer piece comes before a shorter one and a later path must be better, not as good. The
        unknown character comes last and only where no piece of one character fits. Unknown characters count their
        bytes, or a run of them counts one where the vocabulary has no pieces for bytes.
        """
        score, count, odd = [0.0], [0], [False]
        found = self.automaton.iter(word)
        last, piece = next(found, (-1, None))
        for end, char in enumerate(word):
            best, n, unknown, single = None, 0, False, False
            while last == end:
                size, own = piece
                value = score[end + 1 - size] + own
                if best is None or value > best:
                    best, n = value, count[end + 1 - size] + 1
                single |= size == 1
                last, piece = next(found, (-1, None))
            if not single and (best is None or score[end] + self.unknown > best):
                best, unknown = score[end] + self.unknown, True
                n = count[end] + (len(char.encode()) if self.bytes else int(not odd[end]))
            score.append(best)
            count.append(n)
            odd.append(unknown)
        return count[-1]

    def __missing__(self, word: str) -> int:
        parts = self.parts(word) if self.bytes else [word]
        if len(parts) > 1:
            n = sum(self[p] for p in parts)
        else:
            n = self.known(word) if self.alone.issuperset(word) else self.viterbi(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; 0 for an empty one."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return 0
        text = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        if not self.bytes:  # a run of unknown characters counts one, even over the ends of words
            return self.viterbi(text)
        total, lines = 0, text.split("\n")
        for line in lines:
            words = line.split(SPACE)
            if "" in words[1:]:  # runs of spaces, or one at the end
                total += sum(self[w] for w in self.first_of_word.findall(line) if w)
            else:
                total += self[words[0]] if words[0] else 0
                total += sum([self[SPACE + w] for w in words[1:]])
        return total + (len(lines) - 1) * self["\n"]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_tokens, n_chars (0 for null and empty texts); repeated rows repeat.

    The driver reads the vocabulary, whose size doesn't depend on the data, and sends it along.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        if vocabulary_path not in _counters:
            _counters[vocabulary_path] = Counter(vocabulary.value)
        counter = _counters[vocabulary_path]
        for batch in batches:
            texts = batch.column(1)
            n = [counter.count(t.as_py() or "") for t in texts]
            chars = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), chars], ["_id", "n_tokens", "n_chars"])

    ddl = f"_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_chars bigint"
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, ddl).withColumnRenamed("_id", id_col)
