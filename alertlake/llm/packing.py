"""Packing of token sequences by minimum bin slack.

Documents stream through a task. What is longer than a window fills windows of its own; the rest waits as a multiset of lengths.
Each window takes the longest waiting piece and then the sub-multiset of the others whose sum comes closest to the room left: a
subset-sum over bitsets (bit s of an integer says that s tokens can be had), with the steps kept so that the chosen counts are
read back. Room that no sum fills takes the head of one more piece, as documents may be cut. Work stays within the task; only
its last, partly filled window is written as sequences whose lengths are powers of two, so nothing needs padding.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed one by one; an empty table gives no row.
Results are the same for a partition whenever its rows come in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from alertlake.llm.common import id_and_text, slices, with_id

END = 1
#: Bytes that one of a worker's two memories may take, the longest key that is remembered, and what an entry takes besides its bytes.
CACHED = 256 << 20
LONGEST = 64
ENTRY = 240
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: The settings under which a text's ids are those of its words and a word's those of its pieces.
KNOWN_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None}


@dataclass(frozen=True)
class Window:
    """hold: waiting tokens at which a task starts to close windows."""

    size: int = 2048
    hold: int = 1 << 21


class Recent(dict):
    """Found once, then remembered: the latest entries, up to ``room`` (else ``CACHED``) bytes with their overhead. ``find`` makes what is missing.

    Long keys are found anew each time; they are rare, and one of them could take more than all others.
    """

    def __init__(self, find, room: int | None = None):
        self.find, self.room, self.older, self.bytes = find, room, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) > LONGEST:
            return value
        self.bytes += len(key) + len(value) + ENTRY
        if self.bytes >= (self.room or CACHED) // 2:
            self.older, self.bytes = dict(self), 0
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Token ids of texts, as little-endian 32-bit numbers, by way of their blank-separated words.

    The tokenizer never joins text over an ASCII blank, so the ids of a text are those of its words. Printable words go piece by
    piece through the vocabulary's merges, which saves building a whole encoding for each; all others through the tokenizer. Both
    words and pieces are remembered. A tokenizer with other settings than ``KNOWN_SETTINGS`` gets whole texts instead.
    """

    def __init__(self, source: str, room: int | None = None):
        import json
        import re

        import regex
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(source)
        settings = json.loads(source)
        self.by_word = all(settings.get(k) == v for k, v in KNOWN_SETTINGS.items())
        self.split = regex.compile(WORD).findall
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        # The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code above 255.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.stand_in = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.words, self.pieces = Recent(self._word, room), Recent(self._piece, room)

    def _piece(self, piece: str) -> bytes:
        from array import array

        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.stand_in)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        import sys
        from unicodedata import is_normalized

        text = word.decode("utf-8", "replace")
        if sys.byteorder != "little" or not text.isprintable():
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        if text.isascii() or is_normalized("NFC", text) and "\u03a3" not in text:  # lower() treats a final sigma in its own way
            text = text.lower()
        else:
            text = self.tokenizer.normalizer.normalize_str(text)
        if text.isalpha():
            return self.pieces[text]
        if text[:-1].isalpha() and not (text[-1].isalpha() or text[-1].isnumeric()):
            return self.pieces[text[:-1]] + self.pieces[text[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def of(self, data: bytes):
        """Ids of a text."""
        import numpy as np

        if not self.by_word or b"<|" in data and self.special(data.decode("utf-8", "replace")):
            return np.array(self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.words.__getitem__, data.split())), "<u4")


def word_ids(source: str, room: int | None = None) -> WordIds:
    """The worker's cache of this tokenizer; it outlives a task, as workers do."""
    import sys
    import zlib

    name = f"_word_ids_{zlib.crc32(source.encode()):08x}" + (f"_{room}" if room else "")
    if name not in sys.modules:
        sys.modules[name] = WordIds(source, room)
    return sys.modules[name]


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """A sub-multiset of the lengths with the largest sum up to ``room``: length -> how many."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, many = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... of a length and the remainder make every count
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, many = left - take, many * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


class Packer:
    """Waiting pieces by length, and the closing of windows. A piece is (row, start, ids)."""

    def __init__(self, size: int):
        self.size, self.waiting, self.tokens, self.sequence = size, {}, 0, 0

    def add(self, row, ids) -> Iterator[tuple]:
        at = 0
        while len(ids) - at >= self.size:
            yield from self._close([(row, at, ids[at : at + self.size])])
            at += self.size
        if at < len(ids):
            self._wait((row, at, ids[at:]))

    def _wait(self, piece) -> None:
        self.waiting.setdefault(len(piece[2]), []).append(piece)
        self.tokens += len(piece[2])

    def _take(self, length: int):
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.tokens -= length
        return piece

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for row, start, ids in pieces:
            yield row, start, ids, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def _head(self, piece, length: int):
        row, start, ids = piece
        if length < len(ids):
            self._wait((row, start + length, ids[length:]))
        return row, start, ids[:length]

    def windows(self, keep: int) -> Iterator[tuple]:
        """Close full windows while at least ``keep`` tokens wait."""
        while self.tokens >= max(keep, self.size):
            chosen = [self._take(max(self.waiting))]
            room = self.size - len(chosen[0][2])
            for length, many in fill({k: len(v) for k, v in self.waiting.items() if k <= room}, room).items():
                chosen += [self._take(length) for _ in range(many)]
                room -= length * many
            if room:  # all that waits is longer than the room left
                chosen.append(self._head(self._take(min(self.waiting)), room))
            yield from self._close(chosen)

    def rest(self) -> Iterator[tuple]:
        """The last tokens, fewer than a window, in sequences of falling powers of two."""
        while self.tokens:
            room = 1 << self.tokens.bit_length() - 1
            chosen = []
            while room:
                piece = self._head(self._take(max(self.waiting)), room)
                chosen.append(piece)
                room -= len(piece[2])
            yield from self._close(chosen)


FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, window: Window = Window(), id_col: str = "doc_id", text_col: str = "text",
         room: int | None = None) -> DataFrame:
    """One row per piece of a document: where it comes from, its checksum and its place in a sequence. Workers keep two memories of ``room`` (else ``CACHED``) bytes each."""
    schema = with_id(docs, id_col, FIELDS)
    names = schema.fieldNames()
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ids_of, packer = word_ids(source.value, room), Packer(window.size)
        base = TaskContext.get().partitionId() << 40

        def batch(rows: list):
            cells = [([owner, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset])
                     for (owner, total), start, ids, sequence, offset in rows]
            columns = list(zip(*cells))
            owners = pa.concat_arrays(columns[0])
            return pa.record_batch([owners, *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        done: list = []
        for part, texts in slices(batches):
            for i, data in enumerate(texts):
                ids = np.append(ids_of.of(data or b""), np.uint32(END)).astype("<u4", copy=False)
                done += packer.add((part.column(0).slice(i, 1), len(ids)), ids)
            if packer.tokens >= 2 * window.hold:
                done += packer.windows(window.hold)
            if len(done) >= 4096:
                yield batch(done)
                done = []
        done += packer.windows(0)
        done += packer.rest()
        for at in range(0, len(done), 4096):
            yield batch(done[at : at + 4096])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
