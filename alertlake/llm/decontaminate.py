"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may occur with up to ``floor(n * max_error)`` edits. Cut into one piece more than that, at least one
piece occurs unchanged in any such place. One pass over a text finds the pieces of all items (an Aho-Corasick automaton). The same
holds for a range of m pieces with fewer than m edits: of its two halves, one keeps its share. So a hit climbs from its piece over
ranges of about twice the pieces each, and only a hit that every range confirms leads to the whole item. Myers' bit-parallel
distance decides at each step, and finds the best place of the item in the end. Texts are compared with A-Z lower-cased and each
ASCII blank as a space, which keeps positions.

Items are matched in blocks of about ``block_bytes`` of item text, so what a task holds is bounded however long the benchmark is;
every block sees all documents.

Defined cases: null and empty texts and items match nothing; items shorter than ``min_chars`` have
to stand in the text exactly (but for case and blanks) and at word edges;
equal items are one, under their smallest id, and ``n_items`` says how many; of places of one item in one text the one with the
least distance is given, the first of equals; repeated rows are matched one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import id_and_text, per_gigabyte, slices, with_id

UPPER, LOWER, BLANKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"\t\n\v\f\r"
FOLD = bytes.maketrans(UPPER + BLANKS, LOWER + b" " * len(BLANKS))


@dataclass(frozen=True)
class EditMatch:
    max_error: float = 0.1
    min_chars: int = 32
    block_bytes: int = 4 << 20


def fold(data: bytes) -> str:
    return data.translate(FOLD).decode("utf-8", "replace")


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """Cut 0..n into budget+1 ranges of nearly one length."""
    return [(n * i // (budget + 1), n * (i + 1) // (budget + 1)) for i in range(budget + 1)]


def pieces_in(cut: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    return [x for x in cut if a <= x[0] and x[1] <= b]


def masks_of(pattern: str) -> dict[str, int]:
    """Bit i of a character's mask says that it stands at place i of the pattern."""
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    return where


def best_end(n: int, where: dict[str, int], text: str) -> tuple[int, int]:
    """(least distance of a pattern of n characters to a substring of the text, first end of such a substring), after Myers."""
    full, last = (1 << n) - 1, 1 << n - 1
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        if score < best:
            best, end = score, j
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
    return best, end


def best_place(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the best place; the shortest match that ends there."""
    n = len(pattern)
    distance, end = best_end(n, masks_of(pattern), text)
    _, back = best_end(n, masks_of(pattern[::-1]), text[:end][::-1])
    return distance, end - back, end


def at_edges(text: str, start: int, end: int) -> bool:
    """Whether no word of the text goes on beyond the range."""
    joined = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not joined(start) and not joined(end)


class Matcher:
    """The pieces of a block of items, ready to search texts."""

    def __init__(self, items: list[str], method: EditMatch):
        import ahocorasick

        self.items, self.least = items, method.min_chars
        self.budgets = [int(len(x) * method.max_error) if len(x) >= method.min_chars else 0 for x in items]
        found: dict[str, list[tuple[int, int]]] = {}
        #: Ranges that a hit of a piece has to pass, smallest first: (start, end, budget).
        self.ranges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        self.halves: dict[tuple[int, int], tuple[list[str], int]] = {}
        self.cuts: dict[int, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            cut = self.cuts[i] = pieces(len(item), self.budgets[i])
            self._climb(i, cut, [])
            for a, b in cut:
                found.setdefault(item[a:b], []).append((i, b))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, uses)
        if items:
            self.automaton.make_automaton()

    def _climb(self, item: int, cut: list[tuple[int, int]], above: list[tuple[int, int, int]]) -> None:
        """Halve a range of pieces down to single ones, keeping the way back up; the whole item is checked apart."""
        if len(cut) == 1:
            self.ranges[item, cut[0][1]] = above[:0:-1]
            if len(above) > 1:  # of the halves of the smallest range's other pieces, its budget spoils one each
                a, b, budget = above[-1]
                others = [self.items[item][x:y] for u, v in pieces_in(self.cuts[item], a, b) if u != cut[0][0]
                          for x, y in ((u, (u + v) // 2), ((u + v) // 2, v))]
                self.halves[item, cut[0][1]] = others, len(others) - budget
            return
        way = [*above, (cut[0][0], cut[-1][1], len(cut) - 1)]
        half = len(cut) // 2
        self._climb(item, cut[:half], way)
        self._climb(item, cut[half:], way)

    def _confirmed(self, item: int, at: int, end: int, text: str) -> bool:
        """Whether every range around the piece that ends at ``at`` in the item and at ``end`` in the text keeps its budget."""
        ranges = self.ranges[item, at]
        if ranges:  # a cheap test that most chance hits fail
            (a, b, budget), (others, least) = ranges[0], self.halves[item, at]
            window = text[max(0, end - at + a - budget) : end - at + b + budget]
            if sum(x in window for x in others) < least:
                return False
        for a, b, budget in ranges:
            masks = self.masks.get((item, a, b))
            if masks is None:
                masks = self.masks[item, a, b] = masks_of(self.items[item][a:b])
            if best_end(b - a, masks, text[max(0, end - at + a - budget) : end - at + b + budget])[0] > budget:
                return False
        return True

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item that the text holds."""
        windows: dict[int, list[list[int]]] = {}
        short: dict[int, int] = {}
        for end, uses in self.automaton.iter(text):
            for item, at in uses:
                if len(self.items[item]) < self.least:
                    if item not in short and at_edges(text, end + 1 - at, end + 1):
                        short[item] = end + 1
                    continue
                first = end + 1 - at - self.budgets[item]
                stop = first + len(self.items[item]) + 2 * self.budgets[item]
                known = windows.setdefault(item, [])
                if known and first <= known[-1][1]:  # hits come in the order of their ends, so windows of an item nearly do too
                    known[-1][0], known[-1][1] = min(known[-1][0], first), max(known[-1][1], stop)
                elif self._confirmed(item, at, end + 1, text):
                    known.append([first, stop])
        for item, end in sorted(short.items()):
            yield item, 0, end - len(self.items[item]), end
        for item, spans in sorted(windows.items()):
            best = None
            for first, stop in spans:
                first = max(0, first)
                distance, a, b = best_place(self.items[item], text[first:stop])
                if distance <= self.budgets[item] and (best is None or distance < best[0]):
                    best = distance, first + a, first + b
            if best:
                yield item, *best


def item_blocks(items: DataFrame, method: EditMatch, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Blocks of (item id, items of this text, folded text); each is collected alone and its size is bounded."""
    text = F.col(text_col).cast("string")
    alike = (items.where(text.isNotNull()).groupBy(text.alias("text")).agg(F.min(id_col).alias("id"), F.count("*").alias("n"))
             .where(F.length(F.btrim("text", F.lit(BLANKS.decode() + " "))) > 0))
    n = per_gigabyte(alike.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], method.block_bytes)
    for block in range(n):
        part = alike.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block) if n > 1 else alike
        rows = part.collect()
        if rows:
            yield sorted(((r["id"], r["n"], fold(r["text"].encode())) for r in rows), key=lambda x: x[2])


def matches(docs: DataFrame, items: DataFrame, method: EditMatch = EditMatch(), id_col: str = "doc_id", text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: id, item id, n_items, distance, start and end (characters of the text)."""
    schema = with_id(docs, id_col, "n_items long, distance int, start long, end long")
    schema = type(schema)([schema[0], items.schema[item_id], *schema[1:]])
    found = None
    for block in item_blocks(items, method, item_id, item_text):
        part = id_and_text(docs, id_col, text_col).mapInArrow(_finder(block, method, schema), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _finder(block: list[tuple], method: EditMatch, schema):
    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        matcher = Matcher([x[2] for x in block], method)
        for part, texts in slices(batches):
            row, more = [], []
            for i, data in enumerate(texts):
                for item, distance, a, b in matcher.search(fold(data)) if data else ():
                    row.append(i)
                    more.append((block[item][0], block[item][1], distance, a, b))
            columns = list(zip(*more)) if more else [()] * 5
            owners = part.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([owners, *[pa.array(c, f.type) for c, f in zip(columns, list(kinds)[1:])]], schema=kinds)

    return find


def clean_documents(docs: DataFrame, items: DataFrame, method: EditMatch = EditMatch(), text_col: str = "text", item_id: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for block in item_blocks(items, method, item_id, item_text):
        folded = [x[2] for x in block]

        @F.pandas_udf("boolean")
        def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(folded, method)
            for texts in batches:
                yield pd.Series([bool(x) and next(matcher.search(fold(x.encode())), None) is not None for x in texts], dtype=bool)

        docs = docs.where(~holds(F.col(text_col).cast("string")))
    return docs
