"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters (lower case, runs of white space as one space)
matches a document that holds a passage within ``k = floor(rate * m)`` edits
of it. Such a passage must hold at least one of any k + 1 pieces of the item
unchanged: pieces are found exactly (Aho-Corasick over the whole text) and
only the text around a hit is measured, by Myers' bit-parallel distance.

Test items are the stated query set: they are read in blocks of
``BLOCK_CHARS`` characters, and every block is matched against all rows, so
what a task holds does not grow with the benchmark or the corpus.

Defined results: a null or blank text holds nothing; a null or blank item is
held by nothing; repeated document rows each give their own result row, and
repeated items (same id and text) count once; a null document id stays null;
empty tables give an empty result; other columns are ignored (and kept as
they are by ``clean``). Texts are matched whole, whatever their length.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, table, text_of

RATE = 0.08  # edits a character
BLOCK_CHARS = 1 << 22  # of items matched together
RESULT = "doc_id bigint, item_id bigint, distance int, budget int"


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * j // (budget + 1) for j in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' automaton of one item: least edit distance of any substring of a text."""

    def __init__(self, item: str):
        self.text, self.size = item, len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for j, c in enumerate(item):
            self.masks[c] |= 1 << j

    def least(self, text: str, budget: int) -> int:
        """The least distance; above ``budget``, any number above it."""
        if self.text in text:
            return 0
        ones, top, masks = (1 << self.size) - 1, 1 << (self.size - 1), self.masks
        plus, minus, score, best = ones, 0, self.size, self.size
        for c in text:
            eq = masks.get(c, 0)
            x = eq | minus
            d = (((x & plus) + plus) ^ plus) | x
            hp = minus | (~(d | plus) & ones)
            hm = plus & d
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
                if score < best:
                    best = score
            hp = (hp << 1) & ones  # a match may start anywhere: row 0 stays 0
            hm = (hm << 1) & ones
            plus = hm | (~(d | hp) & ones)
            minus = hp & d
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(item_id, Pattern(text), int(rate * len(text))) for item_id, text in items]
        where = defaultdict(list)
        for n, (_, pattern, budget) in enumerate(self.items):
            for offset, piece in pieces(pattern.text, budget):
                where[piece].append((n, offset))
        self.find = ahocorasick.Automaton()
        for piece, hits in where.items():
            self.find.add_word(piece, (len(piece), hits))
        self.find.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the merged stretches of text that a passage with a piece hit could span."""
        out: dict[int, list[list[int]]] = {}
        for last, (size, hits) in self.find.iter(text):
            start = last + 1 - size
            for n, offset in hits:
                _, pattern, budget = self.items[n]
                a = max(0, start - offset - budget)
                b = min(len(text), start - offset + pattern.size + budget)
                spans = out.setdefault(n, [])
                for span in reversed(spans):  # hits come by end, so starts of one item come nearly sorted
                    if a <= span[1] and span[0] <= b:
                        span[0], span[1] = min(a, span[0]), max(b, span[1])
                        break
                    if span[1] < a - 2 * pattern.size:
                        spans.append([a, b])
                        break
                else:
                    spans.append([a, b])
        return out

    def match(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, budget) of the items that the text holds."""
        out = []
        for n, spans in sorted(self.windows(text).items()):
            item_id, pattern, budget = self.items[n]
            best = min(pattern.least(text[a:b], budget) for a, b in spans)
            if best <= budget:
                out.append((item_id, best, budget))
        return out


def item_blocks(bench: DataFrame, id_col: str, text_col: str, block_chars: int):
    rows = (bench.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
            .where("text IS NOT NULL").distinct().orderBy("item_id", "text"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        text = normalised(r["text"])
        if text:
            block.append((r["item_id"], text))
            held += len(text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, bench: DataFrame, rate: float = RATE, id_col="doc_id", text_col="text",
            item_id_col="item_id", item_text_col="text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per document row and test item that it holds: doc_id, item_id, distance, budget."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    out = None
    for block in item_blocks(bench, item_id_col, item_text_col, block_chars):
        found = rows.mapInArrow(_search(block, rate), RESULT)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def _search(items, rate):
    def search(batches):
        m = Matcher(items, rate)
        for b in sliced(batches):
            got = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                   for hit in m.match(normalised(t))]
            columns = list(zip(*got)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "item_id", "distance", "budget"])
    return search


def clean(docs: DataFrame, bench: DataFrame, rate: float = RATE, text_col="text",
          item_id_col="item_id", item_text_col="text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no test item."""
    out = docs
    for block in item_blocks(bench, item_id_col, item_text_col, block_chars):
        out = out.mapInArrow(_without(block, rate, text_col), docs.schema)
    return out


def _without(items, rate, text_col):
    def keep(batches):
        m = Matcher(items, rate)
        for b in sliced(batches):
            yield b.filter(pa.array([not m.match(normalised(t or "")) for t in b.column(text_col).to_pylist()], pa.bool_()))
    return keep


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
