"""Benchmark decontamination: exact bounds from word occurrences, then Smith-Waterman alignment.

An alignment that reaches the least score leaves few of an item's words unmatched, so one more of them than that always
has a match: the words that fewest items have are its seeds. What the words of a document let an item score at most is then
bounded from above, and only passages whose bound reaches the least score are aligned word by word, so that paraphrased or
edited copies score by what they keep. No pair that reaches the score is left out. The text never moves: each block of
items visits the documents where they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

#: Items of fewer words match by all their words in a row only.
SHORT = 3
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Expected items and words of a block of items, which is what is broadcast at a time.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1_000_000
#: Words of a passage that are aligned at a time, besides the overlap.
PIECE = 2_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """A block's items as word numbers, and which items each seed word may mean."""

    def __init__(self, rows: list[tuple[int, str, int]], least: float):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.times, self.words, self.least = [], [], [], least
        for item, text, times in sorted(rows):
            words = words_of(text)
            if words:
                self.ids.append(item)
                self.times.append(times)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.need = np.where(self.size < SHORT, 1.0, least) * MATCH * self.size
        spread = np.bincount(np.concatenate([np.unique(w) for w in self.words]), minlength=len(self.vocabulary)) if self.words else np.zeros(0, np.int64)
        seeds = [np.unique(w[np.argsort(spread[w], kind="stable")[: int(len(w) * (1 - least) + 1e-9) + 1]]) for w in self.words]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])[np.argsort(flat, kind="stable")] if seeds else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(self.vocabulary)))])

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """The items that have a seed in the document, and enough of their words."""
        found = np.unique(ids[ids >= 0])
        number = self.first[found + 1] - self.first[found]
        found, number = found[number > 0], number[number > 0]
        if not len(found):
            return np.zeros(0, np.int64)
        at = np.arange(int(number.sum())) + np.repeat(self.first[found] - np.cumsum(number) + number, number)
        items = np.unique(self.of[at])
        size = self.size[items]
        begin = np.cumsum(size) - size
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[ids] = True
        there[-1] = False
        at = np.arange(int(size.sum())) + np.repeat(self.start[items] - begin, size)
        return items[MATCH * np.add.reduceat(there[self.flat[at]], begin, dtype=np.int64) >= self.need[items]]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, end word, equal words) of the best passage of each item that reaches ``least``."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
        out = []
        for item in self.candidates(ids).tolist():
            words, best = self.words[item], None
            n, need = len(words), self.need[item]
            own = np.zeros(len(self.vocabulary) + 1, bool)
            own[words] = True
            # no alignment that ends at a word scores more than its best run of MATCH for the item's words, -1 for others
            total = np.concatenate([[0], np.cumsum(np.where(own[ids], MATCH, -1))])
            ends = np.flatnonzero(total - np.minimum.accumulate(total) >= need)
            if not len(ends):
                continue
            # words of a passage: the item's, and those that the score leaves room for
            width = n + int((1 - self.least) * MATCH * n + 1e-9)
            breaks = np.flatnonzero(np.diff(ends) > width)
            for a, b in zip(ends[np.append(0, breaks + 1)].tolist(), ends[np.append(breaks, len(ends) - 1)].tolist(), strict=True):
                for low in range(max(0, a - width), b, max(width, PIECE)):
                    score, start, end, equal = smith_waterman(words, ids[low : min(b, low + max(width, PIECE) + width)])
                    if best is None or score > best[0]:
                        best = (score, start + low, end + low, equal)
            if best[0] >= need:
                out += [(self.ids[item], best[0] / (MATCH * n), *best[1:])] * self.times[item]
        return out


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """The best local alignment's score, its range in the passage, and its equal words.

    Two rows are held at a time: the first pass gives the best score and its end, the second carries beginnings and equal
    words along, over the part of the passage that an alignment of that score can reach.
    """
    best, last, end = 0, 0, 0
    steps = np.arange(len(passage) + 1, dtype=np.int32) * -GAP
    h = np.zeros(len(passage) + 1, np.int32)
    for i, word in enumerate(item, 1):
        row = np.maximum(h + GAP, 0)
        row[1:] = np.maximum(row[1:], h[:-1] + np.where(passage == word, MATCH, MISMATCH))
        h = np.maximum.accumulate(row + steps) - steps
        if (top := int(h.max())) > best:
            best, last, end = top, i, int(h.argmax())
    if not best:
        return 0, 0, 0, 0
    begin = max(0, end - last - (MATCH * last - best) // -GAP)  # each word of the passage beyond the item's costs a gap
    passage = passage[begin:end]
    at = np.arange(len(passage) + 1)
    steps, h, start, equal = steps[: len(at)], np.zeros(len(at), np.int32), at.copy(), np.zeros(len(at), np.int64)
    for word in item[:last]:
        same = passage == word
        diagonal = h[:-1] + np.where(same, MATCH, MISMATCH)
        row, begun, alike = h + GAP, start.copy(), equal.copy()
        on = np.flatnonzero(diagonal >= row[1:]) + 1
        row[on], begun[on], alike[on] = diagonal[on - 1], start[on - 1], equal[on - 1] + same[on - 1]
        none = row <= 0
        row[none], begun[none], alike[none] = 0, at[none], 0
        reach = row + steps
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, at, 0))
        h, start, equal = top - steps, begun[source], alike[source]
    return best, begin + int(start[-1]), end, int(equal[-1])


def item_blocks(items: DataFrame, least: float):
    """Each block of distinct items, broadcast."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id is not null and text is not null")
    rows = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // (4 * BLOCK_WORDS)))
    for block in range(blocks):
        got = [(r["item_id"], r["text"], r["times"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        yield spark.sparkContext.broadcast(Items(got, least))


def contaminations(docs: DataFrame, items: DataFrame, *, least_score: float = LEAST_SCORE) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` and the aligned words (``first_word``, ``end_word``, ``equal_words``) of every
    document and test item whose alignment has ``least_score`` of the item's own score or more; its best passage counts.

    Words are lower-cased runs of letters, digits and underscores. Items with fewer than SHORT words match
    where all of them stand in a row; items without words, or with a null id or text, take no part. A null or empty text has
    no match; a null doc_id stays null; repeated documents or items give repeated rows; empty tables give no rows; other
    columns are ignored. Texts are read whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, item_id long, score double, first_word long, end_word long, equal_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in item_blocks(items, least_score):

        def run(batches, sent=sent):
            for batch in batches:
                for part in slices(batch, "text"):
                    found = [(doc, *m) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for m in sent.value.matches(text)]
                    if found:
                        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word", "equal_words"])

        out = out.union(rows.mapInArrow(tidy(run), schema))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, *, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows that no test item matches; the columns stay. The cases are those of ``contaminations``."""
    kept = docs.select(F.struct("*").alias("row"), F.col("text"))
    for sent in item_blocks(items, least_score):

        def run(batches, sent=sent):
            for batch in batches:
                for part in slices(batch, "text"):
                    yield part.filter(pa.array([not sent.value.matches(t) for t in part.column("text").to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(tidy(run), kept.schema)
    return kept.select("row.*")
