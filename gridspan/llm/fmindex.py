"""Substring deduplication with compressed FM-indexes.

A window of words is repeated somewhere only if its minimizer (the smallest hash of a short word run in it) is. Runs of
windows that share a minimizer form regions, regions with a repeated minimizer are dealt to shards by it, and each shard
builds an FM-index (suffix array, Burrows-Wheeler transform, wavelet matrix) over its distinct regions. Regions are then
streamed through backward search; the matching statistics give the intervals where every window occurs twice or more.
Equal regions are combined before they travel, and a minimizer with very many distinct regions is dealt out by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions, slices, tidy

WINDOW, GRAM = 35, 6
#: Distinct regions of a minimizer that a shard takes; tokens of an index.
CROWD, INDEX_TOKENS = 1000, 600_000
B = np.uint64(0x9E3779B97F4A7C15)
B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def regions(lists: list[list[bytes]], window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of each run of windows with one minimizer: its list, first word, number of windows, minimizer and content hash."""
    seen: dict[bytes, int] = {}
    at = np.array([seen.setdefault(w, len(seen)) for words in lists for w in words], np.int64)
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    begin = np.cumsum(counts) - counts
    n = len(at) - window + 1
    if n < 1:
        return {k: np.zeros(0, np.int64) for k in ("list", "start", "n", "anchor", "content")}
    h = np.array([xxhash.xxh64_intdigest(w, 5) for w in seen], np.uint64)[at]
    g = h[: len(h) - gram + 1].copy()
    for i in range(1, gram):
        g = g * B + h[i : len(h) - gram + 1 + i]
    g = mixed(g)
    grams = window - gram + 1
    least, length = np.arange(len(g)), 1
    while length < grams:
        step = min(length, grams - length)
        a, b = least[:-step], least[step:]
        least = np.where(g[a] <= g[b], a, b)  # the leftmost of equals
        length += step
    valid = np.zeros(n, bool)
    for s, c in zip(begin[counts >= window].tolist(), counts[counts >= window].tolist(), strict=True):
        valid[s : s + c - window + 1] = True
    w = np.flatnonzero(valid)
    if not len(w):
        return {k: np.zeros(0, np.int64) for k in ("list", "start", "n", "anchor", "content")}
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (least[w[1:]] != least[w[:-1]])
    new[np.searchsorted(w, begin[counts >= window])] = True
    first = np.flatnonzero(new)
    start, size = w[first], np.diff(np.append(first, len(w)))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(B, len(h)), dtype=np.uint64)])
    stop = start + size + window - 1
    content = mixed((prefix[stop] - prefix[start]) * powers(B_INVERSE, len(h))[start] + size.astype(np.uint64))
    of = np.searchsorted(begin, start, side="right") - 1
    empty = counts == 0
    if empty.any():  # lists without words share their beginning with the next
        real = np.flatnonzero(~empty)
        of = real[np.searchsorted(begin[real], start, side="right") - 1]
    return {"list": of, "start": start - begin[of], "n": size, "anchor": g[least[start]].view(np.int64), "content": content.view(np.int64)}


class WaveletMatrix:
    """Rank over a sequence of symbols, one packed bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        now = symbols
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(now) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.first = self.mapped(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def mapped(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[i][word] + np.bitwise_count(self.bits[i][word] & mask)
            place = np.where((symbol >> (self.levels - 1 - i)) & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.mapped(symbol, place) - self.first[symbol]


class FMIndex:
    """Backward search over texts of symbols 1, 2, ...; symbol 0 separates texts."""

    def __init__(self, texts: list[np.ndarray], alphabet: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        n = int(lengths.sum()) + len(texts)
        self.text = np.zeros(n, np.int64)
        self.stop = np.cumsum(lengths + 1) - 1
        self.start = self.stop - lengths
        fill = np.ones(n, bool)
        fill[self.stop] = False
        self.text[fill] = np.concatenate(texts)
        order = self.text + len(texts) - 1
        order[self.stop] = np.arange(len(texts))  # separators differ, so suffixes do
        _, rank = np.unique(order, return_inverse=True)
        step = 1
        while True:
            later = np.zeros(n, np.int64)
            later[:-step] = rank[step:] + 1
            key = rank * (n + 1) + later
            suffixes = np.argsort(key, kind="stable")
            step *= 2
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(np.concatenate([[0], np.diff(key[suffixes]) != 0]))
            if step > n or rank[suffixes[-1]] == n - 1:
                break
        self.tree = WaveletMatrix(self.text[suffixes - 1], alphabet)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=alphabet))])
        self.size = n

    def repeated(self, which: np.ndarray, window: int) -> list[tuple[int, int, int]]:
        """(text, from, to): the maximal intervals of each indexed text all of whose windows occur twice or more.

        Each lane extends leftwards from an end as long as its words occur twice; where that stops, the next end that can
        give a window is tried.
        """
        out = []
        lane = which.copy()
        begin, end = self.start[lane], self.stop[lane].copy()
        at, low, high = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), self.size)
        while len(lane):
            symbol = self.text[np.maximum(at - 1, 0)]
            inside = at > begin
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            to_low, to_high = self.smaller[symbol] + both[: len(lane)], self.smaller[symbol] + both[len(lane) :]
            grown = inside & (to_high - to_low >= 2)
            at = at - grown
            low, high = np.where(grown, to_low, low), np.where(grown, to_high, high)
            halt = np.flatnonzero(~grown)
            if not len(halt):
                continue
            match = end[halt] - at[halt]
            for i in halt[match >= window].tolist():
                out.append((int(lane[i]), int(at[i] - begin[i]), int(end[i] - begin[i])))
            end[halt] = np.where(match >= window, at[halt] + window - 1, end[halt] - 1)
            over = halt[~inside[halt] | (end[halt] - begin[halt] < window)]
            at[halt], low[halt], high[halt] = end[halt], 0, self.size
            if len(over):
                keep = np.ones(len(lane), bool)
                keep[over] = False
                lane, begin, end, at, low, high = (x[keep] for x in (lane, begin, end, at, low, high))
        return out


def shard_intervals(texts: list[bytes], asked: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Intervals of the asked texts (words joined by spaces) that repeat within the shard."""
    seen: dict[bytes, int] = {}
    made = [np.array([seen.setdefault(w, len(seen) + 1) for w in t.split()], np.int64) for t in texts]
    return FMIndex(made, len(seen) + 1).repeated(asked, window)


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` (with ``with_text`` also ``kept``) of every row.

    A word goes if a window of ``window`` words covers it whose word sequence also starts anywhere else, in the same or
    another row; windows are judged on the input. Words are runs between ASCII white space, unchanged. A null or empty
    text has no words; a null id stays null; repeated rows repeat all their windows; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("key", F.xxhash64("doc_id", "text"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                r = regions([words_of(t) for t in part.column("text").to_pylist()], window)
                of = pa.array(r["list"])
                columns = [pa.array(r["anchor"]), pa.array(r["content"]), part.column("id").take(of), part.column("key").take(of), pa.array(r["start"].astype(np.int32)), pa.array(r["n"].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "id", "key", "start", "n"])

    rows = base.select("id", "key", "text").mapInArrow(tidy(cut), "anchor long, content long, id long, key long, start int, n int")
    again = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor")
    # each aggregate is a side of its own exchange, so that adaptive execution can split the other side's hot keys
    hits = checkpointed(rows.join(checkpointed(again), "anchor"))

    one = F.struct("id", "key", "start", "n")
    contents = hits.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(one).alias("one"))
    contents = checkpointed(contents.select("anchor", "content", "times", "one.*"))
    kinds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 and least = 1").select("anchor", "kinds")
    wanted = contents.join(checkpointed(kinds), "anchor").groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "content", "start", "n", (F.col("times") == 1).alias("asked"), (F.col("kinds") > CROWD).alias("crowd"))).alias("cuts"))

    def fetch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, cuts in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist(), strict=True):
                    words = words_of(text)
                    out += [(c["anchor"], c["content"], c["asked"], c["crowd"], b" ".join(words[c["start"] : c["start"] + c["n"] + window - 1])) for c in cuts]
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
                for low in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[low : low + 10_000], strict=True), kinds, strict=True)], names=["anchor", "content", "asked", "crowd", "words"])

    # rows equal in id and text give the same cuts; one of them is enough
    source = base.select("id", "key", "text").join(wanted, ["id", "key"]).dropDuplicates(["id", "key"])
    fetched = checkpointed(source.mapInArrow(tidy(fetch), "anchor long, content long, asked boolean, crowd boolean, words binary"))

    def search(batches):
        held: list[tuple] = []
        size = 0

        def found(rows):
            asked = np.array([i for i, r in enumerate(rows) if r[2]], np.int64)
            got = shard_intervals([r[3] for r in rows], asked, window) if len(asked) else []
            columns = [(rows[i][0], rows[i][1], a, b) for i, a, b in got]
            if columns:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns, strict=True), kinds, strict=True)], names=["anchor", "content", "low", "high"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "asked", "words")), strict=True):
                if size > INDEX_TOKENS and row[0] != held[-1][0]:
                    yield from found(held)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(b" ") + 2
        if held:
            yield from found(held)

    shards = fetched.filter("not crowd").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    schema = "anchor long, content long, low int, high int"
    by_index = shards.select("anchor", "content", "asked", "words").mapInArrow(tidy(search), schema)

    def each_window(batches):
        for batch in batches:
            out = []
            for anchor, content, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "words")), strict=True):
                w = words.split()
                for i in range(len(w) - window + 1):
                    text = b" ".join(w[i : i + window])
                    out.append((anchor, content, i, xxhash.xxh64_intdigest(text, 1) - (1 << 63), xxhash.xxh64_intdigest(text, 2) - (1 << 63)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "content", "at", "a", "b"])

    apart = fetched.filter("crowd").select("anchor", "content", "words").mapInArrow(tidy(each_window), "anchor long, content long, at int, a long, b long")
    twice = apart.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("a", "b")
    by_window = apart.join(checkpointed(twice), ["a", "b"]).select("anchor", "content", F.col("at").alias("low"), (F.col("at") + window).alias("high"))

    whole = contents.filter("times > 1").select("anchor", "content", F.lit(0).alias("low"), (F.col("n") + (window - 1)).alias("high"))
    spans = whole.union(by_index).union(by_window)
    covered = hits.join(spans, ["anchor", "content"]).select("id", "key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    of_row = covered.groupBy("id", "key").agg(F.collect_set(F.struct("low", "high")).alias("spans"))

    def finish(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = words_of(text)
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans or ():
                        edge[s["low"]] += 1
                        edge[s["high"]] -= 1
                    keep = np.cumsum(edge)[:-1] == 0
                    kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                    out.append((len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
                n, removed, digest, kept = zip(*out, strict=True)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)] + [pa.array(kept)] * with_text
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    joined = base.join(of_row, ["id", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(tidy(finish), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
