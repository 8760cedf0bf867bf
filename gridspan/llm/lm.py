"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

A token (a word, or a text's end) enters as the mean embedding of its subword ids. One masked attention head, with a bias for
each distance, reads the tokens before and predicts the class of the next token's first subword; a token's probability within
its class comes from counts over all training documents. What followed the token before, counted over all training documents
too, is mixed in. Scoring runs over overlapping context windows: each block of tokens is scored once, with the block before
as context.

All counts are looked up by hash: chunks of documents send their distinct tokens and pairs of tokens as sorted arrays to
buckets of the hash space, which add them up and send the sums back, so neither a worker nor the driver holds a table that
grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, checkpointed, grouped, mixed, on_worker, packed, partitions, slices, tidy, unpacked
from .langid import remainder
from .packing import ENCODER, encoder_of, numbered_words, ragged, sums

#: Tokens scored in a block and of its context, widths, classes.
BLOCK, CONTEXT, WIDTH, HIDDEN, CLASSES = 16, 16, 8, 16, 64
SPAN = BLOCK + CONTEXT
#: Steps begin on about so many windows of SPAN + 1 tokens, so many of them in a step; then they go on with every window of
#: all training documents, at a rate that falls in each chunk, and the partitions' weights are averaged.
FIRST_WINDOWS, FIRST_STEPS, FIRST_BATCH, BATCH = 20_000, 600, 64, 256
FIRST_RATE, RATE = 0.01, 0.005
#: Windows of a step that are handled at a time, for the processor's cache.
PART = 64
#: Subwords of a word that are added up for all words at a time.
SHORT = 16
#: Subwords that are grouped by what stands around them, and those that are looked for there.
GROUPED, FRAME = 2048, 256
#: Share of what followed the token before.
FOLLOWED = 0.1
#: Text bytes of a chunk, tokens (expected) of a bucket.
CHUNK_BYTES, BUCKET_TOKENS = 8_000_000, 2_000_000
#: Bytes of the rows that go to Spark together: a batch for each of many small rows costs more than what is in it.
CODED_BYTES = 1_000_000
#: Words and pieces whose ids a worker keeps.
CACHED = (800_000, 600_000)
FAR = np.float32(-1e9)
MOST = np.float32(60)
CODED = "chunk long, bucket long, doc_id array<long>, blobs array<binary>"
SHAPES = {"w": (WIDTH, 3 * WIDTH + HIDDEN), "near": (SPAN,), "o": (WIDTH, HIDDEN), "b": (HIDDEN,), "out": (HIDDEN, CLASSES), "b_out": (CLASSES,)}


@dataclass
class Words:
    """Distinct words as runs of subword ids."""

    ids: np.ndarray
    start: np.ndarray
    width: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return self.ids[self.start]

    def some(self, number: np.ndarray) -> Words:
        """Those of the numbers, in that order."""
        width = self.width.take(number)
        return Words(self.ids.take(ragged(self.start.take(number), width)), np.cumsum(width) - width, width)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Mean row of each word's ids."""
        total = table.take(self.first, axis=0)
        at = np.flatnonzero(self.width > 1)
        for k in range(1, SHORT):
            total[at] += table.take(self.ids.take(self.start[at] + k), axis=0)
            at = at[self.width[at] > k + 1]
        if len(at):
            width = self.width[at] - SHORT
            total[at] += np.add.reduceat(table[self.ids[ragged(self.start[at] + SHORT, width)]], np.cumsum(width) - width)
        total /= self.width[:, None].astype(np.float32)
        return total


@dataclass
class Chunk:
    """Documents as numbers into their distinct words; the last number is the end token, which closes each document."""

    taught: np.ndarray  # by document
    held_out: np.ndarray
    counts: np.ndarray
    at: np.ndarray  # by token
    hashes: np.ndarray  # by distinct word
    words: Words

    @classmethod
    def encoded(cls, encoder, texts: pa.Array, taught: np.ndarray, held_out: np.ndarray) -> Chunk:
        counts, inner, distinct = numbered_words(pc.ascii_lower(texts))
        entries = encoder.numbers(distinct)  # may begin another table of words
        ids, width = encoder.of_word.of(entries)
        end = encoder.tokenizer.get_vocab_size()
        every = np.append(np.maximum(width, 1), 1)
        flat = np.full(int(every.sum()), end + 1, np.int64)  # of words that the tokenizer drops
        flat[np.repeat(np.append(width > 0, False), every)] = ids
        flat[-1] = end
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
        counts = counts + 1
        at = np.full(int(counts.sum()), len(distinct), np.int64)
        inside = np.ones(len(at), bool)
        inside[np.cumsum(counts) - 1] = False
        at[inside] = inner
        return cls(taught, held_out, counts, at, np.append(hashes, np.uint64(xxhash.xxh64_intdigest(b""))), Words(flat, np.cumsum(every) - every, every))

    def blobs(self) -> list[bytes]:
        return [packed(x) for x in (self.taught, self.held_out, self.counts, self.at, self.hashes, self.words.width, self.words.ids)]

    @classmethod
    def read(cls, blobs: list[bytes]) -> Chunk:
        taught, held_out, counts, at, hashes, width, ids = map(unpacked, blobs)
        width = width.astype(np.int64)
        return cls(taught > 0, held_out > 0, counts.astype(np.int64), at.astype(np.int64), hashes.astype(np.uint64), Words(ids.astype(np.int64), np.cumsum(width) - width, width))

    @property
    def before(self) -> np.ndarray:
        """The token before each, the end before a document's first."""
        out = np.empty_like(self.at)
        out[1:] = self.at[:-1]
        out[np.cumsum(self.counts) - self.counts] = len(self.hashes) - 1
        return out

    def pair_keys(self) -> np.ndarray:
        """63 bits for each token and the one before it."""
        second = mixed(self.hashes + np.uint64(1))
        return mixed(second[self.before] * np.uint64(3) + self.hashes[self.at]) >> np.uint64(1)

    def word_keys(self) -> np.ndarray:
        return mixed(self.hashes) >> np.uint64(1)

    def stream(self) -> np.ndarray:
        """All training documents in turn, after an end."""
        return np.append(len(self.hashes) - 1, self.at[np.repeat(self.taught, self.counts)])

    def windows(self, every: int, seed: int) -> np.ndarray:
        """One of ``every`` runs of SPAN + 1 tokens, each of which begins at the last token of the run before it, or sooner at the end."""
        stream = self.stream()
        if len(stream) == 1:
            return np.zeros((0, SPAN + 1), np.int64)
        if len(stream) <= SPAN:
            stream = np.resize(stream, SPAN + 1)
        begin = np.append(np.arange(0, len(stream) - SPAN - 1, SPAN), len(stream) - SPAN - 1)
        begin = begin[mixed(begin.astype(np.uint64) + mixed(np.array([seed], np.uint64))) % np.uint64(every) == 0]
        return stream[begin[:, None] + np.arange(SPAN + 1)]


def bucket_rows(chunk: int, c: Chunk, buckets: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """What a chunk asks: for each bucket, its distinct words (with training counts and first subwords) and pairs (with counts)."""
    keys = c.word_keys()
    order = np.argsort(keys)
    taught = np.repeat(c.taught, c.counts)
    times = np.bincount(c.at[taught], minlength=len(keys))[order]
    keys, first = keys[order], c.words.first[order]
    pairs = np.sort(c.pair_keys() << np.uint64(1) | taught)
    pairs, bit = pairs >> np.uint64(1), (pairs & np.uint64(1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    pairs, pair_times = pairs[new], np.add.reduceat(bit, new)
    of_word, of_pair = (np.searchsorted(bucket_of(k, buckets), np.arange(buckets + 1)) for k in (keys, pairs))
    for bucket in np.flatnonzero(np.diff(of_word) + np.diff(of_pair)).tolist():
        w, p = slice(of_word[bucket], of_word[bucket + 1]), slice(of_pair[bucket], of_pair[bucket + 1])
        steps = [np.diff(k, prepend=np.uint64(0)) for k in (keys[w], pairs[p])]
        yield chunk, bucket, [packed(x) for x in (steps[0], times[w], first[w], steps[1], pair_times[p])]


def bucket_sums(asked: list[tuple[int, list[bytes]]], vocabulary: int) -> tuple[list[tuple[int, list[bytes]]], np.ndarray]:
    """Each chunk's sums of its words and pairs, and by first subword the tokens and the distinct words of the bucket."""
    parts = [[unpacked(b) for b in blobs] for _, blobs in asked]
    out: list[list[bytes]] = [[] for _ in parts]
    of_first = np.zeros((2, vocabulary), np.int64)
    for what, (key, count) in enumerate(((0, 1), (3, 4))):
        cut = np.cumsum([len(p[key]) for p in parts])[:-1]
        keys = np.concatenate([np.cumsum(p[key], dtype=np.uint64) for p in parts])
        order = np.argsort(keys)
        keys = keys[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        total = np.add.reduceat(np.concatenate([p[count] for p in parts])[order].astype(np.int64), begin) if len(keys) else np.zeros(0, np.int64)
        sums_of = np.empty(len(keys), np.int64)
        sums_of[order] = np.repeat(total, np.diff(begin, append=len(keys)))
        for mine, own in zip(out, np.split(sums_of, cut), strict=True):
            mine.append(packed(own))
        if not what:
            first = np.concatenate([p[2] for p in parts])[order[begin]]
            of_first[0] = np.bincount(first, total, vocabulary)
            of_first[1] = np.bincount(first, total > 0, vocabulary)
    return [(chunk, mine) for (chunk, _), mine in zip(asked, out, strict=True)], of_first


def bias_grid(near: np.ndarray, rows: int, back: int) -> np.ndarray:
    """Bias of query i for key j - back, FAR where the key comes later or is out of the context."""
    distance = np.arange(rows)[:, None] + back - np.arange(rows + back)[None]
    return np.where((distance >= 0) & (distance < SPAN), near[np.clip(distance, 0, SPAN - 1)], FAR).astype(np.float32)


@dataclass
class AttentionModel:
    e: np.ndarray  # by subword id
    p: dict[str, np.ndarray]
    class_of: np.ndarray  # by subword id
    mass: np.ndarray  # by class: what the counts within it, each with one more, add up to

    def class_logs(self, chunk: Chunk) -> np.ndarray:
        """Natural log probability of each token's class, given the document's tokens before it."""
        blocks = -(-chunk.counts // BLOCK)
        start = np.cumsum(blocks) - blocks
        n = int(blocks.sum())
        at = ragged(start * BLOCK, chunk.counts)
        end = len(chunk.hashes) - 1
        inputs = np.full(n * BLOCK, end, np.int64)
        targets = np.zeros(n * BLOCK, np.int64)
        inputs[at], targets[at] = chunk.before, self.class_of[chunk.words.first][chunk.at]
        begins = np.zeros(n, bool)
        begins[start] = True
        rows = chunk.words.means(self.e)
        rows = np.append(rows, np.ones((len(rows), 1), np.float32), axis=1)
        w = np.append(self.p["w"], [np.append(np.zeros(3 * WIDTH), self.p["b"])], axis=0).astype(np.float32)
        w[:, :WIDTH] *= np.float32(WIDTH**-0.5)
        out = np.empty(n * BLOCK, np.float32)
        grid = bias_grid(self.p["near"], BLOCK, CONTEXT)
        many, prior = np.ones(SPAN, np.float32), self.p["b_out"] - self.p["b_out"].max()
        weight = np.exp(prior)
        for low in range(0, n, 128):
            high, m = min(low + 128, n), min(low + 128, n) - low
            own = rows.take(inputs[max(low - 1, 0) * BLOCK : high * BLOCK], axis=0) @ w
            if not low:
                own = np.concatenate([own[:BLOCK], own])
            q = own[BLOCK:, :WIDTH].reshape(m, BLOCK, WIDTH)
            # a block's keys and values: the rows of the block before and its own, without a copy
            kv = np.lib.stride_tricks.as_strided(own, (m, SPAN, own.shape[1]), (BLOCK * own.strides[0], *own.strides), writeable=False)
            s = q @ kv[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1)
            s += grid
            s[begins[low:high], :, :CONTEXT] = FAR
            np.exp(np.minimum(s, MOST, out=s), out=s)
            o = (s @ kv[:, :, 2 * WIDTH : 3 * WIDTH]).reshape(-1, WIDTH)
            o /= (s.reshape(-1, SPAN) @ many)[:, None]
            h = o @ self.p["o"]
            h += own[BLOCK:, 3 * WIDTH :]
            logits = np.tanh(h, out=h) @ self.p["out"]
            np.minimum(logits, MOST, out=logits)
            target = targets[low * BLOCK : high * BLOCK]
            want = logits[np.arange(m * BLOCK), target] + prior[target]
            np.exp(logits, out=logits)
            out[low * BLOCK : high * BLOCK] = want - np.log(logits @ weight)
        return out[at].astype(np.float64)


def word_classes(counts: np.ndarray, near: np.ndarray, seed: int = 3) -> np.ndarray:
    """Classes of subwords: k-means of the frequent ones by what stands before and after, the rest by their count."""
    order = np.argsort(-counts, kind="stable")
    top = order[: len(near)]
    near = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    groups = CLASSES - 8
    rng = np.random.default_rng(seed)
    centre = near[rng.choice(len(top), groups, replace=len(top) < groups)]
    for _ in range(12):
        mine = (near @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1)
        for g in range(groups):
            if (mine == g).any():
                centre[g] = near[mine == g].mean(axis=0)
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    out = groups + np.minimum(7, rank * 8 // len(counts))
    out[top] = mine
    return out


def neighbours(first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How often each of the FRAME first of ``order`` (the last stands for all others) comes before and after each of the GROUPED first."""
    place = np.full(len(order), -1)
    place[order[:GROUPED]] = np.arange(len(order[:GROUPED]))
    frame = np.full(len(order), FRAME - 1)
    frame[order[: FRAME - 1]] = np.arange(len(order[: FRAME - 1]))
    size = len(order[:GROUPED]) * 2 * FRAME
    out = np.zeros(size, np.int64)
    for at, of, shift in ((first[1:], first[:-1], 0), (first[:-1], first[1:], FRAME)):
        at, of = place[at], frame[of]
        out += np.bincount((at * 2 * FRAME + of + shift)[at >= 0], minlength=size)
    return out


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each number in ``at``, for numbers below ``n``."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), rows.ravel(), n * width).reshape(n, width).astype(np.float32)


class Training:
    """Adam on windows of SPAN + 1 tokens. Embeddings are updated where a batch has them."""

    def __init__(self, e: np.ndarray, p: dict[str, np.ndarray], class_of: np.ndarray):
        self.e, self.p, self.class_of, self.step = e.copy(), {k: v.copy() for k, v in p.items()}, class_of, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in (p | {"e": e}).items()} for _ in range(2))

    @classmethod
    def begun(cls, class_of: np.ndarray, prior: np.ndarray, seed: int = 11) -> Training:
        rng = np.random.default_rng(seed)
        p = {k: (rng.normal(0, s[0] ** -0.5, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}
        p["b_out"] = np.log(prior / prior.sum()).astype(np.float32)
        return cls(rng.normal(0, 0.3, (len(class_of), WIDTH)).astype(np.float32), p, class_of)

    def slopes(self, x: np.ndarray, y: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Slopes of the summed loss by the input rows of whole windows and by the weights, for ``near`` by query and key."""
        p, many, by_window = self.p, np.ones(len(y), np.float32), (-1, SPAN, WIDTH)
        made = x @ p["w"]
        q, k, v = (made[:, low : low + WIDTH].reshape(by_window) for low in (0, WIDTH, 2 * WIDTH))
        q = q * np.float32(WIDTH**-0.5)
        a = q @ k.transpose(0, 2, 1)
        a += grid
        np.exp(np.minimum(a, MOST, out=a), out=a)
        a *= 1 / (a @ np.ones((SPAN, 1), np.float32))
        o = (a @ v).reshape(-1, WIDTH)
        h = o @ p["o"]
        h += made[:, 3 * WIDTH :]
        h += p["b"]
        np.tanh(h, out=h)
        d = h @ p["out"]
        d += p["b_out"]
        np.exp(np.minimum(d, MOST, out=d), out=d)
        d *= 1 / np.maximum(d @ np.ones((CLASSES, 1), np.float32), np.float32(1e-30))
        d[np.arange(len(y)), y] -= 1
        dh = d @ p["out"].T
        g = {"out": h.T @ d, "b_out": many @ d}
        np.multiply(h, h, out=h)
        dh *= np.subtract(1, h, out=h)
        g |= {"o": o.T @ dh, "b": many @ dh}
        do = dh @ p["o"].T
        o *= do
        do = do.reshape(by_window)
        ds = do @ v.transpose(0, 2, 1)
        ds -= (o @ np.ones(WIDTH, np.float32)).reshape(-1, SPAN, 1)
        ds *= a
        g["near"] = (np.ones(len(ds), np.float32) @ ds.reshape(len(ds), -1)).reshape(SPAN, SPAN)
        made[:, :WIDTH] = (ds @ k).reshape(-1, WIDTH) * np.float32(WIDTH**-0.5)
        made[:, WIDTH : 2 * WIDTH] = (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
        made[:, 2 * WIDTH : 3 * WIDTH] = (a.transpose(0, 2, 1) @ do).reshape(-1, WIDTH)
        made[:, 3 * WIDTH :] = dh
        g["w"] = x.T @ made
        return made @ p["w"].T, g

    def fit(self, windows: np.ndarray, words: Words, rate: float) -> None:
        """One step."""
        inputs, y = words.some(windows[:, :-1].ravel()), self.class_of[words.ids[words.start[windows[:, 1:].ravel()]]]
        x, grid = inputs.means(self.e), bias_grid(self.p["near"], SPAN, 0)
        g: dict[str, np.ndarray] = {}
        for low in range(0, len(y), PART * SPAN):
            part = slice(low, low + PART * SPAN)
            x[part], more = self.slopes(x[part], y[part], grid)
            g = {name: grad + g[name] if g else grad for name, grad in more.items()}
        distance = np.arange(SPAN)[:, None] - np.arange(SPAN)[None]
        g["near"] = np.bincount(np.clip(distance, 0, None).ravel(), (g["near"] * (distance >= 0)).ravel(), SPAN).astype(np.float32)
        x /= inputs.width[:, None].astype(np.float32)
        some = np.zeros(len(self.e), bool)
        some[inputs.ids] = True
        touched = np.flatnonzero(some)
        place = np.cumsum(some) - 1
        g["e"] = summed(place[inputs.ids], np.repeat(x, inputs.width, axis=0), len(touched))
        self.step += 1
        for name, grad in g.items():
            grad = grad / np.float32(len(y))
            at = touched if name == "e" else slice(None)
            m = self.m[name][at] = 0.9 * self.m[name][at] + 0.1 * grad
            s = self.v[name][at] = 0.999 * self.v[name][at] + 0.001 * grad * grad
            to = self.e if name == "e" else self.p[name]
            to[at] -= np.float32(rate) * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.e.ravel(), *(self.p[k].ravel() for k in SHAPES)])

    @staticmethod
    def weights(flat: np.ndarray, vocabulary: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        cut = np.cumsum([vocabulary * WIDTH, *(int(np.prod(s)) for s in SHAPES.values())])
        e, *rest = np.split(flat[: cut[-1]].astype(np.float32), cut[:-1])
        return e.reshape(-1, WIDTH), {k: x.reshape(s) for (k, s), x in zip(SHAPES.items(), rest, strict=True)}


def first_weights(class_of: np.ndarray, prior: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights after FIRST_STEPS steps on windows given as (widths, ids) of their tokens."""
    training = Training.begun(class_of, prior)
    if windows:
        width, ids = (np.concatenate(x).astype(np.int64) for x in zip(*windows, strict=True))
        words, at = Words(ids, np.cumsum(width) - width, width), np.arange(len(width)).reshape(-1, SPAN + 1)
        rng = np.random.default_rng(5)
        for step in range(FIRST_STEPS):
            training.fit(at[rng.integers(0, len(at), FIRST_BATCH)], words, FIRST_RATE * min(1.0, 2 * (1 - step / FIRST_STEPS)))
    return training.flat()


def vector_sum(rows: DataFrame, length: int, kind: str) -> np.ndarray:
    """The sum of the vectors in column ``vector`` (bytes), in two levels on the workers; one vector comes back."""

    def add(batches):
        total = np.zeros(length, kind)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(v), kind)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())], names=["vector"])

    level = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    done = rows.select("vector").repartition(level).mapInArrow(tidy(add), "vector binary").repartition(1).mapInArrow(tidy(add), "vector binary").first()
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(done["vector"])), kind)


def one_vector(values: np.ndarray) -> pa.Array:
    return pa.array([zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())], pa.binary())


def coded(rows) -> Iterator[pa.RecordBatch]:
    """Rows of CODED, in batches of about CODED_BYTES."""

    def batch():
        chunk, bucket, doc_id, blobs = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int64()), pa.array(doc_id, pa.list_(pa.int64())), pa.array(blobs, pa.list_(pa.binary()))], names=["chunk", "bucket", "doc_id", "blobs"])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[3]))
        if size >= CODED_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def score_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    Words are ASCII-lower-cased runs between ASCII white space, and one end token a text. Held-out documents (crc32 of the
    id as text, modulo 7, is 2) teach nothing; neither do rows with a null id, which are not held out either. A null or
    empty text is an end token alone. Repeated rows count and are scored each; an empty table gives no rows; other columns
    are ignored. Texts are read and scored whole. Counts of tokens, pairs of tokens, classes' neighbours and class sizes are
    of all training documents, and attention weights learn from every window of them: FIRST_STEPS steps on some of the windows only
    say where that begins. A word that training lacks counts as one unknown word of its class, as the base counts it
    as one of all. The pairs that a training document is scored by leave out its own occurrence. Tokens are told apart by
    63-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"))
    end = encoder_of(tokenizer, *CACHED).tokenizer.get_vocab_size()
    vocabulary = end + 2

    def encode(batches):
        encoder, chunk = encoder_of(tokenizer, *CACHED), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                held = np.asarray(part.column("held_out"))
                c = Chunk.encoded(encoder, part.column("text"), ~held & np.asarray(part.column("doc_id").is_valid()), held)
                yield from coded([(chunk, -1, part.column("doc_id").to_pylist(), c.blobs())])
                chunk += 1

    chunks = checkpointed(rows.mapInArrow(tidy(encode, ENCODER), CODED))

    def each(batches) -> Iterator[tuple[int, Chunk]]:
        for batch in batches:
            for chunk, blobs in zip(batch.column("chunk").to_pylist(), batch.column("blobs").to_pylist(), strict=True):
                yield chunk, Chunk.read(blobs)

    def sizes(batches):
        n = [(int(unpacked(blobs[2]).sum()), int(unpacked(blobs[2])[unpacked(blobs[0]) > 0].sum())) for batch in batches for blobs in batch.column("blobs").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x) for x in zip(*n, strict=True)] or [0, 0], pa.int64()).slice(i, 1) for i in range(2)], names=["tokens", "taught"])

    size = chunks.select("blobs").mapInArrow(tidy(sizes), "tokens long, taught long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("taught"), F.lit(0)).alias("taught")).first()
    tokens, buckets = size["taught"], max(1, -(-size["tokens"] // BUCKET_TOKENS))

    def ask(batches):
        yield from coded((chunk, bucket, None, blobs) for chunk, c in each(batches) for _, bucket, blobs in bucket_rows(chunk, c, buckets))

    def answer(batches):
        def take(bucket, asked):
            done, of_first = bucket_sums(asked, vocabulary)
            yield from coded((chunk, bucket, None, blobs) for chunk, blobs in done)
            yield from coded([(-1, bucket, None, [zstandard.ZstdCompressor(level=1).compress(of_first.tobytes())])])

        yield from grouped(batches, ("bucket", "chunk", "blobs"), take)

    asked = chunks.select("chunk", "blobs").mapInArrow(tidy(ask), CODED).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = checkpointed(asked.mapInArrow(tidy(answer), CODED))
    of_first = vector_sum(answers.filter("chunk = -1").select(F.col("blobs")[0].alias("vector")), 2 * vocabulary, "int64").reshape(2, vocabulary)
    whole = float(tokens + of_first[1].sum() + 1)
    order = np.argsort(-of_first[0], kind="stable")
    share = max(1, tokens // SPAN // FIRST_WINDOWS)

    def around(batches):
        total = 0
        for chunk, c in each(batches):
            total = total + neighbours(c.words.first[c.stream()], order)
            windows = c.windows(share, chunk).ravel()
            if len(windows):
                width = c.words.width[windows]
                yield pa.RecordBatch.from_arrays([one_vector(width), one_vector(c.words.ids[ragged(c.words.start[windows], width)]), pa.array([chunk])], names=["vector", "ids", "chunk"])
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([one_vector(total), pa.array([None], pa.binary()), pa.array([0], pa.int64())], names=["vector", "ids", "chunk"])

    seen = checkpointed(chunks.select("chunk", "blobs").mapInArrow(tidy(around), "vector binary, ids binary, chunk long"))
    length = len(order[:GROUPED]) * 2 * FRAME
    class_of = on_worker(spark, word_classes, of_first[0], vector_sum(seen.filter("ids is null"), length, "int64").reshape(-1, 2 * FRAME))
    raw = lambda b: np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b)), np.int64)
    sample = [(raw(r["vector"]), raw(r["ids"])) for r in sorted(seen.filter("ids is not null").collect(), key=lambda r: r["chunk"])]
    mass = np.bincount(class_of, of_first.sum(axis=0), CLASSES) + 1.0
    begun = on_worker(spark, first_weights, class_of, mass, sample)
    sent = spark.sparkContext.broadcast((begun, class_of))

    def refine(batches):
        begun, class_of = sent.value
        training, seen = Training(*Training.weights(begun, vocabulary), class_of), 0
        for chunk, c in each(batches):
            windows = c.windows(1, chunk)
            windows = windows[np.random.default_rng(chunk).permutation(len(windows))]
            for low in range(0, len(windows), BATCH):
                training.fit(windows[low : low + BATCH], c.words, RATE * (1 - low / len(windows)))
            seen += len(windows)
        if seen:  # what hasn't moved is 0, which packs well
            yield pa.RecordBatch.from_arrays([one_vector(np.append((training.flat() - begun).astype(np.float64), 1) * seen)], names=["vector"])

    total = vector_sum(chunks.select("chunk", "blobs").mapInArrow(tidy(refine), "vector binary"), len(begun) + 1, "float64")
    e, p = Training.weights(begun + total[:-1] / max(total[-1], 1), vocabulary)
    model = spark.sparkContext.broadcast(AttentionModel(e, p, class_of, mass))

    def score(batches):
        m = model.value

        def take(chunk, parts):
            parts.sort(key=lambda r: r[0])
            (_, doc_id, blobs), *answered = parts
            c = Chunk.read(blobs)
            end = len(c.hashes) - 1
            keys = c.word_keys()
            n = np.empty(len(keys), np.int64)
            n[np.argsort(keys)] = np.concatenate([unpacked(a[2][0]) for a in answered])
            _, of = np.unique(c.pair_keys(), return_inverse=True)
            both = np.concatenate([unpacked(a[2][1]) for a in answered]).astype(np.int64)[of]
            own = np.repeat(c.taught, c.counts)
            alone = np.maximum(n[c.before] - own, 0)
            both = np.maximum(both - own, 0)
            within = np.log(n + 1.0) - np.log(m.mass)[m.class_of[c.words.first]]
            made = np.exp(m.class_logs(c) + within[c.at])
            made = np.where(alone > 0, (1 - FOLLOWED) * made + FOLLOWED * both / np.maximum(alone, 1), made)
            base = np.log10((n + 1) / whole)
            columns = [doc_id, c.held_out, c.counts, sums((n > 0).astype(np.int64)[c.at], c.counts), np.full(len(c.counts), tokens), sums(base[c.at], c.counts), sums(np.log10(made), c.counts)]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

        yield from grouped(batches, ("chunk", "bucket", "doc_id", "blobs"), take)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [c.split()[0] for c in schema.split(", ")]
    together = chunks.union(answers.filter("chunk >= 0"))
    return together.repartition(max(partitions(spark), chunks.rdd.getNumPartitions()), "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(tidy(score), schema)
