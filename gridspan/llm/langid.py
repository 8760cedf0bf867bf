"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter's maximum over the window is
kept, and a softmax layer gives the languages. For prediction the embedding and the filters fold into one lookup table
for each filter offset, so a window costs as many table rows as the widest filter has bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_worker, slices, tidy

WIDTHS = (4, 3, 2)  # widest first: the table of a later offset covers a leading part of the filters
FILTERS, EMBED, SPAN = 16, 12, 125
WINDOW = SPAN + WIDTHS[0] - 1
#: The labelled sample: documents of each language, windows of each document, languages (the most frequent).
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC, MOST_LANGUAGES = 800, 4, 256
STEPS, BATCH = 500, 96
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; the pattern alone also takes numbers such as fractions."""
    return text is not None and any(m[0].isalpha() for m in LETTER.finditer(text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows over whole texts, zero-padded, and the number of windows of each text."""
    counts = np.array([max(1, -(-max(len(t) - WINDOW + SPAN, 1) // SPAN)) for t in texts])
    out = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    row = 0
    for text, n in zip(texts, counts, strict=True):
        padded = np.zeros(n * SPAN + WINDOW - SPAN, np.uint8)
        padded[: len(text)] = np.frombuffer(text, np.uint8)
        out[row : row + n] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::SPAN]
        row += n
    return out, counts


@dataclass
class ByteConvNet:
    """The folded network: a table of 256 rows for each filter offset, biases, and the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.empty((len(x), len(self.bias)), np.float32)
        for low in range(0, len(x), 96):
            part = x[low : low + 96]
            hidden = self.tables[0][part[:, :SPAN]]
            for offset, table in enumerate(self.tables[1:], 1):
                hidden[:, :, : table.shape[1]] += table[part[:, offset : offset + SPAN]]
            pooled[low : low + 96] = hidden.max(axis=1)
        logits = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        grown = np.exp(logits - logits.max(axis=1, keepdims=True))
        return grown / grown.sum(axis=1, keepdims=True)

    def documents(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: mean probabilities of its windows, weighted by their bytes."""
        known = np.array([has_letter(t) for t in texts], bool)
        if not self.languages or not known.any():
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        raw = [t.encode() for t, k in zip(texts, known, strict=True) if k]
        x, counts = windows(raw)
        starts = np.cumsum(counts) - counts
        within = np.arange(len(x)) - np.repeat(starts, counts)
        weight = np.clip(np.repeat([len(t) for t in raw], counts) - within * SPAN, 1, SPAN).astype(np.float64)
        p = np.add.reduceat(self.probabilities(x) * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        labels, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = p.argmax(axis=1)
        for at, k, score in zip(np.flatnonzero(known), best, p[np.arange(len(p)), best], strict=True):
            labels[at], scores[at] = self.languages[k], min(1.0, max(0.0, float(score)))
        return labels, scores


def train(x: np.ndarray, labels: list[str], seed: int = 7) -> ByteConvNet:
    """Adam on windows drawn evenly from the languages."""
    languages = sorted(set(labels))
    if not languages:
        empty = np.zeros((256, FILTERS * len(WIDTHS)), np.float32)
        return ByteConvNet([], [empty], np.zeros(empty.shape[1], np.float32), np.zeros((empty.shape[1], 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(languages, labels)
    members = [np.flatnonzero(y == k) for k in range(len(languages))]
    total = FILTERS * len(WIDTHS)
    p = {"embed": rng.normal(0, 0.3, (256, EMBED)), "bias": np.zeros(total), "out": rng.normal(0, 0.1, (total, len(languages))), "out_bias": np.zeros(len(languages))}
    p |= {f"w{w}": rng.normal(0, (1 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = np.array([rng.choice(members[k]) for k in rng.integers(0, len(languages), BATCH)])
        bytes_ = x[pick]
        e = p["embed"][bytes_]
        views = {w: np.lib.stride_tricks.sliding_window_view(e, w, axis=1)[:, :SPAN].transpose(0, 1, 3, 2).reshape(BATCH * SPAN, w * EMBED) for w in WIDTHS}
        conv = [(views[w] @ p[f"w{w}"]).reshape(BATCH, SPAN, FILTERS) for w in WIDTHS]
        at = [c.argmax(axis=1) for c in conv]
        pooled = np.concatenate([c.max(axis=1) for c in conv], axis=1) + p["bias"]
        active = np.maximum(pooled, 0)
        logits = active @ p["out"] + p["out_bias"]
        soft = np.exp(logits - logits.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        d = soft
        d[np.arange(BATCH), y[pick]] -= 1
        d /= BATCH
        grad = {"out": active.T @ d, "out_bias": d.sum(axis=0)}
        d_pool = (d @ p["out"].T) * (pooled > 0)
        grad["bias"] = d_pool.sum(axis=0)
        d_embed = np.zeros_like(p["embed"])
        rows = np.arange(BATCH)[:, None]
        for i, w in enumerate(WIDTHS):
            g = d_pool[:, i * FILTERS : (i + 1) * FILTERS]
            patch = views[w].reshape(BATCH, SPAN, w * EMBED)[rows, at[i]]  # of the winning positions only
            grad[f"w{w}"] = np.einsum("bfe,bf->ef", patch, g)
            back = (g[:, :, None] * p[f"w{w}"].T[None]).reshape(BATCH, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(d_embed, bytes_[rows, at[i] + j], back[:, :, j])
        grad["embed"] = d_embed
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    tables = []
    for offset in range(WIDTHS[0]):
        parts = [p["embed"] @ p[f"w{w}"][offset * EMBED : (offset + 1) * EMBED] for w in WIDTHS if w > offset]
        tables.append(np.ascontiguousarray(np.concatenate(parts, axis=1), np.float32))
    return ByteConvNet(languages, tables, p["bias"], p["out"], p["out_bias"])


def remainder(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def fit(docs: DataFrame, *, docs_per_language: int = DOCS_PER_LANGUAGE) -> ByteConvNet:
    """A network fitted on a bounded sample: about ``docs_per_language`` labelled documents of each language, chosen by a
    hash of the id, and at most WINDOWS_PER_DOC windows spread evenly over each. Of more than MOST_LANGUAGES values of
    ``lang`` the most frequent are learned.

    Documents with a null text, id or language, or whose crc32 remainder by 5 is 0, are never looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in counted.collect()}
    if not counts:
        return train(np.zeros((0, WINDOW), np.uint8), [])
    grain = 1 << 30
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(grain, -(-grain * docs_per_language // n)))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(grain)) < share[F.col("lang")]).select("doc_id", "lang", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, lang, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                    if has_letter(text):
                        x, counts = windows([text.encode()])
                        for i in np.unique(np.linspace(0, int(counts[0]) - 1, WINDOWS_PER_DOC).astype(int)):
                            out.append((doc, lang, x[i].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["doc_id", "lang", "bytes"])

    got = sorted((r["doc_id"], r["lang"], bytes(r["bytes"])) for r in chosen.mapInArrow(tidy(run), "doc_id long, lang string, bytes binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, WINDOW)
    return on_worker(docs.sparkSession, train, x, [r[1] for r in got])


def identify(docs: DataFrame, net: ByteConvNet, *, text_col: str = "text") -> DataFrame:
    """Every row with its columns, then ``lang_pred`` and ``score`` (replacing columns of these names).

    A null text or one without a letter is ``und`` with score 0; so is every text if nothing was labelled. Texts are read
    whole. An empty table gives no rows.
    """
    kept = docs.drop("lang_pred", "score")

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1_000_000):
                labels, scores = net.documents(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return kept.mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, net: ByteConvNet, *, least_score: float = 0.3) -> DataFrame:
    """The rows whose language can be told: not ``und``, and with ``least_score`` or more. The columns stay."""
    row = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    found = identify(row, net)
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")
