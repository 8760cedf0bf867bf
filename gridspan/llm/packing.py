"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A length belongs to the reciprocal class ``k`` when ``k`` pieces of it, but not ``k + 1``, fit into a sequence. Every
class has its own bins and a bin holds exactly ``k`` pieces, so a worker fills its bins with counters alone and workers
never talk to each other. A document may be cut: pieces are cut off at ``capacity // (k + 1)`` while leaving the rest
whole would waste more than a small share of its slot. What is left in a worker's unfinished bins at the end is chopped
into full sequences, and the last partial one into power-of-two sequences, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, SLICE_BYTES, give_back, slices, tidy

CAPACITY = 4096
SLACK = 64
#: The name of a worker's encoder among what it keeps.
ENCODER = "encoder"
#: Words and pieces whose ids a worker keeps; a table starts anew beyond that.
CACHED_WORDS, CACHED_PIECES = 400_000, 500_000
#: Latin letters whose lower case and composition are one to one, then ASCII punctuation but the apostrophe.
SIMPLE = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, pieces_per_bin int"


def ragged(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... (width[i] of them) of each i in turn."""
    stop = np.cumsum(width)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - stop + width, width)


class Growing:
    """Ids of numbered entries one after another, and where each entry's begin and end."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.width, self.entries = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, ids: np.ndarray, width: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.entries + len(width) > len(self.start):
            self.start, self.width = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.width))
        self.ids[self.used : self.used + len(ids)] = ids
        at = slice(self.entries, self.entries + len(width))
        self.start[at], self.width[at] = self.used + np.cumsum(width) - width, width
        self.used, self.entries = self.used + len(ids), self.entries + len(width)

    def of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries in turn, and how many each has."""
        width = self.width[entries]
        return self.ids[ragged(self.start[entries], width)], width


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space; ids of a word are looked up once.

    Splitting at ASCII white space first gives the ids of the whole text, since the tokenizer's own pattern never
    matches across white space and its normaliser never joins characters across it. A word of Latin letters and ASCII
    punctuation after them is two of the tokenizer's own pieces, whose ids are looked up by themselves, in any case of
    the letters; many such pieces are encoded as one text and told apart by the mark at the end of each. Texts are split
    and their words numbered column-wise, so that only distinct words are looked up one by one.
    """

    def __init__(self, path: str, most_words: int = CACHED_WORDS, most_pieces: int = CACHED_PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; a pool of threads would only spin
        self.most_words, self.most_pieces = most_words, most_pieces
        self.tokenizer = Tokenizer.from_file(path)
        # pieces need no normaliser and no pattern any more, only the mapping of their bytes
        parts = json.loads(self.tokenizer.to_str())
        bytes_only = [{"type": "WhitespaceSplit"}, *(p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel")]
        self.of_pieces = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": bytes_only}}))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget_words()
        self.forget_pieces()

    def forget_words(self) -> None:
        self.known: dict[str, int] = {}
        self.of_word = Growing()

    def forget_pieces(self) -> None:
        self.pieces: dict[str, int] = {"": 0}
        self.of_piece = Growing()
        self.of_piece.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def learn_pieces(self, pieces: list[str]) -> None:
        for low in range(0, len(pieces), 2_000):
            part = pieces[low : low + 2_000]
            ids = np.asarray(self.of_pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            self.pieces.update(zip(part, range(self.of_piece.entries, self.of_piece.entries + len(part)), strict=True))
            self.of_piece.add(ids, np.diff(stops, prepend=0))

    def learn(self, words: list[str]) -> None:
        """Numbers for words not known yet, in order."""
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        parts = pc.extract_regex(pa.array(words, pa.string()), SIMPLE)
        simple = np.asarray(pc.is_valid(parts))
        split = parts.filter(pa.array(simple))
        both = pa.concat_arrays([pc.utf8_lower(split.field("letters")), split.field("marks")]).dictionary_encode()
        pieces = both.dictionary.to_pylist()
        if self.of_piece.entries + len(pieces) > self.most_pieces:
            self.forget_pieces()
        self.learn_pieces([p for p in pieces if p not in self.pieces])
        numbers = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))[np.asarray(both.indices)]
        ids, width = self.of_piece.of(numbers.reshape(2, -1).T.ravel())
        if simple.all():
            self.of_word.add(ids, width.reshape(-1, 2).sum(axis=1))
            return
        rest = [words[i] for i in np.flatnonzero(~simple).tolist()]
        done = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        each = np.empty(len(words), np.int64)
        each[simple], each[~simple] = width.reshape(-1, 2).sum(axis=1), [len(x) for x in done]
        both_ids = np.empty(int(each.sum()), np.uint32)
        mine = np.repeat(simple, each)
        both_ids[mine], both_ids[~mine] = ids, [i for x in done for i in x]
        self.of_word.add(both_ids, each)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Entries of ``of_word`` of distinct words, until the next call."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(found < 0)
        if len(self.known) + len(fresh) > self.most_words:
            self.forget_words()
            fresh = np.arange(len(words))
        if len(fresh):
            found[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.learn([words[i] for i in fresh.tolist()])
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each has; nulls have none."""
        counts, at, words = numbered_words(texts)
        entries = self.numbers(words)[at]
        ids, width = self.of_word.of(entries)
        return ids, sums(width, counts)


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """How many words each text has, the number of each word in turn, and the distinct words by number.

    Words are runs between ASCII white space; nulls have none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    at, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    if "" in words:  # before a text's first white space, or after its last
        empty = words.index("")
        real = at != empty
        counts = sums(real.astype(np.int64), counts)
        at = at[real]
        at -= at > empty
        del words[empty]
    return counts, at, words


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values each."""
    total = np.concatenate([[0], np.cumsum(values)])
    stop = np.cumsum(counts)
    return total[stop] - total[stop - counts]


def encoder_of(path: str, most_words: int = CACHED_WORDS, most_pieces: int = CACHED_PIECES) -> WordEncoder:
    """A worker process's encoder, kept from task to task until another operator's task runs there."""
    wanted = (path, most_words, most_pieces)
    if KEPT.get(ENCODER, (None,))[0] != wanted:
        KEPT[ENCODER] = (wanted, WordEncoder(*wanted))
    return KEPT[ENCODER][1]


def cuts(tokens: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    pieces = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        head = rest if (capacity // k - rest) * slack <= rest else capacity // (k + 1)
        pieces.append(head)
        rest -= head
    return pieces


class HarmonicBins:
    """One worker's open bins. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def close(self, pieces: list[tuple], k: int) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next_id, offset, k, ids
            offset += n
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // (len(piece[2]) // 4)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            yield from self.close(held, k)

    def finish(self) -> Iterator[tuple]:
        """Unfinished bins, chopped: they hold fewer tokens than capacity for each class."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) // 4 for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        total %= self.capacity
        sizes += [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        rest.reverse()
        for size in sizes:
            held = []
            while size:
                doc, start, ids, tokens = rest.pop()
                n = min(size, len(ids) // 4)
                held.append((doc, start, ids[: 4 * n], tokens))
                if n < len(ids) // 4:
                    rest.append((doc, start + n, ids[4 * n :], tokens))
                size -= n
            yield from self.close(held, 0)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; no shuffle.

    A null or empty text is a document of the end id alone; a null id stays null; repeated rows are documents of their
    own; an empty table gives no rows; other columns are ignored. ``with_ids`` adds the ids of each piece. Sequence ids
    are unique, a worker's partition number above a running number. ``pieces_per_bin`` is the class, 0 for chopped rests.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encoder, bins, rows = encoder_of(tokenizer), HarmonicBins(TaskContext.get().partitionId() << 32, capacity), []

        def out():
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(columns[:8], kinds, strict=True)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[8]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for part in slices(batch, "text", 2 * SLICE_BYTES):
                flat, counts = encoder.texts(part.column("text"))
                flat, stop = flat.astype("<u4", copy=False).tobytes(), 0
                for doc, n_ids in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    ids, stop = flat[4 * stop : 4 * (stop + n_ids)] + end, stop + n_ids
                    start = 0
                    for n in cuts(n_ids + 1, capacity):
                        rows.extend(bins.add((doc, start, ids[4 * start : 4 * (start + n)], n_ids + 1)))
                        start += n
                if rows:
                    yield out()
                give_back()
        rows.extend(bins.finish())
        if rows:
            yield out()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run, ENCODER), schema)
