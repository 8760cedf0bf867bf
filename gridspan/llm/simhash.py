"""SimHash near-duplicates found by covering locality-sensitive hashing.

For radius r every bit position gets a non-zero vector of r + 1 bits; a table's mask, one for each non-zero v of r + 1
bits, has the positions whose vector has an odd product with v. Any r positions leave some v orthogonal to all their
vectors, so two fingerprints that differ in r bits at most agree under some mask: every such pair collides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, checkpointed, grouped, mixed, packed, partitions, slices, tidy, unpacked
from .graph import components
from .packing import numbered_words, ragged

RADIUS = 2
#: Distinct fingerprints of a bucket that are compared directly; larger buckets go by shared one-bit neighbours.
DIRECT = 256
#: Document-level stage: words of a shingle, least Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Text bytes of a chunk and (expected) of a bucket of shingles; partners (expected) that a set is compared with in one task.
CHUNK_BYTES, BUCKET_BYTES, PARTNERS = 4_000_000, 8_000_000, 1000


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks over 64 bits, as unsigned integers."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words joined by a space; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip((ends - length)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; zero of none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row; a null text has no words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = [simhash(shingle_hashes(words_of(t), words)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius``."""
    if len(values) == 2:
        return [(int(values[0]), int(values[1]))] if int(np.bitwise_count(np.uint64(values.view(np.uint64)[0] ^ values.view(np.uint64)[1]))) <= radius else []
    raw = values.view(np.uint64)
    near = np.bitwise_count(raw[:, None] ^ raw[None, :]) <= radius
    left, out = set(range(len(values))), []
    while left:
        heap = [left.pop()]
        while heap:
            x = heap.pop()
            for y in left.intersection(np.flatnonzero(near[x]).tolist()):
                left.discard(y)
                heap.append(y)
                out.append((int(values[x]), int(values[y])))
    return out


def covering_links(distinct: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect exactly what pairs of distinct ``fp`` within RADIUS (2) bits connect.

    A bucket of DIRECT fingerprints or fewer is compared within its task and gives a spanning forest. The members of a
    larger one meet at the values one free bit away: two fingerprints differ in 2 bits or fewer exactly if they share
    such a value (or one is it), and a value has at most one member for each free bit, so no group grows with the data.
    """
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks())]
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.key")
    crowded = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = checkpointed(rows.join(checkpointed(crowded), ["t", "key"]))

    def run(batches):
        for batch in batches:
            found = [e for values in batch.column(0) for e in bucket_links(np.asarray(values.values, np.int64), RADIUS)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    small = members.filter(F.col("n") <= DIRECT).repartition(partitions(distinct.sparkSession), "t", "key").groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    direct = small.select("fps").mapInArrow(tidy(run), "a long, b long")
    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks()])
    probes = members.filter(F.col("n") > DIRECT).select("t", "fp", F.explode(free[F.col("t")]).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("probe"))
    met = probes.groupBy("t", "probe").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    shared = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return direct.union(shared)


def near_fingerprints(docs: DataFrame, *, words: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every row of ``docs``.

    Fingerprints link at RADIUS bits or fewer; ``component_id`` is the smallest non-null ``doc_id`` reachable (null if
    there is none). Equal fingerprints are one node, so copies are never paired. A text without words (null, empty) has
    fingerprint zero, linked like any other; repeated rows and ids stay as they are; an empty table gives no rows.
    """
    base = checkpointed(fingerprints(docs, words=words))
    distinct = checkpointed(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(covering_links(distinct.select("fp")))
    labelled = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    of_label = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(checkpointed(of_label), "label").select("fp", "component_id")
    return base.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def class_text(texts: pa.Array) -> pa.Array:
    """ASCII-lower-cased words joined by single spaces; nulls as empty texts."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    return pc.binary_join(pc.ascii_split_whitespace(bare), " ")


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, text) of class texts, ascending: 63-bit hashes of runs of ``words`` words (of all words, if a text
    has fewer), and the texts' numbers."""
    counts, at, distinct = numbered_words(texts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = mixed(np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct)))[at]
    factor = np.uint64(0x9E3779B97F4A7C15)
    begin = np.cumsum(counts) - counts
    long = counts >= words
    start = ragged(begin[long], counts[long] - words + 1)
    run = np.zeros(len(start), np.uint64)
    for i in range(words):
        run = run * factor + h[start + i]
    of = np.repeat(np.flatnonzero(long), counts[long] - words + 1)
    short = np.flatnonzero(~long & (counts > 0))
    last = np.zeros(len(short), np.uint64)
    for i in range(words - 1):
        on = counts[short] > i
        last[on] = (last[on] + np.uint64(i + 1)) * factor + h[begin[short][on] + i]
    run, of = mixed(np.concatenate([run, last])) >> np.uint64(1), np.concatenate([of, short])
    order = np.lexsort((of, run)) if len(short) else np.argsort(run, kind="stable")
    run, of = run[order], of[order]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (of[1:] != of[:-1])])
    return run[new], of[new]


def take_prefix(size: int, similarity: float) -> int:
    """How many of a set's first members, in any order common to all sets, sets that similar share one of at least."""
    return size - int(np.ceil(similarity * size - 1e-9)) + 1 if size else 0


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of sets given ascending."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def candidates(run: np.ndarray, of: np.ndarray, times: np.ndarray, similarity: float) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """(text, members that others have too, rank, the first of these members in the order, whole set) of each text that can
    be similar to another one. The rank is smaller for a text whose members many texts have, as of those that others are
    edited copies of.

    ``times``: how many texts of the corpus have each member. The order is rare members first. A text that shares fewer
    members with any others than the similarity needs is left out.
    """
    if not len(of):
        return
    size = np.bincount(of)
    shared = np.bincount(of[times > 1], minlength=len(size))
    able = (size > 0) & (shared >= np.ceil(similarity * size - 1e-9))
    rank = -np.bincount(of, np.log2(times), len(size)) / np.maximum(size, 1)
    on = able[of]
    run, of, times = run[on], of[on], times[on]
    order = np.lexsort((run, times, of))
    stop = np.cumsum(np.bincount(of, minlength=len(size)))
    whole = run[np.lexsort((run, of))]
    for text in np.flatnonzero(able).tolist():
        mine = slice(int(stop[text] - size[text]), int(stop[text]))
        first = order[mine][: take_prefix(int(size[text]), similarity)]
        yield text, int(shared[text]), float(rank[text]), run[first[times[first] > 1]], whole[mine]


def asked_buckets(run: np.ndarray, buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each bucket, a chunk's distinct members in it and how many of its texts have each; ``run`` ascends."""
    if not len(run):
        return
    new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    keys, times = run[new], np.diff(np.append(new, len(run)))
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(cut)).tolist():
        mine = slice(cut[bucket], cut[bucket + 1])
        yield bucket, [packed(np.diff(keys[mine], prepend=np.uint64(0))), packed(times[mine])]


def one_of_each(docs: DataFrame, *, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates, with its columns: the one with the smallest ``doc_id``.

    Documents with the same lower-cased words are copies. Others are linked if the Jaccard similarity of their sets of
    ``words``-word shingles is ``similarity`` or more, which is verified on whole sets; groups are what links connect, and all
    are found. A document is compared at all only if so many of its shingles occur elsewhere. Then, in any common order of
    shingles, two sets that similar, which have t members in common at least, share one among the first n - t + 1 of each (n:
    its size); the order puts shingles that fewer documents have first, counted over all documents. Documents whose
    fingerprints collide within RADIUS under the covering masks, and documents that share such a shingle with the most common
    one (by its shingles' counts) that has it, are compared first; then those pairs are that this left apart, so a large group
    isn't paired with itself.

    Null and empty texts are copies of each other. A null id counts as the smallest. Rows equal in id go by a hash of all
    their columns; of rows equal in all, one stays. An empty table stays empty; columns of any name stay.
    """
    spark = docs.sparkSession
    columns = [F.col(f"`{f.name.replace('`', '``')}`") for f in docs.schema if "map" not in f.dataType.simpleString()]
    base = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text"), F.xxhash64(*columns).alias("ka"), F.xxhash64(F.lit(1), *columns).alias("kb"))

    def normalise(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                texts = class_text(part.column("text"))
                every = texts.to_pylist()
                ca, cb = (np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in every), np.uint64, len(every)) for seed in (1, 2))
                _, one = np.unique(np.stack([ca, cb], axis=1), axis=0, return_index=True)
                own = [every[i].encode() for i in one.tolist()]
                packs = [ca[one], cb[one], np.array(list(map(len, own)))]
                row = [[chunk], [-1], [sum(map(len, own))], [[packed(x) for x in packs] + [zstandard.ZstdCompressor(level=1).compress(b"".join(own))]]]
                keys = [pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("id", "ka", "kb")] + [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (ca, cb)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)] + keys, names=["chunk", "bucket", "size", "blobs", "id", "ka", "kb", "ca", "cb"])
                chunk += 1

    chunks = base.select("id", "ka", "kb", "text").mapInArrow(tidy(normalise), "chunk long, bucket long, size long, blobs array<binary>, " + ", ".join(f"{c} array<long>" for c in ("id", "ka", "kb", "ca", "cb")))
    chunks = checkpointed(chunks)
    every = chunks.select(F.explode(F.arrays_zip("id", "ka", "kb", "ca", "cb")).alias("x")).select("x.*")
    classes = checkpointed(every.groupBy("ca", "cb").agg(F.min(F.struct("id", "ka", "kb")).alias("node")))
    buckets = max(1, -(-(chunks.agg(F.sum("size").alias("size")).first()["size"] or 0) // BUCKET_BYTES))

    def sets(blobs):
        ca, cb, length, raw = *map(unpacked, blobs[:3]), zstandard.ZstdDecompressor().decompress(blobs[3])
        texts = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64)), pa.py_buffer(raw)])
        return ca, cb, *shingle_sets(texts.cast(pa.string()), words)

    def ask(batches):
        for batch in batches:
            for chunk, blobs in zip(batch.column("chunk").to_pylist(), batch.column("blobs").to_pylist(), strict=True):
                for bucket, mine in asked_buckets(sets(blobs)[2], buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket], pa.int64()), pa.array([mine], pa.list_(pa.binary()))], names=["chunk", "bucket", "blobs"])

    def answer(batches):
        def take(bucket, asked):
            parts = [[unpacked(b) for b in blobs] for _, blobs in asked]
            keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
            _, of = np.unique(keys, return_inverse=True)
            total = np.bincount(of, np.concatenate([p[1] for p in parts])).astype(np.int64)[of]
            for (chunk, _), mine in zip(asked, np.split(total, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket]), pa.array([[packed(mine)]], pa.list_(pa.binary()))], names=["chunk", "bucket", "blobs"])

        yield from grouped(batches, ("bucket", "chunk", "blobs"), take)

    schema = "chunk long, bucket long, blobs array<binary>"
    asked = chunks.select("chunk", "blobs").mapInArrow(tidy(ask), schema).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(tidy(answer), schema)

    def choose(batches):
        def take(chunk, parts):
            parts.sort(key=lambda r: r[0])
            ca, cb, run, of = sets(parts[0][1])
            if not len(run):
                return
            new = np.concatenate([[True], run[1:] != run[:-1]])
            times = np.concatenate([unpacked(blobs[0]) for _, blobs in parts[1:]])[np.cumsum(new) - 1]
            found = list(candidates(run, of, times, similarity))
            for low in range(0, len(found), 500):
                text, common, rank, first, whole = zip(*found[low : low + 500], strict=True)
                text = list(text)
                longs = [ca[text].view(np.int64), cb[text].view(np.int64), np.array(list(map(len, whole))), np.array(common), np.array([simhash(x << np.uint64(1)) for x in whole], np.uint64).view(np.int64)]
                made = [pa.array(x, pa.int64()) for x in longs] + [pa.array(rank, pa.float64()), pa.array([x.view(np.int64) for x in first], pa.list_(pa.int64())), pa.array([x.tobytes() for x in whole], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["ca", "cb", "n", "common", "fp", "rank", "prefix", "members"])

        yield from grouped(batches, ("chunk", "bucket", "blobs"), take)

    together = chunks.select("chunk", "bucket", "blobs").union(answers).repartition(max(partitions(spark), chunks.rdd.getNumPartitions()), "chunk").sortWithinPartitions("chunk", "bucket")
    chosen = together.mapInArrow(tidy(choose), "ca long, cb long, n long, common long, fp long, rank double, prefix array<long>, members binary").dropDuplicates(["ca", "cb"])
    sketches = checkpointed(chosen.withColumn("k", F.monotonically_increasing_id()))

    def needed(x, y):
        """The members that two sets of these sizes have in common at least if they are similar."""
        return F.ceil((x + y) * (similarity / (1 + similarity)) - 1e-6)

    def early(pos, x, y):
        """Whether a member at that place of its set (of size x) can be the first that both have."""
        return pos <= x - needed(x, y)

    col = F.col
    first = F.posexplode("prefix").alias("pos", "token")
    tokens = sketches.select("k", "n", "rank", (col("n") - col("common")).alias("others"), first).select("k", "n", "rank", "token", (col("others") + col("pos")).alias("pos"))
    ends = tokens.groupBy("token").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.min("n").alias("least")).filter("low <> high").select("token", "least")
    shared = tokens.join(checkpointed(ends), "token").filter(early(col("pos"), col("n"), F.greatest(col("least"), F.ceil(similarity * col("n") - 1e-6))))
    shared = checkpointed(shared.select("token", "k", "n", "rank", "pos"))
    lows = shared.groupBy("token").agg(F.min(F.struct("rank", "k", "n", "pos")).alias("low"), F.min("k").alias("least"), F.max("k").alias("most")).filter("least <> most").select("token", "low")

    def verify(batches):
        def take(key, rows):
            own = None
            ok = []
            for _, a, b, members in rows:
                if b is None:
                    own = np.frombuffer(members, np.uint64)
                elif jaccard(own, np.frombuffer(members, np.uint64)) >= similarity - 1e-9:
                    ok.append((a, b))
            if ok:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ok, strict=True)], names=["a", "b"])

        yield from grouped(batches, ("part", "salt", "a", "b", "members"), take)

    def links(pairs):
        """Those of the pairs (``a``, ``b``) that are similar. A set goes once to each part of at most PARTNERS (expected) of its partners."""
        of = lambda x: sketches.select(col("k").alias(x), col("n").alias(f"n_{x}"), col("common").alias(f"common_{x}"))
        both = pairs.distinct().join(of("a"), "a").join(of("b"), "b")
        able = F.least("common_a", "common_b", "n_a", "n_b") >= needed(col("n_a"), col("n_b"))
        both = checkpointed(both.filter(able).select("a", "b"))
        salts = checkpointed(both.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("salts")))
        part = lambda salt: F.xxhash64("a", salt)
        left = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sketches.select(F.col("k").alias("a"), "members"), "a")
        left = left.select(part("salt").alias("part"), "salt", "a", F.lit(None).cast("long").alias("b"), "members")
        right = both.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
        right = right.join(sketches.select(F.col("k").alias("b"), "members"), "b").select(part("salt").alias("part"), "salt", "a", "b", "members")
        met = left.union(right).repartition(max(partitions(spark), sketches.rdd.getNumPartitions()), "part").sortWithinPartitions("part", "a", "salt", F.col("b").asc_nulls_first())
        return checkpointed(met.mapInArrow(tidy(verify), "a long, b long"))

    equal = sketches.groupBy("fp").agg(F.min("k").alias("least"))
    equal = checkpointed(equal)
    of_fp = lambda x: equal.select(F.col("fp").alias(x), F.col("least").alias(f"k_{x}"))
    near = covering_links(equal.select("fp")).join(of_fp("a"), "a").join(of_fp("b"), "b").select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"))
    near = near.union(sketches.join(equal, "fp").filter("k <> least").select(F.col("least").alias("a"), F.col("k").alias("b")))
    star = shared.join(checkpointed(lows), "token").filter((col("k") != col("low.k")) & early(col("pos"), col("n"), col("low.n")) & early(col("low.pos"), col("low.n"), col("n")))
    found = links(star.select(col("low.k").alias("a"), col("k").alias("b")).union(near))
    labels = components(found)
    marked = checkpointed(shared.join(labels, shared.k == labels.node, "left").select("token", "k", "n", "pos", F.coalesce("label", "k").alias("label")))
    apart = marked.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("token")
    rest = checkpointed(marked.join(apart, "token"))
    left, right = (rest.select("token", *[col(c).alias(f"{c}_{x}") for c in ("k", "n", "pos", "label")]) for x in "ab")
    meet = (col("k_a") < col("k_b")) & (col("label_a") != col("label_b")) & early(col("pos_a"), col("n_a"), col("n_b")) & early(col("pos_b"), col("n_b"), col("n_a"))
    across = left.withColumnRenamed("token", "of").join(right, (col("of") == col("token")) & meet).select(col("k_a").alias("a"), col("k_b").alias("b"))
    labels = components(found.union(links(across)))

    nodes = sketches.select("k", "ca", "cb").join(classes, ["ca", "cb"])
    labelled = nodes.join(labels, nodes.k == labels.node, "inner").select("label", nodes.node.alias("of"), "ca", "cb")
    least = checkpointed(labelled.groupBy("label").agg(F.min("of").alias("least")))
    gone = labelled.join(least, "label").filter(~F.col("of").eqNullSafe(F.col("least"))).select("ca", "cb")
    stays = classes.join(checkpointed(gone), ["ca", "cb"], "left_anti").select("node.ka", "node.kb")
    return base.select("row", "ka", "kb").join(stays, ["ka", "kb"], "left_semi").dropDuplicates(["ka", "kb"]).select("row.*")
