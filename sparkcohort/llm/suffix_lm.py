"""Language-model scoring with a probabilistic suffix tree.

Symbols are lower-cased words and an end of text.  The root holds the counts of
all words, however rare.  Deeper states grow from it: a context that occurs
``min_context`` times and whose longest proper suffix is a state is a candidate, its
next symbols are those seen with it ``min_next`` times, and it is retained when their
distribution differs from that in the suffix by a likelihood-ratio (divergence)
test.  A retained state discounts its next symbols; what it does not have backs off
to its suffix.  Depths are added until one retains no state.  Both bounds are counts,
so the tree grows with the corpus; no table of it is gathered in one place.

A run of L + 1 symbols has a hash made of those of its first and its last L symbols:
its context, and the entry that it backs off to.  So every table of a depth is keyed
by hashes of the depth before, and joins are plain.

The score of a text is a sum over its runs: of root probabilities, of the back-off
of each retained context, and of what each entry is above its back-off.  Runs are
looked up in three ways: those with over ``heavy_share`` of all symbols are few
whatever the input (at most 1/``heavy_share`` a depth) and are sent out; a bitmap
tells most of what the tree does not have; the rest meets the tree's table in a
join, a row for each text and run.

What lies on disk is kept small: texts are stored as the ranks of the words that are
sent out, byte by byte, as the high bytes of most are alike, and the hashes of the
others; runs are counted in rounds by their contexts' hashes, and shuffled as the
ranks of their words, packed by buckets; texts are scored in parts whose rows are
deleted in between, and what they are joined with is dealt into buckets once, not
shuffled for every part: as few as a part needs, as a text has a row of sums for each;
a step's shuffle files go when it ends.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcohort.llm.common import Workspace, partitions, text_bytes, text_slices

END = b""
MIN_CONTEXT, MIN_NEXT = 256, 8
#: Twice the log-likelihood that a state must gain, besides log(n) for each next symbol: a chance of about 1 in 10,000 without cause.
GAIN = 10.0
HEAVY_SHARE, DISCOUNT = 1e-6, 0.5
#: A bitmap has 2 to the power of one of these bits, 16 or more an element as far as that goes.
BITMAP_BITS, SHIFTS = (16, 28), (36, 8)
FLUSH = 1_000_000
#: Symbols worked on at once; arrays over them are what a Python worker holds, whatever the size of an Arrow batch.
SLICE = 250_000
#: Tell a context's and a word's key from that of an entry with the same symbols.
CONTEXT, WORD = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
TINY = 1e-12
#: Rounds in which runs are counted and parts in which texts are scored, at most: rows of one at a time are on disk.
ROUNDS, PARTS = 4, 8
#: Buckets that counted runs are dealt into, at most: each is packed by itself, and summed up by one task.
BUCKETS = 512
#: Files that a part has at least, as each is a task.
PART_FILES = 4
#: Columns of a text's codes: their lowest bytes, and so on.
PLANES = ("b0", "b1", "b2", "b3")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession):
    """Each query that ends meanwhile deletes its shuffle files; else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a run from the hashes of the runs without its last and without its first symbol (uint64)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashed(batches, column: int):
    """Parts of batches, hashes of the symbols of all texts in a part (uint64), and where each text begins and the last ends."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in text_slices(batch, column):
            found, ends = [], [0]
            for text in part.column(column).to_pylist():
                found.extend(map(digest, text.lower().split()))  # bytes.lower() changes A-Z only
                found.append(digest(END))
                ends.append(len(found))
            yield part, np.array(found, dtype=np.uint64), np.array(ends)


def _encode(batches, coded):
    """Each text's symbols as codes, 1 + the ranks of the words sent out or 0, a column a byte, and the hashes of the others in their order."""
    known, rank, _ = coded.value
    for part, symbols, ends in _hashed(batches, 1):
        at = _find(known, symbols)
        other = at < 0
        codes = np.where(other, 0, rank[np.maximum(at, 0)] + 1 if len(rank) else 0).astype("<i4")
        edges = pa.py_buffer(ends.astype(np.int32))
        planes = [pa.Array.from_buffers(pa.binary(), part.num_rows, [None, edges, pa.py_buffer(codes.view(np.uint8)[k::4].tobytes())]) for k in range(4)]
        others = np.concatenate(([0], np.cumsum(other)))[ends]
        hashes = pa.ListArray.from_arrays(pa.array(others.astype(np.int32)), pa.array(symbols[other].view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0), *planes, hashes], ["row", *PLANES, "others"])


def _decode(planes: list[pa.BinaryArray], others: pa.ListArray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of some texts (uint64), the place of each in its text, and its rank or -1."""
    lowest, places = _flat(planes[0])
    codes = np.empty((len(lowest), 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        codes[:, k] = _values(plane)
    at = codes.view("<i4")[:, 0] - 1
    symbols, sent = np.empty(len(at), dtype=np.uint64), at >= 0
    symbols[sent] = hashes[at[sent]]
    symbols[~sent] = _values(others)
    return symbols, places, at


def _edges(column: pa.ListArray | pa.BinaryArray) -> np.ndarray:
    """Where each row's symbols begin, and where the last's end."""
    if isinstance(column, pa.ListArray):
        return column.offsets.to_numpy()
    if not len(column):
        return np.zeros(1, dtype=np.int32)
    return np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)


def _values(column: pa.ListArray | pa.BinaryArray) -> np.ndarray:
    """All symbols of a column: hashes (uint64) of lists, bytes of binaries."""
    if isinstance(column, pa.ListArray):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    edges = _edges(column)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[edges[0] : edges[-1]]


def _flat(column: pa.ListArray | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of some texts, and the place of each in its text."""
    symbols, edges = _values(column), _edges(column)
    return symbols, np.arange(len(symbols)) - np.repeat(edges[:-1] - edges[0], np.diff(edges))


def _symbol_slices(batches, column: int):
    """Parts of batches with about ``SLICE`` symbols in a column, one row at least."""
    for batch in batches:
        edges = _edges(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(edges, edges[start] + SLICE, side="right")) - 1, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _count_symbols(batches):
    held, n = [], 0

    def flush():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "n"])

    for _, symbols, _ in _hashed(batches, 0):
        held.append(symbols)
        n += len(symbols)
        if n > FLUSH:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


class Bitmap:
    """A set of hashes by two stretches of their bits: never misses one it has, and has a bounded size."""

    def __init__(self, hashes: DataFrame, name: str):
        least, most = BITMAP_BITS
        self.n_bits = min(max((16 * hashes.count()).bit_length(), least), most)
        top = (1 << self.n_bits) - 1
        places = [F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit(top)) for shift in SHIFTS]
        each = hashes.select(F.explode(F.array(*places)).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
        words = each.select(F.shiftrightunsigned("at", 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.bits = np.zeros(1 << (self.n_bits - 6), dtype=np.uint64)
        self.bits[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)

    def _hit(self, hashes: np.ndarray, shift: int) -> np.ndarray:
        place = (hashes >> np.uint64(shift)) & np.uint64((1 << self.n_bits) - 1)
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = self._hit(hashes, SHIFTS[0])
        out[out] = self._hit(hashes[out], SHIFTS[1])
        return out


def _longer(run: np.ndarray) -> np.ndarray:
    """For each symbol the hash of the run that ends there, from those of the runs a symbol shorter; void where the text has no such run."""
    return np.concatenate((run[:1], mix(run[:-1], run[1:])))


def _pack(codes: np.ndarray, counts: np.ndarray, others: np.ndarray) -> tuple[int, bytes]:
    """Size and compressed bytes of distinct runs: codes a column a symbol, counts, and the hashes of the symbols without code."""
    ints = np.ascontiguousarray(np.vstack([codes.T, counts[None]]), dtype="<i4")
    ints[0, 1:] -= ints[0, :-1].copy()  # in order, so differences are small
    planes = ints.view(np.uint8).reshape(len(ints), len(counts), 4).transpose(0, 2, 1)
    raw = planes.tobytes() + others.tobytes()
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(n: int, size: int, blob: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_pack`` was given."""
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    edge = 4 * n * (depth + 2)
    ints = raw[:edge].reshape(depth + 2, 4, n).transpose(0, 2, 1).copy().view("<i4")[:, :, 0]
    ints[0] = np.cumsum(ints[0])
    return ints[:-1].T, ints[-1], np.frombuffer(raw[edge:].tobytes(), dtype=np.uint64)


def _added_up(context: np.ndarray, lower: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of different runs, and their counts (None: each once)."""
    order = np.lexsort((lower, context))
    c, lo = context[order], lower[order]
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (lo[1:] != lo[:-1])))) if len(c) else np.zeros(0, dtype=np.int64)
    total = np.diff(np.append(first, len(c))) if counts is None else np.add.reduceat(counts[order], first) if len(c) else counts[:0]
    return order[first], total


def _count_runs(batches, depth: int, gates, coded, buckets: int, rounds: int = 1, now: int = 0):
    """Counts of the runs that the depth needs, of contexts that belong to a round, packed by buckets of the runs' hashes.

    As entries: the context is a candidate, and the lower run an entry of a state.
    As contexts of the next depth: the lower run may become a state.
    """
    often, lowers, states = gates.value
    held: list = []
    n = 0

    def flush():
        context, lower, codes, symbols = (np.concatenate(x) for x in zip(*held, strict=True))
        at, counts = _added_up(context, lower, None)
        bucket, codes, symbols = (mix(context[at], lower[at]) >> np.uint64(24)) % np.uint64(buckets), codes[at], symbols[at]
        order = np.argsort((bucket << np.uint64(32)) | codes[:, 0].astype(np.uint64))
        bucket, codes, symbols, counts = bucket[order].astype(np.int32), codes[order], symbols[order], counts[order]
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        made = [_pack(codes[a:b], counts[a:b], symbols[a:b][codes[a:b] == 0]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        arrays = [pa.array(bucket[edges[:-1]]), pa.array(np.diff(edges).astype(np.int32)), pa.array([x for x, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "runs", "size", "packed"])

    hashes = coded.value[2]
    for batch in _symbol_slices(batches, 0):
        symbols, places, rank = _decode(batch.columns[:4], batch.column(4), hashes)
        inner, run = symbols, symbols
        for _ in range(depth - 1):
            inner, run = run, _longer(run)
        ends = places >= depth
        if rounds > 1:
            ends[1:] &= (run[:-1] >> np.uint64(32)).astype(np.uint32) % np.uint32(rounds) == now
        at = np.flatnonzero(ends)
        context, lower = run[at - 1], run[at]
        ok = often.has(context) & lowers.has(lower)
        if states is not None:
            ok |= often.has(lower) & states.has(inner[at])
        at, context, lower = at[ok], context[ok], lower[ok]
        own = at[:, None] + np.arange(-depth, 1)
        held.append((context, lower, rank[own].astype(np.int32) + 1, symbols[own]))
        n += len(at)
        if n > FLUSH:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _sum_runs(batches, depth: int, coded, min_next: int):
    """(c, lo, n) of the runs in some buckets that occur ``min_next`` times."""
    hashes, held, n = coded.value[2], [], 0

    def summed():
        context, lower, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        at, counts = _added_up(context, lower, counts)
        return context[at], lower[at], counts

    for batch in batches:
        for runs, size, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            codes, counts, others = _unpack(runs, size, blob, depth)
            symbols, sent = np.empty(codes.shape, dtype=np.uint64), codes > 0
            symbols[sent], symbols[~sent] = hashes[codes[sent] - 1], others
            row = list(symbols.T)
            while len(row) > 2:
                row = [mix(a, b) for a, b in zip(row[:-1], row[1:], strict=True)]
            held.append((row[0], row[1], counts.astype(np.int64)))
            n += runs
            if n > FLUSH:
                held = [summed()]
                n = 0
    if held:
        context, lower, counts = summed()
        often = counts >= min_next
        arrays = [pa.array(context[often].view(np.int64)), pa.array(lower[often].view(np.int64)), pa.array(counts[often])]
        yield pa.RecordBatch.from_arrays(arrays, ["c", "lo", "n"])


def _hash_batches(batches):
    """Adds h to rows that begin with c and lo."""
    for batch in batches:
        c, lo = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix(c, lo).view(np.int64))], [*batch.schema.names, "h"])


def _sorted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table of (hash, value), by hash."""
    got = df.toArrow()
    h, v = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], v[order]


def _find(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(hashes), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


class Words:
    """The root's table of words, and what of it is sent out: the hashes of frequent words, and their ranks."""

    def __init__(self, table: DataFrame, heavy_share: float):
        tokens, types = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.table, self.tokens, self.types = table, int(tokens), int(types)
        self.unseen = float(self.tokens + self.types + 1)
        self.least = max(heavy_share * self.tokens, 1)
        known, counts = _sorted(table.filter(F.col("n") >= self.least).select("h", "n"))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.root = np.log10((counts[order] + 1) / (self.tokens + self.types + 1))
        self.coded = table.sparkSession.sparkContext.broadcast((known, rank, known[order]))


class SuffixTreeModel:
    """The words, the table of what contexts and entries add, and what is sent out of both."""

    def __init__(self, words: Words, values: DataFrame, depth: int):
        self.words, self.values, self.depth = words, values, depth
        keys, added = _sorted(values.filter(F.col("n") >= words.least).select("h", "v"))
        rest = Bitmap(values.filter(F.col("n") < words.least), "h")
        self.sent = {"root": words.root, "keys": keys, "values": added, "rest": rest, "depth": depth}


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _entries(counted: DataFrame, below: DataFrame, min_context: int) -> DataFrame:
    """The entries of one depth, from counts (c, lo, n) and the table (h, n, plain, smooth) of the depth before.

    ``plain`` is an entry's relative frequency in its context, ``smooth`` its
    probability by the tree so far; both are null for what is only a context.
    """
    contexts = below.filter(F.col("n") >= min_context).select(F.col("h").alias("c"), F.col("n").alias("nc"))
    lower = below.filter("plain IS NOT NULL").select(F.col("h").alias("lo"), F.col("plain").alias("below"), F.col("smooth").alias("low"))
    entries = counted.join(contexts, "c", "left").join(lower, "lo", "left")
    role = F.col("nc").isNotNull() & F.col("low").isNotNull()
    return entries.select("c", "lo", "n", "nc", "below", "low", F.when(role, F.col("n") / F.col("nc")).alias("p"), F.when(role, (F.col("n") - DISCOUNT) / F.col("nc")).alias("q"))


def _states(entries: DataFrame) -> DataFrame:
    """Which contexts are retained, from the written entries of a depth."""
    left = lambda total: F.greatest(F.lit(1.0) - total, F.lit(TINY))
    sums = entries.filter("p IS NOT NULL").groupBy("c").agg(
        F.max("nc").alias("nc"), F.count("*").alias("k"), F.sum("p").alias("p"), F.sum(F.least("below", F.lit(1.0))).alias("below"),
        F.sum(F.col("p") * F.log(F.col("p") / F.col("below"))).alias("kl"), F.sum("q").alias("q"), F.sum("low").alias("low"),
    )
    kl = F.col("kl") + left(F.col("p")) * F.log(left(F.col("p")) / left(F.col("below")))
    states = sums.filter(2 * F.col("nc") * kl > F.col("k") * F.log("nc") + GAIN)
    return states.select("c", "nc", F.log10(left(F.col("q")) / left(F.col("low"))).alias("backoff"))


def fit(symbols: DataFrame, words: Words, ws: Workspace, min_context: int = MIN_CONTEXT, min_next: int = MIN_NEXT, max_depth: int | None = None) -> SuffixTreeModel:
    """Learn from ``symbols`` (``PLANES``, others); every text counts.  ``max_depth`` None: as deep as states are retained."""
    spark, tokens, types = symbols.sparkSession, words.tokens, words.types
    buckets = min(partitions(spark), BUCKETS)
    end = F.lit(int(np.uint64(xxhash.xxh3_64_intdigest(END)).view(np.int64)))
    plain, smooth = F.col("n") / F.lit(float(max(tokens, 1))), (F.col("n") + 1) / F.lit(float(tokens + types + 1))
    table = words.table.filter(F.col("n") >= min_next).select("h", "n", plain.alias("plain"), smooth.alias("smooth"))
    values, depth, states = [spark.createDataFrame([], "h long, n long, v double")], 0, None
    for d in count(1):
        candidates = table.filter(F.col("n") >= min_context)
        if d == 1:
            candidates = candidates.filter(F.col("h") != end)
        occurrences = candidates.agg(F.sum("n")).first()[0]
        if (max_depth is not None and d > max_depth) or not occurrences:
            break
        # few runs are counted but those whose context is a candidate
        rounds = min(ROUNDS, math.ceil(ROUNDS * occurrences / tokens))
        gates = (Bitmap(candidates, "h"), Bitmap(table.filter("plain IS NOT NULL"), "h"), states and Bitmap(states, "c"))
        gates = spark.sparkContext.broadcast(gates)
        counts = []
        for k in range(rounds):
            found = symbols.mapInArrow(partial(_count_runs, depth=d, gates=gates, coded=words.coded, buckets=buckets, rounds=rounds, now=k), "bucket int, runs int, size int, packed binary")
            found = found.repartitionById(buckets, F.col("bucket"))
            counts.append(ws.save(found.mapInArrow(partial(_sum_runs, depth=d, coded=words.coded, min_next=min_next), "c long, lo long, n long"), f"counts{d}/{k}"))
        gates.destroy()
        entries = _entries(_union(counts), table, min_context)
        entries = ws.save(entries.mapInArrow(_hash_batches, "c long, lo long, n long, nc long, below double, low double, p double, q double, h long"), f"entries{d}")
        states = ws.save(_states(entries), f"states{d}")
        ws.drop(f"counts{d}")
        if not states.limit(1).count():
            ws.drop(f"entries{d}")
            break
        depth = d
        joined = entries.join(states.select("c", "backoff"), "c", "left").withColumn("own", F.col("backoff").isNotNull() & F.col("q").isNotNull())
        mine = lambda value, name: F.when(F.col("own"), value).alias(name)
        table = joined.select("h", "n", mine(F.col("p"), "plain"), mine(F.col("q"), "smooth"), mine(F.log10("q") - F.col("backoff") - F.log10("low"), "v"))
        table = ws.save(table, f"table{d}")
        ws.drop(f"entries{d}")
        key = F.col("c").bitwiseXOR(F.lit(int(CONTEXT)))
        values += [states.select(key.alias("h"), F.col("nc").alias("n"), F.col("backoff").alias("v")), table.filter("v IS NOT NULL").select("h", "n", "v")]
    return SuffixTreeModel(words, _union(values), depth)


def _look_up(m: dict, ends: np.ndarray, hashes: np.ndarray, added: np.ndarray, rare: list) -> np.ndarray:
    """Which hashes the tree has or may have; adds the value of those at hand, and puts down the others that it may have."""
    at = _find(m["keys"], hashes)
    sent = at >= 0
    if len(m["keys"]):
        added[ends] += np.where(sent, m["values"][np.maximum(at, 0)], 0.0)
    other = np.flatnonzero(~sent)
    other = other[m["rest"].has(hashes[other])]
    rare.append((ends[other], hashes[other]))
    sent[other] = True
    return sent


def _score(batches, model, coded):
    m, hashes_of = model.value, coded.value[2]
    for batch in _symbol_slices(batches, 1):
        symbols, places, at = _decode(batch.columns[1:5], batch.column(5), hashes_of)
        starts = np.flatnonzero(places == 0)
        known = at >= 0
        base = np.where(known, m["root"][np.maximum(at, 0)] if len(m["root"]) else 0.0, 0.0)
        added = np.zeros(len(symbols))
        rare = [(np.flatnonzero(~known), symbols[~known] ^ np.uint64(WORD))]
        run, ends = symbols, np.arange(len(symbols))
        for depth in range(1, m["depth"] + 1):
            # a context is a state only if its suffix is one, and only states have entries
            ends = ends[places[ends] >= depth]
            ends = ends[_look_up(m, ends, run[ends - 1] ^ np.uint64(CONTEXT), added, rare)]
            run = _longer(run)
            _look_up(m, ends, run[ends], added, rare)
        where, hashes = np.concatenate([x[0] for x in rare]), np.concatenate([x[1] for x in rare])
        text = np.searchsorted(starts, where, side="right") - 1
        order = np.lexsort((hashes, text))
        edges = np.searchsorted(text[order], np.arange(len(starts) + 1))
        tails = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(hashes[order].view(np.int64)))
        sums = lambda x: pa.array(np.add.reduceat(x, starts) if len(starts) else x[:0])
        sizes = np.diff(np.append(starts, len(symbols)))
        arrays = [batch.column(0), pa.array(sizes.astype(np.int64)), sums(known.astype(np.int64)), sums(base), sums(added), tails]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "n_tokens", "n_sent", "base", "added", "tail"])


ROW = "struct<i: long, doc_id: long, held_out: boolean>"


def score(symbols: DataFrame, model: SuffixTreeModel, ws: Workspace) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for rows (row, ``PLANES``, others) of written files."""
    spark = symbols.sparkSession
    shared = spark.sparkContext.broadcast(model.sent)
    kind = f"row {ROW}, n_tokens long, n_sent long, base double, added double, tail array<long>"
    parts = []
    n_parts = max(1, min(PARTS, len(symbols.inputFiles()) // PART_FILES))
    rest = _bucketed(_rest(model), ws, math.ceil(partitions(spark) / n_parts))
    for k in range(n_parts):
        # the number in a file's name tells its part, so that each is read once
        number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
        part = symbols.filter(F.coalesce(number, F.lit(0)) % n_parts == k).select("row", *PLANES, "others")
        made = ws.save(part.mapInArrow(partial(_score, model=shared, coded=model.words.coded), kind), f"scored{k}")
        parts.append(ws.save(_with_rest(made, spark.table(rest), model.words), f"scores{k}"))
        ws.drop(f"scored{k}")
    shared.destroy()
    spark.sql(f"DROP TABLE {rest}")
    ws.drop("rest")
    return _union(parts)


def _rest(model: SuffixTreeModel) -> DataFrame:
    """(h, v, is_word): what contexts and entries that were not sent out add, and words beyond unseen ones, by their keys."""
    words = model.words
    root = words.table.filter(F.col("n") < words.least).select(F.col("h").bitwiseXOR(F.lit(WORD)).alias("h"), F.log10(F.col("n") + 1).alias("v"), F.lit(True).alias("is_word"))
    return root.union(model.values.filter(F.col("n") < words.least).select("h", "v", F.lit(False)))


def _bucketed(df: DataFrame, ws: Workspace, buckets: int) -> str:
    """Name of a table of ``df`` in buckets of h, so that joins on h do not shuffle it."""
    name = f"rest_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, "h").sortWithinPartitions("h").write.option("path", ws.path("rest")).option("compression", "zstd")
    writer.bucketBy(buckets, "h").sortBy("h").saveAsTable(name)
    return name


def _with_rest(made: DataFrame, rest: DataFrame, words: Words) -> DataFrame:
    """Scores, after what was not sent out has met its table."""
    tails = made.select(F.col("row.i").alias("i"), F.explode("tail").alias("h"))
    met = tails.join(rest.hint("merge"), "h").groupBy("i").agg(
        F.sum(F.when(F.col("is_word"), F.col("v"))).alias("rare"),
        F.count_if("is_word").alias("met"),
        F.sum(F.when(~F.col("is_word"), F.col("v"))).alias("more"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = F.col("base") + (F.col("n_tokens") - F.col("n_sent")) * F.lit(math.log10(1 / words.unseen))
    return made.select("row.*", "n_tokens", "n_sent", base.alias("base"), "added").join(met, "i", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_sent") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare")).alias("base_score"),
        (F.col("base") + zero("rare") + F.col("added") + zero("more")).alias("score"),
    )


def lm_scores(docs: DataFrame, min_context: int = MIN_CONTEXT, min_next: int = MIN_NEXT, heavy_share: float = HEAVY_SHARE, max_depth: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row, from a tree learned on rows whose crc32(doc_id as text) mod 7 is not 2.

    A null or empty text is its end symbol alone.  A row with a null doc_id is a
    training row.  Repeated rows count as often as they occur and each gets its
    score.  With no training row nothing is known: N = V = 0.  Other columns of
    ``docs`` are ignored.
    """
    if min_context < min_next or min_next < 1:
        raise ValueError("min_context must be at least min_next, and that at least 1")
    ws = Workspace(docs.sparkSession, "suffix_lm")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    row = F.struct(F.monotonically_increasing_id().alias("i"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"))
    texts = docs.select(row.alias("row"), text_bytes(text_col).alias("t"))
    with _tidy(docs.sparkSession):
        counted = texts.filter("NOT row.held_out").select("t").mapInArrow(_count_symbols, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        words = Words(ws.save(counted, "words"), heavy_share)
        symbols = ws.save(texts.mapInArrow(partial(_encode, coded=words.coded), f"row {ROW}, {', '.join(f'{b} binary' for b in PLANES)}, others array<long>"), "symbols")
        model = fit(symbols.filter("NOT row.held_out").select(*PLANES, "others"), words, ws, min_context, min_next, max_depth)
        scores = score(symbols, model, ws)
        words.coded.destroy()
        ws.drop("symbols", "words", *(f"{name}{d}" for d in range(1, model.depth + 2) for name in ("table", "states")))
    return scores
