"""Exact substring deduplication over a log-structured fingerprint index.

Windows are runs of ``window`` consecutive words.  Storing a hash for each would
take more room than the text, so the index holds one fingerprint for each
*anchor*: the smallest of a window's ``gram``-word hashes (first on ties).
Equal windows have equal anchors, at equal distance, so a window whose anchor
hash is found at one place only has no twin.

The index is a set of immutable runs, each a table bucketed and sorted by hash
with the number of places, named by a manifest in shared storage; it outlives the
call and the session.  A new batch is written as a run, merge-joined with the
historical runs (no shuffle: all have the same buckets), and runs are compacted
into one when there are more than ``fanout``.  Beside the runs lie the anchors of
each batch.  What the join finds is verified in two steps: first the whole region
of words that one anchor stands for, then, where regions of an anchor differ,
every window of one region of each kind.  Both compare 128-bit hashes of the words.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcohort.llm.common import Workspace, partitions, shared_dir, text_bytes, text_key, text_slices

POSITION_BITS = 28
ANCHORS = "k long, d long, h long, r1 long, r2 long, s int, e int"


def anchors_of(words: list[bytes], window: int, gram: int):
    """(hash, both halves of the region's hash, first window start, last window start) of each anchor of a text."""
    n = len(words)
    if n < window:
        return []
    digest = xxhash.xxh3_64_intdigest
    wh = np.array([digest(w) for w in words], dtype=np.uint64)
    g = wh[: n - gram + 1].copy()
    for j in range(1, gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + wh[j : n - gram + 1 + j]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    low = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if rest := span - width:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & mask).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    raw = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = ends[first] - np.fromiter((len(words[i]) for i in first.tolist()), dtype=np.int64, count=len(first)) - 1
    digest = xxhash.xxh3_128_digest
    regions = b"".join(digest(raw[s:e]) for s, e in zip(starts.tolist(), (ends[last + window - 1] - 1).tolist(), strict=True))
    regions = np.frombuffer(regions, dtype=">i8").astype(np.int64).reshape(-1, 2)
    return g[at[first]].view(np.int64), regions[:, 0], regions[:, 1], first, last


def _anchor_batches(batches, window: int, gram: int):
    kinds = (pa.int64(),) * 5 + (pa.int32(), pa.int32())
    for batch in batches:
        for part in text_slices(batch, 2):
            keys, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cols: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(part.column(2).to_pylist()):
                found = anchors_of(text.split(), window, gram)
                if len(found):
                    for c, v in zip(cols, (keys[i], ids[i]), strict=False):
                        c.append(np.full(len(found[0]), v))
                    for c, v in zip(cols[2:], found, strict=True):
                        c.append(v)
            if cols[0]:
                arrays = [pa.array(np.concatenate(c), type=t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "d", "h", "r1", "r2", "s", "e"])


def _window_batches(batches, window: int):
    for part in (x for batch in batches for x in text_slices(batch, 2)):
        out: list[list] = [[] for _ in range(6)]
        for k, d, text, spans in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            words = text.split()
            for span in spans:
                for p in range(span["s"], span["e"] + 1):
                    v = xxhash.xxh3_128_intdigest(b" ".join(words[p : p + window]))
                    for c, x in zip(out, (k, d, p, v >> 64, v & ((1 << 64) - 1), span["n"] == 1), strict=True):
                        c.append(x)
        arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())]
        arrays += [pa.array(np.array(out[i], dtype=np.uint64).view(np.int64)) for i in (3, 4)] + [pa.array(out[5], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, ["k", "d", "p", "w1", "w2", "single"])


def _cut_batches(batches, texts: bool):
    for part in (x for batch in batches for x in text_slices(batch, 1)):
        n, gone, digests, kept_texts = [], [], [], []
        for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            words = text.split()
            n.append(len(words))
            if spans:
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(edge, [x["s"] for x in spans], 1)
                np.add.at(edge, [x["e"] for x in spans], -1)
                keep = np.cumsum(edge[:-1]) == 0
                words = [w for w, x in zip(words, keep.tolist(), strict=True) if x]
            kept = b" ".join(words)
            gone.append(n[-1] - len(words))
            digests.append(hashlib.sha256(kept).hexdigest())
            if texts:
                kept_texts.append(kept.decode(errors="replace"))
        arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            arrays.append(pa.array(kept_texts, pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(arrays, names)


class FingerprintRuns:
    """A log-structured index of fingerprints: immutable sorted runs of (h, n places) below one folder of shared storage.

    Opening a folder that has a manifest goes on with the index that is there.  Each
    change writes new files and then a new manifest, so a reader or a lost job
    sees the index before the change or after it.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = 2):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.prefix = f"run_{uuid.uuid4().hex}"
        state = self._manifest()
        self.buckets, self.made, self.batches = state["buckets"], state["made"], state["batches"]
        self.runs: list[str] = state["runs"]
        for name in self.runs:
            self._open(name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _place(self, name: str):
        at = self.fs.Path(self.path(name))
        return at.getFileSystem(self.conf), at

    def _manifest(self) -> dict:
        fs, at = self._place("manifest")
        names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
        if not names:
            return {"buckets": partitions(self.spark), "made": 0, "batches": 0, "runs": []}
        return json.loads(self.spark.read.text(self.path(f"manifest/{names[-1]}"), wholetext=True).first()[0])

    def _publish(self) -> None:
        state = {"buckets": self.buckets, "made": self.made, "batches": self.batches, "runs": self.runs}
        fs, at = self._place(f"manifest/{self.batches:08d}-{self.made:08d}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _table(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def _open(self, name: str) -> None:
        self.spark.sql(f"CREATE TABLE {self._table(name)} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path(name)}'")

    def _write(self, counts: DataFrame) -> str:
        name = f"run{self.made:06d}"
        self.made += 1
        sorted_rows = counts.repartition(self.buckets, "h").sortWithinPartitions("h")
        writer = sorted_rows.write.option("path", self.path(name)).option("compression", "zstd").mode("overwrite")
        writer.bucketBy(self.buckets, "h").sortBy("h").saveAsTable(self._table(name))
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            fs, at = self._place(name)
            fs.delete(at, True)

    def run(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def add(self, batch: DataFrame) -> DataFrame:
        """(h): fingerprints of the batch (column h) with another place in the batch or in the history; then it is history.

        The batch becomes a sorted run, which is merge-joined with every earlier run.
        """
        earlier = list(self.runs)
        mine = self._write(batch.groupBy("h").agg(F.count("*").alias("n")))
        hits = self.run(mine).filter("n > 1").select("h")
        for name in earlier:
            hits = hits.union(self.run(mine).hint("merge").join(self.run(name), "h", "left_semi").select("h"))
        found = f"hits{self.batches:06d}"
        hits.distinct().write.option("compression", "zstd").mode("overwrite").parquet(self.path(found))
        self.runs.append(mine)
        self.batches += 1
        self._publish()
        if len(self.runs) > self.fanout:
            self.compact()
        return self.spark.read.schema("h long").parquet(self.path(found))

    def compact(self) -> None:
        """Merge all runs into one; a full outer merge-join of sorted runs, bucket by bucket."""
        if len(self.runs) < 2:
            return
        merged = self.run(self.runs[0])
        for name in self.runs[1:]:
            other = self.run(name).withColumnRenamed("n", "m")
            merged = merged.hint("merge").join(other, "h", "full_outer").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        old, new = self.runs, self._write(merged)
        self.runs = [new]
        self._publish()
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        self._drop(*old)

    def close(self) -> None:
        """Leave the session's catalogue as it was; the index stays."""
        for i in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(f'run{i:06d}')}")

    def destroy(self) -> None:
        self.close()
        self._drop("")


class SubstringIndex:
    """Windows of all documents so far: fingerprint runs, and the anchors of each batch."""

    def __init__(self, spark: SparkSession, root: str | None = None, window: int = 35, gram: int = 6, fanout: int = 2):
        self.spark, self.window, self.gram = spark, window, gram
        self.root = root or f"{shared_dir(spark)}/substring-index-{uuid.uuid4().hex}"
        self.runs = FingerprintRuns(spark, self.root, fanout)

    def add(self, rows: DataFrame) -> DataFrame:
        """(h) of the batch's anchors that have another place; ``rows`` has k, d (key and id of a document), t (UTF-8 text)."""
        found = rows.select("k", "d", "t").mapInArrow(partial(_anchor_batches, window=self.window, gram=self.gram), ANCHORS)
        path = self.runs.path(f"anchors/batch={self.runs.batches}")
        found.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.runs.add(self.spark.read.schema(ANCHORS).parquet(path).select("h"))

    def anchors(self) -> DataFrame:
        """Anchors of all batches in the manifest, with their batch."""
        every = self.spark.read.schema(ANCHORS + ", batch int").option("basePath", self.runs.path("anchors")).parquet(self.runs.path("anchors"))
        return every.filter(F.col("batch") < self.runs.batches)

    def spans(self, rows: DataFrame, hits: DataFrame, ws: Workspace) -> DataFrame:
        """(k, d, s, e, batch): word spans [s, e) covered by windows that start more than once, among anchors with a hash in ``hits``.

        ``rows`` has all documents of the index; only those are read in which regions of an anchor differ.
        """
        window = self.window
        # what is joined with is written first: both sides are then shuffled for the join, and a hot hash can be split
        hits = ws.save(hits.distinct(), "hits")
        met = ws.save(self.anchors().join(hits, "h", "left_semi").select("k", "d", "h", "r1", "r2", "s", "e", "batch"), "met")
        kinds = met.groupBy("h", "r1", "r2").agg(F.count("*").alias("n"), F.min(F.struct("k", "d", "s", "e", "batch")).alias("one"))
        kinds = ws.save(kinds, "kinds")
        whole = met.join(kinds.filter("n > 1").select("h", "r1", "r2"), ["h", "r1", "r2"], "left_semi").select("k", "d", "s", (F.col("e") + window).alias("e"), "batch")
        mixed = ws.save(kinds.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h"), "mixed")
        look = kinds.join(mixed, "h", "left_semi").select("one.*", "n").groupBy("k", "d", "batch").agg(F.collect_set(F.struct("s", "e", "n")).alias("spans"))
        look = ws.save(look, "look")
        windows = rows.join(look.drop("batch"), ["k", "d"]).select("k", "d", "t", "spans").mapInArrow(partial(_window_batches, window=window), "k long, d long, p int, w1 long, w2 long, single boolean")
        windows = ws.save(windows, "windows")
        twice = ws.save(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"), "twice")
        part = windows.filter("single").join(twice, ["w1", "w2"], "left_semi").select("k", "d", F.col("p").alias("s"), (F.col("p") + window).alias("e"))
        part = part.join(look.select("k", "d", "batch").distinct(), ["k", "d"])
        return whole.union(part)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("x"))
    return source.select("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")).alias("d"), text_key("doc_id", "x").alias("k"), text_bytes("x").alias("t"))


def _cut(rows: DataFrame, spans: DataFrame, ws: Workspace, texts: bool) -> DataFrame:
    cuts = ws.save(spans.groupBy("k", "d").agg(F.collect_set(F.struct("s", "e")).alias("cuts")), "cuts")
    joined = rows.join(cuts, ["k", "d"], "left").select("doc_id", "t", "cuts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return joined.mapInArrow(partial(_cut_batches, texts=texts), schema)


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 6, batches: int = 3, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row of ``docs``.

    Words are runs of characters other than ASCII white space.  A word goes if
    any window over it has a word sequence that starts anywhere else in the
    table, the same document included; windows are judged on the input.  Null
    and empty texts have no words and the digest of an empty string.  Texts
    shorter than a window lose nothing.  Rows with a null or repeated doc_id are
    kept apart by their text; rows that agree in both are copies of each other,
    each keeps its row and all its windows repeat.  Other columns are ignored.
    Documents enter an index of this call in ``batches`` batches by key.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "substring")
    rows = _rows(docs, id_col, text_col)
    index = SubstringIndex(spark, ws.path("index"), window, gram)
    try:
        hits = None
        for i in range(batches):
            new = index.add(rows.filter(F.pmod("k", F.lit(batches)) == i))
            hits = new if hits is None else hits.union(new)
        spans = index.spans(rows.select("k", "d", "t"), hits, ws)
        out = _cut(rows, spans, ws, texts)
    finally:
        index.runs.destroy()
    ws.drop("met", "kinds", "windows")
    return out


def dedup_batch(batch: DataFrame, index: SubstringIndex, history: DataFrame | None = None, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``substring_dedup`` of a new batch against ``index``, which it then belongs to.

    A word goes if a window over it starts anywhere else in the batch or in the
    history.  ``history`` has all documents added before (None: the index is new);
    only those in which regions of an anchor differ are read.  Nulls, repeats and
    empty texts are as in ``substring_dedup``.
    """
    ws = Workspace(batch.sparkSession, "substring")
    rows, number = _rows(batch, id_col, text_col), index.runs.batches
    hits = index.add(rows)
    every = rows if history is None else rows.unionByName(_rows(history, id_col, text_col))
    # a document that occurs in two batches is read once
    spans = index.spans(every.select("k", "d", "t").dropDuplicates(["k", "d"]), hits, ws)
    return _cut(rows, spans.filter(F.col("batch") == number), ws, texts)
