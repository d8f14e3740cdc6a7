"""SimHash near-duplicate detection over deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Two fingerprints that
differ in at most two bits have a segment that differs in at most one, so they
share one of that segment's 32 one-wildcard variants: equality on variants gives
every candidate, and the full Hamming distance verifies it.

Buckets with more than ``PAIR_LIMIT`` distinct fingerprints would need all pairs.
Their members take an exact linear route instead: each emits itself and its 64
one-bit neighbours; two fingerprints share an emitted value exactly when they
differ in at most two bits, so each value is a star around its smallest member.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcohort.llm.common import Workspace, partitions, text_bytes
from sparkcohort.llm.graph import connected_components

SEGMENTS, SEGMENT_BITS = 2, 32
#: Distinct fingerprints in a bucket up to which its pairs are compared directly.
PAIR_LIMIT = 48


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes (n x words of uint64), as 0/1 bytes, low bit first."""
    total = np.zeros(hashes.shape[1] * 64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return (total * 2 > len(hashes)).astype(np.uint8)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def text_fingerprint(text: bytes, size: int, seed: int) -> int:
    """The unsigned 64-bit fingerprint of a text; zero for a text with no word."""
    digest = xxhash.xxh64_intdigest
    hashes = [digest(s, seed) for s in shingles(text.lower().split(), size)]  # bytes.lower() changes A-Z only
    if not hashes:
        return 0
    bits = majority_bits(np.array(hashes, dtype=np.uint64).reshape(-1, 1))
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches, size: int, seed: int):
    for batch in batches:
        prints = [text_fingerprint(t, size, seed) for t in batch.column(1).to_pylist()]
        signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long): signed 64-bit fingerprints, one row for each input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(partial(_fingerprint_batches, size=size, seed=seed), "doc_id long, fp long")


def shared_variants(rows: DataFrame, segments: list[Column]) -> DataFrame:
    """``rows`` once for each one-wildcard variant of a segment that other rows have too, with place, var and n rows.

    A variant leaves one half of its segment whole.  So only that half is
    shuffled by, with the other half as payload: two rows a segment travel, and
    their variants are made and met where they arrive.
    """
    half, low = SEGMENT_BITS // 2, (1 << SEGMENT_BITS // 2) - 1
    sides = []
    for s, segment in enumerate(segments):
        parts = (segment.bitwiseAND(F.lit(low)), F.shiftrightunsigned(segment, half).bitwiseAND(F.lit(low)))
        for h in (0, 1):
            sides.append(F.struct((F.lit((2 * s + h) << half) + parts[h]).cast("int").alias("place"), parts[1 - h].cast("int").alias("rest")))
    placed = rows.select(*rows.columns, F.explode(F.array(*sides)).alias("x")).select(*rows.columns, "x.*")
    placed = placed.repartition(partitions(rows.sparkSession), "place")
    masked = F.array(*(F.col("rest").bitwiseAND(F.lit(low ^ (1 << i))) + F.lit(i << half) for i in range(half)))
    variants = placed.select(*rows.columns, "place", F.explode(masked).alias("var"))
    return variants.withColumn("n", F.count("*").over(W.partitionBy("place", "var"))).filter("n > 1")


def fingerprint_links(prints: DataFrame, ws: Workspace, max_bits: int = 2) -> DataFrame:
    """(a, b) with a < b: a set of links among distinct fingerprints ``fp`` whose components
    are those of all pairs at ``max_bits`` (0, 1 or 2) or fewer differing bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with one wildcard each serve at most two differing bits here")
    segments = [F.shiftrightunsigned("fp", s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)) for s in range(SEGMENTS)]
    members = ws.save(shared_variants(prints.select("fp"), segments), "members")
    few = members.filter(F.col("n") <= PAIR_LIMIT).groupBy("place", "var").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = few.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= max_bits))).alias("b"))
    crowded = members.filter(F.col("n") > PAIR_LIMIT).select("fp").distinct()
    if max_bits == 2:
        near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    elif max_bits == 1:
        near = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i)))) for i in range(64)))
        near = F.transform(near, lambda v, i: F.xxhash64(v, i))
    else:
        near = F.array(F.col("fp"))
    values = crowded.select("fp", F.explode(near).alias("value"))
    low = values.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = values.join(low, "value").filter("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def simhash_components(docs: DataFrame, size: int = 3, seed: int = 42, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is
    the smallest doc_id that links reach, the row's own included.  A null or
    wordless text has fingerprint zero, linked like any other.  Rows with a null
    doc_id keep their row and fingerprint and take part in links, but never give
    the component its id (a component of null ids alone has a null id).
    Repeated rows stay repeated; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "simhash")
    prints = ws.save(fingerprints(docs, size, seed, id_col, text_col), "prints")
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = ws.save(connected_components(fingerprint_links(per_print.select("fp"), ws, max_bits), ws), "roots")
    ws.drop("members")
    grouped = per_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    names = ws.save(grouped.join(lows, "root").select("fp", "component_id"), "names")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
