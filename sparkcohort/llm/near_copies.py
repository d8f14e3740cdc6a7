"""Near-copies by SimHash candidates, a prefix filter and exact Jaccard verification.

Three searches give candidates, each only for pairs that earlier ones left in
different groups; links are verified by the exact similarity of the sets of
shingles, and components of verified links are the groups.

1. Fingerprints have ``SEGMENTS`` segments of 32 bits over the different words of
   a text; texts that differ in at most one bit of any segment share one of its
   one-wildcard variants.  A variant's texts meet its smallest and largest member.
2. With shingles in one global order, sets of similarity t share an element of
   their first n - ceil(t n) + 1.  A shared element's texts meet the one of them
   that meets most others, so an original gathers its variants at once.
3. What is still in different groups at a shared element is paired throughout;
   pairs with too few shared elements for the similarity need no comparison.

The last step makes the groups exact; the first two only keep it small.  Any
global order will do: shingles that are common in a sample come last.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcohort.llm.common import Workspace, sized, text_bytes, text_key
from sparkcohort.llm.graph import connected_components
from sparkcohort.llm.simhash import majority_bits, shared_variants, shingles

SEGMENTS = 6
#: One text in so many is sampled for the order of shingles, and so many of its common shingles are kept.
ORDER_EVERY, ORDER_SHINGLES = 32, 200_000


def _print_batches(batches):
    for batch in batches:
        nodes, prints = [], []
        for text in batch.column(2).to_pylist():
            words = text.lower().split()
            nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            hashes = []
            for w in set(words):
                a = xxhash.xxh3_128_intdigest(w)
                hashes.append((a & (1 << 64) - 1, a >> 64, xxhash.xxh3_64_intdigest(w, 5)))
            if not hashes:
                prints.append([])
                continue
            bits = majority_bits(np.array(hashes, dtype=np.uint64))
            prints.append(np.packbits(bits, bitorder="little").view("<u4").astype(np.int64).tolist())
        node = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(prints, pa.list_(pa.int64()))], ["d", "k", "node", "fp"])


def _shingle_set(words: list[bytes], size: int) -> np.ndarray:
    return np.array(sorted({xxhash.xxh3_64_intdigest(s) for s in shingles(words, size)}), dtype="<u8")


def _all_batches(batches, size: int):
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if words := text.lower().split():
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(words, size).view(np.int64))], ["tok"])


def _prefix_batches(batches, size: int, similarity: float, common):
    """The first n - ceil(similarity n) + 1 shingles of every text with a word, in the global order."""
    known, counts = common.value
    for batch in batches:
        nodes, sizes, firsts = [], [], []
        for text in batch.column(0).to_pylist():
            words = text.lower().split()
            if not words:
                continue
            found = _shingle_set(words, size).view(np.int64)
            rank = np.zeros(len(found), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                rank = np.where(known[at] == found, counts[at], 0)
            take = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
            nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            sizes.append(len(found))
            firsts.append(found[np.lexsort((found, rank))[:take]])
        node = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([node, pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], ["node", "n", "toks"])


def _set_batches(batches, size: int):
    for batch in batches:
        nodes, sets = [], []
        for text in batch.column(0).to_pylist():
            words = text.lower().split()
            nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            sets.append(_shingle_set(words, size).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sets, pa.binary())], ["node", "s"])


def _verify_batches(batches, similarity: float):
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(both >= similarity * (len(a) + len(b) - both) - 1e-12)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _verified(pairs: DataFrame, name: str, rows: DataFrame, prints: DataFrame, ws: Workspace, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.coalesce("d", F.lit(-1).cast("long")).alias("d"), "k")).alias("one"))
    first = ws.save(first.select(F.col("one.d").alias("d"), F.col("one.k").alias("k")), f"wanted_{name}")
    texts = rows.withColumn("d", F.coalesce("d", F.lit(-1).cast("long"))).join(sized(first), ["d", "k"], "left_semi")
    sets = ws.save(texts.select("t").mapInArrow(partial(_set_batches, size=size), "node long, s binary").dropDuplicates(["node"]), f"sets_{name}")
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return ws.save(both.mapInArrow(partial(_verify_batches, similarity=similarity), "a long, b long"), f"links_{name}")


def _met(rows: DataFrame, ws: Workspace, size: int, similarity: float) -> DataFrame:
    """(tok, node, n, at): the prefix elements that different nodes share, with the set's size and the place in its order."""
    spark = rows.sparkSession
    sample = rows.filter(F.pmod(F.xxhash64("k"), F.lit(ORDER_EVERY)) == 0).select("t").mapInArrow(partial(_all_batches, size=size), "tok long")
    common = sample.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1").orderBy(F.desc("c"), "tok").limit(ORDER_SHINGLES).toArrow()
    known, counts = (common[c].to_numpy() for c in ("tok", "c"))
    by = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[by], counts[by]))
    firsts = rows.select("t").mapInArrow(partial(_prefix_batches, size=size, similarity=similarity, common=shared), "node long, n int, toks array<long>")
    each = firsts.select("node", "n", F.posexplode("toks").alias("at", "tok"))
    here = W.partitionBy("tok")
    each = each.withColumns({"low": F.min("node").over(here), "high": F.max("node").over(here)}).filter("low != high")
    return ws.save(each.select("tok", "node", "n", "at").distinct(), "met")


def _apart(met: DataFrame, links: DataFrame, name: str, ws: Workspace) -> DataFrame:
    """``met`` with the group so far as ``root``, without elements all of whose nodes are in one group."""
    groups = ws.save(connected_components(links, ws), f"groups_{name}")
    out = met.join(sized(groups), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = out.groupBy("tok").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("tok")
    return ws.save(out.join(mixed, "tok", "left_semi").select("tok", "node", "n", "at", "root"), f"apart_{name}")


def _possible(similarity: float):
    """Whether sizes, and places of the shared element, leave room for the similarity."""
    a, b = F.col("a.n"), F.col("b.n")
    most = F.least(F.col("a.at"), F.col("b.at")) + F.least(a - F.col("a.at"), b - F.col("b.at"))
    return (F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9) & (most >= similarity / (1 + similarity) * (a + b) - 1e-9)


def _candidates(left: DataFrame, right: DataFrame, similarity: float, apart) -> DataFrame:
    """Pairs (a, b) that share enough prefix elements: what one set has after its prefix is all else they can share."""
    met = left.alias("a").join(right.alias("b"), F.col("a.tok") == F.col("b.tok")).filter(apart & _possible(similarity))
    met = met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"), F.least("a.n", "b.n").alias("few"), F.greatest("a.n", "b.n").alias("many"))
    met = met.groupBy("a", "b", "few", "many").agg(F.count("*").alias("c"))
    after = F.ceil(similarity * F.col("many") - 1e-9) - 1
    return met.filter(F.col("c") + after >= similarity / (1 + similarity) * (F.col("few") + F.col("many")) - 1e-9).select("a", "b")


def near_copy_groups(docs: DataFrame, ws: Workspace, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: prints (d, k, node, fp) of every row, and groups (node, root) of nodes with a near-copy.

    A node is a sequence of lower-cased words; texts that agree in it are one.
    Texts without a word are one node and near no other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), text_key(id_col, text_col).alias("k"), text_bytes(text_col).alias("t"))
    prints = ws.save(rows.mapInArrow(_print_batches, "d long, k long, node long, fp array<long>"), "prints")
    verified = partial(_verified, rows=rows, prints=prints, ws=ws, size=size, similarity=similarity)
    nodes = prints.filter(F.size("fp") > 0).dropDuplicates(["node"])
    segments = [F.get("fp", F.lit(s)) for s in range(SEGMENTS)]
    here = W.partitionBy("place", "var")
    met = shared_variants(nodes.select("node", "fp"), segments).withColumns({"low": F.min("node").over(here), "high": F.max("node").over(here)})
    stars = met.select("node", F.explode(F.array("low", "high")).alias("end")).filter("node != end")
    tried = ws.save(stars.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct(), "pairs")
    links = verified(tried, "prints")
    met = _met(rows, ws, size, similarity)
    # each element's nodes meet the one with most shared elements
    apart = _apart(met, links, "hubs", ws)
    degree = ws.save(apart.groupBy("node").agg(F.count("*").alias("m")), "degree")
    hubs = apart.join(sized(degree), "node").groupBy("tok").agg(F.max(F.struct("m", "node", "n", "at", "root")).alias("hub")).select("tok", "hub.*")
    pairs = _candidates(apart, hubs, similarity, F.col("a.root") != F.col("b.root"))
    pairs = ws.save(pairs.join(tried, ["a", "b"], "left_anti"), "hub_pairs")
    links, tried = links.union(verified(pairs, "hubs")), tried.union(pairs)
    # the rest pairwise, across groups only
    apart = _apart(met, links, "rest", ws)
    pairs = _candidates(apart, apart, similarity, F.col("a.root") < F.col("b.root"))
    pairs = ws.save(pairs.join(tried, ["a", "b"], "left_anti"), "rest_pairs")
    links = links.union(verified(pairs, "rest"))
    return prints, ws.save(connected_components(links, ws), "groups")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-copies: the smallest doc_id (null last), then text key.

    Texts near each other have a Jaccard similarity of ``similarity`` or more over
    ``size``-word shingles of lower-cased words (shorter texts are one shingle);
    groups are what links join.  Of rows that agree in doc_id and text one stays.
    """
    ws = Workspace(docs.sparkSession, "near_copies")
    prints, groups = near_copy_groups(docs, ws, size, similarity, id_col, text_col)
    last = F.lit((1 << 63) - 1)
    named = prints.join(groups, "node", "left").select(F.coalesce("d", last).alias("d"), "k", F.coalesce("root", "node").alias("root"))
    named = ws.save(named, "named")
    firsts = named.groupBy("root").agg(F.min(F.struct("d", "k")).alias("one"), F.count("*").alias("n")).filter("n > 1").select("root", "one")
    gone = named.join(ws.save(firsts, "firsts"), "root").filter(F.struct("d", "k") != F.col("one")).select("d", "k").distinct()
    gone = ws.save(gone.withColumnRenamed("d", "__d").withColumnRenamed("k", "__k"), "gone")
    rows = docs.withColumn("__d", F.coalesce(F.col(id_col).cast("long"), last)).withColumn("__k", text_key(id_col, text_col))
    out = rows.join(sized(gone), ["__d", "__k"], "left_anti")
    if named.groupBy("d", "k").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["__d", "__k"])
    return out.select(*docs.columns)
