"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of lower-cased words.  A passage of a document matches an
item of L words if it is at most ``floor(max_share * L)`` word edits away.

Item-sized windows of documents and the items are embedded by several CGK random
walks (a step writes the current word and moves on or stays by a hash of step
and word), which turn edit distance into Hamming distance.  Each walk gives several
keys, the words at a few sampled places; a window meets every item that has one of
its keys (an equality join with the sorted keys of all items), and a bit-parallel
search then verifies the edit distance exactly in the window with k words to
either side.

Which windows are looked at: a match leaves a run of at least (L - k) / (k + 1)
words untouched, so a window starts where a run that some item has would put its
start.  That says where to look and skips no match; which item it is, the keys find.

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES``, tens of
thousands of items; one pass over the documents serves a block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.llm.common import text_slices


WORD = re.compile(r"\w+")
WALKS, SAMPLES, PLACES = 12, 10, 3
#: Bytes of runs and keys that are sent out at once, and what an item has of them for its keys and for each character.
BLOCK_BYTES, ITEM_BYTES, CHAR_BYTES = 64 << 20, 24 * WALKS * SAMPLES, 8
MIN_WORDS = 5
BLOOM_BITS = 22


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashes_of(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    g = h[: len(h) - size + 1].copy()
    for j in range(1, size):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j]
    g ^= g >> np.uint64(31)
    return g * np.uint64(0xD6E8FEB86659FD93)


def allowed(n: int, max_share: float) -> int:
    return int(n * max_share + 1e-9)


def run_size(n: int, k: int) -> int:
    """Words in a row that k edits must leave alone in n, 3 at most."""
    return max(1, min(3, (n - k) // (k + 1)))


def _mixed(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1024)
def _places(size: int) -> np.ndarray:
    """Sampled places of an embedding of a window of ``size`` words: walks x samples x places."""
    return (_mixed(WALKS * SAMPLES * PLACES, 7) % np.uint64(2 * size)).astype(np.int64).reshape(WALKS, SAMPLES, PLACES)


def embed(windows: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """CGK: rows of word hashes, zero from ``sizes`` on, to the first 2 max(sizes) words of their walks (step x row).

    A step writes the word under the pointer and then moves on or stays, by a
    hash of step and word; past the end a filler is written.
    """
    n, width = windows.shape
    steps = 2 * int(sizes.max())
    salts, bits = _mixed(steps, 100 + walk) | np.uint64(1), _mixed(steps, 200 + walk) % np.uint64(64)
    flat, base, at = windows.ravel(), np.arange(n) * width, np.zeros(n, dtype=np.int64)
    out = np.empty((steps, n), dtype=np.uint64)
    for j in range(steps):
        symbol = flat.take(base + at)
        out[j] = symbol
        at += ((symbol * salts[j] >> bits[j]) & np.uint64(1)).astype(np.int64)
        np.minimum(at, sizes, out=at)
    return out


def signatures(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One key for each walk and sample: n x (WALKS * SAMPLES); walk, sample and size are part of a key."""
    n = len(windows)
    kind = _mixed(WALKS * SAMPLES, 9).reshape(1, WALKS, SAMPLES) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, 1, 1)
    kinds, which = np.unique(sizes, return_inverse=True)
    places = np.stack([_places(int(k)) for k in kinds])[which]
    rows = np.arange(n)[:, None, None]
    keys = np.empty((n, WALKS, SAMPLES), dtype=np.uint64)
    for walk in range(WALKS):
        taken = embed(windows, sizes, walk)[places[:, walk], rows]
        key = np.zeros((n, SAMPLES), dtype=np.uint64)
        for i in range(PLACES):
            key = (key ^ taken[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, walk] = key
    return (keys ^ kind).reshape(n, -1)


def padded(windows: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(windows), max(sizes) + 1), dtype=np.uint64)
    for row, w in zip(out, windows, strict=True):
        row[: len(w)] = w
    return out, np.array(sizes, dtype=np.int64)


def best_match(item: list, text: list) -> tuple[int, int]:
    """(edits, end) of the passage of ``text`` nearest to ``item``, the first such end; Myers' bit-parallel search."""
    m = len(item)
    masks: dict = defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp, hn = minus | ~(d | plus) & full, plus & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus = hn | ~(d | hp) & full
        minus = hp & d
        if score < best:
            best, end = score, j + 1
    return best, end


def _reach(item: list, text: list) -> int:
    """Length of the beginning of ``text`` that is nearest to ``item``, the shortest on ties."""
    last = list(range(len(item) + 1))
    best, length = last[-1], 0
    for j, w in enumerate(text, 1):
        row = [j]
        for i, x in enumerate(item, 1):
            row.append(min(last[i - 1] + (x != w), last[i] + 1, row[i - 1] + 1))
        if row[-1] < best:
            best, length = row[-1], j
        last = row
    return length


class Items:
    """A block of benchmark items: words, the windows their runs place, and their sorted keys."""

    def __init__(self, rows: list[tuple], max_share: float, min_words: int = MIN_WORDS):
        self.items, self.whole = [], defaultdict(list)
        runs = defaultdict(list)
        hashes = []
        for item_id, text in rows:
            words = words_of(text)
            if len(words) < max(1, min_words):
                if words:
                    self.whole[tuple(words)].append(item_id)
                continue
            h = hashes_of(words)
            k = allowed(len(words), max_share)
            q = run_size(len(words), k)
            g = _grams(h, q)
            runs[q].append((g, (np.arange(len(g), dtype=np.int64) << 32) + len(words)))
            self.items.append((item_id, words, k))
            hashes.append(h)
        self.runs, self.bloom = {}, {}
        for q, found in runs.items():
            g, codes = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((codes, g))
            g, codes = g[order], codes[order]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (codes[1:] != codes[:-1])))
            g, codes = g[new], codes[new]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            self.runs[q] = (g[first], np.concatenate((first, [len(g)])), codes)
            bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
            bits[g >> np.uint64(64 - BLOOM_BITS)] = True
            self.bloom[q] = bits
        keys, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
        for at in range(0, len(hashes), 1024):
            part = hashes[at : at + 1024]
            own = signatures(*padded(part, [len(h) for h in part]))
            keys.append(own.ravel())
            owners.append(np.repeat(np.arange(at, at + len(part), dtype=np.int32), own.shape[1]))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def windows(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(start, size) of the windows of a text that runs place, moved to lie inside the text where they can."""
        found = set()
        for q, (keys, edges, codes) in self.runs.items():
            if len(h) < q:
                continue
            g = _grams(h, q)
            places = np.flatnonzero(self.bloom[q][g >> np.uint64(64 - BLOOM_BITS)])
            at = np.minimum(np.searchsorted(keys, g[places]), len(keys) - 1)
            hit = keys[at] == g[places]
            for p, i in zip(places[hit].tolist(), at[hit].tolist(), strict=True):
                for code in codes[edges[i] : edges[i + 1]].tolist():
                    size = code & 0xFFFFFFFF
                    found.add((max(0, min(p - (code >> 32), len(h) - size)), size))
        return found

    def meet(self, keys: np.ndarray):
        """(row, item) of every row of keys that has a key of an item."""
        flat = keys.ravel()
        low, high = np.searchsorted(self.keys, flat, "left"), np.searchsorted(self.keys, flat, "right")
        met = np.flatnonzero(high > low)
        return {(j // keys.shape[1], int(i)) for j, a, b in zip(met.tolist(), low[met].tolist(), high[met].tolist(), strict=True) for i in self.owners[a:b]}

    def matches(self, texts: list[str]):
        """For each text a list of (item_id, edits, start word, end word), the best passage of each item."""
        words, found = [], []
        out: list[list] = [[] for _ in texts]
        for i, text in enumerate(texts):
            w = words_of(text)
            words.append(w)
            if len(w) and self.items:
                h = hashes_of(w)
                found += [(i, lo, h[lo : lo + size], size) for lo, size in self.windows(h)]
            if self.whole and len(w) < 64:
                out[i] += [(item_id, 0, 0, len(w)) for item_id in self.whole.get(tuple(w), ())]
        pairs = defaultdict(set)
        found.sort(key=lambda x: x[3])  # windows of a size share their sampled places
        for at in range(0, len(found), 4096):
            part = found[at : at + 4096]
            for j, item in self.meet(signatures(*padded([x[2] for x in part], [x[3] for x in part]))):
                pairs[part[j][0], item].add(part[j][1])
        for (i, item), starts in sorted(pairs.items()):
            item_id, target, k = self.items[item]
            best = None
            for lo in sorted(starts):
                a, b = max(0, lo - k), lo + len(target) + k
                edits, end = best_match(target, words[i][a:b])
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, a + end - _reach(target[::-1], words[i][a : a + end][::-1]), a + end)
            if best:
                out[i].append((item_id, *best))
        return out


def _found_batches(batches, block, column: str):
    for batch in batches:
        out = []
        for part in text_slices(batch, batch.schema.get_field_index(column)):
            ids = part.column("doc_id").to_pylist()
            for doc_id, found in zip(ids, block.value.matches(part.column(column).to_pylist()), strict=True):
                out += [(doc_id, *x) for x in found]
        if out:
            names = ["doc_id", "item_id", "edits", "start_word", "end_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)


def _clean_batches(batches, block, column: str):
    for batch in batches:
        for part in text_slices(batch, batch.schema.get_field_index(column)):
            found = block.value.matches(part.column(column).to_pylist())
            yield part.filter(pa.array([not x for x in found]))


def _blocks(items: DataFrame, max_share: float, min_words: int, item_col: str, text_col: str):
    """The benchmark in broadcast blocks of bounded size."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropna(subset=["text"]).distinct()
    size = rows.agg(F.sum(F.length("text") * CHAR_BYTES + ITEM_BYTES)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield items.sparkSession.sparkContext.broadcast(Items(sorted(((r[0], r[1]) for r in got), key=str), max_share, min_words))


def contaminated(docs: DataFrame, items: DataFrame, max_share: float = 0.2, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start_word, end_word): each document and item with a matching passage, at its best.

    Words are counted from 0; the end is exclusive.  Null and wordless texts and
    items match nothing.  An item of fewer than ``min_words`` words, which nearly any
    text has, matches only a document that has nothing else.  Null and repeated
    doc_ids keep a row for each row that matches; very long texts are searched
    whole.  Equal item rows are one item.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    schema = "doc_id long, item_id long, edits long, start_word long, end_word long"
    out = None
    for block in _blocks(items, max_share, min_words, item_col, item_text):
        found = rows.mapInArrow(partial(_found_batches, block=block, column="t"), schema)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, max_share: float = 0.2, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item has a matching passage, whole and with all columns.

    Matches are those of ``contaminated``: rows with null, empty or wordless texts
    stay, repeated rows stay or go together.
    """
    place = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names)
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema, strict=True)])
    for block in _blocks(items, max_share, min_words, "item_id", "text"):
        out = out.mapInArrow(partial(_clean_batches, block=block, column=names[place]), schema)
    return out.toDF(*docs.columns)
