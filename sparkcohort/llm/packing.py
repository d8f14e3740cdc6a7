"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Tokens are made once; of a document only the number of ids and the CRC of each
piece go on.  Pieces are cut before packing: whole sequences, then a half
sequence, then the rest, so that every free piece is at most half a sequence and
first-fit decreasing leaves little padding.  Groups of documents are packed
independently; a document's group is a hash of its row, so groups stay at about
``GROUP_DOCS`` documents whatever the input and no group is hot.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import Workspace, text_bytes, text_slices

GROUP_DOCS = 4096
END_ID = 0
#: The same splits as the published pattern of the vocabulary, in a form that needs less backtracking.
SPLITS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
#: A run of blanks as long as this makes the faster library backtrack too deep; such texts take the other one.
LONG_BLANK = re.compile(r"\s{10000}")


@lru_cache(maxsize=4)
def _encoder(name: str):
    """Text to ids as ``tokenizers`` gives them for this file.

    The byte-level BPE with ranks in a second file gives the same ids several times
    faster; texts that spell out a special token, or have a very long run of blanks,
    take ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(name))
    ranks_file = public_tokenizers.path(name.replace(".json", ".tiktoken"))
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text or LONG_BLANK.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, size: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, a half, the rest."""
    whole, rest = divmod(n, size)
    pieces = [size] * whole
    if rest > size // 2:
        pieces.append(size // 2)
        rest -= size // 2
    return pieces + [rest] * (rest > 0)


def _token_batches(batches, tokenizer: str, size: int):
    encode = _encoder(tokenizer)
    for batch in batches:
        for part in text_slices(batch, 1):
            counts, sums = [], []
            for text in part.column(1).to_pylist():
                ids = np.array([*encode(text.decode(errors="replace")), END_ID], dtype="<u4")
                raw, crcs, start = ids.tobytes(), [], 0
                for n in cut(len(ids), size):
                    crcs.append(zlib.crc32(raw[4 * start : 4 * (start + n)]))
                    start += n
                counts.append(len(ids))
                sums.append(crcs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "n", "crcs"])


def first_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; bins are the leaves of a tree whose nodes hold the most room below.

    Items come largest first.  The first bin with room is found by walking down
    from the root, left child first; a full tree doubles.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        room = tree[node]
        out.append((node - leaves, capacity - room))
        tree[node] = room - size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_group(key, frame: pd.DataFrame, size: int) -> pd.DataFrame:
    frame = frame.sort_values("row")
    items = []
    for doc_id, n, crcs in zip(frame["doc_id"].tolist(), frame["n"].tolist(), frame["crcs"], strict=True):
        start = 0
        for length, crc in zip(cut(n, size), crcs, strict=True):
            items.append((doc_id, start, length, int(crc), n))
            start += length
    items.sort(key=lambda x: -x[2])
    placed = first_fit([x[2] for x in items], size)
    base = int(key[0]) << 36
    rows = [(*x, base + b, o) for x, (b, o) in zip(items, placed, strict=True)]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({**{x: "int64" for x in names[1:]}, "doc_id": "Int64"})


def pack(docs: DataFrame, size: int = 1024, tokenizer: str = "byte_bpe_50k.json", group_docs: int = GROUP_DOCS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``END_ID``; a null or empty text is that one
    id.  Every id lies in one piece; pieces of a sequence fill it from offset 0
    without gaps, to at most ``size`` ids.  Rows with null or repeated doc_ids
    are documents of their own.  Documents longer than a sequence are cut; bytes
    that are not UTF-8 become replacement characters.
    ``tokenizer`` names a file of ``public_tokenizers``.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    made = ws.save(rows.mapInArrow(partial(_token_batches, tokenizer=tokenizer, size=size), "doc_id long, n long, crcs array<long>"), "tokens")
    groups = max(1, -(-made.count() // group_docs))
    rows = made.withColumn("row", F.monotonically_increasing_id())
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    return grouped.groupBy("g").applyInPandas(partial(_pack_group, size=size), PIECES)
