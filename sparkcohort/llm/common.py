"""Shared pieces of the training-data operators.

Lineage is cut by the core's ``Workspace``: Parquet tables in the folder that the
cluster shares (``spark.checkpoint.dir``), so a lost executor only costs the
tasks it ran.  Word and window rules that several operators share are here.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcohort.sources.storage import Workspace, shared_dir  # noqa: F401  used by the operators

#: ASCII white space; every run of other characters is a word.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(saved: DataFrame, most: int = 8 << 20) -> DataFrame:
    """A written table, marked for broadcast if its files have at most ``most`` bytes; beyond that a join shuffles it."""
    held = int(str(saved._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(saved) if held <= most else saved


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty; Python gets them undecoded."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit key of (id, text).  Rows that agree in both may share a result."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 2_000_000):
    """Parts of a batch whose texts have about ``limit`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def space_words(text: Column) -> Column:
    """The words of a text as an array, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS, -1), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def carried(values: Column, combine=lambda a, v: a + v, block: int = 256) -> Column:
    """What ``combine`` makes of all earlier elements, from 0 on, for each element of an array of ints, and at the end of all.

    ``combine`` must be associative, with 0 as its neutral element.  Results are
    carried within blocks and then over blocks, so that the time is about ``block``
    short copies an element and not as many as there are elements.  ``values`` must
    be a column, not an expression: it is used several times.
    """
    run = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(combine(F.element_at(a, -1), v))))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")))
    parts = F.transform(starts, lambda i: run(F.slice(values, i * block + 1, block)))

    def append(a: Column, part: Column) -> Column:
        last = combine(F.element_at(a.ends, -1), F.element_at(part, -1))
        return F.struct(F.concat(a.ends, F.array(last)).alias("ends"), F.concat(a.parts, F.array(part)).alias("parts"))

    none = F.struct(F.array(F.lit(0)).alias("ends"), F.array().cast("array<array<int>>").alias("parts"))
    whole = lambda a: F.transform(a.parts, lambda part, i: F.transform(F.slice(part, 1, F.size(part) - 1), lambda v: combine(F.get(a.ends, i), v)))
    return F.aggregate(parts, none, append, lambda a: F.concat(F.flatten(whole(a)), F.array(F.element_at(a.ends, -1))))
