"""Line deduplication with a deletion-neighbourhood join, in DataFrame expressions.

Lines are sequences of words.  Every line with a word is compared.  The bound is
one word edit (a word put in, taken out or replaced) in ``edit_words`` words: lines
that long match at up to one edit, shorter ones when they are equal.  Callers may
protect short lines: that only leaves them out of what is returned.

Variants with one word deleted are keys, hashed from the hashes of words.  Two lines that are equal
without the word at the same place differ by a replacement; a line that equals
another's variant differs by an insertion.  Lines that meet at a key are read
again and grouped by the very words that are left: what is equal there is at most
one edit apart.  A group is a star or a clique of near lines and never written as
pairs.

In order, a line goes if an earlier line *that stays* is within the bound.  Rounds
decide this: a line stays once all earlier near lines are gone, and goes once one
of them stays.

Only lines that could have a partner emit variants: one edit leaves the first or
the last half of a line alone, so a line goes on only if it shares a half.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import Workspace, sized, text_key

#: One edit is allowed to lines of so many words.
EDIT_WORDS = 5
LAST = (1 << 63) - 1


def _words(line: Column) -> Column:
    """The words of a line.  Only a line with other blanks than spaces is rewritten; one character splits without a pattern."""
    plain = F.when(line.rlike(r"[\t\x0B\f\r]"), F.translate(line, "\t\u000b\f\r", "    ")).otherwise(line)
    return F.array_remove(F.split(plain, " ", -1), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, k, x): order and key of a document; null ids come last."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    return docs.select(d.alias("d"), text_key(id_col, text_col).alias("k"), F.col(text_col).alias("x"))


def _lines(rows: DataFrame, edit_words: int) -> DataFrame:
    """(d, k, p, h1, h2, n, k1..k4) of every compared line: hash, words, and the hashes of its halves."""
    each = rows.select("d", "k", F.posexplode(F.split("x", "\n", -1)).alias("p", "line"))
    each = each.select("d", "k", "p", _words(F.col("line")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    each = each.select("d", "k", "p", "n", F.xxhash64(F.lit(99), "w").alias("h2"), _hashes(F.col("w")).alias("w"))
    half, other = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    keys = [F.xxhash64(F.lit(0), m, F.slice("w", 1, m)) for m in (half, other)] + [F.xxhash64(F.lit(1), m, F.slice("w", F.col("n") - m + 1, m)) for m in (half, other)]
    long_enough = F.col("n") >= edit_words
    return each.select("d", "k", "p", F.xxhash64("w").alias("h1"), "h2", "n", *(F.when(long_enough, c).alias(f"k{i}") for i, c in enumerate(keys, 1)))


ORDER = ("d", "k", "p")


def _variants(lines: DataFrame) -> DataFrame:
    """Rows (place, length, v, own, cut): a line's variants without the word at ``cut``, and the line itself (cut -1).

    A variant is there twice: with its place (replacements) and without (insertions, place -1, where lines are too).
    """
    w, n = F.col("h"), F.col("n")
    low = F.when(F.col("tail"), F.lit(0)).otherwise(F.floor((n - 1) / 2).cast("int"))
    high = F.when(F.col("head"), n - 1).otherwise(n - F.floor((n - 1) / 2).cast("int"))
    cut = F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("cut"), (n - 1).alias("length"), F.xxhash64(F.slice(w, F.lit(1), i), F.slice(w, i + 2, n)).alias("v")))
    whole = F.struct(F.lit(-1).alias("cut"), n.alias("length"), F.xxhash64(w).alias("v"))
    own = F.struct("d", "k", "p").alias("own")
    lines = lines.select(own, "n", "head", "tail", _hashes(F.col("w")).alias("h"))
    each = lines.select("own", F.explode(F.concat(cut, F.array(whole))).alias("c"))
    places = F.when(F.col("c.cut") < 0, F.array(F.lit(-1))).otherwise(F.array("c.cut", F.lit(-1)))
    return each.select(F.explode(places).alias("place"), "c.length", "c.v", "own", "c.cut")


def _read(rows: DataFrame, look: DataFrame) -> DataFrame:
    """The lines that ``look`` names as (d, k, look: array of structs with p), with their words w and length n."""
    texts = rows.join(sized(look), ["d", "k"]).select("d", "k", F.split("x", "\n", -1).alias("l"), "look")
    found = texts.select("d", "k", F.explode(F.transform("look", lambda y: F.struct(y.alias("y"), F.get("l", y.p).alias("line")))).alias("y"))
    return found.select("d", "k", "y.y.*", _words(F.col("y.line")).alias("w")).withColumn("n", F.size("w"))


def _earlier(edges: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """(own, earlier): for every line that has one, its first earlier near line in one of the states.

    In a group of replacements all are near one another; in one of insertions the line and each variant are.
    """
    counted = F.when(F.col("state").isin(*states), F.col("own"))
    groups = edges.groupBy("g").agg(F.min(F.when(F.col("cut") < 0, counted)).alias("line"), F.min(F.when(F.col("cut") >= 0, counted)).alias("variant"))
    other = F.when((F.col("g.place") >= 0) | (F.col("cut") < 0), F.col("variant")).otherwise(F.col("line"))
    return edges.join(groups, "g").select("own", other.alias("earlier")).filter("earlier < own").groupBy("own").agg(F.min("earlier").alias("earlier"))


def _decided(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(own, keep): the lines of ``edges`` (g, own, cut) that go, and the first earlier near line that stays."""
    now = edges.withColumn("state", F.lit("open"))
    for i in count():
        now = ws.save(now, f"open{i}")
        if not now.filter("state = 'open'").limit(1).count():
            break
        waits = _earlier(now, ("open", "stays")).select("own", F.lit(True).alias("waits"))
        stays = F.when((F.col("state") == "open") & F.col("waits").isNull(), "stays").otherwise(F.col("state"))
        now = ws.save(now.join(waits, "own", "left").select("g", "own", "cut", stays.alias("state")), f"stay{i}")
        goes = _earlier(now, ("stays",)).select("own", F.lit(True).alias("goes"))
        now = now.join(goes, "own", "left").select("g", "own", "cut", F.when((F.col("state") == "open") & F.col("goes"), "goes").otherwise(F.col("state")).alias("state"))
        if i:
            ws.drop(f"open{i - 1}", f"stay{i - 1}")
    gone = now.filter("state = 'goes'").select("own").distinct()
    return _earlier(now, ("stays",)).withColumnRenamed("earlier", "keep").join(gone, "own", "left_semi")


def duplicate_lines(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", protect: int = EDIT_WORDS, edit_words: int = EDIT_WORDS) -> DataFrame:
    """(d, k, p, kd, kp, edits): every line that goes, and the earlier line that stands for it and stays.

    A line goes if an earlier line (by doc_id, then place) that stays is equal or
    one edit away; the earliest such line is named.  Lines under ``protect`` words
    stay.
    """
    if protect > edit_words:
        raise ValueError(f"only lines under {edit_words} words can be protected")
    rows = _sources(docs, id_col, text_col)
    lines = ws.save(_lines(rows, edit_words), "lines")
    kinds = lines.groupBy("h1", "h2").agg(F.min(F.struct(*ORDER)).alias("first"), *(F.min(c).alias(c) for c in ("n", "k1", "k2", "k3", "k4")))
    kinds = ws.save(kinds.select("h1", "h2", "first.*", "n", "k1", "k2", "k3", "k4"), "kinds")
    halves = kinds.filter(F.col("n") >= edit_words).select("h1", "h2", "d", "k", "p", F.explode(F.array(
        F.struct(F.col("k1").alias("key"), F.lit(True).alias("head")), F.struct(F.col("k2").alias("key"), F.lit(True).alias("head")),
        F.struct(F.col("k3").alias("key"), F.lit(False).alias("head")), F.struct(F.col("k4").alias("key"), F.lit(False).alias("head")),
    )).alias("x")).select("h1", "h2", "d", "k", "p", "x.*")
    # the two lengths of a half agree for odd n: a line then has its key twice, so the smallest and largest line of a key are compared
    shared = halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a != b").select("key")
    mine = halves.join(sized(ws.save(shared, "halves")), "key", "left_semi").groupBy("h1", "h2", "d", "k", "p")
    mine = mine.agg(F.max("head").alias("head"), F.max(~F.col("head")).alias("tail"))
    look = mine.groupBy("d", "k").agg(F.collect_set(F.struct("p", "head", "tail")).alias("look"))
    variants = ws.save(_variants(_read(rows, ws.save(look, "look"))), "variants")
    key = ["place", "length", "v"]
    # two lines at least; a line may meet itself in two of its variants
    several = variants.groupBy(*key).agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a != b").select(*key)
    met = ws.save(variants.join(sized(ws.save(several, "several")), key, "left_semi").select("own", "place", "cut"), "met")
    ws.drop("variants", "look")
    again = met.select("own.*").distinct().groupBy("d", "k").agg(F.collect_set(F.struct("p")).alias("look"))
    words = _read(rows, ws.save(again, "again")).select(F.struct("d", "k", "p").alias("own"), "w", "n")
    left = F.when(F.col("cut") < 0, F.col("w")).otherwise(F.concat(F.slice("w", F.lit(1), F.greatest("cut", F.lit(0))), F.slice("w", F.col("cut") + 2, F.greatest("n", F.lit(1)))))
    edges = met.join(words, "own").select("own", "place", "cut", F.array_join(left, " ").alias("left"))
    edges = ws.save(edges, "edges")
    # a group is named by its place and its first member; that names the words left as well
    names = edges.groupBy("place", "left").agg(F.min(F.struct("own", "cut")).alias("first"), F.max("own").alias("last")).filter("first.own != last")
    names = ws.save(names.select("place", "left", F.struct("place", "first").alias("g")), "names")
    edges = edges.join(names, ["place", "left"]).select("g", "own", "cut")
    near = ws.save(_decided(edges, ws), "near")
    first = kinds.select("h1", "h2", F.struct("d", "k", "p").alias("first"))
    stands = first.join(near.withColumnRenamed("own", "first"), "first", "left").withColumn("edits", F.col("keep").isNotNull().cast("int"))
    stands = stands.select("h1", "h2", F.coalesce("keep", "first").alias("keep"), "edits")
    copies = lines.filter(F.col("n") >= protect).join(stands, ["h1", "h2"]).filter(F.struct("d", "k", "p") != F.col("keep"))
    return copies.select("d", "k", "p", F.col("keep.d").alias("kd"), F.col("keep.p").alias("kp"), "edits")


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", protect: int = EDIT_WORDS) -> DataFrame:
    """(doc_id, line, keep_doc_id, keep_line, edits): the lines that go, counted from 0 within a text split at \\n.

    Texts without a line break are one line; null texts have none; lines of fewer
    than ``protect`` words stay (0: none is protected).  Null doc_ids come last in order
    and stay null in the result.  Rows that agree in doc_id and text are one
    document: neither is earlier.  Every line named stays.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "line_dedup")
    found = duplicate_lines(docs, ws, id_col, text_col, protect).select("d", "k", "p", "kd", "kp", "edits").distinct()
    back = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return found.select(back("d").alias("doc_id"), F.col("p").cast("long").alias("line"), back("kd").alias("keep_doc_id"), F.col("kp").cast("long").alias("keep_line"), "edits")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", protect: int = EDIT_WORDS) -> DataFrame:
    """``docs`` with duplicate lines taken out of the text.

    Each line taken out has an equal or near one in the result.  A document all of
    whose unprotected lines went and that has no other word left is a copy and goes;
    other documents, null and empty ones included, stay.  Repeated rows are one
    document and lose the same lines.
    """
    ws = Workspace(docs.sparkSession, "line_dedup")
    gone = duplicate_lines(docs, ws, id_col, text_col, protect).groupBy("d", "k").agg(F.collect_set("p").alias("__gone"))
    gone = ws.save(gone, "gone").withColumnRenamed("d", "__d").withColumnRenamed("k", "__k")
    rows = docs.withColumn("__d", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn("__k", text_key(id_col, text_col))
    out = rows.join(sized(gone), ["__d", "__k"], "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept))
    empty = F.col("__gone").isNotNull() & ~F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~empty).select(*docs.columns)
