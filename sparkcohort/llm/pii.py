"""Personal data: base patterns, and terms that disclose a protected entity.

Base spans come from four patterns.  Every matched value is a protected entity.
The whole document around an entity is its context; the corpus gives the
pointwise mutual information of entity and term over documents, and a term's
disclosure is that over the entity's own information content (1: the term gives
the entity away entirely).  The term must also point to the entity: a share of the
documents that have it must have the entity, else a word that is merely not
frequent would count, ever more words in a larger corpus.  Terms above the higher threshold are removed, those
above the lower one generalised, wherever they occur.  A pair counts only with
enough *different* texts, so copies of one text are not evidence.

A term begins outside every address.  Generalising puts a class in a term's place:
a name, a code or a word, by the term's shape.

Everything is a DataFrame expression.  The patterns are written with possessive
repeats and ``\\G`` so that Java's matcher neither recurses nor rescans a run; they
match what the plain forms match.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import Workspace, sized, carried

MAIL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{MAIL})|\G){MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}[\p{L}\p{N}]{2,}+"
MIN_CONTEXTS = 3
REMOVE, GENERALISE = 0.8, 0.5
#: A term reveals an entity only if this share of the documents with the term has the entity.
LEAST_SHARE = 0.1
SPAN = "struct<kind:string,s:int,e:int,v:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.regexp_extract_all(F.reverse(_digits(value)), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(digits, lambda c, i: c.cast("int") * (1 + i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match counts; a match that fails is dropped, shorter ones are not tried."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\.", -1), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _placed(found: str, between: str, before: str) -> Column:
    """(v, s) of each match: its start is what lies before it, matches and texts between them.

    Columns are paired and not read by index in a function, where the optimizer
    might put their whole making in the place of every read.
    """
    starts = F.zip_with(between, before, lambda gap, at: at + F.length(gap))
    return F.filter(F.zip_with(found, starts, lambda m, at: F.struct(m.alias("v"), at.alias("s"))), lambda y: y.v.isNotNull())


def _steps(found: str, between: str) -> Column:
    """Length of each match and the text before it."""
    return F.zip_with(F.slice(between, 1, F.size(between) - 1), found, lambda gap, m: F.length(gap) + F.length(m))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, value) of column x, by kind as listed, then start."""
    x = F.col("x")
    found = {kind: F.regexp_extract_all(x, F.lit(pattern), F.lit(0)) for kind, pattern in PATTERNS.items()}
    some = {kind: x.contains(NEEDS[kind]) if NEEDS[kind] else x.rlike("[0-9]") for kind in PATTERNS}
    docs = docs.select("*", *(F.when(some[k], found[k]).alias(f"m_{k}") for k in PATTERNS))
    docs = docs.select("*", *(F.when(F.size(f"m_{k}") > 0, F.split(x, pattern, -1)).alias(f"g_{k}") for k, pattern in PATTERNS.items()))
    docs = docs.select("*", *(_steps(f"m_{k}", f"g_{k}").alias(f"l_{k}") for k in PATTERNS))
    docs = docs.select("*", *(F.when(F.col(f"l_{k}").isNotNull(), carried(F.col(f"l_{k}"))).alias(f"b_{k}") for k in PATTERNS))
    right = {kind: partial(lambda kind, y: valid(kind, y.v), kind) for kind in PATTERNS}
    docs = docs.select("*", *(F.filter(_placed(f"m_{k}", f"g_{k}", f"b_{k}"), right[k]).alias(f"s_{k}") for k in PATTERNS))
    none = F.array().cast(f"array<{SPAN}>")
    whole = lambda kind: F.transform(f"s_{kind}", lambda y: F.struct(F.lit(kind).alias("kind"), y.s.alias("s"), (y.s + F.length(y.v)).alias("e"), y.v.alias("v")))
    docs = docs.withColumn("spans", F.concat(*(F.coalesce(whole(k), none) for k in PATTERNS)))
    return docs.drop(*(f"{p}_{k}" for p in "mglbs" for k in PATTERNS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda y: F.concat_ws(":", y.kind, y.s, y.e)), ",")


def _by_term(x: Column, make) -> Column:
    """``make`` with the pattern of terms; where a text may have addresses, these are matches too, so that no term is found in one."""
    return F.when(x.contains("@"), make(f"{PATTERNS['email']}|{TERM}")).otherwise(make(TERM))


def _words(x: Column) -> Column:
    """The different terms of a text, in lower case."""
    found = _by_term(x, lambda pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(found, lambda w: ~w.contains("@")), F.lower))


def _occurrences(rows: DataFrame) -> DataFrame:
    """(row, term, s, e) of every occurrence of a row's ``terms`` in its text x."""
    x = F.col("x")
    rows = rows.select("row", "x", "terms", _by_term(x, lambda pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))).alias("m"), _by_term(x, lambda pattern: F.split(x, pattern, -1)).alias("g"))
    rows = rows.select("row", "terms", "m", "g", _steps("m", "g").alias("l")).select("row", "terms", "m", "g", carried(F.col("l")).alias("b"))
    each = rows.select("row", F.explode(F.filter(_placed("m", "g", "b"), lambda y: F.array_contains("terms", F.lower(y.v)))).alias("y"))
    return each.select("row", F.lower("y.v").alias("term"), F.col("y.s").alias("s"), (F.col("y.s") + F.length("y.v")).alias("e"))


def disclosing_terms(docs: DataFrame, base: DataFrame, ws: Workspace, min_texts: int = MIN_CONTEXTS) -> DataFrame:
    """(row, kind, s, e): spans of terms to remove ("term") or to generalise ("class")."""
    held = base.filter(F.size("spans") > 0).select("row", "copy", F.explode(F.array_distinct(F.transform("spans", lambda y: F.xxhash64(y.kind, y.v)))).alias("entity"))
    by_text = held.groupBy("entity", "copy").agg(F.count("*").alias("n"))
    # a pair has no more different texts than its entity
    entities = by_text.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("n")).filter(F.col("n") >= min_texts)
    entities = ws.save(entities.select("entity", "n_entity"), "entities")
    by_row = ws.save(held.join(sized(entities.select("entity")), "entity", "left_semi").groupBy("row", "copy").agg(F.collect_set("entity").alias("entities")), "held")
    each = docs.join(sized(by_row), "row").select("copy", "entities", F.explode(_words(F.col("x"))).alias("term"))
    both = each.select("copy", "term", F.explode("entities").alias("entity")).groupBy("entity", "term", "copy").agg(F.count("*").alias("n"))
    both = both.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n")).filter(F.col("n") >= min_texts)
    pairs = ws.save(both.select("entity", "term", "n_both"), "pairs")
    wanted = ws.save(pairs.select("term").distinct(), "wanted")
    if not wanted.limit(1).count():
        return docs.select("row", F.lit("term").alias("kind"), F.lit(0).alias("s"), F.lit(0).alias("e")).limit(0)
    words = docs.select("row", F.explode(_words(F.col("x"))).alias("term"))
    # counted before the join: what meets the wanted terms is one row a word, however common
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")
    n_docs = F.lit(float(base.count()))
    scored = pairs.join(n_term, "term").join(entities, "entity")
    scored = scored.filter(F.col("n_both") >= LEAST_SHARE * F.col("n_term"))
    shared = F.log(n_docs * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    own = F.log(n_docs / F.col("n_entity"))
    scored = scored.withColumn("disclosure", F.when(own > 0, shared / own).otherwise(0.0)).filter(F.col("disclosure") >= GENERALISE)
    kinds = ws.save(scored.groupBy("term").agg(F.max(F.when(F.col("disclosure") >= REMOVE, "term").otherwise("class")).alias("kind")), "kinds")
    marks = ws.save(words.join(sized(kinds), "term").groupBy("row").agg(F.collect_set("term").alias("terms")), "marks")
    found = _occurrences(docs.join(sized(marks), "row")).join(sized(kinds), "term")
    return found.select("row", "kind", "s", "e")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms[, text, found]) for every row.

    Spans are code points, end exclusive.  ``spans`` lists base spans and then
    term and class spans as kind:start:end, by kind, then start.  Null texts are
    empty; rows with null or repeated doc_ids stay rows of their own (a row is
    told by its place in the scan); other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "pii")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    base = base_spans(rows)
    base = base.withColumn("copy", F.xxhash64("x")).drop(*([] if keep_text else ["x"]))
    base = ws.save(base, "base")
    extra = disclosing_terms(rows, base, ws).groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("extra"))
    order = F.array_sort(F.transform(F.col("extra"), lambda y: F.struct(F.when(y.kind == "term", 0).otherwise(1).alias("o"), y.s.alias("s"), y.e.alias("e"), y.kind.alias("kind"))))
    added = F.transform(order, lambda y: F.struct(y.kind.alias("kind"), y.s.alias("s"), y.e.alias("e"), F.lit("").alias("v")))
    out = base.join(extra, "row", "left").withColumn("found", F.concat("spans", F.coalesce(added, F.array().cast(f"array<{SPAN}>"))))
    count = lambda k: F.size(F.filter("spans", lambda y: y.kind == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *(count(k) for k in PATTERNS),
        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size("spans")).cast("long").alias("n_terms"),
        *(["found", F.col("x").alias("text")] if keep_text else []),
    )


#: What takes a span's place in a sanitised text; a generalised term's class follows from its shape.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": ""}


#: Characters of the chunks in which texts are cut, so that a place is found without reading all before it.
CHUNK = 4096


def _class(term: Column) -> Column:
    return F.when(term.rlike("[0-9]"), "[CODE]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) for every row: every span replaced by its label, removed terms by nothing, others by their class.

    Of spans that overlap the first is replaced and all are taken out.  A null text
    comes out empty; null and repeated doc_ids and repeated rows keep their rows;
    other columns are dropped.
    """
    rows = find_personal_data(docs, id_col, text_col, keep_text=True)
    label = F.create_map(*(F.lit(v) for kv in LABELS.items() for v in kv))
    order = F.array_sort(F.transform("found", lambda y: F.struct(y.s.alias("s"), (-y.e).alias("o"), y.e.alias("e"), y.kind.alias("kind"))))
    rows = rows.select("doc_id", order.alias("found"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("x"), F.length("text").alias("n"))
    rows = rows.select("*", F.transform("found", lambda y: y.e).alias("ends"))
    rows = rows.select("*", carried(F.col("ends"), F.greatest).alias("done"))

    def cut(a: Column, b: Column) -> Column:
        """The text from a to b, of the chunks that it lies in."""
        first = F.floor(a / CHUNK).cast("int")
        held = F.array_join(F.slice("x", first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(held, a % CHUNK + 1, b - a)).otherwise("")

    named = lambda y: F.coalesce(F.element_at(label, y.kind), _class(cut(y.s, y.e)))
    shown = F.zip_with("found", "done", lambda y, done: F.when(y.s.isNull(), cut(done, F.col("n"))).when(y.s >= done, F.concat(cut(done, y.s), named(y))).otherwise(""))
    return rows.select("doc_id", F.array_join(shown, "").alias("text"))
