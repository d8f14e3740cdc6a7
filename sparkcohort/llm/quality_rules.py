"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation
over the counts of vote patterns (at most 3 to the number of rules, whatever the
input) estimates how often each rule votes each way on good and bad documents,
and the posterior probability of good replaces "all rules must pass".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import SPACE_CLASS, Workspace, space_words

SYMBOLS = "[#*$%&|<>]+"
PRIOR_GOOD = 0.8
#: The end of a word in a letter or digit, with one mark of punctuation at most.
PLAIN_END = r"[\p{L}\p{N}][.,;:!?)\"']?(?=[\x20\x09-\x0D]|\z)"
#: Where estimation starts, (given good, given bad): passing a rule says little, failing one much.
START = {1: (0.85, 0.6), -1: (0.02, 0.3), 0: (0.13, 0.1)}


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds ``p``: where the 3-word windows of ``w`` (``n`` words) start that the text has twice or more, in order.

    One sort of longs, a window's hash with its place in the low bits, puts equal
    windows side by side, and the words of neighbours are compared.  Where two
    neighbours agree in hash alone, the text's windows are sorted by their words.
    """
    w, n, s = F.col("w"), F.col("n"), F.col("s")
    bits = F.length(F.bin(n.cast("long")))
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(starts, lambda i: F.call_function("shiftleft", _hash(w, i), bits).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("s", F.sort_array(packed))
    high = lambda v: F.call_function("shiftright", v, bits)
    place = lambda v: v.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    def words_agree(a: Column, b: Column) -> Column:
        i, j = place(a), place(b)
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    # 0: differs from the next, 1: equal, 2: equal in hash alone
    pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(b.isNull() | (high(a) != high(b)), 0).when(words_agree(a, b), 1).otherwise(2).cast("tinyint"))
    rows = rows.withColumn("z", pairs)
    quick = F.zip_with(s, F.zip_with("z", F.concat(F.array(F.lit(0).cast("tinyint")), "z"), lambda x, y: x + y), lambda v, twin: F.when(twin > 0, place(v)))
    named = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("v"), i.alias("i"))))
    rows = rows.withColumn("named", F.when(F.array_contains("z", F.lit(2).cast("tinyint")), named))
    spelt = F.filter("named", lambda x, k: (F.get("named", k - 1).v == x.v) | (F.get("named", k + 1).v == x.v))
    none = F.array().cast("array<int>")
    found = F.when(F.coalesce(F.array_max("z"), F.lit(0)) == 0, none).when(F.col("named").isNull(), F.filter(quick, lambda v: v.isNotNull())).otherwise(F.transform(spelt, lambda x: x.i))
    return rows.withColumn("p", F.sort_array(found)).drop("s", "z", "named")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_caps, n_digits, n_letters, n_plain_ends)."""
    text = F.coalesce(F.col("x"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("x"))
    rows = rows.select("doc_id", text.alias("x"), space_words(F.col("x")).alias("w"))
    rows = _repeats(rows.withColumn("n", F.size("w")))
    rows = rows.select("doc_id", "x", "n", "p", F.split("x", "\n", -1).alias("l"))
    # a window covers three words; the next repeated window may start before its end
    steps = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda v, after: F.least(F.lit(3), F.coalesce(after - v, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, v: a + v)
    gone = lambda kind: F.length("x") - F.length(F.regexp_replace("x", kind, ""))
    rows = rows.withColumn("ll", F.filter("l", lambda v: v.rlike(r"[^\x20\x09-\x0D]")))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("x", SPACE_CLASS, "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("ll") - F.size(F.array_distinct("ll"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("ll").cast("long").alias("n_lines"),
        gone("[A-Z]+").cast("long").alias("n_caps"),
        gone("[0-9]+").cast("long").alias("n_digits"),
        gone(r"\p{L}+").cast("long").alias("n_letters"),
        F.regexp_count("x", F.lit(PLAIN_END)).cast("long").alias("n_plain_ends"),
    )


def votes() -> dict[str, Column]:
    """The rules.  Ratios of a document without words abstain."""
    words = F.col("n_words")
    share = lambda a, b: F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)

    length, symbols = share("word_chars", "n_words"), share("n_symbols", "n_words")
    dup, repeat = share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    letters, ends = share("n_letters", "word_chars"), share("n_plain_ends", "n_words")
    caps, digits = share("n_caps", "word_chars"), share("n_digits", "word_chars")
    return {
        "long_enough": vote(words, words >= 80, words < 50),
        "word_length": vote(length, length.between(3, 9), (length < 2.5) | (length > 12)),
        "few_symbols": vote(symbols, symbols <= 0.02, symbols > 0.1),
        "lines_differ": vote(dup, dup <= 0.1, dup > 0.5),
        "words_differ": vote(repeat, repeat <= 0.1, repeat > 0.3),
        "lower_case": vote(caps, caps <= 0.1, caps > 0.3),
        "letters": vote(letters, letters >= 0.85, letters < 0.7),
        "plain_ends": vote(ends, ends >= 0.8, ends < 0.6),
        "few_digits": vote(digits, digits <= 0.05, digits > 0.2),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict]]:
    """EM over vote patterns and their counts: the share of good documents and, for each rule,
    the probabilities of each vote given good and given bad."""
    rules = len(patterns[0][0]) if patterns else 0
    good = PRIOR_GOOD
    table = [dict(START) for _ in range(rules)]
    for _ in range(rounds):
        sums = [{v: [0.5, 0.5] for v in (-1, 0, 1)} for _ in range(rules)]
        total = [0.0, 0.0]
        for pattern, count in patterns:
            p = posterior(pattern, good, table)
            total[0] += p * count
            total[1] += (1 - p) * count
            for r, v in enumerate(pattern):
                sums[r][v][0] += p * count
                sums[r][v][1] += (1 - p) * count
        new = (total[0] + PRIOR_GOOD * 10) / (sum(total) + 10)
        table = [{v: (x[v][0] / (total[0] + 1.5), x[v][1] / (total[1] + 1.5)) for v in x} for x in sums]
        # a rule may be useless but not perverse: a bad vote never speaks for good
        for x in table:
            if x[-1][0] > x[-1][1]:
                x[-1] = (x[-1][1], x[-1][1])
        if abs(new - good) < 1e-9:
            break
        good = new
    return good, table


def posterior(pattern, good: float, table: list[dict]) -> float:
    log = math.log(good / (1 - good)) + sum(math.log(table[r][v][0] / table[r][v][1]) for r, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, log))))


def quality_verdicts(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the measures, base_failed, probability, kept) for every row of ``docs``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated
    3-word windows.  ``kept`` is false for those, else whether the posterior is at
    least ``threshold``.  Null and empty texts have no words and fail.  Null or
    repeated doc_ids keep their rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "quality_rules")
    rules = votes()
    found = ws.save(measures(docs, id_col, text_col).select("*", *(c.cast("int").alias(f"vote_{k}") for k, c in rules.items())), "measures")
    names = [f"vote_{k}" for k in rules]
    counts = found.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    good, table = estimate([(tuple(r[n] for n in names), r["count"]) for r in counts])
    log_odds = F.lit(math.log(good / (1 - good)))
    for name, x in zip(names, table, strict=False):
        ratio = {v: math.log(a / b) for v, (a, b) in x.items()}
        log_odds = log_odds + F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(ratio[0])
    out = found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("probability", 1 / (1 + F.exp(-log_odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
