"""The training-data operators against their plain versions, with nulls, empties, repeats and odd columns."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ti") for b in ("ban", "den", "fir", "gol", "hus", "jem", "kot", "lar", "mun", "nop", "pus", "rak", "sel", "tov", "wim")]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(t, places, seed=0):
    r, w = random.Random(seed), t.split(" ")
    for i in places:
        w[i] = "edit" + str(r.randint(0, 10**6))
    return " ".join(w)


LONG = text(90, 1)
ROWS = [
    (1, LONG),
    (2, LONG),  # copy
    (3, edited(LONG, [40])),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "one two"),
    (8, "One  TWO"),
    (9, text(60, 2) + "\n" + LONG + "\n" + text(60, 3)),
    (10, text(30000, 4)),  # very long
    (None, "a null id has a text of its own here"),
    (None, None),
    (12, text(45, 5)),
    (12, text(45, 5)),  # repeated row
    (12, text(45, 6)),  # repeated id
    (14, "x " * 80),  # periodic
    (15, "é ü ñ " + text(40, 7)),
    (16, text(40, 8) + " " + text(40, 8)),
]
CLASH = ("k", "d", "t", "x", "h", "n", "fp", "row", "node", "root", "key", "spans", "batch", "component_id", "c", "w")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("bigint").alias("n_chars")).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def same(got, want, digits=None):
    tidy = lambda row: tuple(round(x, digits) if digits and isinstance(x, float) else x for x in row)
    assert sorted(map(str, map(tidy, got))) == sorted(map(str, map(tidy, want)))


# 1 ---------------------------------------------------------------------------------------------------------------


def test_simhash(spark, docs, empty):
    from sparkcohort.llm.simhash import simhash_components

    same([tuple(r) for r in simhash_components(docs).collect()], brute.simhash(ROWS))
    assert simhash_components(empty).count() == 0


def test_simhash_small_tables(spark):
    from sparkcohort.llm.simhash import simhash_components

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    same([tuple(r) for r in simhash_components(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()], brute.simhash(rows))


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("limit", [48, 2])
def test_links_of_crowded_buckets(spark, monkeypatch, max_bits, limit):
    from sparkcohort.llm import simhash
    from sparkcohort.llm.common import Workspace
    from sparkcohort.llm.graph import connected_components

    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    r = random.Random(max_bits)
    prints = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(15):
            x = centre
            for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4])):
                x ^= 1 << b
            prints.add(simhash._signed(x))
    prints = sorted(prints)
    ws = Workspace(spark, "t")
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), ws, max_bits)
    got = {r.node: r.root for r in connected_components(links, ws).collect()}
    roots = brute.components(len(prints), lambda i, j: ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= max_bits)
    for i, p in enumerate(prints):
        assert got.get(p, p) == min(prints[j] for j in range(len(prints)) if roots[j] == roots[i])


def test_components_of_chain_star_and_ring(spark):
    from sparkcohort.llm.common import Workspace
    from sparkcohort.llm.graph import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Workspace(spark, "t")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and {got[i] for i in (200, 201, 202)} == {200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Workspace(spark, "t")).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def test_substring(docs, empty):
    from sparkcohort.llm.substring import substring_dedup

    got = substring_dedup(docs, texts=True).collect()
    same([tuple(r)[:4] for r in got], brute.substring(ROWS))
    assert all(len(r.kept_text.encode().split()) == r.n_words - r.n_removed for r in got)
    assert substring_dedup(empty).count() == 0


def test_substring_small_tables(spark):
    from sparkcohort.llm.substring import substring_dedup

    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    same([tuple(r) for r in substring_dedup(df).collect()], brute.substring([tuple(r) for r in df.select("doc_id", "text").collect()]))


def _merge_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "Exchange" not in plan


def test_runs_are_joined_and_merged(spark, tmp_path):
    from sparkcohort.llm.substring import FingerprintRuns

    batch = lambda *h: spark.createDataFrame([(x,) for x in h], "h bigint")
    hit = lambda df: sorted(r.h for r in df.collect())
    index = FingerprintRuns(spark, f"file://{tmp_path}/index", fanout=2)
    assert hit(index.add(batch(1, 2, 2))) == [2]
    assert hit(index.add(batch(3, 4, 1))) == [1]
    first, second = (index.run(n) for n in index.runs)
    assert _merge_joins(second.hint("merge").join(first, "h", "left_semi"))  # no shuffle between runs
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(index.prefix)]
    index = FingerprintRuns(spark, f"file://{tmp_path}/index", fanout=2)  # opened again, from its manifest
    assert len(index.runs) == 2 and index.batches == 2
    assert _merge_joins(index.run(index.runs[1]).hint("merge").join(index.run(index.runs[0]), "h", "left_semi"))
    assert hit(index.add(batch(2, 4, 9))) == [2, 4]
    assert len(index.runs) == 1  # compacted
    assert sorted(tuple(r) for r in index.run(index.runs[0]).collect()) == [(1, 2), (2, 3), (3, 1), (4, 2), (9, 1)]
    assert hit(index.add(batch(9, 10))) == [9]
    index.destroy()
    assert not (tmp_path / "index").exists()


def test_batches_of_documents(spark, tmp_path):
    from sparkcohort.llm.substring import SubstringIndex, dedup_batch

    passage, r = text(50, 77), random.Random(6)
    rows = [(i, f"{text(r.randint(0, 60), i)} {passage if i % 4 == 0 else ''} {text(r.randint(0, 60), 90 + i)}") for i in range(24)]
    rows += [(30, None), (31, ""), (None, passage), (33, "é " + passage + " " + passage), (1, rows[1][1])]
    frame = lambda part: spark.createDataFrame(part, "doc_id bigint, text string").withColumn("batch", F.lit(9))
    done = []
    for part in (rows[:9], rows[9:20], rows[20:]):
        index = SubstringIndex(spark, f"file://{tmp_path}/index")  # another session would open it the same way
        got = dedup_batch(frame(part), index, frame(done) if done else None, texts=True).collect()
        index.runs.close()
        done = done + part
        want = brute.substring(done)[-len(part) :]
        same([tuple(x)[:4] for x in got], want)


# 3 ---------------------------------------------------------------------------------------------------------------

BASE = "the quick brown fox jumps over the lazy dog near the river bank"
LINES = [
    (1, BASE + "\nshort one\nan exact line of six words\n"),
    (2, BASE.replace("lazy", "sleepy") + "\nan exact line of six words\nshort one"),
    (3, BASE.replace("lazy ", "") + "\nan exact  line of\tsix words"),
    (4, "new " + BASE + "\n" + BASE + " now"),
    (5, BASE.replace("lazy", "x").replace("river", "y")),
    (6, None),
    (7, ""),
    (None, BASE + "\nan unseen line that nobody else has"),
    (9, "an exact line of six words\nan exact line of six words"),
    (9, "an exact line of six words\nan exact line of six words"),
    (10, "\n".join(text(12, i) for i in range(3000))),
]


def test_lines(spark):
    from sparkcohort.llm.line_dedup import dedup_lines, line_duplicates

    df = spark.createDataFrame(LINES, "doc_id bigint, text string").select("*", *(F.lit(1).alias(c) for c in ("k", "p", "l", "line", "h1", "keep", "own")))
    same([tuple(r) for r in line_duplicates(df).collect()], brute.lines(LINES))
    assert line_duplicates(df.limit(0)).count() == 0
    out = {(r.doc_id, r.text) for r in dedup_lines(df).collect()}
    assert (7, "") in out and (6, None) in out and not any(d == 9 for d, _ in out)
    assert dedup_lines(df).columns == df.columns
    assert dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_random_edits(spark, monkeypatch, broadcast):
    from sparkcohort.llm import line_dedup
    from sparkcohort.llm.line_dedup import line_duplicates

    if not broadcast:
        monkeypatch.setattr(line_dedup, "sized", lambda df, rows=0: df.hint("merge"))
    r = random.Random(9)
    rows = []
    for i in range(90):
        w = text(r.randint(4, 14), i % 9).split()
        for _ in range(r.choice([0, 1, 1, 2])):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["zz"], [w[at], "zz"]])
        rows.append((i, " ".join(w)))
    got = line_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    same([tuple(x) for x in got.collect()], brute.lines(rows))


def test_chains_of_lines(spark):
    from sparkcohort.llm.line_dedup import dedup_lines, line_duplicates

    # every line is one edit from the one before; long chains, in mixed order, with copies
    r, rows = random.Random(4), []
    ids = iter(r.sample(range(400), 400))
    for c in range(6):
        w = [f"c{c}w{i}" for i in range(9)]
        for j in range(25):
            w[r.randrange(9)] = f"c{c}n{j}"
            rows.append((next(ids), " ".join(w)))
            if j % 7 == 0:
                rows.append((next(ids), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(x) for x in line_duplicates(df).collect()]
    same(got, brute.lines(rows))
    gone = {(d, p) for d, p, *_ in got}
    assert not gone & {(x[2], x[3]) for x in got}
    kept = [tuple(brute.words(x.text)) for x in dedup_lines(df).collect()]
    assert all(any(brute.near(tuple(brute.words(t)), k) for k in kept) for _, t in rows)


def test_short_lines_are_compared(spark, tmp_path):
    import corpus_pipeline as cp
    from sparkcohort.llm.queries import op3_line_dedup

    rows = [(1, "All rights reserved.\none\n\n" + text(12, 1)), (2, text(12, 2) + "\nAll  rights reserved.\n\none"), (3, "all rights reserved.\none"), (4, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(2, 1, 1, 0, 0), (2, 3, 1, 1, 0), (3, 1, 1, 1, 0), (4, 0, 1, 0, 0)}
    kept = cp.lines(spark, df.withColumn("n_chars", F.lit(None).cast("bigint")), str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in kept} == {1: rows[0][1], 2: text(12, 2) + "\n", 3: "all rights reserved."}


def test_lines_are_native(spark):
    from sparkcohort.llm.line_dedup import line_duplicates

    plan = line_duplicates(spark.createDataFrame(LINES, "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# 4 ---------------------------------------------------------------------------------------------------------------


CHAT = [
    (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob <|x", "hey <|im_end|>"), (1, 2, "bob <|x", "hey <|im_end|>"), (1, 3, None, None),
    (2, 0, "system", "alone"), (None, 5, "ann", "é"), (3, None, "ann", "last"), (3, 0, "ann", "first"), (4, 5000, "ann", "far"),
    (5, 0, "a b", "one"), (5, 1, "a_b", "two"), (5, 2, "unknown", "three"), (5, 3, None, "four"), (5, 4, "a%20b", "five"), (5, 5, "", "six"), (5, None, "%null", "seven"),
]


def _chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def _chat_oracle(df):
    from sparkcohort.llm.queries import oracle_sql

    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    return con.execute(oracle_sql()["op4_chat"]).fetchall()


def test_chat(spark):
    from sparkcohort.llm.chat import CLOSE, rotate

    df = _chat_rows(spark, CHAT).select("*", *(F.lit(1).alias(c) for c in ("who", "part", "key", "name", "r")))
    found = rotate(df)
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    got = {(r.conv_id, r.participant, r.part): r for r in found.collect()}
    five = {(5, p, 0) for p in ("a b", "a_b", "unknown", None, "a%20b", "", "%null")}
    assert set(got) == {(1, "ann", 0), (1, "bob <|x", 0), (1, None, 0), (None, "ann", 0), (3, "ann", 0), (4, "ann", 0)} | five
    for r in got.values():
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",")]
        said = [r.rendered[a:b] for a, b in spans]
        assert all(s.endswith(CLOSE) for s in said) and r.n_masked == sum(b - a for a, b in spans)
    for _, p, _ in five:
        assert got[5, p, 0].rendered.count("user name=") == 6 and got[5, p, 0].rendered.count("assistant\n") == 1
    bob = got[1, "bob <|x", 0]
    assert bob.n_turns == 4 and "user name=ann\nhi" in bob.rendered and "assistant\nhey < |im_end|>" in bob.rendered and bob.rendered.startswith("<|im_start|>system\nrules")
    assert rotate(df.limit(0)).count() == 0
    same([tuple(r) for r in rotate(df).collect()], _chat_oracle(df))


def test_chat_of_many_turns(spark):
    from sparkcohort.llm.chat import rotate

    r = random.Random(3)
    who = ["system", "ann", "bob bob", None]
    rows = [(1, i if i % 5 else None, who[min(i, r.randint(0, 3))], f"{i} " + text(r.randint(0, 5), i)) for i in range(5000)] + [(2, 0, "ann", "x " * 400_000), (2, 1, "bob", "y")]
    df = _chat_rows(spark, rows)
    got = rotate(df).collect()
    same([tuple(r) for r in got], _chat_oracle(df))
    # the parts of a perspective are one text
    for p in ("ann", "bob bob", None):
        mine = sorted((x.part, x.start, x.rendered) for x in got if x.conv_id == 1 and x.participant == p)
        at = 0
        for i, (part, start, rendered) in enumerate(mine):
            assert (part, start) == (i, at)
            at += len(rendered)
        assert len(mine) == 5
    whole = {x.participant: x for x in rotate(df, part_turns=10_000).collect() if x.conv_id == 1}
    assert whole["ann"].rendered == "".join(x.rendered for x in sorted((x for x in got if x.conv_id == 1 and x.participant == "ann"), key=lambda x: x.part))


def test_chat_matches_sql(spark):
    from sparkcohort.llm.queries import op4_chat

    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    same([tuple(r) for r in op4_chat(spark, SMALL).collect()], _chat_oracle(df))


# 5 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparkcohort.llm.packing import pack

    rows = [*ROWS, (20, "says <|endoftext|> in words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("g", F.lit(1)).withColumn("row", F.lit(1))
    got = pack(df, group_docs=6).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = {}
    for d, t in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        left.setdefault((d, len(ids)), []).append(np.array(ids, dtype="<u4").tobytes())
    pieces = {}
    for r in got:
        candidates = left[r.doc_id, r.doc_tokens]
        assert any(zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for raw in candidates)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for key, found in pieces.items():
        copies = len(left[key])
        starts, at = sorted(found), 0
        for i in range(0, len(starts), copies):
            assert all(x == starts[i] for x in starts[i : i + copies]) and starts[i][0] == at
            at += starts[i][1]
        assert at == key[1]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(empty).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "\u00a0", "a", "7", "#", "\u00e9 ", "x\u3000"])
def test_long_runs_are_encoded(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparkcohort.llm.packing import _encoder

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for n in (9_000, 300_000):
        t = run * n + " end\n" + run * 3 + "x"
        assert _encoder("byte_bpe_50k.json")(t) == slow.encode(t, add_special_tokens=False).ids
    assert len(_encoder("byte_bpe_50k.json")(run * (2_000_000 // len(run)))) > 1000


def test_first_fit_is_first_fit():
    from sparkcohort.llm.packing import first_fit

    r = random.Random(3)
    for _ in range(30):
        sizes = sorted((r.randint(1, 60) for _ in range(r.randint(0, 80))), reverse=True)
        rooms, want = [], []
        for s in sizes:
            b = next((i for i, x in enumerate(rooms) if x >= s), len(rooms))
            if b == len(rooms):
                rooms.append(100)
            want.append((b, 100 - rooms[b]))
            rooms[b] -= s
        assert first_fit(sizes, 100) == want


def test_packing_leaves_little_padding(spark):
    from sparkcohort.llm.queries import op5_packing

    got = op5_packing(spark, SMALL).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    full = [r.n for r in got.collect()]
    assert sum(1024 - n for n in full if n & (n - 1)) < 0.02 * sum(full)


# 6 ---------------------------------------------------------------------------------------------------------------


def test_cotraining_held_out(spark):
    from sparkcohort.llm.cotraining import keep_good, quality_scores

    r = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        kind = r.choice(["good", "good", "good", "junk", "rude"])
        t = text(r.randint(40, 90), i)
        if kind == "junk":
            t = " | ".join(t.upper().split()) + " $$$"
        if kind == "rude":
            w = t.split()
            for at in r.sample(range(len(w)), 3):
                w[at] = r.choice(["nasty", "vile"])
            t = " ".join(w)
        rows.append((i, t, "en", "a" if kind == "good" else r.choice("ab"), len(t)))
        if i % 3:
            labels.append((i, int(kind != "junk"), int(kind == "rude")))
        rows[-1] = (*rows[-1], kind)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_scores(docs, lab).join(docs.select("doc_id", "kind"), "doc_id").filter("doc_id % 3 = 0").collect()
    right = sum(x.kept == (x.kind == "good") for x in got) / len(got)
    assert right > 0.93
    kept = keep_good(docs, lab)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in quality_scores(docs, lab).filter("kept").collect()}


def test_cotraining_matches_its_plain_version(spark, docs):
    """All rows in one process, each pass over the unlabelled ones a plain loop; labelled nulls, empties and long texts."""
    from sparkcohort.llm import cotraining as ct

    r, extra = random.Random(3), []
    for i in range(400):
        t = text(r.randint(20, 60), i)
        extra.append((100 + i, t if i % 3 else t.upper() + " $$ $$", "de", "a" if i % 3 else "b", len(t)))
    frame = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)
    lab = [(100 + i, int(i % 3 > 0), 0) for i in range(160)] + [(4, 0, 0), (5, 0, 0), (6, 0, 0), (10, 1, 0), (12, 1, 0)]
    labels = spark.createDataFrame(lab, "doc_id bigint, quality int, toxic int")
    rows = [tuple(x) for x in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = {d: int(q == 1 and not x) for d, q, x in lab}
    views = [(ct.text_features((t or "").encode()), ct.meta_features(*m)) for _, t, *m in rows]
    known = sorted((good[d], v[0].tobytes(), v[1].tobytes()) for (d, *_), v in zip(rows, views, strict=True) if d in good)
    rest = [v for (d, *_), v in zip(rows, views, strict=True) if d not in good]

    def taught_by(weights):
        total = [np.zeros((2, size + 1), dtype=np.int64) for size in ct.SIZES]
        for v in rest:
            for own, size in enumerate(ct.SIZES):
                z = weights[1 - own][v[1 - own]].sum() + weights[1 - own][-1]
                p = 1 / (1 + np.exp(-min(30, max(-30, z))))
                for side, sure in ((0, p >= 0.97), (1, p <= 0.03)):
                    if sure:
                        total[own][side][v[own]] += 1
                        total[own][side][-1] += 1
        return total

    model = ct.co_train(np.array([k[0] for k in known]), [np.frombuffer(k[1], dtype=np.int32) for k in known], [np.frombuffer(k[2], dtype=np.int32) for k in known], taught_by)
    assert taught_by(model.views)[0][:, -1].sum() > 50
    want = model.probabilities(*(ct.Rows.of([v[i] for v in views]) for i in (0, 1)))[2]
    got = [(x.doc_id, round(x.probability, 6)) for x in ct.quality_scores(frame, labels).collect()]
    same(got, [(d, round(float(p), 6)) for (d, *_), p in zip(rows, want, strict=True)])
    kept = ct.keep_good(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(p >= 0.6 for p in want)


def test_cotraining_edges(spark, docs, empty):
    from sparkcohort.llm.cotraining import quality_scores

    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.probability for r in quality_scores(docs, none).collect()] == [1.0] * len(ROWS)
    assert quality_scores(empty, none).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------

PERSONAL = [
    (1, "mail a.b+c@ex-ample.co.uk or a@b, x@y.z%w@v.u! é ü: q@r.st."),
    (2, "ip 1.2.3.4 and 256.1.1.1, 1.2.3.4.5.6.7.8 or 001.002.003.004 9999999999999999.1.1.1"),
    (3, "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 12 3"),
    (4, "call +1 (555) 010-9999, +49.30.1234567 or +1-2 and ++44 20 7946 0958"),
    (5, None),
    (6, ""),
    (7, "a" * 30000 + "@" + "b.c" * 10000),
    (8, "1 " * 30000),
    (9, "9" * 30000),
    (None, "null@id.org"),
    (11, "same@id.org"),
    (11, "same@id.org"),
]


def test_personal_data(spark):
    from sparkcohort.llm.pii import find_personal_data

    df = spark.createDataFrame(PERSONAL, "doc_id bigint, text string").select("*", *(F.lit(1).alias(c) for c in ("row", "x", "spans", "contexts", "term", "kind")))
    got = find_personal_data(df)
    same([tuple(r)[:6] for r in got.collect()], brute.personal(PERSONAL))
    assert find_personal_data(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_disclosing_terms(spark):
    from sparkcohort.llm.pii import find_personal_data, sanitise

    rows = [(i, f"{text(12, i)} Contact Marlowe at phil@agency.com {text(12, 100 + i)}") for i in range(5)]
    rows += [(50 + i, f"{text(40, 200 + i)} write info@firm{i}.com please") for i in range(30)]
    rows += [(90, "copied Quixote mail copy@x.org"), (91, "copied Quixote mail copy@x.org"), (92, "copied Quixote mail copy@x.org")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    for i in range(5):
        at = rows[i][1].index("Marlowe")
        assert f"term:{at}:{at + 7}" in got[i].spans and got[i].spans.startswith("email:")
    assert all(got[50 + i].n_terms == 0 for i in range(30))
    assert got[90].n_terms == 0  # copies of one context are no evidence
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert "Marlowe" not in clean[0] and "[EMAIL]" in clean[0] and "phil@" not in clean[0]
    assert clean[50] == rows[5][1].replace("info@firm0.com", "[EMAIL]")


def test_disclosing_terms_of_whole_texts(spark):
    from sparkcohort.llm.pii import find_personal_data, sanitise

    # the name is far from the address, twice in a text, and once in a text without the address
    rows = [(i, f"Marlowe {text(30, i)} Marlowe {text(30, 60 + i)} mail phil@agency.com") for i in range(5)]
    rows += [(50 + i, f"{text(60, 200 + i)} mail info@firm{i}.com") for i in range(30)]
    rows += [(95, f"{text(60, 400)} MARLOWE said")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    for d, t in rows[:5] + rows[-1:]:
        places = [i for i in range(len(t)) if t[i : i + 7].lower() == "marlowe"]
        assert got[d].n_terms == len(places) and all(f":{i}:{i + 7}" in got[d].spans for i in places)
    assert all(got[50 + i].n_terms == 0 for i in range(30))
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert not any("marlowe" in clean[d].lower() for d in (0, 1, 2, 3, 4, 95))


def test_personal_data_with_many_matches(spark):
    import time

    from sparkcohort.llm.pii import find_personal_data, sanitise

    name = "Marlowe says 10.0.0.1, write phil@agency.com now "
    rows = [(i, f"{text(8, i)} {name * (1 if i else 2000)}") for i in range(4)] + [(9, "12," * 100_000), (10, "+1 202 555 0147 x@y.org, " * 20_000)]
    rows += [(50 + i, f"{text(20, 200 + i)} info@firm{i}.com") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    assert [tuple(got[d])[:6] for d, _ in rows] == brute.personal(rows)
    assert got[10].n_phone == got[10].n_email == 20_000 and got[0].n_terms >= 2000
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert clean[9] == rows[4][1] and clean[10] == "[PHONE] [EMAIL], " * 20_000
    assert "Marlowe" not in clean[0] and clean[0].count("[EMAIL]") == clean[0].count("[IP]") == 2000
    assert time.time() - began < 120


def test_generalised_terms(spark):
    from sparkcohort.llm.pii import sanitise

    rows = [(i, f"{text(9, i)} Gregor mail me@x{i % 3}.org") for i in range(12)] + [(50 + i, f"{text(9, 99 + i)} mail a@b{i}.org") for i in range(40)]
    clean = {r.doc_id: r.text for r in sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all("Gregor" not in clean[i] and "[NAME] mail [EMAIL]" in clean[i] for i in range(12))


# 8 ---------------------------------------------------------------------------------------------------------------


def test_quality_rules(spark, docs, empty, monkeypatch):
    from sparkcohort.llm import quality_rules

    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = [*ROWS, (30, "a b c a b c a b\n#*$\n\n a b\n#*$\r\n|x|"), (31, "dup line\ndup line\n" + text(80, 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *(F.lit(1).alias(c) for c in ("x", "w", "n", "s", "z", "p", "l", "ll")))
    got = quality_rules.quality_verdicts(df)
    same([tuple(r[n] for n in names) for r in got.collect()], brute.measures(rows))
    assert got.filter("kept AND base_failed").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    real = quality_rules._hash
    for weak in (lambda w, i: F.lit(7).cast("long"), lambda w, i: F.pmod(real(w, i), F.lit(5))):  # hashes that clash are told apart
        monkeypatch.setattr(quality_rules, "_hash", weak)
        same([tuple(r[n] for n in names) for r in quality_rules.quality_verdicts(df).collect()], brute.measures(rows))
    assert quality_rules.quality_verdicts(empty).count() == 0


def test_estimated_accuracies():
    from collections import Counter

    from sparkcohort.llm.quality_rules import estimate, posterior

    r = random.Random(1)
    right, truth = (0.95, 0.85, 0.7, 0.55), []
    for _ in range(6000):
        good = r.random() < 0.7
        truth.append((good, tuple(0 if r.random() < 0.2 else (1 if good == (r.random() < a) else -1) for a in right)))
    good, table = estimate(list(Counter(v for _, v in truth).items()))
    assert abs(good - 0.7) < 0.05
    guess = sum((posterior(v, good, table) >= 0.5) == g for g, v in truth) / len(truth)
    majority = sum((sum(v) >= 0) == g for g, v in truth) / len(truth)
    assert guess > majority


# 9 ---------------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    from sparkcohort.llm.decontamination import allowed, contaminated, drop_contaminated, words_of

    r = random.Random(2)
    items = [(i, text(r.choice([6, 10, 14, 25, 40, 60]), 1000 + i)) for i in range(30)] + [(90, None), (91, ""), (3, text(25, 1))]
    rows = [(i, text(r.randint(0, 150), i)) for i in range(40)] + [(200, None), (201, ""), (None, items[0][1])]
    for i in range(120):
        item = items[i % 30][1]
        w = item.split()
        for _ in range(r.randint(0, allowed(len(w), 0.2) + 1)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["zz"], [w[at], "zz"], ["yy"]])
        rows.append((300 + i, f"{text(r.randint(0, 40), i)} {' '.join(w).upper()}. {text(r.randint(0, 40), 50 + i)}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("t", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in contaminated(docs, bench).collect()}
    want = {}
    for d, t in rows:
        for i, u in items:
            target = words_of(u)
            if target and (e := brute.best_passage(target, words_of(t))) <= allowed(len(target), 0.2):
                want[d, i] = min(e, want.get((d, i), 99))
    assert all(want[k] <= x.edits for k, x in got.items())
    assert len(got) >= 0.97 * len(want)
    assert all(got[k].edits == e for k, e in want.items() if e == 0)
    for (d, i), x in got.items():
        t = next(words_of(t) for e, t in rows if e == d)
        assert min(brute.edit_distance(t[x.start_word : x.end_word], words_of(u)) for j, u in items if j == i and u) == x.edits
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_recall_and_blocks(spark, monkeypatch):
    from sparkcohort.llm import decontamination
    from sparkcohort.llm.decontamination import allowed, contaminated

    # every planted passage has as many edits as are allowed
    r, rows = random.Random(12), []
    items = [(i, text(r.randint(14, 59), 3000 + i)) for i in range(40)]
    for i in range(200):
        w = items[i % 40][1].split()
        for at in r.sample(range(len(w)), allowed(len(w), 0.2)):
            w[at] = "zz"
        rows.append((i, f"{text(60, i)} {' '.join(w)} {text(60, 500 + i)}"))
    rows += [(900, text(100_000, 8) + " " + items[3][1] + " " + text(100_000, 9)), (901, "  Yes. "), (902, "yes yes"), (903, "one word yes")]
    bench = spark.createDataFrame([*items, (70, "yes"), (71, items[3][1]), (71, items[3][1])], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in contaminated(docs, bench).collect()}
    planted = {(i, i % 40) for i in range(200)}
    assert len(got & planted) >= 0.9 * len(planted)
    assert {(900, 3), (900, 71), (901, 70)} <= got and not got & {(902, 70), (903, 70)}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40_000)
    assert {(x.doc_id, x.item_id) for x in contaminated(docs, bench).collect()} == got


def test_clean_documents_stay_clean(spark):
    from sparkcohort.llm.queries import op9_decontamination

    got = {(r.doc_id, r.item_id) for r in op9_decontamination(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    assert got >= {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}


# 10 --------------------------------------------------------------------------------------------------------------


def test_lm_base(docs, empty):
    from sparkcohort.llm.suffix_lm import lm_scores

    got = lm_scores(docs).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], brute.lm_base(ROWS), 6)
    assert lm_scores(empty).count() == 0


@pytest.mark.parametrize("heavy_share", [1e-6, 0.01, 1.0])
def test_lm_matches_its_plain_version(spark, heavy_share):
    """What is sent out and what is joined must not matter; nulls, repeats and rare words are among the rows."""
    from sparkcohort.llm.suffix_lm import lm_scores

    r = random.Random(4)
    step = {("a", "b"): "c", ("b", "c"): "a", ("c", "a"): "b", ("a", "a"): "b"}
    rows = []
    for i in range(150):
        w = [r.choice("abc"), r.choice("abc")]
        while len(w) < 40:
            w.append(step.get((w[-2], w[-1]), r.choice("abc")) if r.random() < 0.8 else r.choice(["a", "b", "c", f"rare{r.randint(0, 60)}"]))
        rows.append((i, " ".join(w)))
    rows += [(500 + i, text(20, i % 3)) for i in range(30)] + [(900, None), (901, ""), (None, "a b c"), (7, "a B c\n")]
    want = brute.suffix_tree(rows, min_context=20, min_next=3)
    assert {d for d, _ in want["states"]} >= {1, 2}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm_scores(df, min_context=20, min_next=3, heavy_share=heavy_share).collect()
    same([(x.doc_id, x.n_tokens, x.score) for x in got], want["scores"], 6)
    # each state's probabilities add up, what was never seen included
    for state, total in want["states"].items():
        assert total == pytest.approx(1, abs=1e-9), state


def test_lm_slices(monkeypatch):
    """Slices keep all rows in order, one long row or an empty one included, also of a batch that is itself a slice."""
    import pyarrow as pa

    from sparkcohort.llm import suffix_lm

    monkeypatch.setattr(suffix_lm, "SLICE", 5)
    lists = [[1], [], [2] * 40, [3, 4], [5], [6] * 3, [], [7] * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64()))], ["symbols"])
    for one, want in ((batch, lists), (batch.slice(3), lists[3:]), (batch.slice(0, 0), [])):
        parts = list(suffix_lm._symbol_slices([one], 0))
        assert [x for p in parts for x in p.column(0).to_pylist()] == want
        assert all(p.num_rows == 1 or len(p.column(0).flatten()) <= 5 for p in parts)
        flat = [suffix_lm._flat(p.column(0)) for p in parts]
        assert [int(x) for a, _ in flat for x in a] == [x for xs in want for x in xs]
        assert [int(x) for _, b in flat for x in b] == [i for xs in want for i in range(len(xs))]


def test_lm_leaves_little_on_disk(spark, tmp_path, monkeypatch):
    """Rounds and parts don't change a score; no text is stored as a hash a word; nothing but scores and no shuffle file is left."""
    from pathlib import Path

    from sparkcohort.llm import suffix_lm

    r = random.Random(8)
    often = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(r.choice(often) if r.random() < 0.95 else f"rare{r.randint(0, 900)}" for _ in range(200))) for i in range(400)]
    want = brute.suffix_tree(rows, min_context=20, min_next=3)
    made, stored = [], []
    save, drop = suffix_lm.Workspace.save, suffix_lm.Workspace.drop

    def size(path):
        return sum(p.stat().st_size for p in Path(path.removeprefix("file://")).rglob("*.parquet"))

    def saved(self, df, name):
        out = save(self, df, name)
        made.append((self, name))
        if name == "symbols":
            stored.append(size(self.path(name)))
        return out

    monkeypatch.setattr(suffix_lm.Workspace, "save", saved)
    shuffles = lambda: {p for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*")}
    monkeypatch.setattr(suffix_lm, "PART_FILES", 1)
    before = shuffles()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = suffix_lm.lm_scores(df, min_context=20, min_next=3, heavy_share=1e-3)
    assert not shuffles() - before
    same([(x.doc_id, x.n_tokens, x.score) for x in got.collect()], want["scores"], 6)
    names = {name for _, name in made}
    assert {"counts1/0", "counts1/3", "scores0", "scores4"} <= names
    assert stored[0] < 4 * 201 * 400
    assert {name for ws, name in made if size(ws.path(name))} == {f"scores{k}" for k in range(5)}


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_lm_packs_runs(monkeypatch, depth):
    """Runs are counted exactly, in any rounds and flushes, rare words included, and take a few bytes each where they are shuffled."""
    from collections import Counter
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from sparkcohort.llm import suffix_lm

    r = np.random.RandomState(3)
    texts = [[f"w{int(x)}" if x < 2000 else f"rare{x}" for x in r.zipf(1.3, r.randint(0, 400)) % 2100] for _ in range(300)]
    frequent = np.array([suffix_lm.xxhash.xxh3_64_intdigest(f"w{i}") for i in range(2000)], dtype=np.uint64)
    by_hash = np.argsort(frequent)
    coded = SimpleNamespace(value=(frequent[by_hash], by_hash.astype(np.int32), frequent))
    everything = SimpleNamespace(has=lambda x: np.ones(len(x), dtype=bool))
    gates = SimpleNamespace(value=(everything, everything, None))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([" ".join(w).encode() for w in texts])], ["row", "t"])
    stored = [x.select(["b0", "b1", "b2", "b3", "others"]) for x in suffix_lm._encode([batch], coded)]

    def key(run):
        hashes = [np.array([suffix_lm.xxhash.xxh3_64_intdigest(w)], dtype=np.uint64) for w in run]
        while len(hashes) > 2:
            hashes = [suffix_lm.mix(a, b) for a, b in zip(hashes[:-1], hashes[1:], strict=True)]
        return tuple(int(h.view(np.int64)[0]) for h in hashes)

    runs = Counter(tuple(w[i : i + depth + 1]) for w in ([*x, ""] for x in texts) for i in range(len(w) - depth))
    want = {key(run): n for run, n in runs.items() if n >= 2}
    for flush, rounds in ((1_000_000, 1), (3000, 3)):
        monkeypatch.setattr(suffix_lm, "FLUSH", flush)
        monkeypatch.setattr(suffix_lm, "SLICE", 5000)
        got = {}
        for now in range(rounds):
            packed = list(suffix_lm._count_runs(stored, depth, gates, coded, 4, rounds, now))
            if flush > 3000:
                assert sum(x.column(3).nbytes for x in packed) < 3.5 * (depth + 1) * len(runs)
            for b in range(4):
                mine = [x.filter(pa.compute.equal(x.column(0), b)) for x in packed]
                for out in suffix_lm._sum_runs(mine, depth, coded, 2):
                    for c, lo, n in zip(*(x.to_pylist() for x in out.columns), strict=True):
                        assert (c, lo) not in got
                        got[c, lo] = n
        assert got == want


def test_lm_learns_contexts(spark):
    from sparkcohort.llm.suffix_lm import lm_scores

    r = random.Random(4)
    step = {("a", "b"): "c", ("b", "c"): "a", ("c", "a"): "b"}
    rows = []
    for i in range(400):
        w = r.choice([["a", "b"], ["b", "c"], ["c", "a"]])[:]
        while len(w) < 60:
            w.append(step.get((w[-2], w[-1]), r.choice("abc")) if r.random() < 0.9 else r.choice("abc"))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = [x for x in lm_scores(df).collect() if x.held_out]
    assert sum(x.score for x in held) > 0.7 * sum(x.base_score for x in held)
    one = [x for x in lm_scores(df, max_depth=1).collect() if x.held_out]
    assert sum(x.score for x in held) > sum(x.score for x in one)


# pipeline --------------------------------------------------------------------------------------------------------


def test_near_copies(spark, docs, empty, monkeypatch):
    from sparkcohort.llm import near_copies
    from sparkcohort.llm.near_copies import keep_one

    r, rows = random.Random(8), []
    for i in range(25):
        base = text(r.randint(60, 400), 500 + i)
        rows.append((len(rows), base))
        for j in range(r.randint(0, 4)):
            n = len(base.split())
            rows.append((len(rows), edited(base, r.sample(range(n), max(1, int(n * r.choice([0.003, 0.01, 0.05, 0.2])))), j)))
    rows += [(900, "tiny"), (901, "Tiny "), (902, ""), (903, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).withColumn("root", F.lit(2))
    got = {x.doc_id for x in keep_one(df).collect()}
    want = set(brute.jaccard_groups(rows))
    assert got >= want and len(got - want) <= 0.05 * len(rows)
    monkeypatch.setattr(near_copies, "sized", lambda df, rows=0: df.hint("merge"))
    assert {x.doc_id for x in keep_one(df).collect()} == got
    assert keep_one(df).columns == df.columns
    assert keep_one(empty).count() == 0
    twice = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "same text here")], "doc_id bigint, text string")
    assert [x.doc_id for x in keep_one(twice).collect()] == [1]


@pytest.mark.parametrize("copies", [100, 1000])
def test_variants_of_one_original(spark, copies):
    from sparkcohort.llm.near_copies import keep_one

    # every copy is at 0.8 or more to the original, and copies are below that to one another
    r, base = random.Random(copies), [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for j in range(copies):
        w = base[:]
        for i in r.sample(range(6, 294, 6), 5):
            w[i] = f"new{j}x{i}"
        rows.append((j + 1, " ".join(w)))
    assert set(brute.jaccard_groups(rows[:101])) == {0}
    assert [x.doc_id for x in keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [0]


def test_near_copies_at_the_bound(spark):
    from sparkcohort.llm.near_copies import keep_one

    # appended and truncated texts at a similarity of exactly 0.8, and one shingle below it
    rows = []
    for i in range(60):
        w = [f"t{i}x{j}" for j in range(104)]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w + [f"n{i}x{j}" for j in range(25)]))]
        rows += [(10 * i + 5, " ".join(f"u{i}x{j}" for j in range(104))), (10 * i + 6, " ".join(f"u{i}x{j}" for j in range(84)))]
        rows += [(10 * i + 7, " ".join(f"v{i}x{j}" for j in range(104))), (10 * i + 8, " ".join(f"v{i}x{j}" for j in range(83)))]
    got = {x.doc_id for x in keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == set(brute.jaccard_groups(rows)) == {10 * i + k for i in range(60) for k in (0, 5, 7, 8)}


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    packed = cp.STAGES[-1][1](spark, docs, SMALL)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
