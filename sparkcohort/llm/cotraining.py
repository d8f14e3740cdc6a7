"""Document quality by co-training a text view and a metadata view.

Each view has a logistic classifier over hashed indicator features, fitted on
labelled rows.  In each round both views label *all* unlabelled documents in one
distributed pass, and their confident labels teach the *other* view: what that view
sees on the documents of either label is counted, feature by feature, over the
whole corpus.  The counts scale the view's features, and give it a second, counting
classifier; held-out labelled rows decide how much each of the two says.  Both views
are combined by a small logistic model; the combination scores every row.

Only the labelled rows are a bounded sample: about ``max_labelled`` of them, chosen
by a hash of doc_id.  What is gathered from unlabelled rows is a count for each
feature, whatever their number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.llm.common import Workspace, text_slices

TEXT_BITS, META_BITS = 17, 12
STEM = 5
#: What a document taught by the other view counts beside a labelled one.
TAUGHT = 0.3
SIZES = (1 << TEXT_BITS, 1 << META_BITS)
EDGE = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
LETTERS = bytes(range(65, 91))


def _bin(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


SHARES = (0.001, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.8)


def text_features(text: bytes) -> np.ndarray:
    """Indices of a text's indicators: its different words, beginnings that several of them share, and binned shape measures.

    A shared beginning marks a family of words (one stem, many endings) of which each word alone is rare.
    """
    words = text.split()
    different = set(text.lower().split())
    digest, top = xxhash.xxh3_64_intdigest, (1 << TEXT_BITS) - 1
    bare = {EDGE.sub(b"", w) or w for w in different}
    found = {digest(w) & top for w in bare}
    for stem, many in Counter(w.decode(errors="replace")[:STEM] for w in bare if len(w) > STEM).items():
        for least in (2, 3):
            if many >= least:
                found.add(digest(f"\x00{least} of {stem}") & top)
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    plain = len(text.translate(None, b"#*$%&|<>!"))
    shape = {
        "words": _bin(len(words), (1, 5, 20, 50, 100, 300, 1000, 5000)),
        "length": _bin(sum(map(len, words)) / n, (2, 3, 4, 5, 6, 8, 10, 14, 20)),
        "caps": _bin((size - len(text.translate(None, LETTERS))) / size, SHARES),
        "digits": _bin((size - len(text.translate(None, b"0123456789"))) / size, SHARES),
        "symbols": _bin((size - plain) / size, SHARES),
        "different": _bin(len(different) / n, SHARES),
        "again": _bin(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, SHARES),
        "lines": _bin(1 - len(set(lines)) / max(1, len(lines)), SHARES),
    }
    found |= {digest(f"\x00{k}={v}".encode()) & top for k, v in shape.items()}
    return np.array(sorted(found), dtype=np.int32)


def meta_features(lang, source, n_chars) -> np.ndarray:
    """Indices of the indicators of a page's metadata; nulls have indicators of their own."""
    size = -1 if n_chars is None else int(math.log2(max(1, n_chars)) * 2)
    facts = (f"lang={lang}", f"source={source}", f"size={size}", f"lang,source={lang},{source}", f"lang,size={lang},{size}", f"source,size={source},{size // 2}")
    return np.array(sorted({xxhash.xxh3_64_intdigest(x) & ((1 << META_BITS) - 1) for x in facts}), dtype=np.int32)


def _views(part: pa.RecordBatch):
    """Features of both views from columns t, lang, source, n_chars."""
    cols = {n: part.column(n) for n in ("t", "lang", "source", "n_chars")}
    text = [text_features(t or b"") for t in cols["t"].to_pylist()]
    meta = [meta_features(*x) for x in zip(*(cols[n].to_pylist() for n in ("lang", "source", "n_chars")), strict=True)]
    return text, meta


FEATURES = "doc_id long, label int, text array<int>, meta array<int>"


def _feature_batches(batches):
    for batch in batches:
        for part in text_slices(batch, batch.schema.get_field_index("t")):
            views = [pa.array([x.tolist() for x in v], pa.list_(pa.int32())) for v in _views(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *views], ["doc_id", "label", "text", "meta"])


class Rows:
    """Sparse indicator rows in one index array."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray):
        self.index, self.sizes = index, sizes
        self.row = np.repeat(np.arange(len(sizes)), sizes)

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32), np.array([len(r) for r in rows], dtype=np.int64))

    @classmethod
    def column(cls, column: pa.ListArray) -> Rows:
        return cls(column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()).astype(np.int64))

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.index], minlength=len(self.sizes)) + weights[-1]

    def counts(self, taken: np.ndarray, size: int) -> np.ndarray:
        """Times each feature is in the taken rows, and at the end the number of rows."""
        return np.append(np.bincount(self.index[taken[self.row]], minlength=size), taken.sum()).astype(np.int64)


def _ratios(counts: np.ndarray, size: int) -> np.ndarray:
    """Log of each feature's share of the good rows over that of the bad ones, from counts (2 x size + 1)."""
    good, bad = (np.log((c[:-1] + 0.5) / (c[-1] + 1)) for c in counts.astype(float))
    return np.append(good - bad, 0.0)


def fit_logistic(rows: Rows, y: np.ndarray, size: int, taught: np.ndarray, penalty: float = 10.0, steps: int = 60) -> np.ndarray:
    """Weights (the last is the intercept) of a penalised logistic model over indicators scaled by
    their log-count ratio between the classes, by Adam on the whole sample.

    The scale lets a rare but one-sided indicator weigh in fully and holds common
    ones near zero; it counts the documents that the other view taught as well.
    """
    counts = np.stack([rows.counts(y == 1, size), rows.counts(y == 0, size)]) + TAUGHT * taught
    scale = _ratios(counts, size)
    scale[-1] = 1.0
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(rows.margins(w * scale), -30, 30)))
        error = p - y
        grad = np.bincount(rows.index, weights=error[rows.row], minlength=size + 1) * scale
        grad[-1] = error.sum()
        grad[:-1] += penalty * w[:-1]
        grad /= len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        rate = 0.05 if step < steps * 0.7 else 0.01
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w * scale


def _dense_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps for a few columns, the first of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-9:
            break
    return w


def _mixture(z: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Intercept and weights of some margins; one that would count against itself is left out."""
    use = list(range(len(z)))
    while True:
        w = _dense_logistic(np.stack([np.ones(len(y)), *(z[v] for v in use)], axis=1), y)
        if len(use) < 2 or (w[1:] >= 0).all():
            out = np.zeros(1 + len(z))
            out[[0, *(v + 1 for v in use)]] = w
            return out
        use.remove(use[int(np.argmin(w[1:]))])


class CoTrained:
    """Calibrated weights of both views, and their combination."""

    def __init__(self, views, mix, prior: float):
        self.views, self.mix, self.prior = views, mix, prior

    def probabilities(self, text: Rows, meta: Rows):
        """(text view, metadata view, combined) probabilities of good."""
        if self.views is None:
            same = np.full(len(text.sizes), self.prior)
            return same, same, same
        z = [rows.margins(w) for rows, w in zip((text, meta), self.views, strict=True)]
        z.append(self.mix[0] + self.mix[1] * z[0] + self.mix[2] * z[1])
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z)


def teach(views, text: Rows, meta: Rows, confidence: float) -> list[np.ndarray]:
    """For each view the feature counts (good and bad) of the rows on which the other view is confident."""
    out = []
    for own, other, weights, size in ((text, meta, views[1], SIZES[0]), (meta, text, views[0], SIZES[1])):
        p = 1 / (1 + np.exp(-np.clip(other.margins(weights), -30, 30)))
        out.append(np.stack([own.counts(p >= confidence, size), own.counts(p <= 1 - confidence, size)]))
    return out


def co_train(labels: np.ndarray, text: list[np.ndarray], meta: list[np.ndarray], taught_by: Callable, rounds: int = 3) -> CoTrained:
    """Fit on labelled rows (0 or 1); ``taught_by(views)`` gives both views' counts over all unlabelled rows."""
    if len(labels) < 20 or len(set(labels.tolist())) < 2:
        prior = float((labels.sum() + 1) / (len(labels) + 1)) if len(labels) else 1.0
        return CoTrained(None, None, min(1.0, prior))
    order = np.random.RandomState(5).permutation(len(labels))
    cut = len(order) // 4
    held, train = order[:cut], order[cut:]
    take = lambda rows, at: Rows.of([rows[i] for i in at])
    train_rows, held_rows = [take(v, train) for v in (text, meta)], [take(v, held) for v in (text, meta)]
    y, y_held = labels[train].astype(float), labels[held].astype(float)
    taught = [np.zeros((2, size + 1), dtype=np.int64) for size in SIZES]
    views: list = [None, None]
    for r in range(rounds + 1):
        for v, size in enumerate(SIZES):
            fitted = fit_logistic(train_rows[v], y, size, taught[v])
            counted = _ratios(taught[v], size) if taught[v][:, -1].all() else np.zeros(size + 1)
            a, b, c = _mixture([held_rows[v].margins(fitted), held_rows[v].margins(counted)], y_held)
            views[v] = b * fitted + c * counted
            views[v][-1] += a
        if r < rounds:
            taught = taught_by(views)
    mix = _mixture([rows.margins(w) for rows, w in zip(held_rows, views, strict=True)], y_held)
    return CoTrained(views, mix, float(labels.mean()))


def _teach_batches(batches, views, confidence: float):
    """Sparse counts (view, feature, good, bad) of all rows of a partition; the feature after the last is the number of rows."""
    total = [np.zeros((2, size + 1), dtype=np.int64) for size in SIZES]
    for batch in batches:
        found = teach(views.value, Rows.column(batch.column(0)), Rows.column(batch.column(1)), confidence)
        total = [a + b for a, b in zip(total, found, strict=True)]
    for v, counts in enumerate(total):
        some = np.flatnonzero(counts.any(axis=0))
        arrays = [pa.array(np.full(len(some), v, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some])]
        yield pa.RecordBatch.from_arrays(arrays, ["view", "feature", "good", "bad"])


def _taught(unlabelled: DataFrame, views, confidence: float) -> list[np.ndarray]:
    """``teach`` over a table; at most two numbers for each feature come back."""
    shared = unlabelled.sparkSession.sparkContext.broadcast(views)
    counts = unlabelled.mapInArrow(partial(_teach_batches, views=shared, confidence=confidence), "view int, feature int, good long, bad long")
    got = counts.groupBy("view", "feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    shared.unpersist()
    view, feature, good, bad = (got.column(i).to_numpy() for i in range(4))
    out = []
    for v, size in enumerate(SIZES):
        table, mine = np.zeros((2, size + 1), dtype=np.int64), view == v
        table[0, feature[mine]], table[1, feature[mine]] = good[mine], bad[mine]
        out.append(table)
    return out


def features(docs: DataFrame, labels: DataFrame, ws: Workspace, max_labelled: int = 16_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text, meta) of every row, written: label 1 (quality 1 and toxic 0), 0, or -1 where there is none.

    Rows of ``labels`` with a null label or id teach nothing; of several labels for a
    doc_id the worst holds; of more than ``max_labelled`` about so many are used.
    """
    place = F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(1_000_000))
    known = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy(F.col("doc_id").cast("long").alias("__id"))
    known = known.agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("label"))
    share = min(1.0, max_labelled / max(1, known.count()))
    chosen = known.filter(place < int(1_000_000 * share))  # about max_labelled rows: small enough to send out
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("t"), "lang", "source", "n_chars")
    rows = rows.join(F.broadcast(chosen), "__id", "left").select(F.col("__id").alias("doc_id"), F.coalesce("label", F.lit(-1)).alias("label"), "t", "lang", "source", "n_chars")
    return ws.save(rows.mapInArrow(_feature_batches, FEATURES), "features")


def fit(made: DataFrame, rounds: int = 3, confidence: float = 0.97) -> CoTrained:
    """Learn from a table of ``features``."""
    got = made.filter("label >= 0").select("label", "text", "meta").toArrow()
    y = got.column("label").to_numpy()
    views = []
    for name in ("text", "meta"):
        column = got.column(name).combine_chunks()
        flat, edges = column.values.to_numpy(), column.offsets.to_numpy()
        views.append([flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
    # which rows come first depends on the run; their content does not
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), views[0][i].tobytes(), views[1][i].tobytes()))
    unlabelled = made.filter("label < 0").select("text", "meta")
    return co_train(y[order], *([v[i] for i in order] for v in views), partial(_taught, unlabelled, confidence=confidence), rounds)


def _score_batches(batches, model):
    for batch in batches:
        p = model.value.probabilities(Rows.column(batch.column(1)), Rows.column(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p)], ["doc_id", "p_text", "p_meta", "probability"])


def _keep_batches(batches, model, names: list[str], threshold: float):
    for batch in batches:
        for part in text_slices(batch, batch.schema.get_field_index("t")):
            p = model.value.probabilities(*map(Rows.of, _views(part)))[2]
            yield part.select(names).filter(pa.array(p >= threshold))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.6, max_labelled: int = 16_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_text, p_meta, probability, kept) for every row of ``docs``.

    ``docs`` needs lang, source and n_chars, which may be null; a null text is
    empty; bytes that are not UTF-8 count as replacement characters.  With fewer than
    20 labelled rows or one class only, every row has the labels' share of good.
    Null and repeated doc_ids keep their rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "cotraining")
    made = features(docs, labels, ws, max_labelled, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(made))
    rows = made.select("doc_id", "text", "meta")
    scored = rows.mapInArrow(partial(_score_batches, model=model), "doc_id long, p_text double, p_meta double, probability double")
    return scored.withColumn("kept", F.col("probability") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.6, max_labelled: int = 16_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose probability is at least ``threshold``, whole and with all columns.

    Nulls, empty and very long texts and repeated rows are as in ``quality_scores``;
    equal rows stay or go together.  Texts are read again and not joined with
    their scores: no text is shuffled.
    """
    ws = Workspace(docs.sparkSession, "cotraining")
    model = docs.sparkSession.sparkContext.broadcast(fit(features(docs, labels, ws, max_labelled, id_col, text_col)))
    ws.drop("features")
    taken = {c: F.col(c).alias(f"c_{c}") for c in docs.columns}
    needed = [F.col(text_col).cast("binary").alias("t"), "lang", "source", "n_chars"]
    names = [f"c_{c}" for c in docs.columns]
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema, strict=True)])
    kept = docs.select(*taken.values(), *needed).mapInArrow(partial(_keep_batches, model=model, names=names, threshold=threshold), schema)
    return kept.toDF(*docs.columns)
