"""Quality classifier: a generalised additive model with pairwise interactions.

Every whole text gives FEATURES numbers.  Each is binned, and boosting goes round the features in
turn: a tree of at most three leaves is fitted to the current residuals over one feature's bins and
added, shrunk, to that feature's lookup table.  Then the pairs whose best four-leaf split gains most
are boosted in the same way into two-dimensional tables.  A score is the sum of the looked-up
values, taken for a whole batch at once, through the logistic function.

Training uses labelled rows only, MAX_ROWS of them at most (lowest hash of the id first); their
features, not their texts, reach the driver.

Cases with a defined result
    null or empty text: all features zero; scored like any other
    very long text: read whole, in one linear pass
    null or repeated ids: each row is scored on its own text; null ids are held in (never held out)
    ties: rows of equal hash are taken by id, splits of equal gain by place
    extra columns, whatever their names: not read
    no labelled rows, or one class only: every score is that class's share (0.5 with none)
    empty table: an empty result
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship
from .quality_rules import repeat_words

FEATURES = (
    "log_words", "word_length", "symbols", "bars", "marks", "upper", "digits", "sentence_ends", "commas",
    "non_ascii", "adjacent_repeats", "distinct_words", "repeat_windows", "line_words", "duplicate_lines", "longest_word",
)
#: Labelled rows used at most.
MAX_ROWS = 20_000
MAX_BINS, PAIR_BINS, N_PAIRS = 64, 12, 8
ROUNDS, RATE, MIN_HESSIAN, PENALTY = 150, 0.1, 2.0, 1.0
CUT = 0.7


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = max(1, int(c.sum() - c[[32, 9, 10, 11, 12, 13]].sum()))
    of = lambda s: float(c[list(s)].sum())
    upper, lower = float(c[65:91].sum()), float(c[97:123].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), total / n, of(b"#*$%&<>") / n, of(b"|") / n, of(b"!") / n, upper / max(1.0, upper + lower), float(c[48:58].sum()) / total,
        of(b".?") / n, of(b",;:") / n, float(c[128:].sum()) / total, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(words)) / n, repeat_words(words) / n, float(np.log1p(n / max(1, len(lines)))), (len(lines) - len(set(lines))) / max(1, len(lines)),
        float(np.log1p(max(map(len, words)))),
    ]


@dataclass
class Gam:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of x: bin numbers, then table values summed."""
        total = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            used = sorted({k for i, j, _ in self.pairs for k in (i, j)})
            at = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for k in used}
            for i, j, t in self.pairs:
                total += t[at[i], at[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return q[q > x.min()] if len(q) else q


def _value(g, h):
    return -g / (h + PENALTY)


def _gain(g, h):
    return g * g / (h + PENALTY)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN), _gain(gl, hl) + _gain(gr, hr) - _gain(g.sum(), h.sum()), 0)
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree with three leaves at most."""
    _, cut = _best_cut(g, h)
    if not cut:
        return np.zeros(len(g))
    sides = [(0, cut), (cut, len(g))]
    inner = [_best_cut(g[a:b], h[a:b]) for a, b in sides]
    k = int(inner[1][0] > inner[0][0])
    if inner[k][1]:
        a, b = sides[k]
        sides[k : k + 1] = [(a, a + inner[k][1]), (a + inner[k][1], b)]
    out = np.zeros(len(g))
    for a, b in sides:
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def _best_cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best split of a two-dimensional table into four quarters."""
    cg, ch = (np.cumsum(np.cumsum(m, 0), 1) for m in (g, h))
    tg, th = cg[-1, -1], ch[-1, -1]
    quarters = []
    for c, t in ((cg, tg), (ch, th)):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        quarters.append((a, b, d, t - a - b - d))
    gain = sum(_gain(p, q) for p, q in zip(*quarters, strict=True)) - _gain(tg, th)
    if not gain.size:
        return 0.0, np.zeros(g.shape)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            if h[rows, cols].sum() >= MIN_HESSIAN:
                out[rows, cols] = _value(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    n_features = x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Gam(float(np.log(share / (1 - share))), [np.zeros(0)] * n_features, [np.zeros(1)] * n_features, [], [])
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_edges(x[:, j], MAX_BINS) for j in range(n_features)]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(n_features)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(n_features):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] = model.tables[j] + step
            total += step[bins[j]]

    shape = {j: len(model.coarse[j]) + 1 for j in range(n_features)}

    def flat(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i] * shape[j] + wide[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    gains = sorted(((_best_cross(flat(i, j, g), flat(i, j, h))[0], i, j) for i in range(n_features) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:N_PAIRS] if gain > 1e-6]
    tables = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in chosen}
    for _ in range(ROUNDS // 3):
        for i, j in chosen:
            g, h = slopes()
            step = RATE * _best_cross(flat(i, j, g), flat(i, j, h))[1]
            tables[i, j] += step
            total += step[wide[i], wide[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def held_out(id_col) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """A model of the labelled rows that are not held out."""
    ship(docs.sparkSession)
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(MAX_ROWS)
    met = docs.select(docs[id_col].cast("long").alias("_doc"), docs[text_col].alias("_text")).join(F.broadcast(rows), F.col("_doc") == F.col("_id"))
    found = met.select(F.col("_id").alias("doc_id"), "_label", "_text").mapInArrow(_feature_rows, "doc_id long, label int, x array<double>")
    pdf = found.groupBy("doc_id").agg(F.max(F.struct("label", "x")).alias("r")).select("doc_id", "r.*").toPandas()
    pdf = pdf.sort_values("doc_id")
    x = np.array(pdf["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return train(x, pdf["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    ship(docs.sparkSession)
    m = docs.sparkSession.sparkContext.broadcast(model)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(2)], dtype=float).reshape(-1, len(FEATURES))
            p = m.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(per_task, "doc_id long, held_out boolean, score double, predicted int")
