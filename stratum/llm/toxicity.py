"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models; each later model has the
earlier categories' log-odds among its features. In training these come from models that didn't see
the row: folds are dealt by a hash of the text, so copies of a text share a fold, and each category's
out-of-fold predictions feed the next. The category's threshold is the lowest at which the out-of-fold
predictions reach ``precision``, if that finds half of the positives; else that of the best F1.

Features are the presence of words (ASCII letters in lower case, ASCII punctuation as space). Of words in at least ``min_docs``
training texts each category takes those with the largest likelihood ratio against independence (its
root is about in standard errors).

The fit takes at most ``max_rows`` labelled rows, those with the smallest hash of their id, each text
once (of documents with the same id the text with the smallest hash): that bound is a parameter, and the sample goes to one task. Scoring covers every row and whole texts, is
a map without a shuffle, and ships a model of at most ``max_features`` words.

Null text counts as empty. Rows without a label score as all others; null labels are left out of that
category's fit. With no rows, or only one class, a category's probability is constant and nothing is flagged.
Repeated rows score alike.
"""

from __future__ import annotations

import json
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TABLE = bytes.maketrans(string.punctuation.encode() + string.ascii_uppercase.encode(), b" " * len(string.punctuation) + string.ascii_lowercase.encode())


@dataclass(frozen=True)
class Chain:
    max_rows: int = 10_000
    max_features: int = 400
    min_docs: int = 5
    least_z: float = 4.0
    folds: int = 5
    l2: float = 3.0
    steps: int = 200
    precision: float = 0.97


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)  # per category: words, earlier categories, bias
    thresholds: list[float] = field(default_factory=list)


def word_set(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_TABLE).split())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Weights and bias (last, not penalised) by accelerated gradient descent with the step of the curvature's bound."""
    n, k = x.shape
    rate = (y.sum() + 1) / (n + 2)
    w = np.zeros(k + 1)
    w[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    v = np.ones(k + 1)
    for _ in range(20):
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(x1 @ v) ** 2 * 1.05 + l2)
    penal = np.full(k + 1, l2)
    penal[-1] = 0
    z, t = w.copy(), 1.0
    for _ in range(steps):
        new = z - step * (x1.T @ (_sigmoid(x1 @ z) - y) + penal * z)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    last = np.append(p[1:] < p[:-1], True) if len(p) else np.array([], bool)
    n = np.arange(1, len(p) + 1)
    ok = last & (hits >= precision * n) & (hits > 0) & (p > 0.5 * y.mean() if len(p) else True)
    if not len(p) or not hits[-1]:
        return 1.1
    at = np.nonzero(ok)[0]
    if len(at) and hits[at[-1]] >= hits[-1] / 2:
        return float(p[at[-1]])
    f1 = np.where(last, 2 * hits / (n + hits[-1]), 0)
    return float(p[int(f1.argmax())])


def _root_g2(both: int, word: int, positive: int, n: int) -> float:
    """Root of the likelihood-ratio statistic of a word's presence and a category."""
    total = 0.0
    for got, row, col in ((both, word, positive), (word - both, word, n - positive), (positive - both, n - word, positive), (n - word - positive + both, n - word, n - positive)):
        if got:
            total += got * np.log(got * n / (row * col))
    return max(2 * total, 0.0) ** 0.5


def fit(texts: list[str | None], labels: np.ndarray, categories: list[str], chain: Chain = Chain()) -> Model:
    """``labels``: rows by categories, nan where unknown."""
    seen: dict[int, int] = {}
    for i, t in enumerate(texts):
        seen.setdefault(zlib.crc32((t or "").encode()) | len(t or "") << 32, i)
    rows = sorted(seen.items())
    sets = [word_set(texts[i]) for _, i in rows]
    labels = labels[[i for _, i in rows]] if rows else np.zeros((0, len(categories)))
    fold = np.array([zlib.crc32(str(h).encode()) % chain.folds for h, _ in rows], int)
    total = Counter(w for s in sets for w in s)
    pick: set[bytes] = set()
    for k in range(len(categories)):
        known = ~np.isnan(labels[:, k])
        pos = [s for s, a, b in zip(sets, known, labels[:, k]) if a and b > 0.5]
        n1, n0 = len(pos), int(known.sum()) - len(pos)
        if not n1 or not n0:
            continue
        have, among = Counter(w for s in pos for w in s), total if known.all() else Counter(w for s, a in zip(sets, known) if a for w in s)
        root = {w: _root_g2(have[w], c, n1, n1 + n0) for w, c in among.items() if c >= chain.min_docs}
        best = sorted((w for w in root if root[w] >= chain.least_z), key=lambda w: (-root[w], w))
        pick.update(best[: chain.max_features // len(categories)])
    words = sorted(pick)
    at = {w: j for j, w in enumerate(words)}
    x = np.zeros((len(sets), len(words)), np.float64)
    for i, s in enumerate(sets):
        x[i, [at[w] for w in s if w in at]] = 1
    model = Model([w.decode(errors="replace") for w in words], categories)
    for k in range(len(categories)):
        known = np.nonzero(~np.isnan(labels[:, k]))[0]
        y = labels[known, k]
        out = np.full(len(sets), 0.5)
        for f in range(chain.folds):
            w = fit_logistic(x[known[fold[known] != f]], y[fold[known] != f], chain.l2, chain.steps)
            out[fold == f] = _sigmoid(x[fold == f] @ w[:-1] + w[-1])
        model.weights.append(fit_logistic(x[known], y, chain.l2, chain.steps).tolist())
        model.thresholds.append(_threshold(out[known], y, chain.precision))
        x = np.hstack([x, _logit(out)[:, None]])
    return model


def predict(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probabilities, rows by categories."""
    at = {w.encode(): j for j, w in enumerate(model.words)}
    keys, n = at.keys(), len(model.words)
    w = np.array([row[:n] for row in model.weights]).reshape(len(model.categories), n)
    out = np.zeros((len(texts), len(model.categories)))
    for i, t in enumerate(texts):
        found = [at[x] for x in keys & word_set(t)]
        out[i] = w[:, found].sum(axis=1)
    for k, row in enumerate(model.weights):
        out[:, k] = _sigmoid(out[:, k] + _logit(out[:, :k]) @ np.array(row[n:-1]) + row[-1])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], chain: Chain = Chain(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits the chain in one task on the sample. ``categories``: name -> SQL expression over ``labels``."""
    names = list(categories)
    chosen = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), *[F.expr(e).cast("double").alias(f"y{k}") for k, e in enumerate(categories.values())])
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(chain.max_rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # A text for each id before the labels join, so the sample has max_rows rows at most, however often an id occurs.
    one = texts.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    sample = one.join(F.broadcast(chosen), "id").select("t.text", *[f"y{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b.to_pydict() for b in batches]
        t = [x for r in rows for x in r["text"]]
        y = np.array([[np.nan if v is None else v for r in rows for v in r[f"y{k}"]] for k in range(len(names))], float).T.reshape(len(t), len(names))
        yield pa.RecordBatch.from_pydict({"model": [json.dumps(asdict(fit(t, y, names, chain)))]})

    rows = sample.repartition(1).mapInArrow(run, "model string").collect()
    return Model(**json.loads(rows[0].model)) if rows else fit([], np.zeros((0, len(names))), names, chain)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns row (of ``keep``, else of all columns), p_<category> and is_<category> for each category."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = packed.drop("text").schema
    for c in model.categories:
        schema = schema.add(f"p_{c}", "double").add(f"is_{c}", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = predict(model, b.column("text").to_pylist())
            cols, names = [b.column("row")], ["row"]
            for k, c in enumerate(model.categories):
                cols += [pa.array(p[:, k]), pa.array(p[:, k] >= model.thresholds[k])]
                names += [f"p_{c}", f"is_{c}"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return packed.mapInArrow(run, schema)
