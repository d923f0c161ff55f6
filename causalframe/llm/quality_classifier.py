"""Quality classifier: indicators of n-grams scaled by class log-count ratios, hinge loss by dual coordinate descent."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F, types as T

from causalframe.llm.common import give_back

if TYPE_CHECKING:
    import numpy as np

BUCKETS = 1 << 18
_RUNS = re.compile(rb"([a-z\x80-\xff])[a-z\x80-\xff]*|([A-Z])[A-Z]*|([0-9])[0-9]*|([^A-Za-z0-9\x80-\xff])[^A-Za-z0-9\x80-\xff]*")


def _shape(word: bytes) -> bytes:
    """A word's form: runs of letters, capitals, digits; other characters as their first."""
    return _RUNS.sub(lambda m: b"a" if m[1] else b"A" if m[2] else b"0" if m[3] else m[4], word)


class Features:
    """Distinct hashed n-grams of whole texts: words, pairs of words, and up to three forms of words or repeats in a row."""

    def __init__(self, most: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def _number(self, word: bytes) -> int:
        from xxhash import xxh32_intdigest

        return xxh32_intdigest(word.lower()) << 16 | xxh32_intdigest(_shape(word)) & 0x7FFF

    def of(self, text: bytes | None):
        import numpy as np

        words = (text or b"").split()
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._number(w)
        both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        word, form = both >> np.uint64(16), (both & np.uint64(0x7FFF)) + np.uint64(1)
        form[1:][word[1:] == word[:-1]] = np.uint64(0x8000)  # a word that repeats the one before

        def mix(*parts):
            h = np.zeros(len(parts[0]), np.uint64)
            for p in parts:
                h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return h % np.uint64(BUCKETS)

        one = np.uint64(1)
        grams = [mix(word, word ^ one), mix(word[:-1], word[1:]), mix(form), mix(form[:-1], form[1:]), mix(form[:-2], form[1:-1], form[2:])]
        return np.unique(np.concatenate(grams)).astype(np.int32)


@dataclass
class Model:
    """weights by bucket and a logistic curve on the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features) -> float:
        return (float(self.weights[features].sum()) / max(1.0, len(features) ** 0.5)) + self.bias

    def score(self, features) -> float:
        import math

        z = self.slope * self.margin(features) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _ratios(rows, labels):
    """Class log-count ratios of indicators, smoothed by one."""
    import numpy as np

    counts = []
    for wanted in (1, 0):
        c = np.ones(BUCKETS)
        for f, y in zip(rows, labels):
            if y == wanted:
                c[f] += 1
        counts.append(np.log(c / c.sum()))
    return counts[0] - counts[1]


def _descend(rows, labels, ratios, cost: float, rounds: int, seed: int):
    """A linear support vector machine on scaled indicators, by dual coordinate descent; (weights with ratios, bias)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    scaled = [ratios[f] / max(1.0, len(f) ** 0.5) for f in rows]
    norms = [float(x @ x) + 1.0 for x in scaled]
    sign = [1.0 if y else -1.0 for y in labels]
    weights, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, x, y = rows[i], scaled[i], sign[i]
            gradient = y * (float(weights[f] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                moved = max(moved, abs(step))
                weights[f] += step * x
                bias += step
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights * ratios, bias


def fit(rows: list, labels: list[int], *, cost: float = 1.0, rounds: int = 15, seed: int = 7) -> Model:
    """Fit on lists of features and labels 0 or 1. The logistic curve is fitted to margins of three folds left out in turn.

    With one class only, every score is that class's share: 1 or 0; without rows it is 0.5.
    """
    import numpy as np

    if len(set(labels)) < 2:
        share = 0.5 if not labels else float(labels[0])
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, {0.5: 0.0, 1.0: 30.0, 0.0: -30.0}[share])
    margins = np.zeros(len(rows))
    for fold in range(3):
        part = [i for i in range(len(rows)) if i % 3 != fold]
        if len({labels[i] for i in part}) < 2:
            part = list(range(len(rows)))
        w, b = _descend([rows[i] for i in part], [labels[i] for i in part], _ratios([rows[i] for i in part], [labels[i] for i in part]), cost, rounds, seed)
        m = Model(w, b, 1, 0)
        for i in range(fold, len(rows), 3):
            margins[i] = m.margin(rows[i])
    y = np.array(labels, float)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):  # Newton steps on the logistic loss with a little ridge
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margins * margins).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-8:
            break
    w, b = _descend(rows, labels, _ratios(rows, labels), cost, rounds, seed)
    return Model(w.astype(np.float32), b, float(slope), float(offset))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000) -> Model:
    """Fit on at most per_class labelled documents of each class, those with the least hash of their id.

    Only labels of 0 or 1 outside the held-out fold count, and only ids whose labels agree. The chosen ids, at most
    2 * per_class, are broadcast; the driver gets the features of one row of each: of the text with the least hash. As a class beyond per_class is thinned, the offset is
    moved by the log of the shares taken, so that scores follow the classes' frequency among all these labels.
    """
    import math

    agreed = labels.where(F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    chosen = None
    for y in (0, 1):
        part = agreed.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "label")
        chosen = part if chosen is None else chosen.union(part)

    def run(batches):
        import pyarrow as pa

        features = Features()
        for batch in batches:
            found = [features.of(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "features", "label"])

    import numpy as np

    own, theirs = docs.select(F.col("doc_id").cast("string"), "text"), chosen.select(F.col("doc_id").cast("string"), F.col("label").cast("int"))
    rows = own.join(F.broadcast(theirs), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.coalesce(F.xxhash64("text"), F.lit(0))).alias("r"))
    picked = rows.select("doc_id", "r.text", "r.label").mapInArrow(run, "doc_id string, features binary, label int").collect()
    got = sorted((len(r["doc_id"]), r["doc_id"], bytes(r["features"]), r["label"]) for r in picked)
    got = [x[1:] for x in got]
    model = fit([np.frombuffer(f, np.int32) for _, f, _ in got], [y for _, _, y in got])
    if len({y for _, _, y in got}) == 2:
        taken = {r["label"]: r["count"] / min(r["count"], per_class) for r in agreed.groupBy("label").count().collect()}
        model.offset += math.log(taken[1] / taken[0])
    return model


def classify(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, threshold: float = 0.3) -> DataFrame:
    """The documents' columns and held_out, score, predicted.

    score (0 to 1) depends on the whole text alone; predicted is 1 from `threshold` on. held_out marks the fold that
    training never sees. A null or empty text is scored as a text without n-grams. A null id is not held out. Repeated
    rows are kept; a column of the input named like a result, in any case of letters, is replaced. Ids may be of any type
    that casts to text. An empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class=per_class))
    own = [f for f in docs.schema.fields if f.name.lower() not in ("held_out", "score", "predicted")]
    at = [f.name for f in own].index("text")

    def run(batches):
        import pyarrow as pa

        features, m = Features(), model.value
        for batch in batches:
            scores = [m.score(features.of(t)) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*(f.name for f in own), "score"])
        del features
        give_back()

    schema = T.StructType([*own, T.StructField("score", T.DoubleType())])
    scored = docs.select(*[F.col(f"`{f.name}`") for f in own]).mapInArrow(run, schema)
    names = [F.col(f"`{f.name}`") for f in own]
    return scored.select(*names, F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
