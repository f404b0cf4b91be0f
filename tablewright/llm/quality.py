"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of a text's byte n-grams (3 and 4 bytes) and word
shapes (a word with its letters and digits folded, pairs of such shapes, and
whether neighbouring words are the same), hashed into ``2**bits`` columns.  Spark counts every feature over all
labelled training rows; its class log-count ratio scales the indicator.  A
linear hinge-loss model (L1 loss, L2 penalty, bias as a column) is fitted to
the scaled indicators by dual coordinate descent, in one task, on a bounded
sample: at most ``max_fit`` training rows, half of each label, those of
smallest hash.
Rows are divided by the root of their number of indicators.  A logistic
curve on the fitted margins turns a margin into a score.

Scoring is one map pass over whole texts; the weights (``2**bits`` doubles)
are broadcast, a size that is fixed by a parameter.  Rows whose label is null
or not 0 or 1 are no training rows.  A doc_id with several labels takes the
largest.

Defined results: null text counts as empty; an empty text has the score of
the bias alone.  With no training rows, or rows of one class only, the model
has no weights and every score is the share of label 1 (0.5 without rows).
Rows that repeat are scored each.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import U64, BlockedBloom, in_slices, mix64, texts

#: Byte classes of a word shape: letters fold to 1, digits to 2, upper case to 3, bytes above 127 to 1; other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_FOLD[0x30:0x3A] = 2
_FOLD[0x41:0x5B] = 3
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_CHUNK = 1 << 20
#: Columns of each pattern of repeated words; one column would drown among the n-grams of a long text.
_RUN_COLUMNS = 16


def features(text: str, bits: int = 18) -> np.ndarray:
    """Sorted distinct feature columns of a whole text (blocks of 1 MiB that overlap by one n-gram)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    found = [_block(raw[i:i + _CHUNK + 64], bits) for i in range(0, max(len(raw), 1), _CHUNK)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _block(raw: np.ndarray, bits: int) -> np.ndarray:
    shift, seen = U64(64 - bits), np.zeros(1 << bits, bool)
    v = raw.astype(U64)
    with np.errstate(over="ignore"):
        for n in (3, 4):
            if len(v) >= n:
                h = v[:len(v) - n + 1].copy()
                for k in range(1, n):
                    h |= v[k:len(v) - n + 1 + k] << U64(8 * k)
                seen[((h + U64(n << 40)) * U64(0x9E3779B97F4A7C15)) >> shift] = True
        inside = np.concatenate(([False], ~_BLANK[raw], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        if len(start):
            folded = _FOLD[raw]
            run = np.concatenate(([True], (folded[1:] != folded[:-1]) | (folded[1:] > 3) | _BLANK[raw[1:]]))
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(np.where(run, mix64(folded.astype(U64) + U64(1)), U64(0)), dtype=U64)))
            shape = mix64(sums[end] - sums[start] + np.where(run[start], U64(0), mix64(folded[start].astype(U64) + U64(1))))
            seen[(mix64(shape + U64(11))) >> shift] = True
            if len(shape) > 1:
                seen[mix64(shape[:-1] * U64(31) + shape[1:] + U64(13)) >> shift] = True
                letters = np.concatenate((np.zeros(1, U64), np.cumsum(_BYTE[raw], dtype=U64)))
                word = letters[end] - letters[start]
                same = (word[1:] == word[:-1]).astype(U64)
                if len(same) > 1:
                    runs = np.unique(same[:-1] * U64(2) + same[1:])
                    for k in range(_RUN_COLUMNS):
                        seen[mix64(runs * U64(64) + U64(k + 1000)) >> shift] = True
    return np.flatnonzero(seen).astype(np.int32)


def held_out(doc_id: str):
    """True for the rows of the held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(lid, y) of the labelled rows outside the held-out fold."""
    return (labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("quality").cast("int").alias("y"))
            .where("lid is not null and y in (0, 1)").groupBy("lid").agg(F.max("y").alias("y")).where(~held_out("lid")))


def labelled_texts(docs: DataFrame, y: DataFrame, n_labels: int) -> DataFrame:
    """(text, y) of the training rows.  A Bloom filter of the labelled ids keeps other texts out of the join's shuffle.

    The join shuffles at every size: a broadcast one would leave the filter and
    the Python step that reads the rows in one task, with a worker for each.
    """
    spark = docs.sparkSession
    keys = y.select(F.xxhash64("lid").alias("k"))
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(keys, "k", n_labels))

    @F.pandas_udf("boolean")
    def listed(k: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.has(k.to_numpy(np.int64).view(np.uint64)))

    rows = texts(docs).where(listed(F.xxhash64("doc_id")))
    return rows.join(y.hint("merge"), rows["doc_id"] == y["lid"]).select("text", "y")


def log_count_ratios(train: DataFrame, bits: int = 18, alpha: float = 1.0) -> np.ndarray:
    """Class log-count ratio of every feature over all training rows.

    Each task counts into two arrays of ``2**bits`` and emits what is not
    zero; Spark sums per feature; the driver gets at most ``2**bits`` rows.
    """
    def count(batches):
        n = np.zeros((2, 1 << bits), np.int64)
        for x in batches:
            for text, y in zip(x["text"], x["y"], strict=True):
                n[y, features(text, bits)] += 1
        at = np.flatnonzero(n.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            part = at[k:k + (1 << 16)]
            yield pd.DataFrame({"feature": part.astype(np.int32), "neg": n[0, part], "pos": n[1, part]})

    schema = "feature int, neg long, pos long"
    rows = (train.select("text", "y").mapInArrow(in_slices(count, schema=schema), schema)
            .groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas())
    n = np.zeros((2, 1 << bits))
    n[0, rows["feature"]], n[1, rows["feature"]] = rows["neg"], rows["pos"]
    p = (n + alpha) / (n + alpha).sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: Callable[[np.ndarray], np.ndarray], y: np.ndarray, width: int, c: float,
                            epochs: int, seed: int = 7, tol: float = 1e-3) -> np.ndarray:
    """Weights (last entry: bias) of the L1-loss linear SVM over sparse rows; y is -1 or 1.

    ``values`` gives a row's values from its columns.  They are taken anew at
    each visit: held for all rows they would be two thirds of the memory.
    """
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in map(values, rows)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v, s = rows[i], values(rows[i]), y[i]
            g = s * (w[r] @ v + w[-1]) - 1.0
            pg = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == c else g
            worst = max(worst, abs(pg))
            if pg:
                old = alpha[i]
                alpha[i] = min(max(old - g / norm[i], 0.0), c)
                step = (alpha[i] - old) * s
                w[r] += step * v
                w[-1] += step
        if worst < tol:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins (a few Newton steps, smoothed targets)."""
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        e, q = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([e @ margin, e.sum()])
        h = np.array([[q @ (margin * margin) + 1e-6, q @ margin], [q @ margin, q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


class QualityModel:
    """Weights per feature column, and the logistic curve of the margin."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, bits: int):
        self.weights, self.bias, self.slope, self.offset, self.bits = weights, bias, slope, offset, bits

    def score(self, text: str) -> float:
        f = features(text, self.bits)
        m = float(self.weights[f].sum()) / max(1.0, np.sqrt(len(f))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def fitted(sample: Iterator[str], y: np.ndarray, ratio: np.ndarray, bits: int, c: float, epochs: int) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, slope and offset of the model fitted to a sample of texts; y is -1 or 1.  Of a text only its columns are held."""
    columns = [features(t, bits) for t in sample]

    def values(r: np.ndarray) -> np.ndarray:
        return ratio[r] / max(1.0, np.sqrt(len(r)))

    w = dual_coordinate_descent(columns, values, y, len(ratio), c, epochs)
    slope, offset = _logistic(np.array([w[r] @ values(r) + w[-1] for r in columns]), y)
    return w[:-1] * ratio, w[-1], slope, offset


def fit(docs: DataFrame, labels: DataFrame, bits: int = 18, c: float = 1.0, epochs: int = 12, max_fit: int = 6000) -> QualityModel:
    """Fit on the labelled rows outside the held-out fold; see the module's text.

    No table is written: the labels, two columns, are read again by each job
    instead.  Executors start a process for each file they write, and a copy
    of one counts as much memory as the executor until it runs its program.
    """
    y = training_labels(labels)
    classes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        share = 0.5 if not classes else float(next(iter(classes)))
        return QualityModel(np.zeros(1 << bits), 0.0, 1.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), bits)
    ratio = log_count_ratios(labelled_texts(docs, y, sum(classes.values())), bits)
    known = y.join(docs.select(F.col("doc_id").cast("long").alias("lid")).distinct(), "lid")
    chosen = [known.where(F.col("y") == k).orderBy(F.xxhash64("lid"), "lid").limit(max_fit // 2) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])                         # at most max_fit rows of 12 bytes
    rows = texts(docs)

    def solve(x: pd.DataFrame) -> pd.DataFrame:
        sign = np.where(x["y"].to_numpy() == 1, 1.0, -1.0)
        weights, bias, slope, offset = fitted(iter(x["text"]), sign, ratio, bits, c, epochs)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    sample = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["lid"]).select("text", "y")
    got = (sample.groupBy().applyInPandas(solve, "weights binary, bias double, slope double, offset double")).collect()
    if not got:
        return QualityModel(np.zeros(1 << bits), 0.0, 1.0, 0.0, bits)
    return QualityModel(np.frombuffer(got[0]["weights"]), got[0]["bias"], got[0]["slope"], got[0]["offset"], bits)


def _scores(model: QualityModel, batch: pa.Array, rows: int = 512) -> Iterator[float]:
    """Score of every text of a batch; few of them at a time are Python strings."""
    for at in range(0, len(batch), rows):
        for text in batch.slice(at, rows).to_pylist():
            yield model.score(text)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; one map pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(_scores(shared.value, text), pa.float64())

    return (texts(docs).select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keeps(docs: DataFrame, model: QualityModel, threshold: float = 0.3):
    """Condition on a documents frame: the model does not reject the row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array((x >= threshold for x in _scores(shared.value, text)), pa.bool_())

    return good(F.coalesce(docs["text"], F.lit("")))
