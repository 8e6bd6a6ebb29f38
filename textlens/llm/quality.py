"""Quality classifier: random Fourier features over document statistics, ridge
regression from normal equations summed over partitions, isotonic calibration.

1. Every document's statistics (character classes, word shapes, repetition)
   are computed once from its whole text.
2. Statistics are scaled and mapped to ``n_features`` random cosines whose
   inner products approximate a Gaussian kernel.
3. Each partition of labelled rows sums its part of the normal equations; the
   parts are added up row by row of the matrix, and the driver solves one
   system of ``n_features + 1`` unknowns.
4. On labelled documents the ridge has not seen, scores are counted in bins
   and pooled into a monotone map to the share of good documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import label_of, staged

_MARKS = b".,!?;:'\"-_()[]{}|#*$%&<>@/\\=+~^`"
_BINS = 400


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all 0 without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * N_STATISTICS
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    lengths = np.fromiter(map(len, words), float, n)
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    upper = sum(map(bytes.isupper, words))
    alpha = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(lengths.mean()), float(lengths.std()),
        float(np.log1p(lengths.max())), len(distinct) / n, (len(pairs) + 1) / n,
        float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), upper / n,
        sum(map(bytes.istitle, words)) / n, float((lengths <= 2).mean()), float((lengths >= 15).mean()),
        float(alpha / size), float(count[65:91].sum() / size), float(count[97:123].sum() / size),
        float(count[48:58].sum() / size), float(count[128:].sum() / size),
        float((count[:9].sum() + count[14:32].sum()) / size), *[float(np.sqrt(count[c] / size)) for c in _MARKS],
    ]


N_STATISTICS = 19 + len(_MARKS)


@dataclass
class QualityModel:
    """Scaling, random features, ridge weights and the calibration map; with
    ``prior`` set nothing could be learnt and it is every text's score."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    prior: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        f = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([f, np.ones((len(f), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return np.interp(self.raw(x), self.knots, self.values)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``value`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x)``: the statistics of every row's whole text."""

    @F.pandas_udf("array<float>")
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([statistics(t) for t in s], dtype=object)

    return docs.select(F.col(id_col).alias("id"), stats(F.col(text_col)).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), N_STATISTICS).astype(float)


def normal_equations(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """The sums of ``f f'`` and ``f y`` (last column) over ``rows(x, label)``."""
    size = len(model.phase) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            f = model.features(_matrix(batch))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            total += f.T @ np.hstack([f, y[:, None]])
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(np.arange(size), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(partial, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size + 1))
    got = cells.toPandas()  # size * (size + 1) numbers
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return out


def fit(labelled: DataFrame, calibration: Column, *, n_features: int = 256, width: float = 1.0, ridge: float = 1e-3,
        max_rows: int = 200_000, seed: int = 10) -> QualityModel:
    """A model of ``labelled(id, x, label)``; rows where ``calibration`` holds
    shape the monotone map, the others the ridge.

    Above ``max_rows`` rows, those of smallest hashed id are used, about
    ``max_rows`` of them.  ``width`` is the Gaussian kernel's width in units of
    the square root of the number of statistics.
    """
    rng = np.random.default_rng(seed)
    omega = rng.standard_normal((N_STATISTICS, n_features)) / (width * np.sqrt(N_STATISTICS))
    phase = rng.uniform(0, 2 * np.pi, n_features)
    share = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("p")).first()
    blank = QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), omega, phase, np.zeros(n_features + 1),
                         np.array([0.0]), np.array([0.0]))
    if not share["n"] or share["p"] in (0.0, 1.0):
        blank.prior = float(share["p"] or 0.0)
        return blank
    if share["n"] > max_rows:
        at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") * 2.0 ** -53
        labelled = labelled.where(at < max_rows / share["n"])
    learn, check = labelled.where(~calibration), labelled.where(calibration)
    each = F.posexplode("x").alias("j", "v")
    moments = learn.select(each).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).toPandas()
    model = blank
    if len(moments):
        j = moments["j"].to_numpy()
        model.mean[j], model.scale[j] = moments["m"].to_numpy(), np.maximum(moments["s"].to_numpy(), 1e-6)
    sums = normal_equations(learn.select("x", "label"), model)
    a, b = sums[:, :-1], sums[:, -1]
    model.weights = np.linalg.solve(a + ridge * max(a[-1, -1], 1.0) / len(a) * np.eye(len(a)), b)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch))), batch.column("label")], ["raw", "label"])

    cell = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * _BINS)
    bins = (check.select("x", "label").mapInArrow(score, "raw double, label int").groupBy(cell.alias("cell"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("label").alias("p"))
            .toPandas().sort_values("cell"))  # at most 2 * _BINS + 1 rows
    if not len(bins):  # too few labels to hold any back
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    raw, n = bins["raw"].to_numpy(float), bins["n"].to_numpy(float)
    level = pool_adjacent(bins["p"].to_numpy(float), n)
    # between the centres of two levels the map is a line, so unequal scores stay unequal there
    edges = np.flatnonzero(np.diff(level, prepend=np.nan))
    parts = np.split(np.arange(len(level)), edges[1:])
    model.knots = np.array([np.average(raw[p], weights=n[p]) for p in parts])
    model.values = np.array([level[p[0]] for p in parts])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, learnable: Column, *, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and ``score``, the calibrated
    probability of label 1.  Only label rows where ``learnable`` (an expression
    over ``labels``) holds are used; a quarter of them, chosen by hashed id,
    calibrates.

    A null or empty text has zero statistics and gets their score.  Without
    labels, or with labels of one kind, the score is their share (0 without).
    Ids, null ones too, pass through; repeated rows stay repeated; an empty
    table gives an empty result; other columns are not read.  The statistics
    are staged once in the shared checkpoint folder.
    """
    stats = staged(with_statistics(docs, id_col, text_col), "statistics")
    known = label_of(labels.where(learnable), label_col, id_col).withColumnRenamed(id_col, "id")
    model = fit(stats.join(known, "id"), F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(4)) == 0, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.clip(model.score(_matrix(batch)), 0, 1))], ["id", "score"])

    return stats.mapInArrow(score, f"id {stats.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
