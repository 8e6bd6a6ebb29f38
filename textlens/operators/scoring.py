"""Batch scoring with any predictor (M01) and token attribution.

A predictor is any callable ``list[str] -> array (n, n_classes)`` of logits.
``make_predictor`` is called once per partition inside ``mapInPandas`` (the
model is loaded once per task, never per row); texts travel as Arrow
batches and are re-chunked to ``batch_size``.  Softmax, positive-class
probability and argmax are column expressions on the JVM side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.functions.text import ws_tokens
from textlens.plans.sizing import tasks_for

Predictor = Callable[[list], "np.ndarray"]


# ---------------------------------------------------------------- predictors
class VowelLengthPredictor:
    """Deterministic two-class toy model used by tests and the oracle check:
    logits ``[0, (5 * vowels - 2 * characters) / 100]`` (vowels = a e i o u)."""

    def __call__(self, texts: list) -> np.ndarray:
        s = pd.Series(texts, dtype=object)
        z = (5 * s.str.count("[aeiou]") - 2 * s.str.len()).to_numpy(dtype=float) / 100.0
        return np.column_stack([np.zeros(len(z)), z])


def vowel_length_predictor() -> Predictor:
    return VowelLengthPredictor()


class MarkerPredictor:
    """Deterministic toy model whose answer hangs on one word: logits
    ``[0, 4]`` if the text holds the word ``zzmark``, else ``[0, -4]``."""

    def __call__(self, texts: list) -> np.ndarray:
        z = np.array([4.0 if "zzmark" in t.split() else -4.0 for t in texts])
        return np.column_stack([np.zeros(len(z)), z])


def marker_predictor() -> Predictor:
    return MarkerPredictor()


# ---------------------------------------------------------------- M01
def softmax(logits: Column) -> Column:
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def argmax(values: Column) -> Column:
    """0-based index of the largest value; ties go to the lowest index."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def _score_batches(make_predictor, text_col: str, batch_size: int):
    def run(batches):
        predictor = make_predictor()
        for pdf in batches:
            texts = pdf[text_col].tolist()
            logits: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            for lo in range(0, len(texts), batch_size):
                idx = [i for i in range(lo, min(lo + batch_size, len(texts))) if isinstance(texts[i], str)]
                for i in range(lo, min(lo + batch_size, len(texts))):
                    if not isinstance(texts[i], str):
                        errors[i] = "missing text"
                try:
                    out = np.asarray(predictor([texts[i] for i in idx]), dtype=float)
                    for k, i in enumerate(idx):
                        logits[i] = out[k].tolist()
                except Exception:  # noqa: BLE001 - isolate the failing rows
                    for i in idx:
                        try:
                            logits[i] = np.asarray(predictor([texts[i]]), dtype=float)[0].tolist()
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"
            yield pdf.assign(_logits=pd.Series(logits, dtype=object), _error=pd.Series(errors, dtype=object))
    return run


def score_texts(df: DataFrame, make_predictor: Callable[[], Predictor], text_col: str = "text",
                keep: Sequence[str] = (), batch_size: int = 64, positive: int = 1,
                dedupe: bool = False) -> DataFrame:
    """``keep`` columns + ``logits``, ``probs``, ``p_positive``,
    ``prediction`` and ``error`` (NULL scores and a message for failures).

    ``dedupe`` scores each distinct text once and joins the scores back by a
    text digest: worth it when the predictor costs more than a shuffle.
    Model work runs where the rows are: for an input read as a few large
    splits, deal it over the cores first (``plans.sizing.spread``).
    """
    keep = list(keep)
    if dedupe:
        digest = F.sha2(F.col(text_col), 256)
        # one text per digest, combined in each task before it is sent
        uniq = df.groupBy(digest.alias("_dg")).agg(F.first(text_col).alias(text_col))
        scored = score_texts(uniq, make_predictor, text_col, keep=["_dg"], batch_size=batch_size, positive=positive)
        # rows travel without their texts, which come back with the scores; null-safe: a
        # missing text has no digest, and its error row must come back
        src = df.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], digest.alias("_dg2"))
        joined = src.join(scored, F.col("_dg2").eqNullSafe(F.col("_dg")), "left")
        return joined.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
                             *[c for c in scored.columns if c != "_dg"])
    base = df.select(*keep, text_col)
    schema = T.StructType(base.schema.fields + [
        T.StructField("_logits", T.ArrayType(T.DoubleType())), T.StructField("_error", T.StringType())])
    out = base.mapInPandas(_score_batches(make_predictor, text_col, batch_size), schema)
    probs = softmax(F.col("_logits"))
    return out.select(
        *keep, text_col, F.col("_logits").alias("logits"), probs.alias("probs"),
        F.get(probs, positive).alias("p_positive"),
        F.when(F.col("_logits").isNotNull(), argmax(F.col("_logits"))).alias("prediction"),
        F.col("_error").alias("error"))


# ---------------------------------------------------------------- P14 (sub-word ids)
def encode_texts(df: DataFrame, make_tokenizer: Callable[[], Callable[[list], list]], text_col: str = "text",
                 keep: Sequence[str] = (), max_length: int = 128, pad_id: int = 0,
                 ids_col: str = "input_ids", mask_col: str = "attention_mask") -> DataFrame:
    """Sub-word ids from any tokenizer (``list[str] -> list[list[int]]``,
    built once per task), cut to ``max_length`` and padded with ``pad_id``
    on the JVM side; the mask is 1 for real tokens, 0 for padding."""
    keep = list(keep)

    def run(batches):
        tok = make_tokenizer()
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text_col].tolist()]
            ids = [list(map(int, x)) for x in tok(texts)] if texts else []
            yield pdf[keep].assign(_ids=pd.Series(ids, dtype=object))

    base = df.select(*keep, text_col)
    schema = T.StructType([*[base.schema[c] for c in keep], T.StructField("_ids", T.ArrayType(T.IntegerType()))])
    out = base.mapInPandas(run, schema)
    ids = F.slice(F.col("_ids"), 1, max_length)
    n = F.size(ids)
    pad = F.greatest(F.lit(max_length) - n, F.lit(0))
    return out.select(*keep, F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias(ids_col),
                      F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad)).alias(mask_col))


# ---------------------------------------------------------------- M07
def _softmax_np(logits: np.ndarray) -> np.ndarray:
    z = logits - logits.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _probabilities(predictor, texts: list, batch_size: int, positive: int) -> np.ndarray:
    """Positive-class probabilities in calls of ``batch_size`` texts; where a
    call fails its texts are scored alone, and those that fail are NaN."""
    out = np.full(len(texts), np.nan)
    for lo in range(0, len(texts), batch_size):
        part = texts[lo:lo + batch_size]
        try:
            out[lo:lo + len(part)] = _softmax_np(np.asarray(predictor(part), dtype=float))[:, positive]
        except Exception:  # noqa: BLE001 - isolate the failing texts
            for i, t in enumerate(part):
                try:
                    out[lo + i] = _softmax_np(np.asarray(predictor([t]), dtype=float))[0, positive]
                except Exception:  # noqa: BLE001, S112 - no weight for this variant
                    continue
    return out


def _loo_batches(make_predictor, ids: Sequence[str], k: int, batch_size: int, positive: int):
    def attribute(predictor, toks: list) -> tuple[np.ndarray, np.ndarray]:
        """Positions and weights of the ``k`` largest, variants scored in
        windows so that only a few are held at once."""
        full = " ".join(toks)
        p = _probabilities(predictor, [full], batch_size, positive)[0]
        # variant i is a prefix and a suffix of the full text: no list is rebuilt
        ends = np.cumsum([len(t) + 1 for t in toks])
        weights = np.empty(len(toks))
        for lo in range(0, len(toks), batch_size):
            hi = min(lo + batch_size, len(toks))
            variants = []
            for i in range(lo, hi):
                head, tail = full[:max(0, int(ends[i]) - len(toks[i]) - 2)], full[int(ends[i]):]
                variants.append(f"{head} {tail}" if head and tail else head or tail)
            weights[lo:hi] = p - _probabilities(predictor, variants, batch_size, positive)
        order = np.lexsort((np.arange(len(toks)), -np.round(np.abs(weights), 9)))
        order = order[~np.isnan(weights[order])][:k]
        return order, weights[order]

    def run(batches):
        predictor = make_predictor()
        for pdf in batches:
            out = {c: [] for c in [*ids, "pos", "token", "weight", "rank"]}
            for row in range(len(pdf)):
                toks = pdf["_toks"].iloc[row]
                toks = list(toks) if toks is not None else []
                if not toks:
                    continue
                for r, (i, x) in enumerate(zip(*attribute(predictor, toks)), 1):
                    for c in ids:
                        out[c].append(pdf[c].iloc[row])
                    out["pos"].append(int(i))
                    out["token"].append(toks[i])
                    out["weight"].append(float(x))
                    out["rank"].append(r)
            yield pd.DataFrame(out)
    return run


def loo_attribution(df: DataFrame, make_predictor, id_cols: Sequence[str], text_col: str = "text",
                    k: int = 10, batch_size: int = 64, positive: int = 1) -> DataFrame:
    """Leave-one-out attribution: weight of token i = p(full) - p(text
    without token i); the ``k`` largest ``|weight|`` per text (ties: earlier
    token).

    One ``mapInPandas`` pass with no shuffle: each text's token array goes
    in, its variants are built and scored inside the task (the predictor is
    created once per task), and only the top ``k`` rows come out.  A variant
    whose call fails has no weight; the others of its batch are scored alone.
    A text of T tokens costs T variant texts of T tokens, so this suits short
    texts; use :func:`sampled_attribution` for long ones.
    """
    ids = list(id_cols)
    toks = df.select(*ids, ws_tokens(text_col).alias("_toks"))
    schema = T.StructType([*[df.schema[c] for c in ids],
                           T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()),
                           T.StructField("weight", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return toks.mapInPandas(_loo_batches(make_predictor, ids, k, batch_size, positive), schema)


def _xxh64_ints(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of each (non-negative, 4-byte) value under each seed, as ``xxhash64`` takes an int column."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (seeds + (p5 + np.uint64(4))) ^ (values.astype(np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _masks(key_hash: int, n_tokens: int, n_samples: int, seed: int) -> np.ndarray:
    """Which tokens each sample keeps: the last bit of ``xxhash64(key, sample,
    position, seed)``, given ``xxhash64(key)``; sample 0 keeps all."""
    per_sample = _xxh64_ints(np.arange(n_samples), np.array([key_hash], np.int64).view(np.uint64))
    h = _xxh64_ints(np.arange(n_tokens)[None], per_sample[:, None])
    keep = (_xxh64_ints(np.array([seed], np.int64) & 0xFFFFFFFF, h) & np.uint64(1)).astype(bool)
    keep[0] = True
    return keep


def _fit(X: np.ndarray, y: np.ndarray, k: int, kernel_width: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the ``k`` largest weights of a text's samples."""
    ok = ~np.isnan(y)
    X, y = X[ok].astype(float), y[ok]
    if X.size == 0:
        return np.zeros(0, int), np.zeros(0)
    # Cosine distance of each mask to the full text, exponential kernel.
    norms = np.sqrt(X.sum(axis=1)) * np.sqrt(X.shape[1])
    cos = np.divide(X.sum(axis=1), norms, out=np.zeros_like(norms), where=norms > 0)
    d = (1.0 - cos) * 100.0
    sw = np.sqrt(np.exp(-(d ** 2) / kernel_width ** 2))
    total = sw.sum()
    # Weighted ridge with a free intercept, solved in its dual form: one
    # system of the number of samples, so the cost is linear in the tokens.
    sw = sw / sw.sum()
    Xm, ym = sw @ X, sw @ y
    Z, t = (X - Xm) * np.sqrt(sw)[:, None], (y - ym) * np.sqrt(sw)
    coef = Z.T @ np.linalg.solve(Z @ Z.T + alpha / total * np.eye(len(Z)), t)
    order = np.lexsort((np.arange(len(coef)), -np.abs(np.round(coef, 12))))[:k]
    return order, coef[order]


def _fit_surrogate(ids: Sequence[str], k: int, kernel_width: float, alpha: float):
    """:func:`_fit` of a frame with one row per sample, the text's tokens in one of them."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        carried = pdf["_toks"].dropna()
        toks = list(carried.iloc[0]) if len(carried) else []
        if not toks:
            return pd.DataFrame(columns=[*ids, "rank", "pos", "token", "weight"])
        order, weight = _fit(np.vstack(pdf["_mask"].to_numpy()), pdf["p_positive"].to_numpy(dtype=float), k, kernel_width, alpha)
        out = pd.DataFrame({"rank": np.arange(1, len(order) + 1), "pos": order, "token": [toks[i] for i in order], "weight": weight})
        for c in ids:
            out.insert(0, c, pdf[c].iloc[0])
        return out
    return fit


def sampled_attribution(df: DataFrame, make_predictor, id_cols: Sequence[str], text_col: str = "text",
                        n_samples: int = 64, k: int = 10, seed: int = 42, kernel_width: float = 25.0,
                        alpha: float = 1.0, batch_size: int = 64) -> DataFrame:
    """Perturbation attribution: ``n_samples`` variants per text keep each
    token with probability 1/2 (a seeded hash of id, sample and position;
    sample 0 keeps all), all variants are scored, and a proximity-weighted
    ridge surrogate is fitted per text; top ``k`` by ``|weight|``.  Kernel,
    sample count and ridge strength are parameters.  Time and memory are
    linear in the text's length.

    A text travels once, to the task that makes its variants, scores them and
    fits; tasks follow the number of texts.  Rows of one id are one fit."""
    ids = list(id_cols)
    toks = df.select(*ids, ws_tokens(text_col).alias("_toks")).repartition(tasks_for(df, 2_000), *ids)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ids])
    texts = toks.groupBy(*ids).agg(F.collect_list("_toks").alias("_all")).withColumn("_hash", F.xxhash64(key))
    schema = T.StructType([*[f for f in df.schema.fields if f.name in ids],
                           T.StructField("rank", T.IntegerType()), T.StructField("pos", T.IntegerType()),
                           T.StructField("token", T.StringType()), T.StructField("weight", T.DoubleType())])

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = make_predictor()
        for batch in batches:
            row, rank, pos, token, weight = [], [], [], [], []
            for i, (copies, hashed) in enumerate(zip(batch.column("_all"), batch.column("_hash").to_pylist())):
                copies = [c for c in copies.as_py() if c]
                if not copies:
                    continue
                keep = _masks(hashed, len(copies[0]), n_samples, seed)
                variants = [" ".join(compress(c, m)) for c in copies for m in keep.tolist()]
                y = _probabilities(predictor, variants, batch_size, 1)
                order, found = _fit(np.concatenate([keep] * len(copies)), y, k, kernel_width, alpha)
                row += [i] * len(order)
                rank += range(1, len(order) + 1)
                pos += order.tolist()
                token += [copies[0][j] for j in order]
                weight += found.tolist()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name).take(at) for f in schema.fields[:-4]], pa.array(rank, pa.int32()), pa.array(pos, pa.int32()),
                 pa.array(token, pa.string()), pa.array(weight, pa.float64())], schema.names)

    return texts.mapInArrow(attribute, schema)


def token_attribution(df: DataFrame, make_predictor, id_cols: Sequence[str], text_col: str = "text",
                      mode: str = "loo", k: int = 10, n_samples: int = 64, seed: int = 42,
                      batch_size: int = 64) -> DataFrame:
    """Which tokens drive a score: ``mode='loo'`` (leave-one-out, exact, for
    short texts) or ``'sampled'`` (perturbation samples + weighted ridge
    surrogate, linear in text length).  Top ``k`` tokens per text."""
    if mode == "loo":
        return loo_attribution(df, make_predictor, id_cols, text_col, k=k, batch_size=batch_size)
    if mode == "sampled":
        return sampled_attribution(df, make_predictor, id_cols, text_col, n_samples=n_samples, k=k, seed=seed,
                                   batch_size=batch_size)
    raise ValueError(f"unknown mode {mode!r}")
