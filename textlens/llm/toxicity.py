"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence is toxic with probability
``sigmoid(bias + sum of the weights of its different words)``, a word's weight
the sum over itself and its prefixes of 3 to 6 characters; a document is toxic unless
none of its sentences is (noisy-or).  Only documents are labelled; gradients
of the document likelihood reach the sentences through the noisy-or, and so
the offending sentences are found without sentence labels.

The model is fitted on a bounded sample of labelled documents on the driver;
documents are scored in Spark tasks, whole texts, with the fitted weights
(a few thousand numbers) shipped along.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import label_of

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")
_MEMO = 300_000


def features(word: str) -> list[str]:
    """The word and its proper prefixes of 3 to 6 characters (marked by ``*``)."""
    return [word, *[word[:k] + "*" for k in range(3, min(7, len(word)))]]


@dataclass
class NoisyOr:
    """Weights of word features; ``bias`` is a sentence's logit without any."""

    bias: float
    weights: dict[str, float]
    prior: float | None = None  # the score of any text, where nothing could be learnt

    def scorer(self):
        """A function text -> (score, number of sentences, [(start, end, sentence score)]
        of sentences at 0.5 or more).  It remembers words already weighed."""
        memo: dict[str, float] = {}
        weights, bias = self.weights, self.bias
        quiet = math.log1p(math.exp(bias)) if bias < 30 else bias

        def weigh(word: str) -> float:
            if len(memo) > _MEMO:
                memo.clear()
            w = memo[word] = sum(weights.get(f, 0.0) for f in features(word))
            return w

        def score(text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
            if self.prior is not None:
                return self.prior, 0, []
            total, n, found = 0.0, 0, []
            for m in _SENTENCE.finditer(text):
                n += 1
                z = 0.0
                for word in dict.fromkeys(_WORD.findall(m[0].lower())):  # each once, in a fixed order
                    w = memo.get(word)
                    z += weigh(word) if w is None else w
                if z:
                    z += bias
                    total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
                    if z >= 0:
                        found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
                else:
                    total += quiet
            return -math.expm1(-total), n, found

        return score


def fit(texts: list[str], labels: list[int], *, min_docs: int = 5, max_features: int = 20_000, l2: float = 1e-5,
        steps: int = 300, rate: float = 0.1) -> NoisyOr:
    """Maximum likelihood of the document labels by Adam over all documents.
    Features in at least ``min_docs`` toxic documents and at three times the
    clean rate or more are weighed, the most frequent ``max_features`` of
    them."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return NoisyOr(0.0, {}, float(y[0]) if len(y) else 0.0)
    sentences = [[list(dict.fromkeys(_WORD.findall(m[0].lower()))) for m in _SENTENCE.finditer(t)] for t in texts]
    seen = (Counter(), Counter())
    for doc, label in zip(sentences, labels):
        seen[label].update({f for s in doc for w in s for f in features(w)})
    n1, n0 = y.sum(), (1 - y).sum()
    chosen = [f for f, c in seen[1].items() if c >= min_docs and c / n1 >= 3 * (seen[0][f] + 0.5) / n0]
    chosen = sorted(chosen, key=lambda f: (-seen[1][f], f))[:max_features]
    number = {f: i for i, f in enumerate(chosen)}
    doc_of, in_sentence, feature = [], [], []  # sentences with a weighed feature, and these
    quiet = np.array([len(doc) for doc in sentences], float)  # per document, the other sentences
    for d, doc in enumerate(sentences):
        for s in doc:
            if has := [number[f] for w in s for f in features(w) if f in number]:
                in_sentence += [len(doc_of)] * len(has)
                feature += has
                doc_of.append(d)
                quiet[d] -= 1
    doc_of, in_sentence, feature = (np.array(x, np.int64) for x in (doc_of, in_sentence, feature))
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -math.log(max(1.0, quiet.mean())) - 2
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        b = theta[-1]
        z = b + np.bincount(in_sentence, theta[feature], len(doc_of))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-b))
        total = np.bincount(doc_of, np.logaddexp(0, z), len(y)) + quiet * np.logaddexp(0, b)
        total = np.maximum(total, 1e-9)
        slope = np.where(y == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0)  # of the loss in ``total``
        dz = slope[doc_of] * p
        grad = np.append(np.bincount(feature, dz[in_sentence], len(chosen)), dz.sum() + (slope * quiet).sum() * p0)
        grad = grad / len(y) + l2 * np.append(theta[:-1], 0.0)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        theta = theta - rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-9)
    return NoisyOr(float(theta[-1]), {f: float(w) for f, w in zip(chosen, theta) if abs(w) > 1e-6})


def fit_on(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", max_docs: int = 3000, max_chars: int = 20_000, seed: int = 4) -> NoisyOr:
    """A model of a sample of labelled documents: of each label the
    ``max_docs`` of smallest hashed id, and of those the ones of at most
    ``max_chars`` characters, so at most 2 * max_docs * max_chars characters
    reach the driver.  Of rows with the same id the smallest such text is
    taken, once.  ``labels`` holds the rows that may be learnt from."""
    known = label_of(labels, label_col, id_col)
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    picked = [known.where(F.col("label") == y).orderBy(order, id_col).limit(max_docs) for y in (0, 1)]
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
              .join(F.broadcast(picked[0].union(picked[1]).withColumnRenamed(id_col, "id")), "id")
              .where(F.char_length("text") <= max_chars)
              .groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).toPandas()
              .sort_values(["id", "text"]))
    return fit(sample["text"].tolist(), sample["label"].tolist())


def score_documents(docs: DataFrame, model: NoisyOr, *, id_col: str = "doc_id", text_col: str = "text",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``carry`` columns, ``id_col``, ``score``
    (probability that the whole text is toxic), ``n_sentences`` and
    ``offending`` (sentences of probability 0.5 or more: start and end in code
    points of the text, and score).

    A null or empty text has no sentence and scores 0.  Ids, null ones too,
    pass through; repeated rows stay repeated; an empty table gives an empty
    result.  A carried column with the name of an output column is left out.
    """
    taken = {id_col.lower(), "score", "n_sentences", "offending"}
    kept = [c for c in carry if c.lower() not in taken]

    @F.pandas_udf("score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for s in texts:
            out = [score(t or "") for t in s]
            yield pd.DataFrame({
                "score": np.array([r[0] for r in out], float), "n_sentences": np.array([r[1] for r in out], np.int64),
                "offending": pd.Series([[{"start": a, "end": b, "score": p} for a, b, p in r[2]] for r in out], dtype=object)})

    return docs.select(*[F.col(f"`{c}`").alias(f"_llm_{i}") for i, c in enumerate(kept)], F.col(id_col).alias("_llm_id"),
                       judge(F.col(text_col)).alias("_llm_r")).select(
        *[F.col(f"_llm_{i}").alias(c) for i, c in enumerate(kept)], F.col("_llm_id").alias(id_col), "_llm_r.*")
