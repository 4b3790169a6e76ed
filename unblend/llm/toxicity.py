"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear model on hashed
words that also sees the probabilities of all categories before it. In training
those are out-of-fold predictions, so later models learn from what earlier
ones say of texts that they were not fitted on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import fit_logistic, sigmoid
from .shared import bounded_sample, materialize

WORD = re.compile(r"\w+")


def categories(toxic: str = "toxic", quality: str = "quality") -> dict[str, Column]:
    """The chain's categories over the labels: toxic prose, toxic junk, toxic at all."""
    bad = F.col(toxic) == 1
    return {
        "toxic_prose": bad & (F.coalesce(F.col(quality), F.lit(1)) == 1),
        "toxic_junk": bad & (F.coalesce(F.col(quality), F.lit(1)) == 0),
        "toxic": bad,
    }


def hashed_words(text: str | None) -> np.ndarray:
    """Distinct 32-bit hashes of the lower-cased words of the whole text."""
    found = set(WORD.findall((text or "").lower()))
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in found), np.uint32, len(found))


@dataclass
class Link:
    """One model of the chain: weights of hashed words and of earlier probabilities."""

    words: dict[int, float]
    earlier: np.ndarray
    bias: float

    def predict(self, hashes: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        known = np.fromiter(self.words, np.uint32, len(self.words))
        order = np.argsort(known)
        known, value = known[order], np.fromiter(self.words.values(), float, len(self.words))[order]
        z = before @ self.earlier + self.bias
        if len(known):
            for i, h in enumerate(hashes):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                z[i] += value[at[known[at] == h]].sum()
        return sigmoid(z)


def _pick(rows: np.ndarray, hashes: np.ndarray, target: np.ndarray, min_docs: int, min_z: float) -> np.ndarray:
    """Hashes of at least ``min_docs`` documents that differ from the rest in the target by ``min_z`` deviations, in order."""
    names, at = np.unique(hashes, return_inverse=True)
    docs = np.bincount(at, minlength=len(names))
    hits = np.bincount(at, target[rows], len(names))
    n, p = len(target), target.sum()
    rate = p / n
    z = (hits - docs * rate) / np.sqrt(np.maximum(docs * rate * (1 - rate) * (1 - docs / n), 1e-9))
    good = np.flatnonzero((docs >= min_docs) & (np.abs(z) >= min_z))
    return names[good]


def fit_link(hashes: list[np.ndarray], before: np.ndarray, target: np.ndarray, min_docs: int, min_z: float) -> Link:
    """A linear model of one category; constant where only one class occurs."""
    if not len(target) or target.min() == target.max():
        rate = np.clip(target.mean() if len(target) else 0.0, 1e-4, 1 - 1e-4)
        return Link({}, np.zeros(before.shape[1]), float(np.log(rate / (1 - rate))))
    rows = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    flat = np.concatenate(hashes)
    names = _pick(rows, flat, target, min_docs, min_z)
    at = np.searchsorted(names, flat) if len(names) else np.zeros(0, int)
    hit = np.zeros(len(flat), bool)
    if len(names):
        hit = names[np.minimum(at, len(names) - 1)] == flat
    r, c, v = rows[hit], at[hit] if len(names) else np.zeros(0, int), np.ones(int(hit.sum()))
    for k in range(before.shape[1]):
        r = np.concatenate([r, np.arange(len(hashes))])
        c = np.concatenate([c, np.full(len(hashes), len(names) + k)])
        v = np.concatenate([v, before[:, k]])
    weights, bias = fit_logistic(r, c.astype(np.int64), v, len(names) + before.shape[1], target, l2=0.5, steps=300)
    return Link(dict(zip(names.tolist(), weights.tolist())), weights[len(names) :], bias)


def fit_chain(
    hashes: list[np.ndarray],
    targets: np.ndarray,
    folds: np.ndarray,
    min_docs: int = 5,
    min_z: float = 4.0,
) -> tuple[list[Link], np.ndarray]:
    """A link for each column of ``targets``, in order, and the last one's out-of-fold predictions; ``folds`` numbers each row's fold. A link
    takes every word that passes the test of ``_pick``, so its size is bounded by the sample's words alone."""
    before = np.zeros((len(hashes), 0))
    chain = []
    for k in range(targets.shape[1]):
        y = targets[:, k].astype(float)
        chain.append(fit_link(hashes, before, y, min_docs, min_z))
        out = np.zeros(len(hashes))
        for f in np.unique(folds):
            rest, held = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            part = fit_link([hashes[i] for i in rest], before[rest], y[rest], min_docs, min_z)
            out[held] = part.predict([hashes[i] for i in held], before[held])
        before = np.column_stack([before, out])
    return chain, before[:, -1]


def best_threshold(scores: np.ndarray, target: np.ndarray) -> float:
    """The cut with the largest F1 (the highest of equal ones), in the middle between the scores that it parts; a half where one
    class is all there is."""
    if not len(target) or target.min() == target.max():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(target[order])
    cut = np.flatnonzero(np.append(s[1:] < s[:-1], True))  # equal scores stay together
    f1 = 2 * hits[cut] / (cut + 1 + target.sum())
    at = cut[f1.argmax()]
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    names: dict[str, Column],
    max_sample: int,
    n_folds: int,
) -> tuple[list[Link], float]:
    """The chain and the threshold that suits its out-of-fold predictions best, fitted on at most ``max_sample`` labelled rows, picked by
    hashes of their ids. Rows in which a category is null are left out."""
    known = labels.select(F.col(id_col).alias("label_id"), *[c.cast("int").alias(f"y_{k}") for k, c in enumerate(names.values())])
    known = known.dropna()
    known = materialize(bounded_sample(known, "label_id", max_sample, known.count()), "toxic-labels")

    @F.pandas_udf("binary")
    def words_of(text: pd.Series) -> pd.Series:
        return pd.Series([hashed_words(t).tobytes() for t in text], dtype=object)

    # the labels are at most max_sample rows of a few numbers, so they may be sent to every task
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(known), F.col("id") == F.col("label_id")
    )
    rows = joined.select("id", *known.columns[1:], words_of("text").alias("h")).orderBy("id").limit(max_sample).collect()
    hashes = [np.frombuffer(r["h"], np.uint32) for r in rows]
    targets = np.array([[r[f"y_{k}"] for k in range(len(names))] for r in rows]).reshape(len(rows), len(names))
    folds = np.array([zlib.crc32(str(r["id"]).encode()) % n_folds for r in rows], int)
    chain, scores = fit_chain(hashes, targets, folds)
    return chain, best_threshold(scores, targets[:, -1])


def classify_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    names: dict[str, Column] | None = None,
    max_sample: int = 12_000,
    n_folds: int = 5,
    threshold: float | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, a probability ``p_<category>`` for each
    category of the chain, and flagged (the last category's is >= ``threshold``, by default the one with the
    largest F1 on out-of-fold predictions).

    Whole texts are scored. Null and empty texts have no words: their probabilities
    come from the models' constants. Without labels every probability is near 0.
    Repeated rows are scored each; other columns are ignored. An empty table gives no rows. Models are fitted
    on at most ``max_sample`` labelled rows, with every word of theirs that tells a category apart.
    """
    names = categories() if names is None else names
    chain, fitted = train(docs, labels, id_col, text_col, names, max_sample, n_folds)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = [f"p_{n}" for n in names]
    schema = T.StructType([own.schema["id"], *[T.StructField(n, T.DoubleType()) for n in found]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [hashed_words(t) for t in batch["text"]]
            before = np.zeros((len(hashes), 0))
            for link in chain:
                before = np.column_stack([before, link.predict(hashes, before)])
            out = pd.DataFrame(before, columns=found)
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    scored = own.mapInPandas(run, schema)
    return scored.select(F.col("id").alias(id_col), *found, (F.col(found[-1]) >= (fitted if threshold is None else threshold)).alias("flagged"))
