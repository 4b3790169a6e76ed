"""A quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns estimates, without any given label, what share of
documents is good and how often each labeller is right. Labellers depend on each
other, as each knows one kind of defect and calls documents with another one good; so a
document is good or has one of as many kinds of defect as there are labellers, and each labeller
has its own rates on every kind: those that notice the same defect overlap there. The posterior of a
document's pattern is its soft label; a linear scorer on hashed token
shapes learns from a bounded sample of those and then scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import fit_logistic, sigmoid
from .shared import bounded_sample, materialize

GOOD, BAD, NONE = 1, -1, 0
#: Where estimation starts: a labeller's rate of bad votes on its own kind of defect, on other kinds and on good documents.
OWN, OTHER, FALSE = 0.9, 0.01, 0.003
LABELLERS = ("symbols", "capitals", "top_word", "marks", "bare_tokens", "sentences", "line_copies", "neighbours")

# Classes of bytes (fixed values): letters to a or A (bytes beyond ASCII count as letters), digits to 0.
_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in (9, 10, 11, 12, 13) else b
    for b in range(256)
)
_RUNS = [(re.compile(rb"a+"), b"a"), (re.compile(rb"A+"), b"A"), (re.compile(rb"0+"), b"0")]
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>~^=_{}[]\\"))


def _vote(value: float, good_below: float, bad_above: float) -> int:
    return BAD if value > bad_above else GOOD if value < good_below else NONE


def describe(text: str | None, dims: int) -> tuple[list[int], list[int], list[float]]:
    """(votes in the order of ``LABELLERS``, hashed feature numbers, their values)."""
    data = (text or "").encode("utf-8", "replace")
    found = data.split()
    n = len(found)
    if not n:
        return [NONE] * len(LABELLERS), [], []
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = max(1, len(data) - int(counts[[9, 10, 11, 12, 13, 32]].sum()))
    shaped = data.translate(_SHAPE)
    for pattern, to in _RUNS:
        shaped = pattern.sub(to, shaped)
    shapes = Counter(shaped.split())
    bare = sum(k for s, k in shapes.items() if not (b"a" in s or b"A" in s))
    ends = sum(k for s, k in shapes.items() if s[-1:] in (b".", b"?"))
    words = Counter(found)
    top = max(words.values()) / n
    beside = sum(map(eq, found, found[1:])) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    copies = 1 - len(set(lines)) / len(lines)
    symbols = int(counts[_SYMBOLS].sum()) / chars
    capitals = int(counts[65:91].sum()) / chars
    marks = int(counts[33]) / n
    enough = n >= 20
    votes = [
        _vote(symbols, 0.02, 0.08),
        _vote(capitals, 0.12, 0.3) if n >= 5 else NONE,
        _vote(top, 0.15, 0.3) if enough else NONE,
        _vote(marks, 0.05, 0.25) if n >= 5 else NONE,
        _vote(bare / n, 0.05, 0.2) if n >= 10 else NONE,
        (BAD if ends * 60 < n else GOOD if ends * 30 >= n else NONE) if enough else NONE,
        _vote(copies, 0.1, 0.4) if len(lines) >= 4 else NONE,
        _vote(beside, 0.05, 0.2) if enough else NONE,
    ]
    # every shape counts; sorted, so that sums in a bucket don't depend on the order of words
    values = {b"shape " + s: k / n for s, k in sorted(shapes.items())}
    values |= {b"top": top, b"beside": beside, b"copies": copies, b"symbols": symbols, b"capitals": capitals}
    hashed: dict[int, float] = {}
    for name, v in values.items():
        k = zlib.crc32(name) % dims
        hashed[k] = hashed.get(k, 0.0) + v**0.5
    return votes, list(hashed), list(hashed.values())


@dataclass(frozen=True)
class LabelModel:
    """shares[kind]: of good documents (kind 0) and of each kind of defect; bad_vote[kind, labeller]: how
    often a labeller that votes on a document of the kind calls it bad."""

    shares: np.ndarray
    bad_vote: np.ndarray

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each kind for documents with these votes. Not voting says nothing."""
        z = np.log(self.shares) + (votes == BAD) @ np.log(self.bad_vote).T + (votes == GOOD) @ np.log1p(-self.bad_vote).T
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes are good."""
        return self.kinds(votes)[:, 0]


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.9, weight: float = 10.0) -> LabelModel:
    """Expectation maximisation over patterns of votes and how many documents have each.

    Shares and rates are all estimated. They start from what such heuristics are like: each knows one kind
    of defect and seldom calls another document bad, which also fixes which kind is the good one. ``prior``
    is only the share of good documents to start from; ``weight`` votes of each labeller on each kind, as the start has them, keep rates off 0 and 1.
    """
    n = votes.shape[1]
    start = np.full((n + 1, n), OTHER)
    start[0], start[1:][np.eye(n, dtype=bool)] = FALSE, OWN
    model = LabelModel(np.r_[prior, np.full(n, (1 - prior) / n)], start)
    is_bad, is_good = votes == BAD, votes == GOOD
    for _ in range(rounds):
        of = (model.kinds(votes) * counts[:, None]).T
        rates = (of @ is_bad + weight * start) / (of @ (is_bad | is_good) + weight)
        model = LabelModel((of.sum(1) + 1) / (counts.sum() + n + 1), rates)
    return model


def described(docs: DataFrame, dims: int) -> DataFrame:
    """(id, text) to (id, votes, k, v)."""
    schema = T.StructType(
        [
            docs.schema["id"],
            T.StructField("votes", T.ArrayType(T.ByteType())),
            T.StructField("k", T.ArrayType(T.IntegerType())),
            T.StructField("v", T.ArrayType(T.FloatType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [describe(t, dims) for t in batch["text"]]
            yield pd.DataFrame(
                {"id": batch["id"], "votes": [r[0] for r in rows], "k": [r[1] for r in rows], "v": [r[2] for r in rows]}
            )

    return docs.mapInPandas(run, schema)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists."""
    sizes = [len(x) for x in lists]
    return np.repeat(np.arange(len(sizes)), sizes), np.array([y for x in lists for y in x])


@dataclass(frozen=True)
class Classifier:
    """A label model and the linear scorer that has learned from it."""

    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, k, v) -> np.ndarray:
        """Probabilities for columns of feature numbers and values."""
        at, flat = _flat(k)
        if not len(flat):
            return np.full(len(k), sigmoid(np.array(self.bias)))
        return sigmoid(np.bincount(at, self.weights[flat.astype(np.int64)] * _flat(v)[1], len(k)) + self.bias)


def fit_classifier(seen: DataFrame, max_sample: int, dims: int) -> Classifier | None:
    """From ``described`` documents; None if there are none.

    All of them count for shares and accuracies: the driver gets one row a vote
    pattern, of which there are at most 3 to the power 8. The scorer is fitted on the
    ``max_sample`` documents at most, picked by hashes of their ids.
    """
    patterns = seen.groupBy("votes").count().collect()
    if not patterns:
        return None
    labels = fit_label_model(np.array([p["votes"] for p in patterns]), np.array([p["count"] for p in patterns], float))
    sample = bounded_sample(seen, "id", max_sample, sum(p["count"] for p in patterns)).select("votes", "k", "v").toArrow()
    target = labels.posterior(np.array(sample["votes"].to_pylist()))
    k, v = sample["k"].combine_chunks(), sample["v"].combine_chunks()
    rows = np.repeat(np.arange(len(k)), k.value_lengths().to_numpy(zero_copy_only=False))
    cols, values = k.flatten().to_numpy(), v.flatten().to_numpy()
    weights, bias = fit_logistic(rows, cols.astype(np.int64), values.astype(float), dims, target, l2=0.1, steps=600)
    return Classifier(labels, weights, bias)


def classify_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_sample: int = 20_000,
    dims: int = 1 << 14,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: ``id_col``, posterior (that the votes make it good),
    score (the linear model's probability) and kept (score >= ``threshold``).

    The scorer's sample is bounded by ``max_sample`` documents; everything else covers
    all documents and whole texts, with every token shape in one of ``dims`` buckets. The
    driver holds the sample's filled buckets: max_sample * dims numbers at the very most. Null, empty and blank texts get no votes and no
    features: they have the prior's posterior and the intercept's score.
    Repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = materialize(described(own, dims), "votes")
    model = fit_classifier(seen, max_sample, dims)
    schema = T.StructType(
        [seen.schema["id"], T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                soft = model.labels.posterior(np.array(batch["votes"].tolist(), dtype=np.int64))
                yield pd.DataFrame({"id": batch["id"], "posterior": soft, "score": model.score(batch["k"], batch["v"])})

    scored = seen.mapInPandas(run, schema)
    return scored.select(F.col("id").alias(id_col), "posterior", "score", (F.col("score") >= threshold).alias("kept"))


def keep_good(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_sample: int = 20_000,
    dims: int = 1 << 14,
    threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns.

    Rows are scored where they are read, so no text is shuffled. Each row is
    judged by its own text, whatever its id.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit_classifier(materialize(described(own, dims), "votes"), max_sample, dims)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = [describe(t, dims) for t in texts]
        return pd.Series(model.score([r[1] for r in rows], [r[2] for r in rows]))

    return docs.where(score(F.col(text_col)) >= threshold)
