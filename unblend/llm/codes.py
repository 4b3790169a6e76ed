"""Compression of vectors to codes: each part of a vector becomes the number of its nearest codebook entry.

Components become integers, so equal parts are exactly equal. Those at one position are brought together
into distinct rows with their weight (how many vectors have them), and all that iterates works on distinct rows: assignment
to the codebook's entries, which every task gets (parts x entries x width integers, whatever the table's size),
and weighted sums a (position, entry), of which tasks hand on one each. At the end codes and errors are
joined back to the vectors by (position, part). A part that more than one in 1,024 of all rows share is
joined apart from the others, and so is such a label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .spread import join_by_count
from .vectors import integer_table, smallest

#: Differences that are held at a time.
AT_ONCE = 1 << 22


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; of equally near entries the first."""
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    step = max(1, AT_ONCE // max(1, codebook.size))
    for k in range(0, len(parts), step):
        gap = parts[k : k + step, None, :] - codebook
        far = np.einsum("nke,nke->nk", gap, gap)
        code[k : k + step] = far.argmin(1)
        error[k : k + step] = far.min(1)
    return code, error


def _assigned(batch: pa.RecordBatch, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, parts, entry, squared distance) of the batch's distinct rows."""
    pos = batch.column("pos").to_numpy()
    parts = batch.column("part").flatten().to_numpy().reshape(len(pos), codebooks.shape[2])
    code, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for p in np.unique(pos).tolist():
        at = np.flatnonzero(pos == p)
        code[at], error[at] = nearest(parts[at], codebooks[p])
    return pos, parts, code, error


def _sums(distinct: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(pos, code, place, total): weighted sums of the components of the rows that an entry gets, and at place -1 their weight."""
    shape = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shape[0], shape[1], shape[2] + 1), np.int64)
        for batch in batches:
            pos, parts, code, _ = _assigned(batch, codebooks)
            w = batch.column("weight").to_numpy()
            np.add.at(total, (pos, code), np.column_stack([parts * w[:, None], w]))
        pos, code = np.nonzero(total[:, :, -1])
        place = np.tile(np.append(np.arange(shape[2]), -1), len(pos))
        cols = [np.repeat(pos, shape[2] + 1), np.repeat(code, shape[2] + 1), place, total[pos, code].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["pos", "code", "place", "total"])

    rows = distinct.mapInArrow(run, "pos long, code long, place long, total long")
    return rows.groupBy("pos", "code", "place").agg(F.sum("total").alias("total"))


def lloyd(distinct: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds over weighted distinct rows: each entry becomes its rows' mean,
    every component rounded down; an entry without rows stays."""
    for _ in range(rounds):
        new, weights = codebooks.copy(), {}
        sums = _sums(distinct, codebooks).collect()  # codebook entries x (width + 1), whatever the table's size
        for r in sums:
            if r.place < 0:
                weights[r.pos, r.code] = r.total
        for r in sums:
            if r.place >= 0:
                new[r.pos, r.code, r.place] = r.total // weights[r.pos, r.code]
        codebooks = new
    return codebooks


def _codes(distinct: DataFrame, codebooks: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, code, error = _assigned(batch, codebooks)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("pos", "part", "weight")), pa.array(code), pa.array(error)], names=["pos", "part", "weight", "code", "error"]
            )

    return distinct.mapInArrow(run, "pos int, part array<long>, weight long, code long, error long")


def compress_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    scale: int = 256,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """Per usable row: ``id_col``, codes (array of entry numbers by position), error, label_error; and the codebooks
    (parts, entries, width).

    Rows whose vector is null, empty or holds null or non-finite components are dropped, as are vectors
    that don't have the dimensions of most (of those that divide into ``parts``). Components become floor(scale * x). The codebooks start as the
    parts of the ``entries`` smallest ids (nulls last, equal ids by vector); with fewer vectors they have fewer entries. Ties go to the
    lower entry. ``error`` is the sum of squared distances, ``label_error`` its sum over rows with an equal label, where
    nulls are one label. Repeated rows each get their own row. Other columns are ignored, whatever their names. An
    empty table gives no rows and codebooks without entries. Components beyond what squared distances in 64 bits allow stop the job.
    """
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col).cast("string")
    rows, dims = integer_table(df, id_col, vec_col, scale, 0, parts, {"lab": F.coalesce(label, F.lit("")), "bare": label.isNull()})
    schema = df.select(F.col(id_col), F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).schema
    if not dims:
        return df.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = dims // parts
    top = rows.agg(F.max(F.array_max(F.transform("x", F.abs))), F.count(F.lit(1))).first()
    if dims * (2 * top[0] + 2) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {top[0]} are too large for squared distances over {dims} dimensions")
    start = smallest(rows, entries)
    codebooks = np.array([r.x for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()

    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("x", p * width + 1, F.lit(width)))
    each = rows.select("no", F.posexplode(cut).alias("pos", "part"))
    distinct = materialize(each.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    codebooks = lloyd(distinct, codebooks, rounds)
    coded = materialize(_codes(distinct, codebooks), "part-codes")

    found = join_by_count(each, coded, ["pos", "part"], "weight", top[1] * parts)
    mine = found.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("z"), F.sum("error").alias("error"))
    done = mine.join(rows.select("no", "id", "lab", "bare"), "no").select("id", F.col("z.code").cast("array<int>").alias("codes"), "error", "lab", "bare")
    done = materialize(done, "coded-vectors")
    labels = done.groupBy("lab", "bare").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("k"))
    out = join_by_count(done, materialize(labels, "label-errors"), ["lab", "bare"], "k", top[1])
    return out.select(F.col("id").alias(id_col), "codes", "error", "label_error"), codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
