"""Scores of predictions that keep arriving: the batch operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluate import mixture_metrics, prediction_detail
from ..operators.normalize import KEYS


def score_stream(predictions: DataFrame, truth: DataFrame, folder: str, checkpoint: str, rare: float = 0.05, keys: list[str] = KEYS) -> StreamingQuery:
    """Append each micro-batch's per-mixture scores to ``folder``.

    A mixture's rows of one method must arrive in one batch, as files of results do.
    A batch that is run again after a failure replaces its own rows.
    """

    def score(batch: DataFrame, number: int) -> None:
        scores = mixture_metrics(prediction_detail(batch, truth, rare, keys), keys)
        scores.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(folder)

    return predictions.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
