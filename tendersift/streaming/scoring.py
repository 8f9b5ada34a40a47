"""New transactions scored as they arrive, against a saved model.

A model's tables never change, so a row's score depends on the row alone: every micro-batch
is scored like any other table, and the rows of all batches together have the scores that one run
over all of them gives.  A batch is written under its number and replaced if it is run
again, so a restart neither loses nor repeats a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tendersift.operators import review
from tendersift.plans import models
from tendersift.plans.config import ReviewPlan
from tendersift.storage import stored

Score = Callable[[DataFrame], DataFrame]


def reviewer(plan: ReviewPlan, model: models.Trained) -> Score:
    """Rows with the plan's features to their review scores by the primary forest."""
    return lambda rows: review.scored(models.scored(rows, plan, model)[plan.primary.name])


def run_available(stream: DataFrame, score: Score, out: str, checkpoint: str) -> DataFrame:
    """Scores what the stream holds by now and returns all scores that out holds, with their batch.

    Another call with the same folders goes on where this one ended.  Empty batches are
    left out; repeated rows are scored again.  checkpoint: the stream's own folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = stored(batch, "stream-batch")
        if rows.head(1):
            score(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("basePath", out).parquet(out)

