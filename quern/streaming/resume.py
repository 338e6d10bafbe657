"""Batch work that can stop and go on: the streaming engine as the keeper of what is done.

Only what the batch operators need: new files are worked on once, in order, and
each batch is appended before it counts as done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linking import resume


def work_on_new_files(spark: SparkSession, source: str, schema: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], sink: str, *, key: str, files_each: int = 20) -> None:
    """Applies ``work`` to JSON files of ``source`` that came since the last run and appends to the Parquet table ``sink``.

    Stops when there are no more. A batch that was written but not yet counted as done
    is written once: keys that the sink has are left out.
    """

    def append(batch: DataFrame, number: int) -> None:
        made = work(batch)
        try:
            done = spark.read.parquet(sink)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            made = resume(made, done, key)
        made.write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(source)
    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def last_turns(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", columns: list[str]) -> DataFrame:
    """Of each conversation the latest turn: its state, from which the next question is rewritten."""
    return turns.groupBy(conversation).agg(F.max_by(F.struct(turn, *columns), turn).alias("last")).select(conversation, "last.*")
