"""Structured Streaming scorer: requests arriving as files -> predictions and
rejects, written exactly once per micro-batch.

The scoring itself is :func:`tillcast.operators.scoring.score`, stateless,
so the stream needs no watermark or state store; the checkpoint under the
session's checkpoint folder lets a restarted query resume where it stopped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.models import LinearModel
from tillcast.operators.scoring import REQUEST_SCHEMA, score
from tillcast.session import checkpoint_dir


def request_stream(spark: SparkSession, source: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source)


def start_scoring(spark: SparkSession, source: str, sink: str, model: LinearModel, codes: DataFrame,
                  supported: DataFrame, name: str = "scoring", fmt: str = "parquet",
                  available_now: bool = True, max_files_per_trigger: int | None = None, **score_args):
    """Start the stream: each micro-batch is scored and written once under
    ``<sink>/batch_id=N/kind=predictions`` and ``kind=rejects``; read them with
    :func:`read_predictions` and :func:`read_rejects`.  The stream resumes from
    a checkpoint of its name, source and sink.  Returns the StreamingQuery."""
    scored = score(request_stream(spark, source, fmt, max_files_per_trigger), model, codes, supported,
                   **score_args)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on a retry: a batch that is
        # replayed after a failure replaces its own output instead of adding to it
        kind = F.when(F.col("error").isNull(), "predictions").otherwise("rejects")
        (batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind")
         .parquet(f"{sink}/batch_id={batch_id}"))

    key = hashlib.sha256(f"{source}\n{sink}".encode()).hexdigest()[:16]
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{key}"
    writer = scored.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


_WRITTEN = ("famille string, year int, week_of_year int, predicted_quantity double, error string, "
            "batch_id bigint, kind string")


def read_predictions(spark: SparkSession, sink: str) -> DataFrame:
    """What the stream has predicted so far, with its ``batch_id``."""
    return spark.read.schema(_WRITTEN).parquet(sink).filter("kind = 'predictions'").drop("kind", "error")


def read_rejects(spark: SparkSession, sink: str) -> DataFrame:
    """Requests the stream could not score, with the error and ``batch_id``."""
    return spark.read.schema(_WRITTEN).parquet(sink).filter("kind = 'rejects'").drop("kind", "predicted_quantity")
