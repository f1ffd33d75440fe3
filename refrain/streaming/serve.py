"""Paragraphs arrive as files, each micro-batch is answered with annotated text; the checkpoint resumes where it stopped.

The plan is stateless: anchors are a small table read once, and a batch is scored as documents are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from refrain.plans import detect as D

REQUEST = "doc_id long, text string"


def requests(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines {doc_id, text}."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).json(folder)


def answer(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    return D.annotate(docs, D.detect(docs, anchors))


def serve(stream: DataFrame, anchors: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Answers as JSON under out, a folder for each batch, so that a repeated batch replaces its own answers."""

    def batch(docs: DataFrame, number: int) -> None:
        answer(docs, anchors).write.mode("overwrite").json(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
