"""Scores a stream of documents against fixed count tables. An extra: the batch engine is complete without it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textsieve.operators.lm import NgramModel, gap_scores
from textsieve.operators.sentences import text_to_sentences


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score_gaps(stream: DataFrame, model: NgramModel, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's sentences are scored like a table and appended; a batch that is run again replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        gap_scores(text_to_sentences(batch), model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
