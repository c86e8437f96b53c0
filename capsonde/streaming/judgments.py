"""J1 and J2 on a stream of judged records: parse as files arrive, append the outputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from capsonde.operators import judging as J
from capsonde.sources.schemas import JUDGE_RESULTS

OUTPUTS = ("judgments", "abilities", "rejects")


def read_results(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(JUDGE_RESULTS)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path)


def refine_stream(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived and stop; run again to take up where it stopped.

    Each micro-batch is parsed once and replaces its own `batch=` folders, so a batch which
    is retried after a failure leaves no second copy.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = J.parse_replies(batch).persist()
        judged = J.judgments(parsed)
        parts = {
            "judgments": judged.drop("latent_abilities"),
            "abilities": J.abilities(judged),
            "rejects": J.rejects(parsed),
        }
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(os.path.join(out, name, f"batch={batch_id}"))
        parsed.unpersist()

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out, name))
