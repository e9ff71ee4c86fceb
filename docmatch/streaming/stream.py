"""The engine over a growing folder of manifests.

Records are independent, so the plan has no state: each micro-batch is enriched and
written. A bad line refuses its micro-batch, not the lines before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import Engine
from ..plans.refusals import Refusal
from ..sources import manifest


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The non-blank lines of new files."""
    return spark.readStream.text(folder).where(F.trim("value") != "").select(F.col("value").alias("raw"))


def enrich(engine: Engine, lines: DataFrame, ids: list[str], out: str, checkpoint: str, base: str = "", available_now: bool = False) -> StreamingQuery:
    """Writes enriched lines below ``out``, a folder per micro-batch, so that a batch
    that is tried again replaces itself."""
    engine.registry.check(engine.trust)
    definitions = engine.registry.select(ids)

    def batch(df: DataFrame, number: int) -> None:
        df = df.select(F.monotonically_increasing_id().alias("seq"), "raw")  # order within a file
        try:
            recs = manifest.records(df)
        except Refusal as e:
            df.sparkSession.createDataFrame([(e.json(),)], "value string").write.mode("overwrite").text(f"{out}/batch={number}")
            return
        engine.enrich(recs, definitions, base).select("value").write.mode("overwrite").text(f"{out}/batch={number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
