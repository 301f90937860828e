"""Extension: findings for property rows that keep arriving in a folder.

The rules are stateless per row, so a stream of facts goes through the same plan
as a batch; a baseline is a static table that every batch is joined with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from firmscope.operators import report, rules
from firmscope.operators import schema as S


def prop_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(S.PROP).parquet(folder)


def watch_props(spark: SparkSession, folder: str, out: str, checkpoint: str, baseline: DataFrame | None = None) -> StreamingQuery:
    """Append the findings of every new file in ``folder`` to the Parquet table ``out``;
    all that is there is handled once and the query ends."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        found = rules.seal(rules.prop_findings(rows))
        if baseline is not None:
            found = report.mark_baseline(found, baseline)
        found.drop("scan_ord").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return prop_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
