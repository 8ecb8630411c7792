"""Score a stream of tables with a fitted run.

Scoring is stateless (each table is scored on its own), so there is no
watermark or state store: every micro-batch goes through the batch scorer in
``foreachBatch``. The sink is an idempotent parquet
append keyed by batch id, so a replayed batch after an executor or driver
failure is written to the same folder again (checkpointed offsets make the
stream exactly-once end to end).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.jobs import Fitted, score
from ..plans.saved import load_fitted
from ..sources.tables import parse_table_data


def start_scoring_stream(spark: SparkSession, run: Fitted | str, cfg: dict | None, source_dir: str, out_dir: str,
                         checkpoint_dir: str, schema: str = "id long, table_data string",
                         ranked: bool = True, trigger_once: bool = False, quarantine_dir: str | None = None,
                         files: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """``readStream`` parquet tables -> score -> parquet, one folder per batch.

    ``run`` is the folder of a saved run, loaded once when the stream starts, so a
    new driver goes on from the checkpoint with the files alone; or a fit of this
    session. ``files`` is a pattern of file names, ``prepare`` turns the rows of
    another schema into ``(id, table_data)``.

    Rows whose matrix cannot be decoded are written, raw text included, to
    ``quarantine_dir`` (default: ``out_dir`` + ``_quarantine``), one folder per
    batch id like the scores, so a replay replaces both."""
    fitted = load_fitted(spark, run) if isinstance(run, str) else run
    reader = spark.readStream.schema(schema)
    stream = (reader.option("pathGlobFilter", files) if files else reader).parquet(source_dir)
    aside = (quarantine_dir or f"{out_dir.rstrip('/')}_quarantine").rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = prepare(batch) if prepare else batch
        raw = F.col("table_data").cast("string").alias("raw") if dict(batch.dtypes)["table_data"] == "string" else \
            F.to_json("table_data").alias("raw")
        tables = parse_table_data(batch.select("*", raw), on_bad="quarantine").persist()
        if "_bad" in tables.columns:
            bad = tables.where("_bad").select("id", "raw")
            if not bad.isEmpty():
                bad.write.mode("overwrite").parquet(f"{aside}/batch_id={batch_id}")
            tables_ok = tables.where("NOT _bad").drop("_bad", "raw")
        else:
            tables_ok = tables.drop("raw")
        score(fitted, tables_ok, cfg, ranked=ranked).write.mode("overwrite").parquet(
            f"{out_dir.rstrip('/')}/batch_id={batch_id}")
        tables.unpersist()

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
