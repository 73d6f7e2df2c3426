"""Mappings over streams: a mapping keeps no state, so it is the same projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mapweave.plans.mapping import Mapping


def write_stream(compiled: Mapping, stream: DataFrame, path: str, checkpoint: str, quarantine: str | None = None, fmt: str = "parquet", trigger: dict | None = None, **options) -> StreamingQuery:
    """Run a mapping over a stream into files, exactly once; rows with diagnostics go to `quarantine` if it is given."""
    if quarantine is None:
        out = compiled.to_json_df(stream, **options)
        return out.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)

    def split(batch: DataFrame, number: int) -> None:
        out = compiled.to_json_df(batch, on_error="quarantine", **options).persist()
        try:
            # a batch that is run again writes to the same folder
            out.filter("size(_diagnostics) = 0").drop("_diagnostics").write.mode("overwrite").format(fmt).save(f"{path}/batch={number}")
            out.filter("size(_diagnostics) > 0").write.mode("overwrite").format(fmt).save(f"{quarantine}/batch={number}")
        finally:
            out.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
