"""What the watermark extract does for tables, for folders of files: each file is loaded once.

The stream's checkpoint remembers the files that are done, so a run takes what is new and ends. A
batch that was written when the stream failed is tried again; a managed table knows it by the
stream's id and its number, and takes it once. Steps of transforms can be applied on the way, as
long as they map rows one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TransformError
from ..operators import build_transform
from ..sources.base import Adapter, LoadMode, WriteRequest


def ingest_new_files(spark: SparkSession, path: str, schema: T.StructType | str, target: Adapter, collection: str, checkpoint: str, *, format: str = "parquet", steps: Sequence[tuple[str, object]] = (), mode: str = "append", key: Sequence[str] = (), options: dict | None = None) -> int:
    """Loads the files that came since the last call; gives the number of rows read for it."""
    actions = [build_transform(name, block) for name, block in steps]
    late = [a for a in actions if a.tier == "collection" or a.needs_order()]
    if late:
        raise TransformError("only actions on single rows can be applied to a stream")
    stream = spark.readStream.schema(schema).format(format).options(**(options or {})).load(path)
    total = 0

    def load(batch: DataFrame, number: int) -> None:
        nonlocal total
        read = Observation()
        rows = batch.observe(read, F.count(F.lit(1)).alias("n"))
        for action in actions:
            rows = action.run(rows)
        known = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if target.write_once([WriteRequest(rows, collection, LoadMode(mode), list(key))], known or checkpoint, number):
            total += read.get["n"]

    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return total
