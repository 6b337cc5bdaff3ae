"""I-05: the daily load as a file stream.

``readStream`` over the partitioned source picks up every new file once
(the checkpoint remembers what was processed); ``trigger(availableNow=True)``
drains what is there and stops, so the job can run on the same schedule as
the batch loader. Each micro-batch is appended or upserted with the batch
writers; the checkpoint lives in the shared checkpoint folder so a restarted
driver resumes where it stopped.

Delivery: ``foreachBatch`` replays a micro-batch whose commit was not
recorded. Upserts are idempotent (replaying a batch gives the same table);
an appended batch is named after the stream and its epoch, and a replay
replaces the files of that name, so it is appended once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.repair import latest_per_key
from tidemark.session import checkpoint_dir
from tidemark.sources import io


def stream_load(spark: SparkSession, source: str, schema: T.StructType, target: str, mode: str = "append",
                merge_keys: list[str] | None = None, order_by: list | None = None,
                partition_by: list[str] | None = None, name: str = "daily", max_files: int | None = None,
                version: list[str] | None = None):
    """Start an availableNow stream from ``source`` into ``target`` and wait
    for it. ``schema`` must include the partition columns of the source
    layout (e.g. year, month, day).

    ``version`` (e.g. those columns) makes the upsert conditional: a row that
    is older than the target's is left out, so days that arrive late, in
    later micro-batches or runs, never replace newer ones. The state across
    micro-batches is the target itself. Within a micro-batch the newest
    version of a key wins, after ``order_by`` if that is given."""
    partition_by = partition_by or ["year", "month", "day"]
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    reader = spark.readStream.schema(schema).option("basePath", source)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    stream = reader.parquet(source)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        if mode == "append":
            io.append_once(batch.sparkSession, batch, target, partition_by, f"{name}-{epoch_id:09d}")
        else:
            order = [*(order_by or []), *[F.col(c).desc() for c in version or []]]
            src = latest_per_key(batch, merge_keys, order) if order else batch
            io.write_upsert(batch.sparkSession, target, src, merge_keys, partition_by, version=version)

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).queryName(f"tidemark_{name}").start())
    q.awaitTermination()
    return q
