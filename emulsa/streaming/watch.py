"""Images that arrive in a folder, rendered as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from emulsa.operators.render import FRAME, render
from emulsa.plans.planner import Plan
from emulsa.sources.images import read_images, write_images

FILES = "path string, modificationTime timestamp, length bigint, content binary"
MAX_FILES = 64


def watch(spark: SparkSession, inbox: str, outbox: str, plan: Plan, checkpoint: str, fmt: str = "png16", rejects: str | None = None) -> StreamingQuery:
    """A query that renders every PNG and JPEG file put into inbox to outbox once; a batch that is run again writes the same names.

    rejects: a folder for what can't be read, a JSON file (path, reason) of each batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # MAX_FILES at most
        if not paths:
            return
        frames, bad = read_images(batch.sparkSession, paths)
        write_images(render(frames, plan), outbox, fmt, plan.supersample).count()
        if rejects:
            bad.coalesce(1).write.mode("overwrite").json(f"{rejects}/batch={number}")

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", MAX_FILES).load(inbox)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
