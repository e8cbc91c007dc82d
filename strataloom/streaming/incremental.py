"""A file index kept current by a stream of file versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import first_of, load_index, refreshed, save_index


def index_stream(versions: DataFrame, folder: str, tag: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the index in folder at the newest version of each file of a stream versions(path, lang, size, hash, content, seq).

    Each micro-batch tags only files whose hash is new; null content deletes a file. The index goes over
    to the new one by one atomic step, and a batch that runs again finds its files unchanged, so repeats
    do no harm. An index that is named but not readable ends the stream: it is never begun anew from a
    batch's own files.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = first_of(batch, ["path"], [F.desc("seq")]).drop("seq").persist()
        old = load_index(spark, folder)
        wanted = newest.where("content IS NOT NULL")
        rows = refreshed(wanted, old, tag)
        if old is not None:
            rows = old.join(newest.select("path"), "path", "left_anti").unionByName(rows, allowMissingColumns=True)
        save_index(rows, folder)
        newest.unpersist()

    writer = versions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
