"""Feed versions and vehicle activity as streams.

The reference data model has no unbounded tables; these two make the batch
operators incremental: versions of feeds arrive and only changed feeds go on, and
timed events add up to weekly activity under a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isochron.operators import feeds


def on_changed_feeds(versions: DataFrame, manifest: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``handle`` with the feeds (feed, sha) of each batch of versions (feed, sha, seen_at) that differ from the manifest.

    Of several versions of a feed in a batch the last seen counts.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        last = df.groupBy("feed").agg(F.max_by("sha", F.struct("seen_at", "sha")).alias("sha"))
        change = feeds.changed_feeds(manifest(), last).where("change IN ('created', 'modified')").select("feed")
        handle(last.join(change, "feed", "left_semi"), batch_id)

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_stream(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, key, cell, weight): events per hour of the week in tumbling windows; later than ``late`` is dropped."""
    cell = (F.weekday(ts) * 24 + F.hour(ts)).alias("cell")
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), F.col(key), cell).agg(F.count("*").alias("weight"))
