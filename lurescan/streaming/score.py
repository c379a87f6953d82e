"""Checking a stream of URLs or requests. Same functions as the batch check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.check import check
from ..sources.readers import parse_requests, rejected_requests, request_urls


def distinct_urls(stream: DataFrame, ts: str = "ts", url: str = "url", delay: str = "10 minutes") -> DataFrame:
    """Drops repeats of a URL within the watermark (ST2). State is keyed by URL and expires."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([url])


def score_stream(stream: DataFrame, detector=None, threshold: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Result rows of a stream of URLs (ST1): stateless and map-only."""
    return check(stream, detector, threshold, keep=keep)


def verdict_counts(stream: DataFrame, ts: str = "ts", window: str = "1 day", delay: str = "1 day", detector=None, threshold: float | None = None) -> DataFrame:
    """``start, end, verdict, urls`` per window of event time (ST1, ST2).

    Appended once the watermark, the latest time seen less ``delay``, has passed a window's end: its state is dropped
    then, and rows that come later still are counted as late (``state_of``) and not at all here.
    """
    results = check(stream, detector, threshold, keep=(ts,)).withWatermark(ts, delay)
    counted = results.groupBy(F.window(ts, window).alias("w"), "verdict").agg(F.count(F.lit(1)).alias("urls"))
    return counted.select("w.start", "w.end", "verdict", "urls")


def start_counts(counts: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends closed windows to Parquet, exactly once."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def state_of(query: StreamingQuery) -> list[dict]:
    """Per micro-batch: rows read, groups held in state, groups dropped from it, and rows that came too late."""
    out = []
    for p in query.recentProgress:
        held = p["stateOperators"] or [{}]
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "held": held[0].get("numRowsTotal", 0), "dropped": held[0].get("numRowsRemoved", 0), "late": held[0].get("numRowsDroppedByWatermark", 0)})
    return out


def start_scoring(stream: DataFrame, out: str, checkpoint: str, detector=None, threshold: float | None = None, keep: tuple[str, ...] = (), trigger: dict | None = None) -> StreamingQuery:
    """Writes result rows to Parquet, exactly once."""
    writer = score_stream(stream, detector, threshold, keep).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_requests(requests: DataFrame, out: str, quarantine: str, checkpoint: str, key: str = "request_id", detector=None, threshold: float | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A stream of JSON request bodies: accepted URLs are checked, malformed requests set aside (ST1, ST3).

    Each micro-batch overwrites its own folder, so a repeated batch leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_requests(batch)
        urls = request_urls(parsed, key)
        check(urls, detector, threshold, keep=(key, "pos")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        rejected_requests(parsed).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
