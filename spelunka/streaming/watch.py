"""Structured Streaming: incremental re-index, rolling latency, sessions and rate limits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spelunka.operators.telemetry import GAP_SECONDS, RING


def watch(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, debounce: str = "2 seconds") -> StreamingQuery:
    """Batches of new rows of a folder of Parquet files go to handle(batch, number). once: what there is, then stop.

    A batch number that was handled before comes again only after a failure, so handle should write by number (see Generations)."""
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def classify(batch: DataFrame, known: DataFrame) -> DataFrame:
    """path, hash, state of watched changes (path, hash null if deleted): paths with a dot segment go; the last row of a path counts."""
    clean = batch.where(~F.col("path").rlike(r"(^|/)\.[^/]"))
    last = clean.groupBy("path").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq"))
    both = last.join(known.select("path", F.col("hash").alias("old")), "path", "left")
    state = F.when(F.col("hash").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("hash"), "same").otherwise("modified")
    return both.select("path", "hash", state.alias("state")).where("state <> 'same'")


class Generations:
    """Which generation of a re-index may write: an older one than the newest begun is late and is discarded.

    Events (repo, kind, generation) are appended to a folder, so the state outlives the driver; without a session they are
    kept in memory. Events of a repository are few: one for each start, end or failure of a re-index."""

    SCHEMA = "repo string, kind string, generation long"

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        self.spark, self.folder, self.events = spark, folder, []

    def _add(self, repo: str, kind: str, generation: int) -> None:
        if self.spark is None:
            self.events.append((repo, kind, generation))
        else:
            self.spark.createDataFrame([(repo, kind, generation)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def _of(self, repo: str) -> list[tuple[str, int]]:
        if self.spark is None:
            return [(k, g) for r, k, g in self.events if r == repo]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return [(r.kind, r.generation) for r in self.spark.read.schema(self.SCHEMA).parquet(self.folder).where(F.col("repo") == repo).collect()]

    def _last(self, repo: str, kind: str) -> int:
        return max((g for k, g in self._of(repo) if k == kind), default=0)

    def start(self, repo: str) -> int:
        new = self._last(repo, "begun") + 1
        self._add(repo, "begun", new)
        return new

    def finish(self, repo: str, generation: int) -> bool:
        if generation < self._last(repo, "begun"):
            return False
        self._add(repo, "done", generation)
        return True

    def fail(self, repo: str) -> None:
        self._add(repo, "failed", self._last(repo, "begun"))

    def failures(self, repo: str) -> int:
        """Failures since a re-index was last done."""
        done = self._last(repo, "done")
        return sum(k == "failed" and g > done for k, g in self._of(repo))

    def stale(self, repo: str) -> bool:
        return self._last(repo, "begun") > self._last(repo, "done")

    def table(self) -> DataFrame:
        """repo, begun, done, failures."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        last = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("generation"))), F.lit(0))
        done = rows.groupBy("repo").agg(last("begun").alias("begun"), last("done").alias("done"))
        failed = rows.where("kind = 'failed'").join(done, "repo").where("generation > done").groupBy("repo").agg(F.count("*").alias("failures"))
        return done.join(failed, "repo", "left").fillna(0, ["failures"])


def fresh_enough(generations: Generations, repo: str, query: StreamingQuery | None = None, wait_ms: int = 500) -> bool:
    """Waits, at most wait_ms, until a repository's newest re-index is done, or the query has read what there is."""
    end = time.monotonic() + wait_ms / 1000
    while generations.stale(repo) and time.monotonic() < end:
        if query is not None and not query.isActive:
            break
        time.sleep(min(0.05, max(0.0, end - time.monotonic())))
    return not generations.stale(repo)


def stop_when_idle(query: StreamingQuery, idle_seconds: float, poll_seconds: float = 1.0) -> None:
    """Stops a query once it has read nothing for that long."""
    last = time.monotonic()
    seen = -1
    while query.isActive:
        progress = query.lastProgress
        if progress is not None and progress["numInputRows"] > 0 and progress["batchId"] != seen:
            seen, last = progress["batchId"], time.monotonic()
        if time.monotonic() - last >= idle_seconds:
            query.stop()
            return
        query.awaitTermination(poll_seconds)


class Folders:
    """One watching query a folder; one that fails is started again, at most `restarts` times, the others go on."""

    def __init__(self, start: Callable[[str], StreamingQuery], restarts: int = 3):
        self.start, self.restarts = start, restarts
        self.queries: dict[str, StreamingQuery] = {}
        self.failed: dict[str, int] = {}

    def add(self, folder: str) -> None:
        self.queries[folder] = self.start(folder)

    def remove(self, folder: str) -> None:
        self.queries.pop(folder).stop()

    def tend(self) -> list[str]:
        """Starts again what has failed; the folders that are given up."""
        lost = []
        for folder, running in list(self.queries.items()):
            if not running.isActive and running.exception() is not None:
                self.failed[folder] = self.failed.get(folder, 0) + 1
                if self.failed[folder] > self.restarts:
                    lost.append(folder)
                    del self.queries[folder]
                else:
                    self.queries[folder] = self.start(folder)
        return lost


def _newest(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The last RING rows of each tool by ts and the further keys, oldest first; rows without ts are oldest."""
    rows = rows.sort_values(keys, kind="stable", na_position="first")
    return rows[rows.groupby("tool", dropna=False, sort=False).cumcount(ascending=False) < RING]


def _trimmer(keys: list[str], most: int = 100 * RING):
    """Of each tool the rows that may be among its last: what a task holds at once is a batch and about `most` rows."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for df in frames:
            held.append(df)
            n += len(df)
            if n > most:
                kept = _newest(pd.concat(held, ignore_index=True), keys)
                if len(kept) > most // 2:  # so many tools that little goes: what is here is passed on
                    yield kept
                    kept = kept[:0]
                held, n = [kept], len(kept)
        if held:
            yield _newest(pd.concat(held, ignore_index=True), keys)

    return work


def _roller(keys: list[str], whole: set[str]):
    """whole: the keys that are whole numbers, which pandas turns into floats where one is unknown."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [*keys, "duration_ms", "bad"]
        rows = pd.DataFrame(dict(zip(names, map(list, state.get)))) if state.exists else None
        for df in frames:
            new = df[names]
            rows = new if rows is None else pd.concat([rows, new], ignore_index=True)
            rows = _newest(rows.assign(tool=0), keys)[names]
        values = [None if pd.isna(x) else float(x) for x in rows["duration_ms"]]
        plain = lambda c: [None if pd.isna(x) else int(x) if c in whole else x for x in rows[c].tolist()]
        state.update((*(plain(c) for c in keys), values, [int(x) for x in rows["bad"]]))
        v, n = sorted(values, key=lambda x: (x is None, x or 0.0)), len(values)  # unknown durations are last
        most = max((x for x in v if x is not None), default=None)
        yield pd.DataFrame({"tool": [key[0]], "n": [n], "p50": [v[n // 2]], "p95": [v[min(int(0.95 * n), n - 1)]], "max_ms": [most], "error_rate": [round(sum(rows["bad"]) / n, 4)]})

    return work


def rolling_latency(events: DataFrame, order: str | None = None) -> DataFrame:
    """tool, n, p50, p95, max_ms, error_rate over the last calls of each tool (tool, ts, duration_ms, ok), a row for each tool of
    a batch. Last is by ts, then by order, a column of numbers or texts (none: by arrival), whatever the order of arrival is. State is
    a bounded ring; before rows are dealt by tool, each task keeps the last ones of its own."""
    keys = ["ts"] if order is None else ["ts", order]
    rows = events.select("tool", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), *keys[1:], F.col("duration_ms").cast("double").alias("duration_ms"), F.when(F.col("ok"), 0).otherwise(1).alias("bad"))
    state = ", ".join(f"k{i} array<{rows.schema[c].dataType.simpleString()}>" for i, c in enumerate(keys)) + ", v array<double>, bad array<int>"
    whole = {c for c in keys if rows.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    last = rows.mapInPandas(_trimmer(keys), rows.schema)
    return last.groupBy("tool").applyInPandasWithState(_roller(keys, whole), "tool string, n long, p50 double, p95 double, max_ms double, error_rate double", state, "update", GroupStateTimeout.NoTimeout)


def turns(events: DataFrame, late: str = "10 minutes", gap: int = GAP_SECONDS) -> DataFrame:
    """user_id, start, end, n, size of turns that a pause of more than gap seconds closes; late rows beyond the watermark go."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "size")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """tool, start, n in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "tool").agg(F.count("*").alias("n")).select("tool", F.col("w.start").alias("start"), "n")


def _limiter(limit: int, seconds: int):
    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ([],)
        held, out = list(held), []
        for df in frames:
            for event, ts in sorted(zip(df["event_id"], df["ts"].astype("int64") if df["ts"].dtype == "int64" else df["ts"].astype("datetime64[us]").astype("int64")), key=lambda x: (x[1], x[0])):
                held = [t for t in held if t > ts - seconds * 1_000_000]
                ok = len(held) < limit
                if ok:
                    held.append(ts)
                out.append((event, ok))
        state.update((held,))
        yield pd.DataFrame(out, columns=["event_id", "accepted"])

    return work


def rate_limit(events: DataFrame, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """event_id, accepted: at most limit accepted events of a key in any sliding span; rejected ones don't count. State: the
    accepted times of one span, at most limit."""
    return events.groupBy(key).applyInPandasWithState(_limiter(limit, seconds), "event_id long, accepted boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)
