"""Job event streams: tails, running progress, item states with late results rejected, bursts and activity windows."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

TERMINAL = ("succeeded", "failed", "canceled")


def events(spark: SparkSession, path: str, schema, per_batch: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def tail(stream: DataFrame, after: int, late: str = "1 hour") -> DataFrame:
    """Events behind a cursor, each id once."""
    return stream.where(F.col("event_id") > after).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def follow(stream: DataFrame, job_id: str, after: int, where: str, checkpoint: str, ends: tuple[str, ...] = TERMINAL, seconds: float | None = None) -> bool:
    """The events of a job behind a cursor, written to ``where`` batch by batch up to and with the first of a state in
    ``ends``; then the stream stops.  False if ``seconds`` went by before.  Events come with rising ids; a batch that runs
    again writes its folder again."""
    ended = threading.Event()
    mine = stream.where((F.col("job_id") == job_id) & (F.col("event_id") > after))

    def write(batch: DataFrame, number: int) -> None:
        if ended.is_set():
            return
        last = batch.where(F.col("state").isin(*ends)).agg(F.min("event_id")).first()[0]
        (batch if last is None else batch.where(F.col("event_id") <= last)).write.mode("overwrite").parquet(f"{where}/batch={number}")
        if last is not None:
            ended.set()

    query = mine.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    begun = time.monotonic()
    while query.isActive and not ended.wait(0.1) and (seconds is None or time.monotonic() - begun < seconds):
        pass
    query.stop()
    if query.exception() and not ended.is_set():
        raise query.exception()
    return ended.is_set()


def progress(stream: DataFrame) -> DataFrame:
    """Events per job and state so far (update mode)."""
    return stream.groupBy("job_id", "state").count()


def burst_sessions(stream: DataFrame, gap: str = "2 seconds", late: str = "1 hour") -> DataFrame:
    """Bursts of a job's events: a pause longer than the gap ends one."""
    return stream.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"), F.sum("ms").alias("total")).select("job_id", "session.start", "session.end", "n", "total")


def activity(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each state per time window; rows behind the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide or length).alias("w"), "state").agg(F.count("*").alias("n"), F.sum("ms").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "state", "n", "total")


class ItemStates(StatefulProcessor):
    """One item's state machine: queued, running, then an end; a retry queues it again.  A result counts only with the
    current generation; others come out as rejected."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("item", "state string, generation long, attempts long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("event_id")
        state, generation, attempts, last = self.state.get() if self.state.exists() else ("new", -1, 0, -1)
        rejected = 0
        for event_id, to, gen in new[["event_id", "state", "generation"]].itertuples(index=False):
            if event_id <= last:
                continue
            last = int(event_id)
            if to == "queued" and gen >= generation:
                state, generation = to, int(gen)
            elif gen != generation:
                rejected += 1
            elif to == "running" and state in ("queued", "new"):
                state, attempts = to, attempts + 1
            elif to in TERMINAL and state in ("queued", "running"):
                state = to
            else:
                rejected += 1
        self.state.update((state, generation, attempts, last))
        yield pd.DataFrame({"job_id": [key[0]], "item_id": [key[1]], "state": [state], "attempts": [attempts], "rejected": [rejected]})

    def close(self) -> None:
        pass


def item_states(stream: DataFrame) -> DataFrame:
    """State of each item after each batch with news of it; needs the RocksDB state store."""
    return stream.groupBy("job_id", "item_id").transformWithStateInPandas(ItemStates(), "job_id string, item_id string, state string, attempts long, rejected long", "Update", "None")


class Results(StatefulProcessor):
    """Claims and results of one item.  A claim takes a queued item with its token; a result counts only with the token of
    the claim that runs, and not after a cancel, but for one that is ``committed``: what it did can not be undone.
    Every claim and result comes out, accepted or rejected, with the reason; a rejected one changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", "state string, token string, canceled boolean, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = sorted((e for part in rows for e in zip(*(part[c].tolist() for c in ("event_id", "state", "token", "committed")), strict=True)), key=lambda e: e[0])
        state, token, canceled, last = self.item.get() if self.item.exists() else ("new", None, False, -1)
        out = []
        for event_id, to, own, committed in new:
            if event_id <= last:
                continue
            last, accepted, reason = int(event_id), False, None
            if to == "queued":
                state, token, canceled = "queued", None, False
            elif to == "canceled":
                state, canceled = ("canceled" if state in ("new", "queued") else state), True
            elif to == "running":
                accepted = state in ("new", "queued") and not canceled
                reason = "claimed" if accepted else "not to be claimed"
                state, token = ("running", own) if accepted else (state, token)
            elif state != "running":
                reason = "not running"
            elif own != token:
                reason = "another claim"
            elif canceled and not committed:
                reason = "canceled"
            else:
                accepted, reason = True, "committed" if canceled else "finished"
                state, token = to, None
            if reason:
                out.append((*key, last, accepted, reason))
        self.item.update((state, token, canceled, last))
        yield pd.DataFrame(out, columns=["job_id", "item_id", "event_id", "accepted", "reason"])

    def close(self) -> None:
        pass


def results(stream: DataFrame) -> DataFrame:
    """Each claim and result of (job_id, item_id, event_id, state, token, committed) with whether it counts, and why; needs
    the RocksDB state store."""
    return stream.groupBy("job_id", "item_id").transformWithStateInPandas(Results(), "job_id string, item_id string, event_id long, accepted boolean, reason string", "Append", "None")


def write_results(stream: DataFrame, where: str, checkpoint: str) -> StreamingQuery:
    """Both outputs of ``results`` below ``where``: accepted and rejected; a batch that runs again writes its folders again.
    A batch is kept while both are written, or the states would be run through for each."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            for name, rows in (("accepted", kept.where("accepted")), ("rejected", kept.where("NOT accepted"))):
                rows.drop("accepted").write.mode("overwrite").parquet(f"{where}/{name}/batch={number}")
        finally:
            kept.unpersist()

    return results(stream).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Pairing(StatefulProcessor):
    """The files of one match key seen so far, and what they make of each other.

    Of n images and m annotations of a key only whether each is none, one or more matters.  When that changes, every
    file of the key comes out again with its new status; else only new files and files whose content changed do.  So a
    file comes out a bounded number of times, however many batches its key is spread over, and a popular key is read
    again only at those changes.  A file that is sent again unchanged changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "kind string, path string", "broken boolean")
        self.sizes = handle.getValueState("sizes", "images long, annotations long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        images, annotations = self.sizes.get() if self.sizes.exists() else (0, 0)
        before = (min(images, 2), min(annotations, 2))
        news: dict[tuple[str, str], bool] = {}
        for part in rows:
            for file in part[["kind", "path", "broken"]].itertuples(index=False, name=None):
                kind, path, broken = file[0], file[1], bool(file[2])
                known = self.files.containsKey((kind, path))
                if known and self.files.getValue((kind, path))[0] == broken:
                    continue
                self.files.updateValue((kind, path), (broken,))
                images, annotations = images + (not known and kind == "image"), annotations + (not known and kind == "annotation")
                news[kind, path] = broken
        self.sizes.update((images, annotations))
        now = (min(images, 2), min(annotations, 2))
        every = now != before or now == (1, 1)
        broken_annotation = now == (1, 1) and any(v[0] for k, v in self.files.iterator() if k[0] == "annotation")
        out = []
        for (kind, path), broken in ((tuple(k), v[0]) for k, v in self.files.iterator()) if every and news else news.items():
            out.append((*key, kind, path, self._status(kind, broken, *now, broken_annotation)))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=_PAIRED)
                out = []
        yield pd.DataFrame(out, columns=_PAIRED)

    @staticmethod
    def _status(kind: str, broken: bool, images: int, annotations: int, broken_annotation: bool) -> str:
        if kind == "annotation":
            return "used" if images else "orphan_annotation"
        if not annotations:
            return "hidden"
        if images > 1 or annotations > 1:
            return "duplicate_match"
        return "corrupt_image" if broken else "corrupt_annotation" if broken_annotation else "valid"

    def close(self) -> None:
        pass


_PAIRED = ["generation", "match_key", "kind", "asset_id", "status"]
_KEYS = {"relative_stem": "rel_stem", "same_directory": r"regexp_replace(path, r'\.[^./]*$', '')", "basename": "lower(stem)"}


def pairing(stream: DataFrame, strategy: str = "basename") -> DataFrame:
    """Files (generation, kind: image or annotation, path, rel_stem, stem, broken) as they come in, paired over all batches so
    far: whenever a partner, a second candidate or a late orphan comes, the new status of each file that it changes.
    The newest status of each path (``registered``) is what pairing all files at once gives; images without a candidate
    are hidden, annotations with an image used.  Needs the RocksDB state store."""
    keyed = stream.select("generation", F.expr(_KEYS[strategy]).alias("match_key"), "kind", "path", F.coalesce("broken", F.lit(False)).alias("broken"))
    return keyed.groupBy("generation", "match_key").transformWithStateInPandas(Pairing(), "generation long, match_key string, kind string, asset_id string, status string", "Update", "None")


def register(stream: DataFrame, index: str, checkpoint: str, generation: int) -> StreamingQuery:
    """Scan items appended to the index batch by batch; a batch that runs again writes its own folder again, items of
    another generation are left out."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.col("generation") == generation).withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(index)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registered(spark: SparkSession, index: str, generation: int) -> DataFrame:
    """The items of a generation that are there by now, each id as its newest batch has it: readable while the scan runs."""
    rows = spark.read.parquet(index).where(F.col("generation") == generation)
    columns = [c for c in rows.columns if c not in ("batch_id", "asset_id")]
    newest = rows.groupBy("asset_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("_n"))
    return newest.select("asset_id", "_n.*")


def scan_summary(spark: SparkSession, index: str, generation: int, revision: int) -> DataFrame:
    """Items per status of a finished scan, with the revision behind its batches: each batch counts one, the summary one."""
    batches = spark.read.parquet(index).where(F.col("generation") == generation).agg(F.countDistinct("batch_id").alias("_b"))
    counts = registered(spark, index, generation).groupBy("status").count()
    return counts.crossJoin(F.broadcast(batches)).withColumn("index_revision", F.lit(revision) + F.col("_b") + 1).drop("_b")  # one row


def drain(frame: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there and stop."""
    frame.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
