"""Live activity as Structured Streaming jobs. Each has a batch twin in operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strideframe.operators import activity, nearby
from strideframe.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Kept(StatefulProcessor):
    """One JSON value per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("value", "value string")

    def load(self, empty):
        kept = self._value.get()
        return json.loads(kept[0]) if kept else empty

    def save(self, value) -> None:
        self._value.update((json.dumps(value),))

    def close(self) -> None:
        pass


def _latest(runs: list[list], most: int) -> list[list]:
    """The `most` last distinct courses of rows (ts, completion_id, course_key, ...), oldest first.

    Whatever order rows come in, keeping only these loses nothing: a course that
    others have pushed out can only come back by a newer row.
    """
    last = {r[2]: r for r in sorted(runs, key=lambda r: (r[0], r[1]))}
    return sorted(last.values(), key=lambda r: (r[0], r[1]))[-most:]


def _rows(batch: pd.DataFrame) -> list[list]:
    """(ts, completion_id, course_key, shape, place) of a batch; times as fixed-width text, which sorts like time."""
    return [[t, int(i), int(c), s, p] for t, i, c, s, p in zip(
        batch["ts"].dt.strftime("%Y-%m-%dT%H:%M:%S.%f"), batch["completion_id"], batch["course_key"], batch["shape"], batch["place"])]


class _Passport(_Kept):
    """Last distinct courses of a user; a repeated course moves to the end. Late and unordered rows find their place."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, runs = self.load((0, []))
        for batch in rows:  # an Arrow batch at a time; the state never exceeds the cap by more than a batch
            seen += len(batch)
            runs = _latest(runs + _rows(batch), activity.PASSPORT_RUNS)
        self.save((seen, runs))
        shapes = sorted({r[3] for r in runs})
        places: dict[str, set] = {}
        for r in runs:
            places.setdefault(r[4], set()).add(r[3])
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "runs": [len(runs)], "shapes": [",".join(shapes)],
                            "masters": [sum(len(v) == activity.ALL_SHAPES for k, v in places.items() if k)],
                            "complete": [len(shapes) == activity.ALL_SHAPES]})


class _Relay(_Kept):
    """The first leg in time fixes a relay's shape; legs of other shapes are rejected, the last legs stay.

    A leg that comes late may be the first one after all, so every shape keeps its
    first leg, its number of legs and its last distinct courses: a few rows a user,
    from which the answer is the same in whatever order legs arrive.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shapes = self.load({})
        for batch in rows:
            new: dict[str, list] = {}
            for r in _rows(batch):
                new.setdefault(r[3], []).append(r)
            for shape, legs in new.items():
                first, n, last = shapes.get(shape, (None, 0, []))
                first = min([x for x in (first, *[r[:2] for r in legs]) if x])
                shapes[shape] = (first, n + len(legs), _latest(last + legs, activity.RELAY_LEGS))
        self.save(shapes)
        seen = sum(n for _, n, _ in shapes.values())
        shape, (_, n, legs) = min(shapes.items(), key=lambda s: s[1][0])
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "shape": [shape], "legs": [len(legs)],
                            "top_course": [max(r[2] for r in legs)], "rejected": [seen - n]})


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="None")


def passports(completions: DataFrame) -> DataFrame:
    """Updates of every user's passport."""
    return _stateful(completions, "user_id", _Passport(), "user_id long, seen long, runs long, shapes string, masters long, complete boolean", "Update")


def relays(completions: DataFrame) -> DataFrame:
    """Updates of every user's relay."""
    return _stateful(completions, "user_id", _Relay(), "user_id long, seen long, shape string, legs long, top_course long, rejected long", "Update")


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", transform=None) -> StreamingQuery:
    """Every micro-batch, after `transform`, as Parquet under its batch id; a repeated batch replaces itself."""
    def put(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(put).trigger(availableNow=True).start())


def watch_off_route(fixes: DataFrame, segments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Live monitor: every fix with its distance from its course's line."""
    return write_batches(fixes, path, checkpoint, transform=lambda batch: nearby.off_route(batch, segments))


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append", transform=None) -> DataFrame:
    """Runs a stream over what is there now, in the shared checkpoint folder, and reads the result back."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = write_batches(stream, f"{base}/out", f"{base}/ckpt", mode, transform)
    q.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*")


def latest_per(df: DataFrame, key: str) -> DataFrame:
    """The newest update per key of an update-mode result."""
    rest = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
