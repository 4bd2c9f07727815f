"""Online forms of two batch operators. Replayed over a finished stream, each
gives the batch result.

Input rows are keyed by run, relationship and entity; keys share a call and a state by groups. Within a key, rows come
in frame order; a late row cannot be folded into a closed interval, so the
caller orders each file or partition of the source (a watermark drops rows
later than the delay it allows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INTERVAL = (
    "run_id long, type string, entity_id string, frame_first long, frame_last long, "
    "t_start double, t_end double, compare double"
)
# event time an interval may stay open with no new frame before it is emitted
GRACE_MS = 1000
# keys are dealt to this many groups; a group is one call and one state however many keys it holds
GROUPS = 1024
_KEY = ["run_id", "type", "entity_id"]


def _names() -> list[str]:
    return [part.split()[0] for part in INTERVAL.split(", ")]


def _packed(opened: pd.DataFrame) -> bytes:
    return pa.ipc.serialize_pandas(opened, preserve_index=False).to_pybytes()


def _fold_intervals(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Extend each key's open interval while the value holds and frames follow on; otherwise emit it
    and open the next. One open interval per key is all the state, with the time it may stay open to."""
    now = state.getCurrentWatermarkMs()
    opened = pa.ipc.deserialize_pandas(state.get[0]) if state.exists else None
    out = []
    if not state.hasTimedOut:
        rows = pd.concat(list(batches))
        fresh = pd.DataFrame({
            **{c: rows[c] for c in _KEY}, "frame_first": rows["frame_idx"], "frame_last": rows["frame_idx"],
            "t_start": rows["t"], "t_end": rows["t"], "compare": rows["compare"],
        })
        fresh["due"] = now + GRACE_MS
        both = fresh.assign(_side=1) if opened is None else pd.concat([opened.assign(_side=0), fresh.assign(_side=1)])
        both = both.sort_values([*_KEY, "_side", "frame_first"], ignore_index=True, kind="stable")
        same = np.ones(len(both) - 1, dtype=bool)
        for c in _KEY:
            same &= both[c].to_numpy()[1:] == both[c].to_numpy()[:-1]
        new_key = np.r_[True, ~same]
        follows = (both["frame_first"].to_numpy()[1:] == both["frame_last"].to_numpy()[:-1] + 1) & (
            both["compare"].to_numpy()[1:] == both["compare"].to_numpy()[:-1]
        )
        begins = np.flatnonzero(np.r_[True, ~(same & follows)])
        ends = np.r_[begins[1:], len(both)] - 1
        spans = both.iloc[begins].reset_index(drop=True)
        for c in ("frame_last", "t_end", "due"):
            spans[c] = both[c].to_numpy()[ends]
        stays = np.r_[new_key[begins[1:]], True]  # the last interval of a key
        out.append(spans[~stays])
        opened = spans[stays].drop(columns="_side")
    over = opened["due"].to_numpy() < now
    out.append(opened[over])
    opened = opened[~over]
    if len(opened):
        state.update((_packed(opened),))
        state.setTimeoutTimestamp(int(opened["due"].min()))
    elif state.exists:
        state.remove()
    closed = [x for x in out if len(x)]
    if closed:
        yield pd.concat(closed)[_names()]


def stream_intervals(observations: DataFrame, lateness: str = "1 second", groups: int = GROUPS) -> DataFrame:
    """Closed intervals of a streaming observation table with an event-time
    column `at`. An interval still open is emitted when the watermark passes.

    A call of Python and a state cost milliseconds whatever they hold, so keys are dealt to
    `groups`, and the keys of a group are folded and stored together."""
    return (
        observations.withWatermark("at", lateness)
        .select(*_KEY, "frame_idx", "t", "compare", "at", F.pmod(F.xxhash64(*_KEY), F.lit(groups)).alias("group"))
        .groupBy("group")
        .applyInPandasWithState(
            _fold_intervals, INTERVAL, "open binary", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


ALARM = "run_id long, t double, kind string"


def _watch(watchdog: float, t_start: float | None):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        run, _ = pd.factorize(rows["run_id"], use_na_sentinel=False)
        rows = rows.assign(_run=run).sort_values(["_run", "t", "side", "seq"], ignore_index=True)
        run, t, offer = rows["_run"].to_numpy(), rows["t"].to_numpy(float), rows["side"].to_numpy() == 0
        begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ends = np.r_[begins[1:], len(rows)] - 1
        known = rows.loc[begins, ["run_id"]]
        held = pa.ipc.deserialize_pandas(state.get[0]) if state.exists else None
        if held is None:
            known = known.assign(heard=np.nan, expires=np.nan)
        else:
            known = known.merge(held, on="run_id", how="left")
        began = rows["t_start"].to_numpy(float)[begins] if t_start is None else np.full(len(begins), float(t_start))
        heard0 = np.where(known["heard"].isna(), began, known["heard"])
        # what was last heard, and the expiry of the last offer, at every row of a run
        heard = pd.Series(np.where(offer, t, np.nan)).groupby(run).cummax().groupby(run).ffill().to_numpy()
        heard = np.fmax(heard, heard0[run])
        last = np.maximum.accumulate(np.where(offer, np.arange(len(rows)), -1))
        until = np.where(last >= begins[run], (t + rows["horizon"].to_numpy(float))[last], known["expires"].to_numpy()[run])
        silent = ~offer & (t - heard > watchdog)
        stale = ~offer & ~silent & (t > until)
        ended = pd.DataFrame({"run_id": rows["run_id"].to_numpy()[ends], "heard": heard[ends], "expires": until[ends]})
        if held is not None:
            ended = pd.concat([held[~held["run_id"].isin(ended["run_id"])], ended], ignore_index=True)
        state.update((_packed(ended),))
        kind = np.where(silent, "watchdog_expiry", "stale_declaration")
        yield rows.assign(kind=kind).loc[silent | stale, ["run_id", "t", "kind"]]

    return step


def stream_watchdog(
    events: DataFrame, watchdog: float, t_start: float | None = None, groups: int = GROUPS
) -> DataFrame:
    """Alarms for actions after silence or under an expired declaration.
    State is the last instant heard and the last expiry of each run, and the runs of a group share a call and a
    state. A run is listened to from `t_start` on; with None, from the instant its rows name in a column of that name."""
    group = F.when(F.col("run_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("run_id"), F.lit(groups)))
    return events.withColumn("group", group).groupBy("group").applyInPandasWithState(
        _watch(watchdog, t_start), ALARM, "held binary", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive a streaming query over what is available into a Parquet table."""
    q = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def as_stream(df: DataFrame, path: str) -> DataFrame:
    """Write a batch table and read it back as a file stream."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def closing_rows(observations: DataFrame) -> DataFrame:
    """One sentinel per key after its last frame, so a replay closes the last
    interval of every key without waiting for the watermark."""
    last = observations.groupBy("run_id", "type", "entity_id").agg(
        F.max("frame_idx").alias("frame_idx"), F.max("t").alias("t"), F.max("at").alias("at")
    )
    return last.select(
        "run_id", "type", "entity_id", (F.col("frame_idx") + 2).alias("frame_idx"), "t",
        F.lit(float("-1")).alias("compare"), "at",
    )
