"""Streams: duplicate marking behind a frontier, de-duplication with bounded state, event-time windows.

The frontier: records come in coordinate order (ref, pos); a key's state is released once the reference changes or its
coordinate lies more than ``max_length`` behind. Order and length are enforced by errors, not by dropping rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Positions of one reference on the time axis of a frontier: (ref, pos) becomes ref * SPAN + pos seconds.
SPAN = 1 << 32


def frontier_time(ref_id: Column, pos: Column) -> Column:
    """(ref, pos) as one event time, so that a watermark can stand for the frontier."""
    return F.timestamp_seconds(F.when(ref_id < 0, F.lit(1 << 20)).otherwise(ref_id).cast("long") * F.lit(1 << 12) + F.floor(pos / F.lit(1 << 20)).cast("long"))


def checked(records: DataFrame, length: Column, max_length: int) -> DataFrame:
    """records; one longer than the bound is an error."""
    ok = F.when(length > max_length, F.raise_error(F.lit("a record is longer than the bound")).cast("boolean")).otherwise(F.lit(True))
    return records.filter(ok)


def mark_streaming(records: DataFrame, part: str, max_length: int, idle_ms: int | None = None) -> DataFrame:
    """(part, rank, name, is_dup) from a stream (part, ref_id, pos, coord, orient, paired, score, name, rank).

    ``part`` deals the stream into groups that are in coordinate order each (a library, a range of references). Pairs of one key keep the
    highest score, ties the smaller name; fragments lose where the key has a pair, else keep the highest score, ties the
    first. Rows leave when the frontier has passed them, so that state is bounded by the records within ``max_length``. What the
    frontier has not passed stays held; with ``idle_ms`` a part without records for so long is closed (such a stream runs on
    until it is stopped)."""
    schema = f"{part} long, rank long, name string, is_dup boolean"
    state_schema = "ref long, pos long, held string"

    def close(rows: list[list]) -> list[tuple]:
        keys: dict[tuple, list] = {}
        for r in rows:
            keys.setdefault((r[0], r[1], r[2]), []).append(r)
        out = []
        for group in keys.values():
            pairs = [r for r in group if r[3]]
            if pairs:
                best = min(pairs, key=lambda r: (-r[4], r[5]))
            else:
                best = min(group, key=lambda r: (-r[4], r[6]))
            out += [(r[6], r[5], r is not best) for r in group]
        return out

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        ref, pos, held = state.get if state.exists else (-(1 << 40), 0, "[]")
        rows, out = json.loads(held), []
        if state.hasTimedOut:
            out = close(rows)
            state.remove()
        else:
            fresh = pd.concat(list(batches)).sort_values("rank")
            for r in fresh.itertuples(index=False):
                here = (1 << 31) if r.ref_id < 0 else int(r.ref_id), int(r.pos)
                if here < (ref, pos):
                    raise ValueError("the input is not in coordinate order")
                if here[0] != ref:
                    out += close(rows)
                    rows = []
                else:
                    done = [x for x in rows if x[1] + max_length < here[1]]
                    if done:
                        out += close(done)
                        rows = [x for x in rows if x[1] + max_length >= here[1]]
                ref, pos = here
                rows.append([here[0], int(r.coord), str(r.orient), bool(r.paired), int(r.score), str(r.name), int(r.rank)])
            state.update((ref, pos, json.dumps(rows)))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({part: [key[0]] * len(out), "rank": [x[0] for x in out], "name": [x[1] for x in out], "is_dup": [x[2] for x in out]})

    return records.groupBy(part).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], slide: str | None = None) -> DataFrame:
    """(start, by, n, total): counts and sums of ``value`` in windows of event time."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: list[str]) -> DataFrame:
    """(start, stop, by, n): runs of events that lie less than the gap apart."""
    return events.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")
