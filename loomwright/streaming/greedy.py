"""Greedy per-key decisions: comment dedup, rate limit, heartbeat throttle; batch and stream.

What is admitted depends on what was admitted before, which no window function says. Each rule is
one small kernel over a key's events in order and a bounded state; the batch and the stream form
share it. The state is a few times and a text, and a key idle for an hour is forgotten.

The batch form walks over partitions sorted by key and time and keeps only the current key's state,
so that a key with a third of all rows streams through one task in constant memory; its order is the
rule, and more machines can't share it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS = 3_600_000
#: (state or None, seconds, text) -> (admitted, state); the state is a list that JSON can hold.
Kernel = Callable[[list | None, float, str], tuple[bool, list]]


def same_comment(seconds: float = 60.0) -> Kernel:
    """Rejects a text equal to the last accepted one within ``seconds`` of it; a rejected one changes nothing."""

    def decide(state: list | None, at: float, text: str) -> tuple[bool, list]:
        if state and state[1] == text and at - state[0] < seconds:
            return False, state
        return True, [at, text]

    return decide


def at_most(n: int = 5, seconds: float = 60.0) -> Kernel:
    """Admits while fewer than ``n`` were admitted in the last ``seconds``."""

    def decide(state: list | None, at: float, text: str) -> tuple[bool, list]:
        recent = [t for t in state or [] if at - t < seconds]
        return (False, recent) if len(recent) >= n else (True, [*recent, at])

    return decide


def spaced(seconds: float = 5.0, first_free: bool = False) -> Kernel:
    """Keeps an event only ``seconds`` or more after the last kept one. The clock starts with the key's
    first event (the task's start), which is not kept itself unless ``first_free``."""

    def decide(state: list | None, at: float, text: str) -> tuple[bool, list]:
        if state is None:
            return first_free, [at]
        return (True, [at]) if at - state[0] >= seconds else (False, state)

    return decide


def admit(events: DataFrame, keys: list[str], kernel: Kernel, at: str = "ts", text: str | None = None, tie: str = "event_id") -> DataFrame:
    """``events`` with ``admitted``, decided per key in the order of ``at`` and ``tie``."""
    rows = events.withColumns({"__at": F.unix_micros(F.col(at).cast("timestamp")) / 1e6, "__text": F.col(text) if text else F.lit("")})
    schema = events.schema.add("admitted", "boolean")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for part in parts:
            out = []
            for now, when, words in zip(part[keys].itertuples(index=False, name=None), part["__at"], part["__text"]):
                if now != key:
                    key, state = now, None
                ok, state = kernel(state, when, words)
                out.append(ok)
            yield part.drop(columns=["__at", "__text"]).assign(admitted=out)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "__at", tie)
    return dealt.mapInPandas(run, schema)


def admit_stream(events: DataFrame, keys: list[str], kernel: Kernel, at: str = "ts", text: str | None = None, tie: str = "event_id", lateness: str = "1 hour") -> DataFrame:
    """The same on a stream: (keys, tie, admitted) for each event, with state kept from batch to batch.
    Events of a key are ordered within a batch; those later than ``lateness`` are dropped, and the state
    of a key goes once the watermark is an hour past its last event."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, tie]) + ", admitted boolean"
    rows = events.withColumns({"__at": F.unix_micros(F.col(at).cast("timestamp")) / 1e6, "__text": F.col(text) if text else F.lit("")})

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = json.loads(state.get[0]) if state.exists else None
        batch = pd.concat(list(parts), ignore_index=True).sort_values(["__at", tie])
        out = []
        for when, words in zip(batch["__at"], batch["__text"]):
            ok, own = kernel(own, when, words)
            out.append(ok)
        state.update((json.dumps(own),))
        state.setTimeoutTimestamp(max(int(batch["__at"].max() * 1000), state.getCurrentWatermarkMs()) + IDLE_MS)
        yield batch[[*keys, tie]].assign(admitted=out)

    timed = rows.withWatermark(at, lateness)
    return timed.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
