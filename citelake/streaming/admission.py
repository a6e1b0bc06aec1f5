"""Rate limiting of requests: sliding counts, and exact admission.

A request is admitted when fewer than ``limit`` *admitted* requests of its client lie in the span
before it. Rejected requests do not count, so the rule needs state in order of time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.operators.ordered import fill_forward, running_sum, trailing_count

SPAN_US = 60_000_000
_BLOCK_US = 3_600_000_000


def rate_counts(requests: DataFrame, limit: int = 10, span_us: int = SPAN_US) -> DataFrame:
    """Requests of the client in the span up to each request, and whether they exceed the limit."""
    counted = trailing_count(requests, ["client"], "t_us", span_us, "in_span")
    return counted.withColumn("over_limit", F.col("in_span") > limit)


def _admit(times: list[int], keys: list, limit: int, span_us: int, state: dict) -> list[bool]:
    """Verdicts for requests in order of time; ``state`` holds the current key's admitted times."""
    out = []
    for t, key in zip(times, keys):
        if key != state["key"]:
            state["key"], state["admitted"] = key, deque()
        admitted = state["admitted"]
        while admitted and admitted[0] <= t - span_us:
            admitted.popleft()
        fits = len(admitted) < limit
        if fits:
            admitted.append(t)
        out.append(fits)
    return out


def admit(requests: DataFrame, limit: int = 10, span_us: int = SPAN_US) -> DataFrame:
    """Exact admission of ``requests(client, t_us, event_id)``.

    A pause of at least the span clears a client's state, so a client is split at its pauses and the
    pieces go to different tasks. Inside a task the rows pass in sorted batches; only the current
    piece's admitted times, at most ``limit``, are held.
    """
    columns = requests.columns
    ties = ("event_id",)
    before = fill_forward(requests, ["client"], "t_us", F.col("t_us"), "__prev", _BLOCK_US, ties=ties)
    opens = F.when(F.col("__prev").isNull() | (F.col("t_us") - F.col("__prev") >= span_us), 1).otherwise(0)
    pieces = running_sum(before, ["client"], "t_us", opens, "__piece", _BLOCK_US, ties=ties)
    sorted_rows = pieces.select(*columns, "__piece").repartition("client", "__piece").sortWithinPartitions(
        "client", "__piece", "t_us", "event_id"
    )

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"key": None, "admitted": deque()}
        for batch in batches:
            keys = list(zip(batch["client"], batch["__piece"]))
            fits = _admit(batch["t_us"].tolist(), keys, limit, span_us, state)
            yield batch.drop(columns="__piece").assign(admitted=fits)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)
    return sorted_rows.mapInPandas(verdicts, f"{fields}, admitted boolean")


def admit_stream(requests: DataFrame, limit: int = 10, span_us: int = SPAN_US) -> DataFrame:
    """The same rule on a stream: state per client is the list of its admitted times in the span."""

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["t_us", "event_id"])
        held = {"key": key[0], "admitted": deque(state.get[0] if state.exists else [])}
        fits = _admit(rows["t_us"].tolist(), [key[0]] * len(rows), limit, span_us, held)
        state.update((list(held["admitted"]),))
        yield rows.assign(admitted=fits)[["client", "t_us", "event_id", "admitted"]]

    return requests.select("client", "t_us", "event_id").groupBy("client").applyInPandasWithState(
        step, "client long, t_us long, event_id long, admitted boolean", "times array<long>", "append", "NoTimeout"
    )
