"""Structured Streaming: rate limits, leases and index upkeep as stateful or micro-batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvina.operators.index import index_batch
from corvina.session import cut

def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """A key's rows of a batch in order of time, however many chunks they come in.

    They are held together: what a key sends within one micro-batch, which the source's rate limit bounds.
    """
    held = list(frames)
    if held:
        yield pd.concat(held, ignore_index=True).sort_values(by, kind="stable")


_DECISIONS = "client string, ts_ms long, request_id long, allowed boolean, retry_after_s long"


def limited(requests: DataFrame, limit: int = 120, window_ms: int = 60_000, *, evict: bool = True) -> DataFrame:
    """Decisions on a stream of (client, ts_ms, request_id), windows anchored at a client's first request.

    State is one window per client; with ``evict`` it is dropped when a client has been silent for a window (processing
    time), for which the query keeps running batches: leave it off with an availableNow trigger.
    """

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        for frame in _in_order(frames, ["ts_ms", "request_id"]):
            allowed, wait = [], []
            for t in frame["ts_ms"]:
                if start is None or t - start >= window_ms:
                    start, used = int(t), 0
                used += 1
                allowed.append(used <= limit)
                wait.append(0 if used <= limit else -((t - start - window_ms) // 1000))
            yield pd.DataFrame({"client": key[0], "ts_ms": frame["ts_ms"], "request_id": frame["request_id"], "allowed": allowed, "retry_after_s": wait})
        state.update((start, used))
        if evict:
            state.setTimeoutDuration(window_ms)

    kind = GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout
    return requests.groupBy("client").applyInPandasWithState(run, _DECISIONS, "start long, used long", "append", kind)


_LEASES = "job_id string, url string, ts_ms long, worker string, action string, granted boolean, attempts long"


def leased(events: DataFrame, lease_ms: int = 30_000) -> DataFrame:
    """Decisions on a stream of (job_id, url, ts_ms, worker, action) with the actions claim, heartbeat and done.

    A claim is granted if nobody holds the entry or the lease has run out (at or after its end); a heartbeat renews only
    an own lease that hasn't; done ends an own lease.  State is one lease per entry.
    """

    def run(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, expires, attempts = state.get if state.exists else (None, 0, 0)
        for frame in _in_order(frames, ["ts_ms", "worker"]):
            granted, tries = [], []
            for t, worker, action in zip(frame["ts_ms"], frame["worker"], frame["action"]):
                held = owner is not None and t < expires
                if action == "claim":
                    ok = not held
                    if ok:
                        owner, expires, attempts = worker, int(t) + lease_ms, attempts + 1
                else:
                    ok = held and owner == worker
                    if ok and action == "heartbeat":
                        expires = int(t) + lease_ms
                    elif ok:
                        owner, expires = None, 0
                granted.append(ok)
                tries.append(attempts)
            yield pd.DataFrame({"job_id": key[0], "url": key[1], "ts_ms": frame["ts_ms"], "worker": frame["worker"], "action": frame["action"], "granted": granted, "attempts": tries})
        state.update((owner, expires, attempts))

    return events.groupBy("job_id", "url").applyInPandasWithState(run, _LEASES, "owner string, expires long, attempts long", "append", GroupStateTimeout.NoTimeout)


def keep_index(load: Callable[[], tuple[DataFrame, DataFrame]], save: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that indexes each micro-batch: ``load`` gives documents and links, ``save`` takes the new ones.

    The results are checkpointed before they are saved, as ``save`` may replace what ``load`` reads.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        documents, links = load()
        documents, links = index_batch(documents, links, batch)
        save(cut(documents), cut(links))

    return handle
