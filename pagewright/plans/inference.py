"""Asking a model server from within tasks: a window of requests in flight, retries, a time limit, a key that makes repeats harmless."""

from __future__ import annotations

import hashlib
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Limits:
    """Of each task: requests at once, further attempts after one that raised, seconds before the first of them (doubled for each next), seconds that a row may take in all."""

    in_flight: int = 8
    retries: int = 2
    backoff: float = 0.5
    timeout: float = 600.0
    #: Rows whose answers a task holds before it hands them on.
    rows: int = 256

    def __post_init__(self):
        if self.in_flight < 1 or self.retries < 0 or self.timeout <= 0 or self.rows < 1:
            raise ValueError("limits must allow a request")


def request_key(row: dict) -> str:
    """The same for the same columns, in whichever task or attempt: a server or cache that knows it answers from memory."""
    return hashlib.sha256(repr(sorted((k, str(v)) for k, v in row.items())).encode()).hexdigest()


def _attempts(ask: Callable, row: dict, limits: Limits, until: float) -> tuple[str, int | None, str | None]:
    """(payload, tokens, error) of the first attempt that answers, or the error of the last."""
    said = "TimeoutError: no time left"
    for k in range(limits.retries + 1):
        if k and time.monotonic() + limits.backoff * 2 ** (k - 1) >= until:
            break
        if k:
            time.sleep(limits.backoff * 2 ** (k - 1))
        try:
            payload, tokens = ask(row)
            return payload, tokens, None
        except Exception as e:  # noqa: BLE001  whatever the client raises belongs to this row
            said = f"{type(e).__name__}: {e}"
    return "", None, said


def answers(rows: list[dict], ask: Callable, limits: Limits) -> Iterator[tuple[int, tuple[str, int | None, str | None]]]:
    """(index, (payload, tokens, error)) for every row, each once, in the order in which they come; never more than ``in_flight`` at work.

    A row over its time is given up: it gets an error, its place goes to the next, and an answer that comes later is dropped.
    """
    came: queue.SimpleQueue = queue.SimpleQueue()
    waiting, ahead = {}, iter(enumerate(rows))

    def start() -> None:
        for k, row in ahead:
            waiting[k] = until = time.monotonic() + limits.timeout
            threading.Thread(target=lambda: came.put((k, _attempts(ask, row, limits, until))), daemon=True).start()
            return

    for _ in range(limits.in_flight):
        start()
    while waiting:
        try:
            k, answer = came.get(timeout=max(0.0, min(waiting.values()) - time.monotonic()))
            late = [k] if waiting.pop(k, None) is not None else []
            out = {k: answer}
        except queue.Empty:
            now = time.monotonic()
            late = [k for k, until in waiting.items() if until <= now]
            out = {k: ("", None, f"TimeoutError: no answer within {limits.timeout:g} s") for k in late}
            for k in late:
                del waiting[k]
        for k in late:
            start()
            yield k, out[k]


def answered(work: DataFrame, ask: Callable, columns: tuple[str, ...], limits: Limits | None = None) -> DataFrame:
    """work with raw_payload, tokens and error of each row, as ``ask`` gives them for a row of ``columns`` and its request_key; a failure is the row's error, not the job's.

    Rows stay in their partitions, so a task has its own window of requests; a task that runs again asks with the same keys.
    """
    held = limits or Limits()

    def call(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, held.rows):
                part = batch.slice(lo, held.rows)
                rows = [r | {"request_key": request_key(r)} for r in part.select(list(columns)).to_pylist()]
                out = [("", None, "")] * len(rows)
                for k, answer in answers(rows, ask, held):
                    out[k] = answer
                own = [pa.array([x[0] for x in out], pa.string()), pa.array([None if pd.isna(x[1]) else int(x[1]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], [*part.schema.names, "raw_payload", "tokens", "error"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields)
    return work.mapInArrow(call, f"{kind}, raw_payload string, tokens bigint, error string")
