"""Counts, gauges and timings of a run, handed to sinks on the driver."""

from __future__ import annotations

import json
import queue
import socket
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    kind: str
    name: str
    value: float
    tags: Mapping[str, str] = field(default_factory=dict)


class Metrics:
    """A bounded buffer; what finds it full is dropped rather than waited for."""

    def __init__(self, prefix: str = "", tags: Mapping[str, str] | None = None, size: int = 1024):
        self.prefix, self.tags, self.buffer = prefix, dict(tags or {}), queue.Queue(size)

    def _put(self, kind: str, name: str, value: float, tags: Mapping[str, str] | None) -> None:
        try:
            self.buffer.put_nowait(Metric(kind, f"{self.prefix}{name}", value, {**self.tags, **(tags or {})}))
        except queue.Full:
            pass  # a report is not worth holding the run back

    def count(self, name: str, value: int = 1, tags: Mapping[str, str] | None = None) -> None:
        self._put("count", name, value, tags)

    def gauge(self, name: str, value: float, tags: Mapping[str, str] | None = None) -> None:
        self._put("gauge", name, value, tags)

    @contextmanager
    def measure(self, name: str, tags: Mapping[str, str] | None = None) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self._put("timer", name, time.monotonic() - began, tags)

    def drain(self, sink: Callable[[Metric], None]) -> int:
        n = 0
        while not self.buffer.empty():
            sink(self.buffer.get_nowait())
            n += 1
        return n


class StatsD:
    """A sink that sends each metric as one datagram; a timer in milliseconds."""

    #: How the protocol marks the kinds.
    KINDS = {"count": "c", "gauge": "g", "timer": "ms"}

    def __init__(self, host: str = "127.0.0.1", port: int = 8125):
        self.address, self.socket = (host, port), socket.socket(socket.AF_INET, socket.SOCK_DGRAM)

    def line(self, m: Metric) -> str:
        value = m.value * 1000 if m.kind == "timer" else m.value
        tags = ",".join(f"{k}:{v}" for k, v in sorted(m.tags.items()))
        return f"{m.name}:{value:g}|{self.KINDS[m.kind]}" + (f"|#{tags}" if tags else "")

    def __call__(self, m: Metric) -> None:
        self.socket.sendto(self.line(m).encode(), self.address)


def observed(df: DataFrame, name: str, size: Column | None = None) -> tuple[DataFrame, Observation]:
    """The rows with a count of them, and the sum of their sizes, that the job itself takes; read it when the job has run."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    sums = [F.count(F.lit(1)).alias("rows")] + ([F.sum(size).cast("bigint").alias("bytes")] if size is not None else [])
    return df.observe(seen, *sums), seen


def reporter(url: str, tags: Mapping[str, str] | None = None) -> Callable[[str, BaseException], None]:
    """What a run's ``on_error`` may be: posts the state and the error once, and lets the run fail with its own error."""
    sent = []

    def report(state: str, error: BaseException) -> None:
        if not sent:
            sent.append(True)
            post(url, {**(tags or {}), "error": f"{type(error).__name__}: {error}", "state": json.loads(state)})

    return report


def post(url: str, payload: object, timeout: float = 10.0) -> None:
    """Post a report as JSON; any answer but 200 is an error."""
    body = json.dumps({"Payload": json.dumps(payload)}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        if answer.status != 200:
            raise RuntimeError(f"{url} answered {answer.status}")
