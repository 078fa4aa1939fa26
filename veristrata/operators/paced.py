"""Model calls at a pace that a whole job keeps, with bounded requests in flight and retries by kind of error.

The rate is shared out: items are dealt to as many tasks as may run at once, and each sends
at its part of the rate, from a start of its own within the first step.  A task keeps a
bounded number of requests in flight and returns replies in the order of its items.  Only
errors that may pass (429 and 5xx) are tried again, after a wait that doubles and jitters;
a retry waits for its turn at the pace like any other request.  An error becomes a failed
row, never a failed job.
"""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

RETRIED = frozenset({429, 500, 502, 503, 504})


class TransportError(RuntimeError):
    """A reply with an HTTP status that is no success."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"HTTP {status} {message}".strip())
        self.status = status


@dataclass(frozen=True)
class Pace:
    """Requests a second of the whole job, tasks that share them, and what each task may do."""

    per_second: float
    tasks: int = 4
    in_flight: int = 4
    retries: int = 4
    backoff: float = 1.0
    seed: int = 0

    def __post_init__(self) -> None:
        if self.per_second <= 0 or self.tasks < 1 or self.in_flight < 1 or self.retries < 0 or self.backoff < 0:
            raise ValueError("a pace needs a positive rate, tasks and requests in flight, and no negative retries or waits")

    @property
    def step(self) -> float:
        """Seconds between two requests of one task."""
        return self.tasks / self.per_second


class _Turns:
    """Starting times of one task's requests, a step apart; any thread may wait for the next."""

    def __init__(self, pace: Pace, rng: random.Random):
        self._step, self._lock = pace.step, threading.Lock()
        self._next = time.monotonic() + rng.uniform(0, self._step)

    def wait(self) -> None:
        with self._lock:
            at = max(self._next, time.monotonic())
            self._next = at + self._step
        time.sleep(max(0.0, at - time.monotonic()))


def call(client: Callable[[str], str], prompt: str, pace: Pace, turn: Callable[[], None], rng: random.Random) -> tuple[str, str, int]:
    """(reply or reason, execution status, attempts) of one prompt."""
    for attempt in range(pace.retries + 1):
        turn()
        try:
            return client(prompt), "ok", attempt + 1
        except TransportError as e:
            if e.status not in RETRIED or attempt == pace.retries:
                return f"TransportError: {e}"[:200], "failed", attempt + 1
            wait = pace.backoff * 2**attempt
            time.sleep(wait + rng.uniform(0, min(0.25, wait / 10)))
        except Exception as e:  # noqa: BLE001 - any other error fails the row closed
            return f"{type(e).__name__}: {e}"[:200], "failed", attempt + 1
    raise AssertionError


def stage(items: DataFrame, client: Callable[[], Callable[[str], str]], pace: Pace, prompt: str = "prompt") -> DataFrame:
    """Items with reply, execution_status, attempts and latency (seconds, waits included).

    No more than ``pace.tasks`` tasks exist, so the rate holds however many could run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rng = random.Random(pace.seed * 1_000_003 + part)
        turns, ask = _Turns(pace, rng), client()

        def one(text: str) -> tuple[str, str, int, float]:
            began = time.perf_counter()
            return *call(ask, text, pace, turns.wait, rng), time.perf_counter() - began

        with ThreadPoolExecutor(pace.in_flight) as pool:
            for batch in batches:
                done, waiting = [], deque()
                for text in batch[prompt]:
                    if len(waiting) == pace.in_flight:
                        done.append(waiting.popleft().result())
                    waiting.append(pool.submit(one, text))
                done += [w.result() for w in waiting]
                reply, status, attempts, latency = zip(*done, strict=True) if done else ((), (), (), ())
                yield batch.assign(reply=list(reply), execution_status=list(status), attempts=list(attempts), latency=list(latency))

    schema = f"{items._jdf.schema().toDDL()}, reply string, execution_status string, attempts int, latency double"
    return items.repartition(pace.tasks).mapInPandas(run, schema)


def http_client(url: str, timeout: float = 30.0, headers: dict[str, str] | None = None) -> Callable[[], Callable[[str], str]]:
    """A client that posts the prompt as the body and returns the reply's text."""

    def make() -> Callable[[str], str]:
        import urllib.error
        import urllib.request

        def send(prompt: str) -> str:
            request = urllib.request.Request(url, prompt.encode(), {"Content-Type": "application/json", **(headers or {})})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    return reply.read().decode()
            except urllib.error.HTTPError as e:
                raise TransportError(e.code, e.reason) from None

        return send

    return make
