"""Calling models from tasks: bounded work in flight, waits between retries, pauses when the service asks for them.

A provider is a picklable function from a prompt to an answer. Each task calls it for
its own rows, several at a time; at most ``calls`` calls and ``tokens`` tokens are in
flight in a task, so a job's bound is that times its number of tasks. What fails after
all retries becomes a row with an error; the batch goes on. A null prompt is an empty
one; an empty table gives an empty table.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "id string, answer string, error string"


class Busy(Exception):
    """Raised by a provider that is asked too often; ``wait`` is the pause that it asks for, in seconds."""

    def __init__(self, wait: float = 0.0):
        super().__init__(f"asked too often, wait {wait} s")
        self.wait = wait


@dataclass(frozen=True)
class Limits:
    """What a task may do to a provider."""

    calls: int = 8
    tokens: int = 85_000
    retries: int = 3
    first_wait: float = 1.0
    most_wait: float = 30.0
    busy_wait: float = 5.0


class InFlight:
    """Lets calls in while they fit; one that is larger than the bound by itself goes alone."""

    def __init__(self, calls: int, tokens: int):
        self._free_calls, self._free_tokens, self._all = calls, tokens, tokens
        self._changed = threading.Condition()

    @contextmanager
    def hold(self, tokens: int) -> Iterator[None]:
        tokens = min(max(0, tokens), self._all)
        with self._changed:
            self._changed.wait_for(lambda: self._free_calls > 0 and tokens <= self._free_tokens)
            self._free_calls, self._free_tokens = self._free_calls - 1, self._free_tokens - tokens
        try:
            yield
        finally:
            with self._changed:
                self._free_calls, self._free_tokens = self._free_calls + 1, self._free_tokens + tokens
                self._changed.notify_all()


class Pause:
    """A pause of all of a task's calls together, as a busy service asks for it."""

    def __init__(self) -> None:
        self._until, self._lock = 0.0, threading.Lock()

    def ask(self, seconds: float) -> None:
        with self._lock:
            self._until = max(self._until, time.monotonic() + seconds)

    def keep(self, sleep: Callable[[float], None]) -> None:
        left = self._until - time.monotonic()
        if left > 0:
            sleep(left)


def ask(provider: Callable[[str], str], prompt: str, limits: Limits, pause: Pause, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(answer, error) of a call with its retries: waits double, with a random part, up to ``most_wait``."""
    error = None
    for turn in range(max(1, limits.retries)):
        pause.keep(sleep)
        try:
            return provider(prompt), None
        except Busy as e:
            error = f"Busy: {e}"
            pause.ask(e.wait or limits.busy_wait)
        except Exception as e:  # a provider may raise anything
            error = f"{type(e).__name__}: {e}"
            if turn + 1 < limits.retries:
                sleep(min(limits.most_wait, limits.first_wait * 2**turn) * (0.5 + random.random() / 2))
    return None, error


def call(rows: DataFrame, provider: Callable[[str], str], limits: Limits = Limits()) -> DataFrame:
    """(id, prompt) to (id, answer, error), one row each."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, pause = InFlight(limits.calls, limits.tokens), Pause()

        def one(prompt: str | None) -> tuple[str | None, str | None]:
            prompt = prompt or ""
            with gate.hold(len(prompt)):
                return ask(provider, prompt, limits, pause)

        with ThreadPoolExecutor(limits.calls) as pool:
            for b in batches:
                found = list(pool.map(one, b["prompt"]))
                yield pd.DataFrame({"id": b["id"], "answer": [a for a, _ in found], "error": [e for _, e in found]})

    return rows.select("id", "prompt").mapInPandas(task, SCHEMA)


def embedder(provider: Callable[[str], list[float]], limits: Limits = Limits(), most_chars: int = 8000) -> Callable[[DataFrame], DataFrame]:
    """(id, text) to (id, vector) by a provider, with the retries of ``call``; null for an empty text and where it fails."""

    def embed(rows: DataFrame) -> DataFrame:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gate, pause = InFlight(limits.calls, limits.tokens), Pause()

            def one(text: str | None):
                if not text:
                    return None
                with gate.hold(min(len(text), most_chars)):
                    return ask(provider, text[:most_chars], limits, pause)[0]

            with ThreadPoolExecutor(limits.calls) as pool:
                for b in batches:
                    yield pd.DataFrame({"id": b["id"], "vector": pd.Series(list(pool.map(one, b["text"])), dtype=object)})

        return rows.select("id", "text").mapInPandas(task, "id string, vector array<float>")

    return embed
