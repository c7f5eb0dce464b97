"""Model calls of a task: several in flight, retried, and remembered.

A chat model is slow and remote, so a task keeps a window of calls in flight
and hands out their results in the order of its rows.  Calls that fail for a
passing reason are made again after growing waits, as long as the task's
budget of retries lasts: a server that is down is not asked for ever.

A journal keeps every finished call in the shared folder, one line each, under
the partition that made it.  An attempt that follows a lost executor, or a run
that follows a failed one, takes those answers instead of asking again.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import threading
import time
import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

#: errors that may pass: no connection, no answer in time
PASSING = (ConnectionError, TimeoutError)


@dataclass(frozen=True)
class CallPolicy:
    """How a task calls the model; ``window`` above 1 needs a function that may be called from several threads."""

    window: int = 8
    #: calls for one row, the first included
    attempts: int = 4
    #: seconds before the first retry; each further wait is twice as long, up to ``max_wait_s``, less a random part
    wait_s: float = 0.5
    max_wait_s: float = 30.0
    #: retries of one task, all rows together
    retry_budget: int = 100
    retry_on: tuple[type[BaseException], ...] = PASSING


class Caller:
    """Calls ``fn`` under a policy; safe to use from the threads of one window."""

    def __init__(self, fn: Callable[..., str], policy: CallPolicy):
        self.fn, self.policy, self.left = fn, policy, policy.retry_budget
        self.lock = threading.Lock()

    def _may_retry(self) -> bool:
        with self.lock:
            self.left -= 1
            return self.left >= 0

    def __call__(self, *args) -> str:
        wait = self.policy.wait_s
        for attempt in range(1, self.policy.attempts + 1):
            try:
                return self.fn(*args)
            except self.policy.retry_on:
                if attempt == self.policy.attempts or not self._may_retry():
                    raise
            time.sleep(wait * random.uniform(0.5, 1))
            wait = min(2 * wait, self.policy.max_wait_s)
        raise ValueError("a policy needs one attempt at least")


def in_order(fn: Callable, rows: Iterable[tuple], window: int) -> Iterator:
    """``fn(*row)`` of every row, in order, with up to ``window`` calls in flight.

    Rows are taken from their source only as calls are handed out.
    """
    if window <= 1:
        for row in rows:
            yield fn(*row)
        return
    with ThreadPoolExecutor(window) as pool:
        flying: deque = deque()
        try:
            for row in rows:
                flying.append(pool.submit(fn, *row))
                if len(flying) >= window:
                    yield flying.popleft().result()
            while flying:
                yield flying.popleft().result()
        finally:
            for f in flying:
                f.cancel()


def local_path(path: str) -> str | None:
    """Where Python sees a path of a mounted folder; None for stores that only Spark reads."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return None if "://" in path else path


class Journal:
    """Finished calls of one partition: lines that this and earlier attempts wrote.

    A row is known by the digest of its prompts, and among equal ones by its
    place, so repeated questions keep answers of their own.
    """

    def __init__(self, root: str, partition: int):
        self.folder = os.path.join(root, str(partition))
        os.makedirs(self.folder, exist_ok=True)
        self.seen: Counter = Counter()
        self.known: dict[str, dict] = {}
        for name in sorted(os.listdir(self.folder)):
            with open(os.path.join(self.folder, name), encoding="utf-8") as lines:
                for line in lines:
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue  # the line that the attempt died on
                    self.known[row["key"]] = row
        self.lock = threading.Lock()
        self.out = open(os.path.join(self.folder, f"{uuid.uuid4().hex}.jsonl"), "a", encoding="utf-8")  # noqa: SIM115

    def key(self, *prompts) -> str:
        digest = hashlib.sha256("\0".join("" if p is None else str(p) for p in prompts).encode("utf-8", "surrogatepass")).hexdigest()
        self.seen[digest] += 1
        return f"{digest}-{self.seen[digest]}"

    def add(self, key: str, answer: str | None, elapsed: float) -> None:
        with self.lock:
            self.out.write(json.dumps({"key": key, "answer": answer, "elapsed": elapsed}) + "\n")
            self.out.flush()
            os.fsync(self.out.fileno())

    def close(self) -> None:
        self.out.close()
