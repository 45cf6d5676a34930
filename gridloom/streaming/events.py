"""Completion handles of work that runs beside the caller."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait


class Event:
    """Done when the Spark action behind it is; a failed action raises from wait()."""

    def __init__(self, future: Future):
        self._future = future

    @classmethod
    def ready(cls) -> Event:
        f: Future = Future()
        f.set_result(None)
        return cls(f)

    def wait(self, timeout: float | None = None) -> object:
        return self._future.result(timeout)

    def query(self) -> bool:
        return self._future.done()

    def then(self, call: Callable[[], object]) -> Event:
        """Runs call once this is done, in the thread that finishes it."""
        out: Future = Future()

        def run(f: Future) -> None:
            try:
                f.result()
                out.set_result(call())
            except BaseException as e:  # handed on to whoever waits
                out.set_exception(e)

        self._future.add_done_callback(run)
        return Event(out)


class Pool:
    """Threads that submit Spark actions, and a barrier over all that were submitted."""

    def __init__(self, threads: int = 4):
        self._pool = ThreadPoolExecutor(threads, thread_name_prefix="gridloom")
        self._open: set[Future] = set()

    def submit(self, call: Callable[[], object]) -> Event:
        f = self._pool.submit(call)
        self._open.add(f)
        f.add_done_callback(self._open.discard)
        return Event(f)

    def synchronize(self) -> None:
        done = wait(list(self._open)).done
        for f in done:
            f.result()
