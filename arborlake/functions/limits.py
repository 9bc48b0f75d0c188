"""A limit of time within a task."""

from __future__ import annotations

import signal
from collections.abc import Iterator
from contextlib import contextmanager


class OutOfTime(BaseException):
    """Raised in the work itself; no Exception, so that work which swallows those ends too."""


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Ends what runs inside after ``seconds``, wherever it is, by raising OutOfTime; None sets no limit.

    The clock is the process's alarm, so this is for the main thread, where
    Spark's Python workers run their functions; limits do not nest.
    """
    if seconds is None:
        yield
        return

    def ring(*_) -> None:
        raise OutOfTime

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
