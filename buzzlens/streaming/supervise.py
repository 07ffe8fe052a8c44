"""Many sources side by side: one that fails is started again, the others go on."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


@dataclass
class Outcome:
    """What became of one source: how often it was started and the errors it met."""

    starts: int = 0
    errors: list[str] = field(default_factory=list)
    running: bool = False

    @property
    def failed(self) -> bool:
        """Whether the last start ended in an error."""
        return not self.running and len(self.errors) == self.starts


class _Ends(StreamingQueryListener):
    """Puts the run id and error of every query that ends into a queue."""

    def __init__(self):
        self.ended: queue.Queue[tuple[str, str | None]] = queue.Queue()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.put((str(event.runId), event.exception))


def supervise(
    spark: SparkSession,
    jobs: Mapping[str, Callable[[], StreamingQuery]],
    restarts: int = 3,
    pause: float = 1.0,
    seconds: float | None = None,
) -> dict[str, Outcome]:
    """Start all ``jobs`` and watch them until each has ended for good.

    A source that cannot start or dies, in whichever batch, is started again
    ``pause`` seconds later from its checkpoint, ``restarts`` times at most; the
    news comes from a listener, whatever the order of the jobs. Others are never
    touched. ``seconds`` ends the watch (queries that still run keep running).
    """
    listener = _Ends()
    spark.streams.addListener(listener)
    outcomes = {name: Outcome() for name in jobs}
    runs: dict[str, str] = {}
    due: dict[str, float] = dict.fromkeys(jobs, 0.0)  # when to start a source next
    early: dict[str, str | None] = {}  # ends that came before their run id was known
    limit = None if seconds is None else time.monotonic() + seconds

    def ended(name: str, error: str | None) -> None:
        outcome = outcomes[name]
        outcome.running = False
        if error is None:
            return
        outcome.errors.append(error)
        if outcome.starts <= restarts:
            due[name] = time.monotonic() + pause

    try:
        while due or any(o.running for o in outcomes.values()):
            now = time.monotonic()
            if limit is not None and now > limit:
                break
            for name in [n for n, at in due.items() if at <= now]:
                del due[name]
                outcomes[name].starts += 1
                try:
                    run = str(jobs[name]().runId)
                except Exception as error:  # noqa: BLE001 - reported in the outcome
                    ended(name, str(error))
                    continue
                outcomes[name].running = True
                runs[run] = name
                if run in early:
                    ended(name, early.pop(run))
            try:
                run, error = listener.ended.get(timeout=0.2)
            except queue.Empty:
                continue
            if run in runs:
                ended(runs[run], error)
            else:
                early[run] = error
    finally:
        spark.streams.removeListener(listener)
    return outcomes
