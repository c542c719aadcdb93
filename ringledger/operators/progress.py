"""Progress: counters that leave a job while it runs, without another pass over its rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming.listener import StreamingQueryListener


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """`df`, and an observation whose .get has the counters once an action over `df` is done."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in counters.items())), seen


class Progress(StreamingQueryListener):
    """Calls back with the counters of each micro-batch of streams that observe() under `name`."""

    def __init__(self, name: str, callback: Callable[[int, Mapping[str, object]], None]):
        self.name, self.callback = name, callback

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.callback(event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
