"""Rows that a watermark dropped: counted per query and operator, so that none vanishes unseen."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery


def dropped_rows(progress) -> Counter:
    """Rows dropped in one progress report, by operator.

    Aggregations are asked after their sums within a task: rows of one group and task count as one there. Joins,
    deduplication and custom state count rows.
    """
    return Counter({s.operatorName: s.numRowsDroppedByWatermark for s in progress.stateOperators if s.numRowsDroppedByWatermark})


class LateRows(StreamingQueryListener):
    """Running counts of dropped rows; register with `spark.streams.addListener`.

    `counts` has the rows by (query name or id, operator). `limit` rows of one query raise its name in `over`, for alerts.
    """

    def __init__(self, limit: int | None = None) -> None:
        self.counts: Counter = Counter()
        self.over: set[str] = set()
        self._limit, self._lock = limit, Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        name = progress.name or str(progress.id)
        with self._lock:
            self.counts.update({(name, operator): n for operator, n in dropped_rows(progress).items()})
            if self._limit is not None and self.of(name) >= self._limit:
                self.over.add(name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, name: str) -> int:
        """Rows dropped in the query of this name or id."""
        return sum(n for (query, _), n in self.counts.items() if query == name)


def dropped_so_far(query: StreamingQuery) -> int:
    """The same from the reports that a query still holds, without a listener."""
    return sum(sum(dropped_rows(p).values()) for p in query.recentProgress)
