"""Numbers about running queries, in the text form that Prometheus reads.

    metrics = Metrics()
    spark.streams.addListener(metrics)
    print(metrics.text())
"""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections import defaultdict
from datetime import datetime

from pyspark.sql.streaming import StreamingQueryListener

#: Upper ends, in seconds, of the ranges in which durations of micro-batches are counted.
BUCKETS = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 60.0)
_HELP = {
    "weirflow_queries_active": ("gauge", "Queries started and not ended."),
    "weirflow_queries_failed_total": ("counter", "Queries that ended with an error."),
    "weirflow_batches_total": ("counter", "Micro-batches done."),
    "weirflow_rows_total": ("counter", "Rows read."),
    "weirflow_rows_per_second": ("gauge", "Rows a second in the last micro-batch."),
    "weirflow_state_rows": ("gauge", "Rows in the state store after the last micro-batch."),
    "weirflow_watermark_seconds": ("gauge", "The watermark, in seconds since 1970."),
    "weirflow_batch_seconds": ("histogram", "Durations of micro-batches and of their parts."),
}


class Metrics(StreamingQueryListener):
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._values: dict[tuple[str, str], float] = defaultdict(float)
        self._times: dict[str, list[float]] = defaultdict(lambda: [0.0] * (len(BUCKETS) + 2))  # by bucket, beyond all of them, sum
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._names[str(event.id)] = event.name or str(event.id)
            self._values["weirflow_queries_active", ""] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        label = f'query="{p.name or p.id}"'
        with self._lock:
            v = self._values
            v["weirflow_batches_total", label] += 1
            v["weirflow_rows_total", label] += p.numInputRows
            v["weirflow_rows_per_second", label] = p.processedRowsPerSecond
            v["weirflow_state_rows", label] = sum(s.numRowsTotal for s in p.stateOperators)
            mark = (p.eventTime or {}).get("watermark")
            if mark:
                v["weirflow_watermark_seconds", label] = datetime.fromisoformat(mark.replace("Z", "+00:00")).timestamp()
            for part, ms in (p.durationMs or {}).items():
                at = self._times[f'{label},part="{part}"']
                at[bisect_left(BUCKETS, ms / 1000)] += 1
                at[-1] += ms / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._values["weirflow_queries_active", ""] -= 1
            if event.exception:
                self._values["weirflow_queries_failed_total", f'query="{self._names.get(str(event.id), event.id)}"'] += 1

    def get(self, name: str, label: str = "") -> float:
        with self._lock:
            return self._values.get((name, label), 0.0)

    def text(self) -> str:
        with self._lock:
            lines = []
            for name, (kind, about) in _HELP.items():
                lines += [f"# HELP {name} {about}", f"# TYPE {name} {kind}"]
                lines += [f"{name}{{{label}}} {v:g}" if label else f"{name} {v:g}" for (n, label), v in sorted(self._values.items()) if n == name]
                for label, at in sorted(self._times.items()) if kind == "histogram" else []:
                    below = 0.0
                    for end, n in zip((*map(str, BUCKETS), "+Inf"), at[:-1]):
                        below += n
                        lines.append(f'{name}_bucket{{{label},le="{end}"}} {below:g}')
                    lines += [f"{name}_sum{{{label}}} {at[-1]:g}", f"{name}_count{{{label}}} {below:g}"]
            return "\n".join(lines) + "\n"
