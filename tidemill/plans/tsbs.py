"""The devops monitoring queries: selections over metrics, hosts and the time before an end, and their aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.times import DAY_MS, HOUR_MS
from ..model import METRIC_LABEL, Samples
from ..operators.aggregate import bucketed, last_point, threshold
from ..operators.matchers import Eq, In, Matcher
from ..operators.select import select
from ..sources.shared import written

FIVE_MINUTES_MS = 300_000


@dataclass(frozen=True)
class Scale:
    """What the workload's units stand for: dense monitoring data has samples every few seconds, sparse data every few hours."""

    fine: int = FIVE_MINUTES_MS
    coarse: int = HOUR_MS
    hour: int = HOUR_MS


SPARSE = Scale(HOUR_MS, DAY_MS, DAY_MS)

#: name: (metrics, hosts, hours back or None for all, aggregate, bucket); None of hosts is all of them.
SHAPES = {
    "1_1_1": (1, 1, 1, "max", "fine"),
    "1_1_12": (1, 1, 12, "max", "fine"),
    "1_1_24": (1, 1, 24, "max", "fine"),
    "1_1_all": (1, 1, None, "max", "fine"),
    "1_8_1": (1, 8, 1, "max", "fine"),
    "5_1_1": (5, 1, 1, "max", "fine"),
    "5_1_12": (5, 1, 12, "max", "fine"),
    "5_1_24": (5, 1, 24, "max", "fine"),
    "5_1_all": (5, 1, None, "max", "fine"),
    "5_8_1": (5, 8, 1, "max", "fine"),
    "cpu_max_all_8": (10, 8, 1, "max", "coarse"),
    "double_groupby_5": (5, None, None, "avg", "coarse"),
    "double_groupby_all": (10, None, None, "avg", "coarse"),
}


@dataclass(frozen=True)
class Workload:
    samples: Samples
    host: str
    metrics: list[str]
    hosts: list[str]
    end: int
    scale: Scale = Scale()

    def matchers(self, metrics: int, hosts: int | None) -> list[Matcher]:
        own: list[Matcher] = [In(METRIC_LABEL, tuple(self.metrics[:metrics])) if metrics > 1 else Eq(METRIC_LABEL, self.metrics[0])]
        if hosts is not None:
            own.append(In(self.host, tuple(self.hosts[:hosts])) if hosts > 1 else Eq(self.host, self.hosts[0]))
        return own

    def run(self, shape: str) -> DataFrame:
        metrics, hosts, hours, how, width = SHAPES[shape]
        mint = 0 if hours is None else self.end - hours * self.scale.hour
        found = select(self.samples, self.matchers(metrics, hosts), mint, self.end, dedupe=False)
        return bucketed(found, getattr(self.scale, width), how, [self.host], f"{how}_v")

    def last_points(self, metric: str, since: int = 0) -> DataFrame:
        """The last reading of a metric of each host."""
        return last_point(select(self.samples, [Eq(METRIC_LABEL, metric)], since, dedupe=False))

    def recent_points(self, metric: str, series: DataFrame, step: int) -> DataFrame:
        """The same, read backwards: the last ``step`` before the end first, then as much as all before again, until each of
        the series (rows of the metric's series columns) has a point or the beginning is reached. So old days are read
        only for hosts that were silent since."""
        hi, lo, out = self.end, max(0, self.end - step), None
        keys = self.samples.series_key()
        left = series.select(*keys)
        while True:
            part = select(self.samples, [Eq(METRIC_LABEL, metric)], lo, hi, dedupe=False)
            found = written(last_point(part.with_df(part.df.join(left, keys, "left_semi"))))
            out = found if out is None else out.unionByName(found)
            left = written(left.join(found, keys, "left_anti"))
            if lo == 0 or left.isEmpty():
                return out
            hi, lo = lo - 1, max(0, lo - 2 * (self.end - lo))

    def high(self, metric: str, above: float, hosts: int | None = None) -> DataFrame:
        own = [Eq(METRIC_LABEL, metric)] + ([In(self.host, tuple(self.hosts[:hosts]))] if hosts else [])
        return threshold(select(self.samples, own, 0, self.end), above)
