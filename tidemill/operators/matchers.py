"""Label matchers as predicates.

A series that lacks a label has the empty value for it. So a matcher that matches the empty string also selects series
without the label, and one that does not, does not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import METRIC_LABEL, Samples


class Matcher:
    name: str

    def matches_empty(self, samples: Samples) -> bool:
        raise NotImplementedError

    def holds(self, value: Column, samples: Samples) -> Column:
        """The predicate on a value that is there; null where it isn't."""
        raise NotImplementedError

    def predicate(self, samples: Samples) -> Column:
        value = samples.label(self.name)
        inside = self.holds(value, samples)
        return value.isNull() | inside if self.matches_empty(samples) else inside


def _integers(samples: Samples, name: str, values: Iterable[str]) -> list[int] | None:
    """The values as integers where the label's column is one and all of them are written canonically."""
    if name not in samples.numeric:
        return None
    found = []
    for v in values:
        if not re.fullmatch(r"0|-?[1-9]\d{0,17}", v):
            return None
        found.append(int(v))
    return found


@dataclass(frozen=True)
class Eq(Matcher):
    name: str
    value: str

    def matches_empty(self, samples: Samples) -> bool:
        return self.value == ""

    def holds(self, value: Column, samples: Samples) -> Column:
        n = _integers(samples, self.name, [self.value])
        return F.col(samples.promoted[self.name]) == n[0] if n else value == self.value


@dataclass(frozen=True)
class In(Matcher):
    """Any of several values: one scan instead of a select for each."""

    name: str
    values: tuple[str, ...]

    def matches_empty(self, samples: Samples) -> bool:
        return "" in self.values

    def holds(self, value: Column, samples: Samples) -> Column:
        n = _integers(samples, self.name, self.values)
        return F.col(samples.promoted[self.name]).isin(n) if n else value.isin(list(self.values))


@dataclass(frozen=True)
class Re(Matcher):
    """Full match of a regular expression; an invalid one matches nothing."""

    name: str
    pattern: str

    def _compiled(self, samples: Samples):
        """The pattern as the JVM reads it, which is what runs; None if it is invalid."""
        try:
            return samples.df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(self._whole())
        except (Py4JJavaError, PySparkException):
            return None

    def _whole(self) -> str:
        return f"^(?:{self.pattern})\\z"

    def matches_empty(self, samples: Samples) -> bool:
        c = self._compiled(samples)
        return c is not None and c.matcher("").find()

    def holds(self, value: Column, samples: Samples) -> Column:
        return F.lit(False) if self._compiled(samples) is None else value.rlike(self._whole())


@dataclass(frozen=True)
class Not(Matcher):
    """The negation of any matcher."""

    matcher: Matcher

    @property
    def name(self) -> str:
        return self.matcher.name

    def matches_empty(self, samples: Samples) -> bool:
        return not self.matcher.matches_empty(samples)

    def holds(self, value: Column, samples: Samples) -> Column:
        return ~self.matcher.holds(value, samples)


def Neq(name: str, value: str) -> Not:
    return Not(Eq(name, value))


def Nre(name: str, pattern: str) -> Not:
    return Not(Re(name, pattern))


OPERATORS = {"=": Eq, "EQ": Eq, "!=": Neq, "NEQ": Neq, "=~": Re, "RE": Re, "!~": Nre, "NRE": Nre}


def parse_matcher(spec: dict) -> Matcher:
    """``{"name":…, "op" or "type":…, "value":…}`` with any of the four operators."""
    op = str(spec.get("op", spec.get("type", "EQ")))
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    return OPERATORS[op](spec["name"], spec["value"])


def conjunction(matchers: Iterable[Matcher], samples: Samples, tree_mode: bool = False) -> Column:
    """All matchers; none at all selects nothing.

    ``tree_mode`` also asks for an equality on the metric and one on another label, as only those are looked up there.
    """
    matchers = list(matchers)
    if not matchers:
        return F.lit(False)
    if tree_mode:
        eq = {m.name for m in matchers if isinstance(m, Eq)}
        if METRIC_LABEL not in eq or len(eq) < 2 or any(not isinstance(m, Eq) for m in matchers):
            return F.lit(False)
    return reduce(lambda a, b: a & b, (m.predicate(samples) for m in matchers))
