"""Random samples, tiers and tombstones against a plain model."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from test_contracts import samples

from tidemill.model import METRIC_LABEL
from tidemill.operators import select as sel
from tidemill.operators import tombstones
from tidemill.operators.matchers import Eq, Neq, Nre, Re

times = st.integers(-3, 40)
row = st.tuples(st.sampled_from(["m", "n"]), st.sampled_from([None, "a", "ab", "b"]), times, st.integers(0, 9))
matcher = st.one_of(*(st.builds(k, st.just("h"), st.sampled_from(["", "a", "ab", "b", "z"])) for k in (Eq, Neq)), *(st.builds(k, st.just("h"), st.sampled_from(["a.*", ".*", "b|", "[ab]"])) for k in (Re, Nre)))


def holds(m, value):
    import re

    v = value or ""
    inner = getattr(m, "matcher", m)
    hit = v == inner.value if isinstance(inner, Eq) else re.fullmatch(inner.pattern, v) is not None
    return hit != (inner is not m)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, max_size=25), matcher, times, times, st.lists(st.tuples(times, times), max_size=4))
def test_select_merge_delete(spark, rows, m, lo, hi, stones):
    s = samples(spark, [({METRIC_LABEL: a, **({"h": h} if h is not None else {})}, t, v, i) for i, (a, h, t, v) in enumerate(rows)])
    found = sel.select(s, [Eq(METRIC_LABEL, "m"), m], lo, hi)
    want = {(h, t): float(v) for a, h, t, v in rows if a == "m" and holds(m, h) and max(lo, 0) <= t <= hi}
    got = {(r["tags"].get("h"), r["t"]): r["v"] for r in found.df.collect()}
    assert got == want
    from pyspark.sql import functions as F

    df = found.df.withColumn("series_id", F.lit(1).cast("long"))
    iv = spark.createDataFrame([(1, a, b) for a, b in stones], "series_id long, min_t long, max_t long")
    left = {(r["tags"].get("h"), r["t"]) for r in tombstones.apply_tombstones(df, iv).collect()}
    assert left == {k for k in want if not any(a <= k[1] <= b for a, b in stones)}
    merged = sorted((r["min_t"], r["max_t"]) for r in tombstones.coalesce_intervals(iv).collect())
    covered = {x for a, b in stones for x in range(a, b + 1)}
    assert {x for a, b in merged for x in range(a, b + 1)} == covered
    assert all(b + 1 < c for (_, b), (c, _) in zip(merged, merged[1:]))
