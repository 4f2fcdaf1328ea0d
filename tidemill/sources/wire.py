"""Remote write and read requests, as JSON, dicts or protobuf bodies of the usual messages, turned into plans. No network."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Samples
from ..operators.matchers import conjunction, parse_matcher
from ..operators.select import merge_newest, nested, time_filter
from . import proto
from .adaptors import from_maps
from .shared import ship

WRITE_SCHEMA = "timeseries array<struct<labels:array<struct<name:string,value:string>>,samples:array<struct<timestamp:bigint,value:double>>>>"


def write_requests(lines: DataFrame, column: str = "value") -> Samples:
    """Write requests, one JSON text in each row, as samples; series with no samples give no rows, and of labels of one name the first counts."""
    return _flat(lines.select(F.from_json(column, WRITE_SCHEMA).alias("r")))


def write_bodies(bodies: DataFrame, column: str = "value") -> Samples:
    """Write requests, one protobuf body under Snappy in each row, as samples; a malformed one fails the job."""
    ship(bodies.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                if body.is_valid:
                    yield pa.RecordBatch.from_pylist([{"value": json.dumps(proto.parse_write(body.as_py()))}], pa.schema([("value", pa.string())]))

    return write_requests(bodies.select(column).mapInArrow(run, "value string"))


def bodies_of(samples: Samples) -> DataFrame:
    """Protobuf bodies (column value) of the samples, one for each series and day."""
    ship(samples.df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [proto.write_body({"timeseries": [json.loads(x)]}) for x in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    labels = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    points = F.transform("samples", lambda p: F.struct(p["t"].alias("timestamp"), p["v"].alias("value")))
    return nested(samples).select(F.to_json(F.struct(labels.alias("labels"), points.alias("samples"))).alias("value")).mapInArrow(run, "value binary")


def _flat(requests: DataFrame) -> Samples:
    x = requests.select(F.explode("r.timeseries").alias("s"))
    first = F.filter("s.labels", lambda e, i: F.array_position(F.transform("s.labels", lambda o: o["name"]), e["name"]) == i + 1)
    labels = F.map_from_entries(F.transform(first, lambda e: F.struct(e["name"].alias("key"), e["value"].alias("value"))))
    return from_maps(x.select(labels.alias("labels"), F.explode("s.samples").alias("p")).select("labels", F.col("p.timestamp").alias("t"), F.col("p.value").alias("v")))


def write_request(spark: SparkSession, request: dict | bytes) -> Samples:
    if isinstance(request, bytes):
        request = proto.parse_write(request)
    return write_requests(spark.createDataFrame([(json.dumps(request),)], "value string"))


def _asked(request: dict | str | bytes) -> list[dict]:
    if isinstance(request, bytes):
        return proto.parse_read(request)["queries"]
    return (json.loads(request) if isinstance(request, str) else request)["queries"]


def _found(samples: Samples, queries: list[dict]) -> Samples:
    """The samples of all queries, merged newest first, with the number of the query as a tag; one scan for all of them."""
    lo, hi = min(max(q["start_timestamp_ms"], 0) for q in queries), max(q["end_timestamp_ms"] for q in queries)
    wants = []
    for q in queries:
        matched = conjunction(list(map(parse_matcher, q["matchers"])), samples)
        wants.append(F.coalesce(matched, F.lit(False)) & F.col("t").between(max(q["start_timestamp_ms"], 0), q["end_timestamp_ms"]))
    df = time_filter(samples, lo, hi).filter(reduce(lambda a, b: a | b, wants))
    hits = F.filter(F.array(*(F.when(w, F.lit(i)) for i, w in enumerate(wants))), lambda i: i.isNotNull())
    df = df.withColumn("query", F.explode(hits))
    return merge_newest(samples.with_df(df, promoted={**samples.promoted, "query": "query"}))


def read_request(samples: Samples, request: dict | str | bytes) -> DataFrame:
    """Rows (query, series columns, t, v) of all queries of a request, each a range and matchers; none without queries.

    All four operators work; a series without samples in the range is left out.
    """
    queries = _asked(request)
    if not queries:
        return samples.df.limit(0).select(F.lit(0).alias("query"), *samples.series_key(), "t", "v")
    return _found(samples, queries).df.select("query", *samples.series_key(), "t", "v")


def read_series(samples: Samples, request: dict | str | bytes, return_metric: bool = True) -> Iterator[tuple[int, dict]]:
    """(query, series) of the answer, in the order of queries and labels, fetched a partition at a time.

    A series that is longer than a day comes in pieces, a day in each, one behind another.
    """
    queries = _asked(request)
    if not queries:
        return
    own = _found(samples, queries)
    rows = nested(own).withColumn("labels", samples.labels_map(with_metric=True))
    for r in rows.orderBy("query", F.array_sort(F.map_entries("labels")), "slice").select("query", "labels", "samples").toLocalIterator():
        labels = [{"name": k, "value": v} for k, v in sorted(r["labels"].items()) if return_metric or k != "__name__"]
        yield r["query"], {"labels": labels, "samples": [{"timestamp": p["t"], "value": p["v"]} for p in r["samples"]]}


def read_response(samples: Samples, request: dict | str | bytes, return_metric: bool = True) -> Iterator[dict]:
    """One answer for each query, whole, as the usual message has it: for answers that fit into the driver. ``read_series`` gives them piece by piece."""
    pieces = read_series(samples, request, return_metric)
    held = next(pieces, None)
    for i in range(len(_asked(request))):
        series: list[dict] = []
        while held is not None and held[0] == i:
            if series and series[-1]["labels"] == held[1]["labels"]:
                series[-1]["samples"] += held[1]["samples"]
            else:
                series.append(held[1])
            held = next(pieces, None)
        yield {"timeseries": series}


def read_answer(samples: Samples, request: bytes) -> bytes:
    """The protobuf answer to a protobuf request."""
    return proto.response_body(list(read_response(samples, request)))
