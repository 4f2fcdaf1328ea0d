"""``python -m tidemill write|read --store PATH < request.json``: remote write and read requests against a store, for spark-submit.

An answer is a line of JSON for each piece of a series, with the number of its query.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .sources import store, wire


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemill")
    p.add_argument("what", choices=("write", "read"))
    p.add_argument("--store", required=True, help="directory of the sample store")
    p.add_argument("--request", type=argparse.FileType(), default=sys.stdin, help="JSON of a write or read request")
    a = p.parse_args(args)
    request = json.load(a.request)
    spark = SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "write":
        store.append_table(wire.write_request(spark, request), a.store)
    else:
        samples = store.read_samples(spark, a.store, {}, tags_column="tags")
        for query, series in wire.read_series(samples, request):
            print(json.dumps({"query": query, **series}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
