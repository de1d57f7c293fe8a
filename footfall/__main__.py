"""Replays a log and writes what was asked for: ``spark-submit --py-files footfall.zip footfall/__main__.py --events ...``."""

from __future__ import annotations

import argparse
import json
import sys

ANSWERS = ("metrics", "funnel", "heatmap", "anomalies", "health", "calibration", "camera_trust")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="footfall", description="Answers about stores out of an event log and transactions.")
    parser.add_argument("--events", required=True, help="JSONL log, a file or a folder")
    parser.add_argument("--pos", help="transactions as CSV with a header")
    parser.add_argument("--store", help="one store only")
    parser.add_argument("--as-of-us", type=int, required=True, help="the clock, in microseconds since 1970")
    parser.add_argument("--answers", nargs="+", choices=ANSWERS, default=["metrics"])
    parser.add_argument("--output", help="folder for one JSON dataset an answer; printed if not given")
    parser.add_argument("--log", help="folder that the accepted events are appended to as Parquet")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from footfall.api import StoreAnalytics, StoreNotFound
    from footfall.schema import POS
    from footfall.sources import readers, sinks

    asked = arguments(argv)
    spark = SparkSession.builder.appName("footfall").getOrCreate()
    pos = readers.read_transactions(spark, asked.pos) if asked.pos else spark.createDataFrame([], POS)
    try:
        store = StoreAnalytics.replay(spark, asked.events, pos, asked.as_of_us, asked.store)
    except FileNotFoundError as e:
        print(f"no such log: {e}", file=sys.stderr)
        return 2
    print(json.dumps(store.replayed.to_dict()))
    if asked.log:
        sinks.write_log(store.events, asked.log)
    for name in asked.answers:
        try:
            answer = getattr(store, name)() if name == "health" else getattr(store, name)(asked.store)
        except StoreNotFound as e:
            print(f"no such store: {e}", file=sys.stderr)
            return 3
        if asked.output:
            answer.write.mode("overwrite").json(f"{asked.output}/{name}")
        else:
            for row in answer.toJSON().toLocalIterator():
                print(json.dumps({"answer": name, "row": json.loads(row)}))
    store.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
