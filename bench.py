"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once cold and three times warm; its figure is the median of the warm runs. Results go to Parquet for the
transform, as a user's would, and to a sink that takes every row for the others. ``transform_13m`` writes 13 million rows
of generated input first (not timed) and then times filter, cast, select and the write. ``stream_1m`` (batches of 100,000)
and ``stream_100k_by_5k`` (batches of 5,000, as small as a single process would take) are one run each, cold."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewright.operators import transform  # noqa: E402
from tidewright.plans import catalogue  # noqa: E402
from tidewright.plans.ir import from_mapping  # noqa: E402
from tidewright.session import session  # noqa: E402
from tidewright.streaming import runner  # noqa: E402

HEADLINE = ["t_chain", "t_filter", "t_dedup_ordered", "agg_group", "agg_distinct", "join_inner", "join_three", "join_anti", "join_asof", "win_row_number", "win_running_sum", "sort_topk", "set_except", "gate_counts", "gate_split_good", "upsert_last_wins", "cdc_current_state", "dispatch_diff", "stream_tumbling", "stream_session", "watermark_late_rows"]


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


#: Events and events a batch of the stream benches; a batch is a few Spark jobs, so the headline's are larger than a single process would take.
EVENTS = {"stream_1m": (1_000_000, 100_000), "stream_100k_by_5k": (100_000, 5_000)}


def stream_bench(spark, tmp: str, times: dict) -> None:
    """Events through the micro-batch runner (hash, write under the batch's name, ledger), and a run that finds all done."""
    for name, (events, a_batch) in EVENTS.items():

        def poll(spark, position, events=events, a_batch=a_batch):
            k = (position or {}).get("batch", 0)
            rows = spark.range(k * a_batch, (k + 1) * a_batch).selectExpr("id", "id * 0.5D AS amount", "id % 10 AS kind")
            return runner.Batch(rows, {"batch": k + 1}, (k + 1) * a_batch >= events)

        stream = runner.Stream(name, poll, f"{tmp}/{name}", f"{tmp}/state")
        times[name] = round(timed(lambda: runner.run(spark, stream)), 4)  # noqa: B023
        assert spark.read.parquet(f"{tmp}/{name}/*").count() == events
    times["stream_again"] = round(statistics.median(timed(lambda: runner.run(spark, stream)) for _ in range(3)), 4)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp()
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"{tmp}/w", "spark.checkpoint.dir": f"file://{tmp}/shared"})
    spark.sparkContext.setLogLevel("ERROR")
    times, cold = {}, {}
    for name in HEADLINE:
        run = lambda: catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        cold[name] = round(timed(run), 4)
        times[name] = round(statistics.median(timed(run) for _ in range(3)), 4)
    rows = int(os.environ.get("BENCH_ROWS", "13000000"))
    source = spark.range(rows).selectExpr("id", "CAST(id % 100000 AS double) / 100 AS amount", "id % 100 AS quantity", "concat('c', id % 10) AS category", "sha2(CAST(id AS string), 256) AS payload")
    source.write.parquet(f"{tmp}/in")
    plan = from_mapping({"name": "bench", "input": f"{tmp}/in", "output": f"{tmp}/out", "steps": [{"filter": "quantity > 50"}, {"cast": {"amount": "double"}}, {"select": ["id", "amount", "quantity", "category"]}]})
    run = lambda: transform.run(spark, plan)
    cold["transform_13m"] = round(timed(run), 4)
    times["transform_13m"] = round(statistics.median(timed(run) for _ in range(3)), 4)
    stream_bench(spark, tmp, times)
    spark.stop()
    shutil.rmtree(tmp, ignore_errors=True)
    print(json.dumps({"metric": "total of warm medians, without stream_1m and stream_100k_by_5k", "value": round(sum(v for k, v in times.items() if k not in EVENTS), 4), "unit": "sec", "queries": times, "cold": cold, "transform_rows_per_s": round(rows / times["transform_13m"]), "sf": sf}))


if __name__ == "__main__":
    main()
