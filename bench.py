"""Times the headline queries and prints one JSON line.

The given files hold one row group each, which Spark reads in one task. Before the clock starts they are copied, row for row,
into files of several row groups, as tables of a size worth a cluster have them; BENCH_AS_GIVEN=1 reads the given files.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow.parquet as pq  # noqa: E402

from fundweave import workload  # noqa: E402
from fundweave.session import build_session  # noqa: E402

HEADLINES = [
    "q1_query_type",           # routing
    "a8_holdings_statistics",  # table aggregation
    "a8_trades_statistics",
    "w1_ranked_funds",
    "j4_fund_summaries",
    "c8_aggregation_context",
    "p1_holdings_numbers",     # cleaning
    "c1_holdings_text",
    "c3_packed_holdings",      # packing
    "c5_all_chunks",
    "c7_hashed_vectors",       # vectors
    "s6_upsert",
    "s9_index_build",          # index build
    "r4_routed_top_k",         # search
    "j3_shared_buckets",
    "r6_near_repeats_dropped",
    "r12_gathered_contexts",   # whole batches
    "s11_batch_results",
]


def row_groups(sf_dir: str, groups: int) -> str:
    """A folder with the same tables in the same order, each in several row groups."""
    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        table = pq.read_table(path)
        pq.write_table(table, os.path.join(folder, os.path.basename(path)), row_group_size=max(1, -(-len(table) // groups)))
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = workload.queries()
    wanted = sys.argv[1:] or HEADLINES
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    given = os.environ.get("BENCH_AS_GIVEN") == "1"
    sf_dir = sf_dir if given else row_groups(sf_dir, 2 * int(cpus))
    queries["a5_trade_count"](spark, sf_dir).collect()  # start-up is not measured
    times = {}
    for key in wanted:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": scale, "row_groups": "as given" if given else "several a table",
    }))


if __name__ == "__main__":
    main()
