"""Time every named query on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run once, which warms it up, and then in ``$BENCH_RUNS`` further rounds; a query's
time is the median of its warm runs. ``$BENCH_BUDGET`` seconds end the rounds early, so that a slow
machine still prints a line; ``warm_runs`` tells whether it did. The bucketed join is also timed
apart from the writing of its tables, with and without a broadcast. Results go to the ``noop`` sink, so all of each is computed and
none of it collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from deedscope.session import build_session
from deedscope.workload import QUERIES


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def per_column_null_counts(spark, sf_dir: str) -> None:
    """The plain form of ``null_percentages``: one job for the rows and one per column."""
    from pyspark.sql import functions as F

    from deedscope.workload.tables import registry

    rows = registry(spark, sf_dir)
    rows.count()
    for column in rows.columns:
        rows.filter(F.col(column).isNull()).count()


def window_then_distinct(spark, sf_dir: str) -> None:
    """The plain form of ``partition_max``: a window over all rows, then DISTINCT."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from deedscope.workload.tables import registry

    over = Window.partitionBy("district", "county")
    registry(spark, sf_dir).select(
        "district", "county", F.count("district").over(over), F.max("price_paid").over(over)
    ).distinct().write.format("noop").mode("overwrite").save()


def join_times(spark, sf_dir: str, runs: int) -> dict[str, float]:
    """The bucketed join over tables that are there already, by merge and by broadcast."""
    from deedscope.operators import joins
    from deedscope.workload import storage

    tables = storage._bucketed_pair(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def once(broadcast_bytes: int) -> float:
        joined = joins.bucketed_left_join(*tables, "c_custkey", "o_custkey", broadcast_bytes=broadcast_bytes)
        return seconds(lambda: joined.write.format("noop").mode("overwrite").save())

    ways = {"merge": 0, "broadcast": 1 << 30}
    found = {way: round(statistics.median([once(size) for _ in range(runs + 1)][1:]), 4) for way, size in ways.items()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return found


PLAIN_FORMS = {"null_percentages": per_column_null_counts, "partition_max": window_then_distinct}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "1200"))
    memory = os.environ.get("BENCH_MEMORY", "16g")
    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), checkpoint_dir=tempfile.mkdtemp(prefix="bench-"),
        conf={"spark.ui.enabled": "false", "spark.driver.memory": memory},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    started = time.perf_counter()

    def once(name: str) -> float:
        query = QUERIES[name]
        return seconds(lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())

    first = {name: once(name) for name in names}
    warm: dict[str, list[float]] = {name: [] for name in names}
    # Each query's first time tells whether another run still fits the budget.
    for _ in range(runs):
        for name in names:
            if time.perf_counter() - started + first[name] < budget:
                warm[name].append(once(name))
    times = {name: round(statistics.median(warm[name] or [first[name]]), 4) for name in names}
    plain: dict[str, float] = {}
    for name in set(names) & set(PLAIN_FORMS):
        PLAIN_FORMS[name](spark, sf_dir)
        plain[name] = round(seconds(lambda name=name: PLAIN_FORMS[name](spark, sf_dir)), 4)
    print(
        json.dumps(
            {
                "metric": "total of the median seconds of all queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "plain_forms": plain,
                "bucketed_join": join_times(spark, sf_dir, runs) if "bucketed_left_join" in names else {},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "driver_memory": memory,
                "warm_runs": {"least": min(map(len, warm.values())), "most": max(map(len, warm.values()))},
            }
        )
    )


if __name__ == "__main__":
    main()
