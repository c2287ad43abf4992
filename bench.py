"""Times the engine's queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs over its whole tables, once to compile and then twice; the
better time counts.  Results go to Spark's no-op sink, so all rows are made.
The replay rate is that of changeset files read, committed version by version
of writing state trees on other machines and other data, so no ratio is given.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerline import catalog  # noqa: E402
from ledgerline.session import session  # noqa: E402


def run(df) -> float:
    """Seconds to make all rows."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", int(cpus), **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in catalog.QUERIES.items():
        run(query(spark, sf))
        seconds[name] = round(min(run(query(spark, sf)) for _ in range(2)), 4)
    changes = catalog.changes_of(spark, sf)
    n = changes.count()
    began = time.perf_counter()
    catalog.replay_state(spark, sf)  # its commits are made when it is called
    took = time.perf_counter() - began
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "replay_changes_per_sec": round(n / took)}))
    spark.stop()


if __name__ == "__main__":
    main()
