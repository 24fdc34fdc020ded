"""Headline timings: one JSON line.

``prepare`` ingests the tree tables and builds the shared references, which later queries
reuse; ``end_to_end`` repeats everything from the test tables to the carbon panel in a
fresh workspace. Results go to a sink that reads every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from standtally.catalog import builds  # noqa: E402
from standtally.session import local_session  # noqa: E402
from standtally.workspace import Workspace  # noqa: E402

HEADLINES = [
    "plot_rollup_c1",
    "plot_rollup_c3",
    "wood_density_cascade",
    "wood_density_cascade_shuffled",
    "tree_agb_c3",
    "plot_metadata_c1",
    "census_plot_table_c1",
    "census_plot_table_c3",
    "plot_number_global",
    "panel_with_change",
    "panel_with_change_union",
    "panel_with_bgb",
    "class_ownership_history",
    "agb_method_boxstats",
    "agb_method_fit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    build = builds()
    times: dict[str, float] = {}

    def timed(name: str, work: Callable[[], None]) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    def sink(name: str, w: Workspace) -> None:
        build[name](w).write.format("noop").mode("overwrite").save()

    shared = Workspace(spark, folder)

    def prepare() -> None:
        for k in (1, 2, 3):
            shared.raw_trees(k)
        _ = shared.refs, shared.states

    timed("prepare", prepare)
    for name in HEADLINES:
        timed(name, lambda name=name: sink(name, shared))
    timed("end_to_end", lambda: sink("panel_with_bgb", Workspace(spark, folder)))
    print(
        json.dumps(
            {
                "metric": "inventory headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
