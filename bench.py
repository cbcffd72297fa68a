"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from paramloom.operators import grid
from paramloom.plans import QUERIES
from paramloom.plans.registry import table
from paramloom.plans.runs import sweep_over_lineitem
from paramloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

REGISTERED = [
    "run_sweep_agg", "run_sweep_mixed", "run_sweep_predicate", "run_kfold_metric", "run_map",
    "run_dedup_redelivery", "ps_grid_decode", "ps_cross_join", "ps_carry_forward",
    "ps_task_id", "src_param_spec", "src_output_log", "log_lines", "log_clean_lines",
    "log_out_then_err", "log_interleave", "log_history", "log_step_gap", "log_tail",
    "log_accumulate", "ml_epoch_shuffle", "ml_forward", "ml_cross_entropy", "ml_report",
    "fl_resolve_ref", "fl_known", "gen_worker_rows", "run_train_per_combo", "st_route",
    "st_first_exit", "st_dedup",
]


def _sweep(combinations):
    side = int(combinations ** 0.5)
    return lambda spark, sf_dir: sweep_over_lineitem(
        spark, sf_dir, [0.1 * (i + 1) / side for i in range(side)],
        [50.0 * (i + 1) / side for i in range(side)])


def _decode(exponent):
    """10^exponent combinations of ten-valued parameters, read by a filtered count."""
    def run(spark, sf_dir):
        dims = {f"p{i}": list(range(10)) for i in range(exponent)}
        total = sum(F.col(name) for name in dims)
        return grid.grid_range(spark, dims).where(total % 7 == 0).agg(F.count(F.lit(1)))
    return run


EXTRA = {
    "sweep_4": _sweep(4), "sweep_64": _sweep(64), "sweep_1024": _sweep(1024),
    "decode_1e7": _decode(7), "decode_1e8": _decode(8),
}


def timed(spark, run) -> float:
    began = time.perf_counter()
    run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = local_session(CPUS)
    table(spark, SF_DIR, "lineitem").count()
    runs = {**{key: QUERIES[key] for key in REGISTERED}, **EXTRA}
    seconds = {name: round(min(timed(spark, run) for _ in range(REPEATS)), 3)
               for name, run in runs.items()}
    events = table(spark, SF_DIR, "events").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "streamed_rows_per_sec": round(events / seconds["st_route"])}))
    spark.stop()


if __name__ == "__main__":
    main()
