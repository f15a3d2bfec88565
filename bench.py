"""Benchmark the headline plans; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each plan is fully computed into Spark's ``noop`` sink (no output I/O), after
a warm-up pass on sf0.001 so JIT and class loading are not measured.
Training uses the reference parameters for logistic regression; the boosted
model is timed with 20 rounds (stated in its key), not the reference's 400.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dispute_engine import config as C  # noqa: E402
from dispute_engine.operators import evidence, ml, queue, split  # noqa: E402
from dispute_engine.operators.runs import run_metrics  # noqa: E402
from dispute_engine.plans.pipeline import Plan  # noqa: E402
from dispute_engine.session import get_spark  # noqa: E402


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def plans(spark, sf_dir: str) -> dict:
    p = Plan(spark, sf_dir)
    return {
        "silver_gold_v2": lambda: sink(p.gold_v2),
        "evidence_candidates_one_pass": lambda: sink(p.candidates),
        "evidence_candidates_union": lambda: sink(evidence.evidence_candidates_union(p.evidence_base, ts=p.ts)),
        "evidence_top3_enrich": lambda: sink(p.enriched),
        "queue_kpis": lambda: sink(queue.queue_kpis(p.queue).unionByName(
            queue.payer_kpis(p.queue).withColumnRenamed("payer", "owner_queue"), allowMissingColumns=True)),
        "actions_prompts": lambda: sink(p.prompts),
        "run_metrics_latest": lambda: sink(run_metrics(p.runs)),
        "train_lr_collapsed": lambda: ml.train_lr(
            split.take_split(split.hash_split(p.gold_v2), "TRAIN"), C.SPEC_V2, C.LR_BALANCED),
        "train_boosted_20_rounds": lambda: ml.train_boosted(
            split.take_split(split.hash_split(p.gold_v2), "TRAIN"), C.SPEC_V2, C.BoostedParams(n_estimators=20)),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    warm = plans(spark, "/root/testdata/sf0.001")
    for k in ("silver_gold_v2", "evidence_top3_enrich", "actions_prompts"):
        warm[k]()
    times = {}
    for name, fn in plans(spark, sf_dir).items():
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({"metric": "dispute_pipeline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
