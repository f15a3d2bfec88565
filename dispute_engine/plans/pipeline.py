"""The pipeline as lazily composed DataFrames, and a runner that writes tables.

``Plan`` wires the operators together over one input set (benchmark parquet
+ fixtures); the catalog and the bench pick plans from it. It runs nothing but the two
tables that evidence reads more than once, gold and queue, which are written at first use. ``run_pipeline`` materialises the table DAG in dependency order:
every stage writes a table and the next stage reads it back, so each table
is computed once and a lost executor re-runs one stage, not the lineage.
Tables joined on dispute_id are bucketed by it (same bucket count), so
those joins and the evidence window run without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import actions, evidence, gold, queue, routing, silver, split
from ..operators.runs import model_metrics, run_metrics, runs_from_flat
from ..session import checkpoint_dir
from ..sources import io
from ..sources.fixtures import Inputs, inputs
from .training import train_log_and_score


@dataclass
class Plan:
    spark: SparkSession
    sf_dir: str
    ts: str | None = C.FIXED_RUN_TS
    _t: Inputs = field(init=False)

    def __post_init__(self):
        self._t = inputs(self.spark, self.sf_dir)

    @property
    def t(self) -> Inputs:
        return self._t

    @cached_property
    def silver(self) -> DataFrame:
        return silver.clean_disputes(self.t.raw_disputes)

    @cached_property
    def snippets(self) -> DataFrame:
        return silver.clean_snippets(self.t.policy_snippets)

    @cached_property
    def gold(self) -> DataFrame:
        return gold.build_features(self.silver, self.t.payer_rules, self.t.ndc_reference, self.t.plan_reference)

    @cached_property
    def gold_v2(self) -> DataFrame:
        return gold.collapse_labels(self.gold)

    @cached_property
    def routed(self) -> DataFrame:
        return routing.route(self.t.scored, ts=self.ts)

    @cached_property
    def queue(self) -> DataFrame:
        return queue.build_queue(self.routed, self.gold_v2, ts=self.ts)

    @cached_property
    def written_gold(self) -> DataFrame:
        """The gold columns that the queue and its evidence read, computed once: written, then read back."""
        cols = dict.fromkeys(queue.GOLD_QUEUE_COLS + evidence.GOLD_EVIDENCE_COLS)
        return io.stored(self.gold_v2.select(*cols), "gold-of-queue")

    @cached_property
    def written_queue(self) -> DataFrame:
        """``queue`` over the written gold, written too: its evidence and the enriched queue both read it."""
        return io.stored(queue.build_queue(self.routed, self.written_gold, ts=self.ts), "queue")

    @cached_property
    def evidence_base(self) -> DataFrame:
        return evidence.evidence_base(self.written_queue, self.written_gold, self.t.payer_rules, self.t.plan_reference,
                                      self.t.ndc_reference)

    @cached_property
    def candidates(self) -> DataFrame:
        return evidence.evidence_candidates(self.evidence_base, ts=self.ts)

    @cached_property
    def top3(self) -> DataFrame:
        return evidence.top_evidence(evidence.evidence_candidates(self.evidence_base, ts=self.ts,
                                                                  best=C.TOP_EVIDENCE_K))

    @cached_property
    def evidence_agg(self) -> DataFrame:
        return evidence.aggregate_evidence(self.top3)

    @cached_property
    def enriched(self) -> DataFrame:
        return evidence.enrich_queue(self.written_queue, self.evidence_agg)

    @cached_property
    def actionable(self) -> DataFrame:
        return actions.build_actions(self.enriched, ts=self.ts)

    @cached_property
    def prompts(self) -> DataFrame:
        return actions.build_prompts(self.actionable, ts=self.ts)

    @cached_property
    def runs(self) -> DataFrame:
        return runs_from_flat(self.t.ml_runs)


_PLANS: dict[tuple[int, str], Plan] = {}


def plan_for(spark: SparkSession, sf_dir: str) -> Plan:
    key = (id(spark), sf_dir)
    if key not in _PLANS:
        _PLANS[key] = Plan(spark, sf_dir)
    return _PLANS[key]


def ensure_database(spark: SparkSession, db: str) -> str:
    """A database whose managed tables live under the shared checkpoint folder.

    With the in-memory catalog, tables are forgotten when the session ends
    while their folders remain; the folder is then scoped by application
    id so a later session never collides with an old table's location. A
    persistent (Hive) catalog keeps one stable location per database.
    """
    root = checkpoint_dir(spark).rstrip("/")
    in_memory = spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "in-memory"
    loc = f"{root}/warehouse/{spark.sparkContext.applicationId}/{db}.db" if in_memory else f"{root}/warehouse/{db}.db"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{loc}'")
    return db


def run_pipeline(spark: SparkSession, sf_dir: str, db: str = C.DEFAULT_DB, ts: str | None = None,
                 buckets: int | None = None, fmt: str = C.DEFAULT_FORMAT, train: C.BoostedParams | None = None,
                 model_path: str | None = None) -> dict[str, str]:
    """Build every table of the DAG in order; returns {table: qualified name}.

    ``buckets`` (default: the session's shuffle partitions) buckets the
    dispute-keyed tables by dispute_id. With ``train`` both models are fitted on the written training
    table, logged, and score the disputes (``model_path`` lets a cut-off fit continue); without it the
    predictions and runs are those of the input.
    """
    ensure_database(spark, db)
    t = inputs(spark, sf_dir)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_id = (n, ["dispute_id"])
    out: dict[str, str] = {}

    def write(df: DataFrame, name: str, bucket: bool = False) -> DataFrame:
        io.write_table(df, db, name, fmt=fmt, bucket_by=by_id if bucket else None)
        out[name] = io.qualified(db, name)
        return spark.table(out[name])

    for name in ("payer_rules", "ndc_reference", "plan_reference"):
        write(t.fixture(name), name)
    raw = write(t.raw_disputes, "raw_disputes")
    write(silver.clean_snippets(t.policy_snippets), "silver_policy_snippets")
    s = write(silver.clean_disputes(raw), "silver_clean_disputes")
    rules, ndc, plan = (spark.table(out[k]) for k in ("payer_rules", "ndc_reference", "plan_reference"))
    g = write(gold.build_features(s, rules, ndc, plan), "gold_features_disputes")
    g2 = write(gold.collapse_labels(g), "gold_features_disputes_v2", bucket=True)
    for version, table in (("", g), ("_v2", g2)):
        names = [f"{n}{version}" for n in ("gold_features_split", "train_disputes", "test_disputes")]
        _, training, test = split.write_split_tables(table, db, *names)
        out.update({n: io.qualified(db, n) for n in names})
    if train is None:
        run_log = write(runs_from_flat(t.ml_runs), "ml_runs")
        predictions = t.scored
    else:
        predictions = train_log_and_score(spark, db, g2, training, test, train, "ml_runs", model_path, ts=ts)
        out["ml_runs"] = io.qualified(db, "ml_runs")
        run_log = spark.table(out["ml_runs"])
    write(run_metrics(run_log), "mlflow_run_metrics")
    write(model_metrics(run_log), "model_metrics_reason_classifier")
    scored = write(predictions, "predictions_disputes_scored", bucket=True)
    routed = write(routing.route(scored, ts=ts), "predictions_disputes_scored_routed", bucket=True)
    src = spark.table(io.resolve_source(spark, db, ["predictions_disputes_scored_routed",
                                                   "predictions_disputes_scored"]))
    del routed
    q = write(queue.build_queue(src, g2, ts=ts), "dispute_work_queue", bucket=True)
    write(queue.queue_kpis(q), "dispute_queue_kpis")
    write(queue.payer_kpis(q), "dispute_queue_kpis_payer")
    io.ensure_table(spark, db, "dispute_work_events", io.EVENTS_SCHEMA, fmt)
    io.append_events(queue.created_events(q), db, "dispute_work_events")
    out["dispute_work_events"] = io.qualified(db, "dispute_work_events")

    base = evidence.evidence_base(q, g2, io.optional_table(spark, db, "payer_rules"),
                                  io.optional_table(spark, db, "plan_reference"),
                                  io.optional_table(spark, db, "ndc_reference"))
    cand = write(evidence.evidence_candidates(base, ts=ts), "dispute_evidence_candidates", bucket=True)
    top = write(evidence.top_evidence(cand), "dispute_evidence_top3", bucket=True)  # of all that are written
    enriched = write(evidence.enrich_queue(q, evidence.aggregate_evidence(top)), "dispute_work_queue_enriched",
                     bucket=True)
    act = write(actions.build_actions(enriched, ts=ts), "dispute_work_queue_actionable")
    write(actions.build_prompts(act, ts=ts), "llm_explanation_prompts")
    io.create_dashboard_view(spark, db)
    out["v_queue_dashboard"] = io.qualified(db, "v_queue_dashboard")
    return out


def main(argv: list[str] | None = None) -> None:
    """python -m dispute_engine.plans.pipeline [--train] SF_DIR [DB] — build every table (--train: fit and score)."""
    import sys

    from ..session import get_spark
    args = list(sys.argv[1:] if argv is None else argv)
    fit = "--train" in args
    args = [a for a in args if a != "--train"]
    if not args:
        raise SystemExit("usage: python -m dispute_engine.plans.pipeline [--train] SF_DIR [DB]")
    spark = get_spark()
    for name, table in run_pipeline(spark, args[0], db=args[1] if len(args) > 1 else C.DEFAULT_DB,
                                    train=C.BoostedParams() if fit else None).items():
        print(f"{name}\t{table}")


if __name__ == "__main__":
    main()
