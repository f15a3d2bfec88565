"""Input tables of the dispute pipeline, derived from the benchmark parquet.

The pipeline's inputs (raw disputes, payer rules, drug and plan reference,
policy snippets, a fixed scoring output and a run log) are defined as SQL
over the generated TPC-H-like tables. The same text runs on Spark (tables
bound as DataFrame arguments of ``spark.sql``) and on DuckDB (tables as
views), so the oracle and the Spark job read identical inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

RAW_DISPUTES_SQL = """
WITH li AS (
  SELECT l_orderkey, min(l_partkey) AS pk, sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS cents,
         sum(CAST(l_quantity AS BIGINT)) AS qty
  FROM {lineitem} GROUP BY l_orderkey)
SELECT 'D' || lpad(CAST(o_orderkey AS STRING),10,'0') AS dispute_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 'not-a-date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS service_date,
  CAST(CAST(o_orderdate AS DATE) + CAST((o_orderkey*13) % 200 AS INT) AS STRING) AS submitted_date,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST((o_orderkey*13) % 200 AS INT) END AS days_to_submit,
  c_mktsegment AS payer,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN ' medicaid FFS ' WHEN '2' THEN 'MANAGED care'
    WHEN '3' THEN 'medicare' WHEN '4' THEN ' Commercial' ELSE 'state program' END AS program,
  'S' || lpad(CAST(c_nationkey AS STRING),2,'0') AS state,
  CASE o_orderkey % 5 WHEN 0 THEN '340B Contract' WHEN 1 THEN NULL WHEN 2 THEN 'contract 340b'
    WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Non-340B' ELSE '' END ELSE 'Retail' END AS channel,
  'PL' || lpad(CAST(c_nationkey AS STRING),2,'0') AS plan_id,
  lpad(CAST(pk AS STRING),11,'0') AS ndc11,
  CASE WHEN pk % 2 = 0 THEN 'BRAND' WHEN pk % 2 = 1 THEN 'GENERIC' END AS brand_generic,
  'TC' || CAST(pk % 7 AS STRING) AS therapeutic_class,
  'MF' || CAST(pk % 5 AS STRING) AS manufacturer,
  CASE o_orderstatus WHEN 'F' THEN ' denied ' WHEN 'O' THEN 'Approved' ELSE 'partial' END AS outcome,
  CASE o_orderkey % 11 WHEN 0 THEN ' timely_filing' WHEN 1 THEN 'DUPLICATE_DISCOUNT_340B' WHEN 2 THEN 'prior_auth '
    WHEN 3 THEN 'ELIGIBILITY' WHEN 4 THEN 'NDC_MAPPING' WHEN 5 THEN 'PLAN_EXCLUSION' WHEN 6 THEN 'STEP_THERAPY'
    WHEN 7 THEN 'UNIT_ERROR' WHEN 8 THEN 'RATE_MISMATCH' WHEN 9 THEN NULL ELSE 'CONTRACT_TERM' END AS reason_code,
  CASE WHEN (o_orderkey*7) % 10 < 2 THEN NULL ELSE CASE o_orderkey % 11 WHEN 0 THEN 'Filed late, timely limit'
    WHEN 1 THEN 'Duplicate discount 340B' WHEN 2 THEN 'no Prior Auth on file' WHEN 3 THEN 'member ineligible'
    WHEN 4 THEN 'NDC crosswalk issue' WHEN 5 THEN 'check eligibility' ELSE 'see contract' END END AS dispute_notes,
  CASE o_orderkey % 6 WHEN 0 THEN 'PA missing' WHEN 1 THEN 'ndc not covered' WHEN 2 THEN NULL ELSE 'rate' END
    AS rejection_code_text,
  CASE WHEN o_orderkey % 103 = 0 THEN 'n/a' ELSE CAST(qty AS STRING) END AS units,
  cents/100e0 AS billed_amount,
  CASE WHEN o_orderkey % 97 = 0 THEN 0e0 ELSE cents/100e0 END AS expected_amount,
  CASE o_orderkey % 6 WHEN 0 THEN cents/100e0 WHEN 1 THEN (cents-50000)/100e0 WHEN 2 THEN (cents-250000)/100e0
    WHEN 3 THEN (cents-750000)/100e0 WHEN 4 THEN (cents+150000)/100e0 ELSE NULL END AS paid_amount
FROM {orders} JOIN {customer} ON o_custkey = c_custkey LEFT JOIN li ON o_orderkey = l_orderkey
"""

PAYER_RULES_SQL = """
SELECT payer, program, CAST(30*(1+length(payer)%6) AS INT) AS timely_filing_days,
  CASE WHEN length(program) > 9 THEN 'HIGH' ELSE 'LOW' END AS pa_strictness, length(payer)/10e0 AS appeal_success_bias
FROM (SELECT DISTINCT c_mktsegment AS payer FROM {customer}) a
CROSS JOIN (SELECT 'Medicaid Ffs' AS program UNION ALL SELECT 'Managed Care' UNION ALL SELECT 'Medicare'
            UNION ALL SELECT 'Commercial') b
"""

NDC_REFERENCE_SQL = """
SELECT lpad(CAST(p_partkey AS STRING),11,'0') AS ndc11, p_type AS therapeutic_class,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS manufacturer
FROM {part} WHERE p_partkey % 10 <> 0
"""

PLAN_REFERENCE_SQL = """
SELECT 'PL' || lpad(CAST(n_nationkey AS STRING),2,'0') AS plan_id,
  CASE WHEN n_nationkey % 11 = 3 THEN NULL WHEN n_regionkey < 2 THEN 'LOW' WHEN n_regionkey < 4 THEN 'MEDIUM' ELSE 'HIGH' END
    AS coverage_generosity
FROM {nation} WHERE n_nationkey % 8 <> 0
"""

POLICY_SNIPPETS_SQL = """
SELECT item_id AS snippet_id, ' medicaid FFS ' AS program,
  ' s' || lpad(CAST(item_id % 25 AS STRING),2,'0') AS state, 'building ' AS payer,
  CASE item_id % 3 WHEN 0 THEN 'timely_filing ' WHEN 1 THEN 'Prior_Auth' ELSE NULL END AS reason_code,
  '  ' || text || ' ' AS snippet_text
FROM {benchmark}
"""

SCORED_FIXTURE_SQL = """
SELECT 'D' || lpad(CAST(o_orderkey AS STRING),10,'0') AS dispute_id,
  CASE (o_orderkey*3) % 9 WHEN 0 THEN 'TIMELY_FILING' WHEN 3 THEN 'DUPLICATE_DISCOUNT_340B' ELSE
    CASE o_orderkey % 8 WHEN 0 THEN 'PRIOR_AUTH' WHEN 1 THEN 'ELIGIBILITY' WHEN 2 THEN 'NDC_MAPPING'
      WHEN 3 THEN 'PLAN_EXCLUSION' WHEN 4 THEN 'STEP_THERAPY' WHEN 5 THEN NULL ELSE 'PRICING_ADMIN_OTHER' END END AS pred_reason_xgb,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE ((o_orderkey*37) % 1001)/1000e0 END AS conf_xgb,
  CASE WHEN o_orderkey % 2 = 0 THEN 'TIMELY_FILING' ELSE 'PRICING_ADMIN_OTHER' END AS pred_reason_lr,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE ((o_orderkey*53) % 1001)/1000e0 END AS conf_lr,
  '2024-01-01T00:00:00+00:00' AS scored_at_utc
FROM {orders}
"""

ML_RUNS_SQL = """
SELECT 'E' || CAST(user_id % 5 AS STRING) AS experiment_id, 'exp-' || CAST(user_id % 5 AS STRING) AS experiment_name,
  'R' || lpad(CAST(event_id AS STRING),8,'0') AS run_id,
  CASE event_type WHEN 'view' THEN 'reason_classifier_lr_saga' WHEN 'click' THEN 'reason_classifier_lr_after_collapse'
    WHEN 'purchase' THEN 'reason_classifier_xgboost_v2' WHEN 'signup' THEN 'other_run' ELSE NULL END AS run_name,
  CASE WHEN event_id % 7 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts END AS start_time,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value/500e0 END AS f1_macro,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE value/400e0 END AS roc_auc,
  props AS params_json
FROM {events}
"""

# name -> (sql template, base tables it reads)
FIXTURE_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "raw_disputes": (RAW_DISPUTES_SQL, ("orders", "customer", "lineitem")),
    "payer_rules": (PAYER_RULES_SQL, ("customer",)),
    "ndc_reference": (NDC_REFERENCE_SQL, ("part",)),
    "plan_reference": (PLAN_REFERENCE_SQL, ("nation",)),
    "policy_snippets": (POLICY_SNIPPETS_SQL, ("benchmark",)),
    "scored_fixture": (SCORED_FIXTURE_SQL, ("orders",)),
    "ml_runs": (ML_RUNS_SQL, ("events",)),
}


def fixture_sql_for_duckdb(name: str) -> str:
    """The fixture text with plain table names (views pre-registered)."""
    text, deps = FIXTURE_SQL[name]
    return text.format(**{d: d for d in deps})


@dataclass
class Inputs:
    """Lazily bound DataFrames over one scale-factor directory.

    Nothing is read until an action runs; each attribute is a parquet scan
    (base tables) or a SQL plan over them (fixtures), so Catalyst prunes
    columns and pushes filters into the scans of every downstream query.
    """

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    # Spread a table too small to fill the cores (fewer row groups than cores)
    # round-robin; off by default: measured at sf0.1 it speeds the narrow
    # silver/gold plan but slows the join-heavy ones. A no-op at scale.

    def base(self, name: str) -> DataFrame:
        """Parquet scan of a benchmark table."""
        if name not in self._cache:
            df = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
            self._cache[name] = df
        return self._cache[name]

    def fixture(self, name: str) -> DataFrame:
        key = f"fixture:{name}"
        if key not in self._cache:
            text, deps = FIXTURE_SQL[name]
            self._cache[key] = self.spark.sql(text, **{d: self.base(d) for d in deps})
        return self._cache[key]

    @property
    def raw_disputes(self) -> DataFrame:
        return self.fixture("raw_disputes")

    @property
    def payer_rules(self) -> DataFrame:
        return self.fixture("payer_rules")

    @property
    def ndc_reference(self) -> DataFrame:
        return self.fixture("ndc_reference")

    @property
    def plan_reference(self) -> DataFrame:
        return self.fixture("plan_reference")

    @property
    def policy_snippets(self) -> DataFrame:
        return self.fixture("policy_snippets")

    @property
    def scored(self) -> DataFrame:
        return self.fixture("scored_fixture")

    @property
    def ml_runs(self) -> DataFrame:
        return self.fixture("ml_runs")


_INPUTS: dict[tuple[int, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (id(spark), sf_dir)
    if key not in _INPUTS:
        _INPUTS[key] = Inputs(spark, sf_dir)
    return _INPUTS[key]
