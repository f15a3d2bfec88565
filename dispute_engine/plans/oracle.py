"""Independent SQL oracle for the registered queries (DuckDB dialect).

Hand-written SQL over the benchmark tables; it shares only the fixture
definitions (the inputs) with the Spark side. Traps handled: ``||`` instead
of ``concat`` (DuckDB's concat skips NULL), ``e0`` literals for doubles, an
explicit initcap, ``format('{:,.Nf}')`` for ``format_number``.
"""

from __future__ import annotations

from ..sources.fixtures import FIXTURE_SQL, fixture_sql_for_duckdb

RUN_TS_SQL = "TIMESTAMP '2024-01-01 00:00:00'"


def initcap(x: str) -> str:
    return (f"list_aggregate(list_transform(string_split(lower(trim({x})),' '), "
            f"lambda w: upper(w[1])||w[2:]),'string_agg',' ')")


def lc(x: str) -> str:
    return f"lower(coalesce({x},''))"


def kw(both: list[str], rej_only: list[str] = ()) -> str:
    terms = [f"contains({lc('dispute_notes')},'{n}')" for n in both]
    terms += [f"contains({lc('rejection_code_text')},'{n}')" for n in both]
    terms += [f"contains({lc('rejection_code_text')},'{n}')" for n in rej_only]
    return f"CAST(({' OR '.join(terms)}) AS INTEGER)"


OWNER_CASE = """CASE WHEN {c} = 'DUPLICATE_DISCOUNT_340B' THEN '340B Team'
    WHEN {c} = 'TIMELY_FILING' THEN 'Timely Filing Team'
    WHEN {c} = 'PRIOR_AUTH' THEN 'PA Team'
    WHEN {c} IN ('PLAN_EXCLUSION','STEP_THERAPY','ELIGIBILITY','NDC_MAPPING') THEN 'Policy Ops Team'
    ELSE 'Pricing/Admin Team' END"""


def split_sql(id_col: str = "dispute_id") -> tuple[list[str], str]:
    """Steps of the 64-bit xxHash (seed 42) of an 11-byte id, each an expression over the last (h), and the side.

    An id of that length is one 8-byte word, three single bytes and the final mix."""
    # FIXED VALUES - the hash's five primes
    p1, p2, p3, p4, p5 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                          2870177450012600261)
    mod = f"{1 << 64}::UHUGEINT"

    def times(x, p):
        return f"((({x})::UHUGEINT * {p}::UHUGEINT) % {mod})"

    def rotate(x, n):
        return f"(((({x})::UHUGEINT * {1 << n}::UHUGEINT) % {mod}) + (({x})::UHUGEINT // {1 << (64 - n)}::UHUGEINT))"

    def xor(a, b):
        return f"xor(({a})::UBIGINT, ({b})::UBIGINT)"

    byte = [f"ascii(substr({id_col}, {i + 1}, 1))" for i in range(11)]
    word = " + ".join(f"{byte[i]}::UHUGEINT * {1 << (8 * i)}::UHUGEINT" for i in range(8))
    steps = [f"({times(word, p2)})", times(rotate("h", 31), p1),
             f"(({times(rotate(xor((42 + p5 + 11) % (1 << 64), 'h'), 27), p1)} + {p4}::UHUGEINT) % {mod})"]
    steps += [times(rotate(xor("h", times(byte[i], p5)), 11), p1) for i in (8, 9, 10)]
    steps += [times(xor("h", f"h // {1 << 33}::UHUGEINT"), p2), times(xor("h", f"h // {1 << 29}::UHUGEINT"), p3),
              xor("h", f"h // {1 << 32}::UHUGEINT")]
    side = (f"CASE WHEN (CASE WHEN h < {1 << 63}::UHUGEINT THEN h WHEN h = {1 << 63}::UHUGEINT THEN 0::UHUGEINT "
            f"ELSE {mod} - h END) % 100 < 80 THEN 'TRAIN' ELSE 'TEST' END")
    return steps, side


def split_cte(table: str) -> str:
    steps, side = split_sql()
    body = f"SELECT *, {steps[0]}::UHUGEINT AS h FROM {table}"
    for step in steps[1:]:
        body = f"SELECT * REPLACE (({step})::UHUGEINT AS h) FROM ({body}) t"
    return f"SELECT * EXCLUDE (h), {side} AS split FROM ({body}) t"


FIXTURE_CTES = [(name, fixture_sql_for_duckdb(name)) for name in FIXTURE_SQL]

PIPELINE_CTES = [
    ("silver", f"""
SELECT dispute_id,
  try_cast(service_date AS DATE) AS service_date,
  try_cast(submitted_date AS DATE) AS submitted_date,
  CASE WHEN days_to_submit IS NOT NULL THEN try_cast(days_to_submit AS INTEGER)
       ELSE CAST(try_cast(submitted_date AS DATE) - try_cast(service_date AS DATE) AS INTEGER) END AS days_to_submit,
  payer, {initcap('program')} AS program, state,
  CASE WHEN contains(lower(channel),'340b') THEN '340B' WHEN channel IS NULL THEN 'Unknown' ELSE 'Non-340B' END
    AS channel,
  plan_id, ndc11, brand_generic, therapeutic_class, manufacturer,
  upper(trim(outcome)) AS outcome, upper(trim(reason_code)) AS reason_code,
  dispute_notes, rejection_code_text,
  try_cast(units AS DOUBLE) AS units, try_cast(billed_amount AS DOUBLE) AS billed_amount,
  try_cast(paid_amount AS DOUBLE) AS paid_amount, try_cast(expected_amount AS DOUBLE) AS expected_amount
FROM raw_disputes"""),
    ("gold", f"""
SELECT s.*, r.timely_filing_days, r.pa_strictness, r.appeal_success_bias,
  n.therapeutic_class AS ndc_therapeutic_class, n.manufacturer AS ndc_manufacturer, p.coverage_generosity,
  s.expected_amount - s.paid_amount AS delta_amount,
  CASE WHEN s.expected_amount = 0 THEN 0e0 ELSE abs(s.expected_amount - s.paid_amount) / s.expected_amount END
    AS delta_pct,
  CAST(s.channel = '340B' AS INTEGER) AS is_340b_flag,
  CASE WHEN r.timely_filing_days IS NULL THEN NULL
       ELSE CAST(s.days_to_submit <= r.timely_filing_days AS INTEGER) END AS timely_flag,
  {kw(['340b'])} AS kw_340b,
  {kw(['duplicate'])} AS kw_duplicate,
  {kw(['timely'])} AS kw_timely,
  {kw(['prior auth'], ['pa '])} AS kw_pa,
  {kw(['ndc'])} AS kw_ndc,
  {kw(['eligible'])} AS kw_eligibility
FROM silver s
LEFT JOIN payer_rules r ON s.payer = r.payer AND s.program = r.program
LEFT JOIN ndc_reference n ON s.ndc11 = n.ndc11
LEFT JOIN plan_reference p ON s.plan_id = p.plan_id"""),
    ("gold_v2", """
SELECT * REPLACE (upper(trim(reason_code)) AS reason_code),
  CASE WHEN upper(trim(reason_code)) IN ('TIMELY_FILING','DUPLICATE_DISCOUNT_340B','PRIOR_AUTH','ELIGIBILITY',
       'NDC_MAPPING','PLAN_EXCLUSION','STEP_THERAPY') THEN upper(trim(reason_code))
       ELSE 'PRICING_ADMIN_OTHER' END AS reason_code_v2
FROM gold"""),
    ("split_v1", split_cte("gold")),
    ("split_v2", split_cte("gold_v2")),
    ("train_v2", "SELECT * FROM split_v2 WHERE split = 'TRAIN'"),
    ("routed", f"""
SELECT *,
  CASE WHEN conf_xgb IS NULL THEN 'REQUEST_INFO' WHEN conf_xgb >= 0.75 THEN 'AUTO_ROUTE'
       WHEN conf_xgb >= 0.5 THEN 'REVIEW' ELSE 'REQUEST_INFO' END AS route_decision,
  CASE WHEN conf_xgb IS NULL THEN 'missing_confidence' WHEN conf_xgb >= 0.75 THEN 'high_confidence'
       WHEN conf_xgb >= 0.5 THEN 'medium_confidence' ELSE 'low_confidence' END AS route_reason,
  {RUN_TS_SQL} AS routed_at_utc
FROM scored_fixture"""),
    ("queue_pre", f"""
SELECT s.dispute_id, s.pred_reason_xgb, s.conf_xgb, s.pred_reason_lr, s.conf_lr,
  g.payer, g.program, g.state, g.channel, g.ndc11, g.expected_amount, g.paid_amount,
  CAST(g.expected_amount - g.paid_amount AS DOUBLE) AS recoverable_amount,
  abs(g.expected_amount - g.paid_amount) AS dispute_variance_amount,
  g.delta_pct, g.days_to_submit, g.timely_flag
FROM routed s LEFT JOIN gold_v2 g ON s.dispute_id = g.dispute_id"""),
    ("queue_prio", """
SELECT *, CASE WHEN conf_xgb >= 0.85 AND dispute_variance_amount >= 5000 THEN 'P1'
               WHEN conf_xgb >= 0.75 AND dispute_variance_amount >= 1000 THEN 'P2' ELSE 'P3' END AS priority
FROM queue_pre"""),
    ("queue", f"""
SELECT dispute_id, 'OPEN' AS work_status,
  {OWNER_CASE.format(c='pred_reason_xgb')} AS owner_queue,
  priority,
  CASE WHEN priority = 'P1' THEN 2 WHEN priority = 'P2' THEN 5 ELSE 10 END AS sla_days,
  pred_reason_xgb, conf_xgb, pred_reason_lr, conf_lr, payer, program, state, channel, ndc11,
  expected_amount, paid_amount, recoverable_amount, dispute_variance_amount,
  CASE WHEN recoverable_amount > 0 THEN 'UNDERPAID_RECOVER' WHEN recoverable_amount < 0 THEN 'OVERPAID_VERIFY'
       ELSE 'MATCH' END AS variance_direction,
  delta_pct, days_to_submit, timely_flag, {RUN_TS_SQL} AS created_at
FROM queue_prio"""),
    ("ev_base_core", """
SELECT q.dispute_id, q.pred_reason_xgb, q.conf_xgb, q.payer, q.program, q.state, q.channel, q.ndc11,
  q.expected_amount, q.paid_amount, q.recoverable_amount, q.dispute_variance_amount, q.days_to_submit,
  q.timely_flag, q.delta_pct, g.plan_id, g.kw_340b, g.kw_duplicate, g.kw_timely, g.kw_pa, g.kw_ndc,
  g.kw_eligibility, g.is_340b_flag
FROM queue q LEFT JOIN gold_v2 g ON q.dispute_id = g.dispute_id"""),
    ("ev_base", """
SELECT b.*, r.timely_filing_days, p.coverage_generosity, n.therapeutic_class, n.manufacturer
FROM ev_base_core b
LEFT JOIN payer_rules r ON b.payer = r.payer AND b.program = r.program
LEFT JOIN plan_reference p ON b.plan_id = p.plan_id
LEFT JOIN ndc_reference n ON b.ndc11 = n.ndc11"""),
]


def candidate_branches(base: str = "ev_base", with_rules: bool = True) -> list[str]:
    """One SELECT per evidence rule over ``base`` (5-column shape)."""
    ts = RUN_TS_SQL
    out = [
        f"""SELECT dispute_id, 'MODEL_CONFIDENCE' AS evidence_type,
  'Model confidence is ' || format('{{:,.3f}}', conf_xgb) || ' for ' || pred_reason_xgb AS evidence_text,
  CAST(conf_xgb * 100 AS DOUBLE) AS evidence_score, {ts} AS evidence_ts FROM {base}""",
        f"""SELECT dispute_id, 'AMOUNT_VARIANCE',
  'Variance amount = $' || format('{{:,.2f}}', dispute_variance_amount) || '; recoverable = $'
    || format('{{:,.2f}}', recoverable_amount),
  CASE WHEN dispute_variance_amount >= 5000 THEN 90e0 WHEN dispute_variance_amount >= 1000 THEN 70e0 ELSE 40e0 END,
  {ts} FROM {base}""",
    ]
    if with_rules:
        out.append(f"""SELECT * FROM (SELECT dispute_id, 'TIMELY_FILING_RULE' AS evidence_type,
  CASE WHEN timely_filing_days IS NOT NULL THEN 'Payer timely filing limit is ' || CAST(timely_filing_days AS VARCHAR)
    || ' days; submitted in ' || CAST(days_to_submit AS VARCHAR) || ' days.' END AS evidence_text,
  CASE WHEN timely_filing_days IS NOT NULL AND days_to_submit > timely_filing_days THEN 95e0
       WHEN timely_filing_days IS NOT NULL AND days_to_submit <= timely_filing_days THEN 60e0 END AS evidence_score,
  {ts} AS evidence_ts FROM {base}) t WHERE evidence_text IS NOT NULL""")
    for etype, msg, flag, score in [
        ("KW_340B", "Keywords indicate 340B / duplicate discount context.", "kw_340b", 90),
        ("KW_DUPLICATE", "Keywords indicate duplicate / duplicate discount.", "kw_duplicate", 85),
        ("KW_TIMELY", "Keywords indicate timely filing context.", "kw_timely", 80),
        ("KW_PA", "Keywords indicate prior authorization context.", "kw_pa", 80),
        ("KW_NDC", "Keywords indicate NDC / mapping context.", "kw_ndc", 75),
        ("KW_ELIGIBILITY", "Keywords indicate eligibility/coverage context.", "kw_eligibility", 75),
    ]:
        out.append(f"SELECT dispute_id, '{etype}', '{msg}', {score}e0, {ts} FROM {base} WHERE {flag} = 1")
    out.append(f"""SELECT dispute_id, 'CHANNEL_340B',
  'Dispute is flagged as 340B (channel/flag indicates 340B involvement).', 88e0, {ts}
FROM {base} WHERE channel = '340B' OR is_340b_flag = 1""")
    out.append(f"""SELECT dispute_id, 'PLAN_CONTEXT', 'Plan coverage generosity = ' || CAST(coverage_generosity AS VARCHAR),
  55e0, {ts} FROM {base} WHERE coverage_generosity IS NOT NULL""")
    out.append(f"""SELECT dispute_id, 'NDC_CONTEXT',
  'Drug context: therapeutic class = ' || therapeutic_class || '; manufacturer = ' || manufacturer, 50e0, {ts}
FROM {base} WHERE therapeutic_class IS NOT NULL""")
    return out


EVIDENCE_CTES = [
    ("candidates", "\nUNION ALL\n".join(candidate_branches())),
    ("top3", """
SELECT dispute_id, evidence_type, evidence_text, evidence_score, evidence_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY dispute_id ORDER BY evidence_score DESC NULLS LAST,
    evidence_ts DESC NULLS LAST, evidence_type ASC NULLS FIRST, evidence_text ASC NULLS FIRST) AS rn
  FROM candidates) t WHERE rn <= 3"""),
    ("ev_agg", """
SELECT dispute_id,
  coalesce(list(item ORDER BY sk0, sk1, sk2, sk3, sk4) FILTER (WHERE item IS NOT NULL), []) AS evidence_list,
  coalesce(string_agg(item, chr(10) ORDER BY sk0, sk1, sk2, sk3, sk4) FILTER (WHERE item IS NOT NULL), '')
    AS evidence_text_block
FROM (SELECT dispute_id,
        '[' || evidence_type || '] ' || evidence_text || ' (score=' || format('{:,.0f}', evidence_score) || ')'
          AS item,
        evidence_score IS NULL AS sk0, -evidence_score AS sk1, evidence_ts AS sk2, evidence_type AS sk3,
        evidence_text AS sk4
      FROM top3) t
GROUP BY dispute_id"""),
    ("enriched", """
SELECT q.*, e.evidence_list, e.evidence_text_block FROM queue q LEFT JOIN ev_agg e ON q.dispute_id = e.dispute_id"""),
    ("actionable", f"""
SELECT *,
  CASE WHEN conf_xgb IS NULL THEN true WHEN conf_xgb < 0.75 THEN true ELSE false END AS requires_human_review,
  CASE WHEN pred_reason_xgb = 'TIMELY_FILING' AND days_to_submit IS NOT NULL AND timely_flag = 0
         THEN 'Validate submission dates; request timely-filing exception or supporting proof; refile if allowed'
       WHEN pred_reason_xgb = 'TIMELY_FILING' AND timely_flag = 1
         THEN 'Proceed with dispute citing timely filing compliance; attach submission proof'
       WHEN pred_reason_xgb = 'DUPLICATE_DISCOUNT_340B'
         THEN 'Run 340B duplicate discount validation; attach 340B claim/eligibility evidence; coordinate with covered entity if needed'
       WHEN pred_reason_xgb = 'PRIOR_AUTH'
         THEN 'Check PA requirement; validate PA number/status; attach PA approval or request retro-PA review'
       WHEN pred_reason_xgb = 'ELIGIBILITY'
         THEN 'Verify member/plan eligibility for DOS; validate coverage window; attach eligibility proof'
       WHEN pred_reason_xgb = 'NDC_MAPPING'
         THEN 'Validate NDC11 mapping (package/labeler); check crosswalk; attach correct NDC and product reference'
       WHEN pred_reason_xgb = 'PLAN_EXCLUSION'
         THEN 'Review formulary/coverage rules; verify exception criteria; submit medical necessity/coverage documentation'
       WHEN pred_reason_xgb = 'STEP_THERAPY'
         THEN 'Verify step therapy requirements; attach trial/failure evidence or exception documentation'
       ELSE 'Review pricing/contract alignment; validate units/contract terms; attach contract/rate evidence and recalculation details'
  END AS recommended_action,
  'Predicted=' || pred_reason_xgb || '; confidence=' || format('{{:,.3f}}', conf_xgb)
    || CASE WHEN evidence_text_block IS NOT NULL THEN '; top evidence:' || chr(10) || evidence_text_block ELSE '' END
    AS action_reason,
  {OWNER_CASE.format(c='pred_reason_xgb')} AS next_action_owner,
  {RUN_TS_SQL} AS action_created_at
FROM enriched"""),
    ("prompts", f"""
SELECT dispute_id, pred_reason_xgb, conf_xgb, priority, owner_queue, next_action_owner, expected_amount,
  paid_amount, recoverable_amount, dispute_variance_amount, days_to_submit, timely_flag, recommended_action,
  evidence_text_block,
  'You are a medicaid market access disputes assistant. Write an audit-ready explanation and next steps.'
    || chr(10) || chr(10)
    || 'Return JSON with keys: summary, rationale, next_steps, missing_info, risk_level.' || chr(10) || chr(10)
    || 'Case:' || chr(10)
    || '- predicted_reason: ' || pred_reason_xgb || chr(10)
    || '- confidence: ' || format('{{:,.3f}}', conf_xgb) || chr(10)
    || '- priority: ' || priority || chr(10)
    || '- expected_amount: ' || CAST(expected_amount AS VARCHAR) || chr(10)
    || '- paid_amount: ' || CAST(paid_amount AS VARCHAR) || chr(10)
    || '- recoverable_amount: ' || CAST(recoverable_amount AS VARCHAR) || chr(10)
    || '- dispute_variance_amount: ' || CAST(dispute_variance_amount AS VARCHAR) || chr(10)
    || '- days_to_submit: ' || CAST(days_to_submit AS VARCHAR) || chr(10)
    || '- timely_flag: ' || CAST(timely_flag AS VARCHAR) || chr(10) || chr(10)
    || 'Recommended action:' || chr(10) || recommended_action
    || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce(evidence_text_block, 'No evidence available.')
    || chr(10) || chr(10) || 'Rules:' || chr(10) || '- Do not invent facts.' || chr(10)
    || '- If evidence is insufficient, say what is missing.' || chr(10) AS llm_prompt,
  {RUN_TS_SQL} AS prompt_created_at
FROM actionable"""),
]

RUN_CTES = [
    ("runs", """
SELECT experiment_id, experiment_name, run_id, run_name, status, start_time, f1_macro, roc_auc,
  CAST(NULL AS DOUBLE) AS avg_precision, to_json(CAST(params_json::JSON AS MAP(VARCHAR, VARCHAR))) AS params,
  CASE WHEN run_name IS NULL THEN '{}' ELSE '{"mlflow.runName":"' || run_name || '"}' END AS tags
FROM ml_runs"""),
    ("runs_recent", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY start_time DESC NULLS LAST,
  run_id) AS rn FROM runs) t WHERE rn <= 500"""),
    ("runs_latest", """
SELECT * EXCLUDE (rn2) FROM (
  SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY run_name ORDER BY start_time DESC NULLS LAST, run_id) AS rn2
  FROM runs_recent WHERE run_name IN ('reason_classifier_lr_saga','reason_classifier_lr_after_collapse',
    'reason_classifier_xgboost_v2')) t WHERE rn2 = 1"""),
]

ALL_CTES = FIXTURE_CTES + PIPELINE_CTES + EVIDENCE_CTES + RUN_CTES


def with_ctes(select: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``select`` with the whole CTE chain (unreferenced CTEs are not run)."""
    ctes = ALL_CTES + (extra or [])
    body = ",\n".join(f"{name} AS ({text.strip()})" for name, text in ctes)
    return f"WITH {body}\n{select.strip()}"


def iso_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S') || "
            f"CASE WHEN microsecond({c}) % 1000000 <> 0 THEN '.' || lpad(CAST(microsecond({c}) % 1000000 AS VARCHAR), 6, '0') "
            f"ELSE '' END || '+00:00' END")
