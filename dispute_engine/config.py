"""Configuration: thresholds, code lists and fixed texts.

Every value under a "FIXED VALUES" comment must stay equal to the pipeline
being re-implemented, because results (labels, queue routing, evidence text,
prompt text) are compared against it verbatim.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DEFAULT_DB = "dispute_ai"
DEFAULT_FORMAT = "parquet"

# A fixed run timestamp used by registered queries so that timestamp columns
# (routed_at_utc, created_at, evidence_ts, ...) are comparable across engines.
FIXED_RUN_TS = "2024-01-01 00:00:00"

# ---------------------------------------------------------------------------
# FIXED VALUES — routing and queue thresholds
# ---------------------------------------------------------------------------
ROUTE_HIGH = 0.75
ROUTE_MID = 0.50
P1_CONF, P1_VARIANCE = 0.85, 5000.0
P2_CONF, P2_VARIANCE = 0.75, 1000.0
SLA_DAYS = {"P1": 2, "P2": 5}
SLA_DEFAULT = 10
HUMAN_REVIEW_BELOW = 0.75
SPLIT_TRAIN_PCT = 80

# ---------------------------------------------------------------------------
# FIXED VALUES — label collapse (reason_code -> reason_code_v2)
# ---------------------------------------------------------------------------
KEEP_REASON_CODES = (
    "TIMELY_FILING",
    "DUPLICATE_DISCOUNT_340B",
    "PRIOR_AUTH",
    "ELIGIBILITY",
    "NDC_MAPPING",
    "PLAN_EXCLUSION",
    "STEP_THERAPY",
)
OTHER_REASON_CODE = "PRICING_ADMIN_OTHER"

# ---------------------------------------------------------------------------
# FIXED VALUES — owner team per predicted reason (first match wins)
# ---------------------------------------------------------------------------
OWNER_RULES = (
    (("DUPLICATE_DISCOUNT_340B",), "340B Team"),
    (("TIMELY_FILING",), "Timely Filing Team"),
    (("PRIOR_AUTH",), "PA Team"),
    (("PLAN_EXCLUSION", "STEP_THERAPY", "ELIGIBILITY", "NDC_MAPPING"), "Policy Ops Team"),
)
OWNER_DEFAULT = "Pricing/Admin Team"

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword features: (feature, substrings searched in notes and
# rejection text, substrings searched in rejection text only)
# ---------------------------------------------------------------------------
KEYWORD_RULES = (
    ("kw_340b", ("340b",), ()),
    ("kw_duplicate", ("duplicate",), ()),
    ("kw_timely", ("timely",), ()),
    ("kw_pa", ("prior auth",), ("pa ",)),
    ("kw_ndc", ("ndc",), ()),
    ("kw_eligibility", ("eligible",), ()),
)

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword evidence rules: (evidence_type, text, flag column, score)
# ---------------------------------------------------------------------------
KEYWORD_EVIDENCE = (
    ("KW_340B", "Keywords indicate 340B / duplicate discount context.", "kw_340b", 90),
    ("KW_DUPLICATE", "Keywords indicate duplicate / duplicate discount.", "kw_duplicate", 85),
    ("KW_TIMELY", "Keywords indicate timely filing context.", "kw_timely", 80),
    ("KW_PA", "Keywords indicate prior authorization context.", "kw_pa", 80),
    ("KW_NDC", "Keywords indicate NDC / mapping context.", "kw_ndc", 75),
    ("KW_ELIGIBILITY", "Keywords indicate eligibility/coverage context.", "kw_eligibility", 75),
)

# ---------------------------------------------------------------------------
# FIXED VALUES — other evidence texts and scores
# ---------------------------------------------------------------------------
EV_MODEL_CONFIDENCE = "MODEL_CONFIDENCE"
EV_AMOUNT_VARIANCE = "AMOUNT_VARIANCE"
EV_TIMELY_FILING = "TIMELY_FILING_RULE"
EV_CHANNEL_340B = "CHANNEL_340B"
EV_PLAN_CONTEXT = "PLAN_CONTEXT"
EV_NDC_CONTEXT = "NDC_CONTEXT"
CHANNEL_340B_TEXT = "Dispute is flagged as 340B (channel/flag indicates 340B involvement)."
CHANNEL_340B_SCORE = 88
VARIANCE_SCORE_HIGH, VARIANCE_SCORE_MID, VARIANCE_SCORE_LOW = 90, 70, 40
TIMELY_LATE_SCORE, TIMELY_OK_SCORE = 95, 60
PLAN_CONTEXT_SCORE = 55
NDC_CONTEXT_SCORE = 50
TOP_EVIDENCE_K = 3

# ---------------------------------------------------------------------------
# FIXED VALUES — recommended action per predicted reason
# ---------------------------------------------------------------------------
ACTION_TIMELY_LATE = (
    "Validate submission dates; request timely-filing exception or supporting proof; refile if allowed"
)
ACTION_TIMELY_OK = "Proceed with dispute citing timely filing compliance; attach submission proof"
ACTION_BY_REASON = (
    ("DUPLICATE_DISCOUNT_340B",
     "Run 340B duplicate discount validation; attach 340B claim/eligibility evidence; "
     "coordinate with covered entity if needed"),
    ("PRIOR_AUTH",
     "Check PA requirement; validate PA number/status; attach PA approval or request retro-PA review"),
    ("ELIGIBILITY",
     "Verify member/plan eligibility for DOS; validate coverage window; attach eligibility proof"),
    ("NDC_MAPPING",
     "Validate NDC11 mapping (package/labeler); check crosswalk; attach correct NDC and product reference"),
    ("PLAN_EXCLUSION",
     "Review formulary/coverage rules; verify exception criteria; submit medical necessity/coverage documentation"),
    ("STEP_THERAPY",
     "Verify step therapy requirements; attach trial/failure evidence or exception documentation"),
)
ACTION_DEFAULT = (
    "Review pricing/contract alignment; validate units/contract terms; "
    "attach contract/rate evidence and recalculation details"
)

# ---------------------------------------------------------------------------
# FIXED VALUES — prompt text
# ---------------------------------------------------------------------------
PROMPT_HEADER = (
    "You are a medicaid market access disputes assistant. "
    "Write an audit-ready explanation and next steps.\n\n"
    "Return JSON with keys: summary, rationale, next_steps, missing_info, risk_level.\n\n"
)
PROMPT_NO_EVIDENCE = "No evidence available."
PROMPT_RULES = "\n\nRules:\n- Do not invent facts.\n- If evidence is insufficient, say what is missing.\n"

# ---------------------------------------------------------------------------
# FIXED VALUES — work events
# ---------------------------------------------------------------------------
EVENT_CREATED = "CREATED"
EVENT_ACTOR = "system"
EVENT_CREATED_NOTE = "Work queue item created from batch scoring"

# ---------------------------------------------------------------------------
# FIXED VALUES — run names tracked in the run log
# ---------------------------------------------------------------------------
RUN_LR = "reason_classifier_lr"
RUN_LR_BALANCED = "reason_classifier_lr_saga"
RUN_LR_COLLAPSED = "reason_classifier_lr_after_collapse"
RUN_BOOSTED = "reason_classifier_xgboost_v2"
TARGET_RUN_NAMES = (RUN_LR_BALANCED, RUN_LR_COLLAPSED, RUN_BOOSTED)
RECENT_RUNS_PER_EXPERIMENT = 500
MODEL_METRICS_TOP = 5


@dataclass(frozen=True)
class FeatureSpec:
    """Feature columns of a classifier: numeric, categorical, label."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    label: str
    id_col: str = "dispute_id"

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


# FIXED VALUES — feature lists
NUMERIC_FEATURES = (
    "delta_amount", "delta_pct", "is_340b_flag", "timely_flag",
    "kw_340b", "kw_duplicate", "kw_timely", "kw_pa", "kw_ndc", "kw_eligibility",
    "units", "billed_amount", "paid_amount", "expected_amount", "days_to_submit",
)
CATEGORICAL_V1 = ("program", "state", "payer", "channel", "brand_generic", "therapeutic_class", "manufacturer")
CATEGORICAL_V2 = ("program", "state", "payer", "channel", "brand_generic",
                  "ndc_therapeutic_class", "ndc_manufacturer")

SPEC_LR_V1 = FeatureSpec(NUMERIC_FEATURES, CATEGORICAL_V1, "reason_code")
SPEC_LR_BALANCED = FeatureSpec(NUMERIC_FEATURES, CATEGORICAL_V2, "reason_code")
SPEC_V2 = FeatureSpec(NUMERIC_FEATURES, CATEGORICAL_V2, "reason_code_v2")


@dataclass(frozen=True)
class BoostedParams:
    """Boosted-tree parameters; defaults are the reference run's."""

    n_estimators: int = 400
    max_depth: int = 8
    learning_rate: float = 0.08
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    seed: int = 42
    max_bins: int = 256  # histogram bins, as a "hist" tree method uses


@dataclass(frozen=True)
class LRParams:
    max_iter: int = 2000
    scale: bool = False
    balanced: bool = False
    tol: float = 1e-4  # the classifier library default the original relies on (tol not set)


# unscaled features: a relative improvement of 1e-4 stops far from the optimum (the original's rule bounds the gradient)
LR_V1 = LRParams(max_iter=2000, scale=False, balanced=False, tol=1e-6)
LR_BALANCED = LRParams(max_iter=8000, scale=True, balanced=True)
