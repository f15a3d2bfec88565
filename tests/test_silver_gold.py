"""Edge cases of cleaning and features (NULL, '', malformed text, traps)."""

import datetime as dt

import pytest
from pyspark.sql import Row

from dispute_engine.operators import gold, silver

RAW_SCHEMA = ("dispute_id string, service_date string, submitted_date string, days_to_submit int, payer string, "
              "program string, state string, channel string, plan_id string, ndc11 string, brand_generic string, "
              "therapeutic_class string, manufacturer string, outcome string, reason_code string, "
              "dispute_notes string, rejection_code_text string, units string, billed_amount string, "
              "paid_amount string, expected_amount string")


def raw_row(**kw):
    base = dict(dispute_id="D1", service_date="2024-01-01", submitted_date="2024-01-11", days_to_submit=None,
                payer="P", program=" medicaid FFS ", state="S01", channel="Retail", plan_id="PL01",
                ndc11="00000000001", brand_generic="BRAND", therapeutic_class="TC1", manufacturer="MF1",
                outcome=" denied ", reason_code=" timely_filing", dispute_notes=None, rejection_code_text=None,
                units="3", billed_amount="10.5", paid_amount="4.5", expected_amount="10.5")
    base.update(kw)
    return base


def make(spark, *rows):
    return spark.createDataFrame([Row(**r) for r in rows], RAW_SCHEMA)


def test_clean_types_and_normalisation(spark):
    out = silver.clean_disputes(make(spark, raw_row())).first()
    assert out.service_date == dt.date(2024, 1, 1)
    assert out.days_to_submit == 10  # fallback: submitted - service
    assert out.program == "Medicaid Ffs"
    assert out.outcome == "DENIED" and out.reason_code == "TIMELY_FILING"
    assert out.units == 3.0 and out.paid_amount == 4.5


def test_malformed_dates_and_numbers_become_null(spark):
    out = silver.clean_disputes(make(spark, raw_row(service_date="not-a-date", units="n/a"))).first()
    assert out.service_date is None and out.units is None
    assert out.days_to_submit is None  # datediff with a NULL date


def test_strict_mode_raises_on_bad_text(spark):
    with pytest.raises(Exception):
        silver.clean_disputes(make(spark, raw_row(units="n/a")), strict=True).collect()


def test_given_days_win_over_dates(spark):
    out = silver.clean_disputes(make(spark, raw_row(days_to_submit=-3))).first()
    assert out.days_to_submit == -3


@pytest.mark.parametrize("raw,expected", [
    ("340B Contract", "340B"), ("contract 340b", "340B"), ("Non-340B", "340B"),  # the non-idempotent trap
    ("", "Non-340B"), ("Retail", "Non-340B"), (None, "Unknown"),
])
def test_channel_rule(spark, raw, expected):
    assert silver.clean_disputes(make(spark, raw_row(channel=raw))).first().channel == expected


def lookups(spark):
    rules = spark.createDataFrame([("P", "Medicaid Ffs", 30, "HIGH", 0.1)],
                                  "payer string, program string, timely_filing_days int, pa_strictness string, "
                                  "appeal_success_bias double")
    ndc = spark.createDataFrame([("00000000001", "TYPE A", None)],
                                "ndc11 string, therapeutic_class string, manufacturer string")
    plan = spark.createDataFrame([("PL01", "LOW")], "plan_id string, coverage_generosity string")
    return rules, ndc, plan


def features(spark, **kw):
    rules, ndc, plan = lookups(spark)
    s = silver.clean_disputes(make(spark, raw_row(**kw)))
    return gold.build_features(s, rules, ndc, plan).first()


def test_lookups_and_renames(spark):
    f = features(spark)
    assert f.timely_filing_days == 30 and f.ndc_therapeutic_class == "TYPE A" and f.ndc_manufacturer is None
    assert f.therapeutic_class == "TC1"  # raw column kept unprefixed
    assert f.coverage_generosity == "LOW"


def test_payer_not_normalised_for_join(spark):
    assert features(spark, payer="p").timely_filing_days is None
    rules, ndc, plan = lookups(spark)
    s = silver.clean_disputes(make(spark, raw_row(payer=" p ")))
    assert gold.enrich_payer(s, rules, normalize_keys=True).first().timely_filing_days == 30


@pytest.mark.parametrize("expected_amount,paid,delta_pct", [
    ("0", "5", 0.0), ("0", None, 0.0), (None, "5", None), ("-10", "-8", -0.2), ("10", "4", 0.6),
])
def test_delta_pct(spark, expected_amount, paid, delta_pct):
    f = features(spark, expected_amount=expected_amount, paid_amount=paid)
    assert f.delta_pct == (pytest.approx(delta_pct) if delta_pct is not None else None)


def test_timely_flag(spark):
    assert features(spark, days_to_submit=31).timely_flag == 0
    assert features(spark, days_to_submit=30).timely_flag == 1
    assert features(spark, program="state program").timely_flag is None  # no rule
    assert features(spark, service_date="bad").timely_flag is None  # NULL days


def test_keywords(spark):
    f = features(spark, dispute_notes="Member INELIGIBLE; check eligibility", rejection_code_text="copa y")
    assert f.kw_eligibility == 1  # 'ineligible' contains 'eligible'
    assert f.kw_pa == 1  # 'copa ' contains 'pa ' in rejection text
    f2 = features(spark, dispute_notes="eligibility only; pa missing", rejection_code_text=None)
    assert f2.kw_eligibility == 0  # 'eligibility' does not contain 'eligible'
    assert f2.kw_pa == 0  # 'pa ' counts in rejection text only
    f3 = features(spark, dispute_notes=None, rejection_code_text=None)
    assert (f3.kw_340b, f3.kw_duplicate, f3.kw_timely, f3.kw_ndc) == (0, 0, 0, 0)


def test_collapse_labels(spark):
    df = spark.createDataFrame([(" prior_auth ",), ("UNIT_ERROR",), (None,)], "reason_code string")
    got = [r.reason_code_v2 for r in gold.collapse_labels(df).collect()]
    assert got == ["PRIOR_AUTH", "PRICING_ADMIN_OTHER", "PRICING_ADMIN_OTHER"]


def test_absent_reference_tables_keep_columns(spark):
    s = silver.clean_disputes(make(spark, raw_row()))
    f = gold.build_features(s, None, None, None).first()
    assert f.timely_filing_days is None and f.timely_flag is None and f.coverage_generosity is None


def test_snippets(spark):
    df = spark.createDataFrame([(1, " medicaid FFS ", " s01", "building ", "timely_filing ", "  text ")],
                               "snippet_id long, program string, state string, payer string, reason_code string, "
                               "snippet_text string")
    r = silver.clean_snippets(df).first()
    assert (r.program, r.state, r.payer, r.reason_code, r.snippet_text) == (
        "Medicaid Ffs", "S01", "BUILDING", "TIMELY_FILING", "text")


def test_salted_lookup_join_equals_plain_join(spark):
    from pyspark.sql import functions as F

    from dispute_engine.functions.joins import lookup_join
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(
        (F.col("id") % 7).cast("string")).alias("k"), F.col("id"))
    right = spark.createDataFrame([(str(i), f"v{i}") for i in range(5)], "k string, v string")
    salted = lookup_join(left, right, ["k"], max_bytes=0)  # size check fails -> salted sort-merge path
    plain = left.join(right, ["k"], "left")
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    assert "xxhash64" in salted._jdf.queryExecution().optimizedPlan().toString()
