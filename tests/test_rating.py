import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import ACME, GLOBEX, NOBODY
from tallywork.operators import metering, rating
from tallywork.sources import catalogs

LADDER = [
    {"up_to": 1000000, "unit_price_minor": 30, "per_units": 1000},
    {"up_to": None, "unit_price_minor": 20, "per_units": 1000},
]


def plan(kind, tiers, version=1):
    return {"p": {"version": version, "currency": "AUD", "meters": {"m": {"type": kind, "tiers": tiers}}}}


def price(spark, kind, tiers, *quantities):
    models = catalogs.models_from_documents(catalogs.plan_documents(spark, plan(kind, tiers)))
    rows = spark.createDataFrame([(q,) for q in quantities], "q bigint")
    priced = rows.join(models, F.lit(True)).select(
        "q", rating.price(F.col("pricing_type"), F.col("q"), F.col("tiers")).alias("c")
    )
    found = {r.q: r.c for r in priced.collect()}
    return [found[q] for q in quantities]


def test_flat(spark):
    tiers = [{"up_to": None, "unit_price_minor": 5, "per_units": 1}]
    assert price(spark, "FLAT", tiers, 100, 0) == [500, 0]


def test_tiered_and_volume(spark):
    assert price(spark, "TIERED", LADDER, 500_000, 1_500_000) == [15_000, 40_000]
    assert price(spark, "VOLUME", LADDER, 500_000, 1_500_000, 1_000_000, 0) == [15_000, 30_000, 30_000, 0]


def test_unknown_pricing_type_fails(spark):
    with pytest.raises(Exception, match="unknown pricing type"):
        price(spark, "AUCTION", LADDER, 1)


def exact_cost(units, tier):
    if units <= 0:
        return 0
    n, d = units * tier["unit_price_minor"], tier["per_units"]
    q, r = divmod(n, d)
    return q + (2 * r > d or (2 * r == d and q % 2 == 1))


ladders = st.lists(
    st.tuples(st.integers(1, 50), st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=5
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(ladders, st.integers(0, 200))
def test_pricing_matches_plain_arithmetic(spark, steps, start):
    tiers, limit = [], start
    for gap, unit, per in steps:
        limit += gap
        tiers.append({"up_to": limit, "unit_price_minor": unit, "per_units": per})
    tiers[-1]["up_to"] = None
    quantities = list(range(0, limit + 20, 3))
    tiered, volume = [], []
    for q in quantities:
        low, total = 0, 0
        for t in tiers:
            high = q if t["up_to"] is None else min(q, t["up_to"])
            total += exact_cost(high - low, t)
            low = t["up_to"] if t["up_to"] is not None else low
        tiered.append(total)
        volume.append(
            next(exact_cost(q, t) for t in tiers if t["up_to"] is None or q <= t["up_to"])
        )
    assert price(spark, "TIERED", tiers, *quantities) == tiered
    assert price(spark, "VOLUME", tiers, *quantities) == volume


@pytest.mark.parametrize(
    ("kind", "tiers", "violation"),
    [
        ("TIERED", LADDER, None),
        ("TIERED", [{**LADDER[0]}], "last_tier_bounded"),
        ("VOLUME", [LADDER[0], LADDER[0], LADDER[1]], "limits_not_increasing"),
        ("TIERED", [LADDER[1], LADDER[1]], "unbounded_before_last"),
        ("TIERED", [{**LADDER[1], "per_units": 0}], "per_units_below_one"),
        ("TIERED", [{**LADDER[1], "unit_price_minor": -1}], "negative_price"),
        ("TIERED", [{**LADDER[0], "up_to": -1}, LADDER[1]], "negative_limit"),
        ("FLAT", [{**LADDER[0]}], None),
    ],
)
def test_ladder_rules(spark, kind, tiers, violation):
    documents = catalogs.plan_documents(spark, plan(kind, tiers))
    found = rating.ladder_violations(documents).collect()
    assert [r.violation for r in found] == ([violation] if violation else [])
    if violation:
        with pytest.raises(ValueError, match="malformed price ladder"):
            rating.checked_models(documents)
    else:
        assert rating.checked_models(documents).count() == 1


def test_models_agree_however_built(spark):
    documents = catalogs.plan_documents(spark, plan("TIERED", LADDER))
    direct = catalogs.models_from_documents(documents).first()
    grouped = catalogs.price_models(catalogs.flatten_plans(documents)).first()
    assert [tuple(t) for t in direct.tiers] == [tuple(t) for t in grouped.tiers]
    assert [t.lower_bound for t in direct.tiers] == [0, 1_000_000]


def test_plan_documents_from_files(spark, tmp_path):
    import json

    text = "\n".join(json.dumps({"plan_code": k, **v}) for k, v in plan("FLAT", LADDER).items())
    (tmp_path / "plans.json").write_text(text)
    documents = catalogs.read_plan_documents(spark, str(tmp_path))
    assert catalogs.flatten_plans(documents).count() == 2


def test_only_priced_readings_are_charged(events, meters, tenant_plan, models):
    df = events(
        ("a", ACME, "llm.tokens.input", 1_500_000, {"model": "gpt-4o"}, 1),
        ("b", GLOBEX, "llm.tokens.input", 1_500_000, {}, 1),
        ("c", NOBODY, "llm.tokens.input", 5, {}, 1),
        ("d", ACME, "unpriced", 5, {}, 1),
    )
    readings = metering.meter(df, meters)
    charges = rating.rate(readings, tenant_plan, models)
    got = {r.tenant_id: (r.amount_minor, r.plan_version, r.currency) for r in charges.collect()}
    assert got == {ACME: (40_000, 1, "AUD"), GLOBEX: (22_500, 1, "AUD")}
    left = rating.unrated(readings, tenant_plan, models).collect()
    assert {(r.tenant_id, r.reason) for r in left} == {(NOBODY, "no_plan"), (ACME, "unpriced_meter")}


def test_rerating_is_deterministic_and_versions_change_the_id(spark, events, meters, tenant_plan):
    from tallywork.plans import standard

    def models(version):
        plans = {c: {**p, "version": version} for c, p in standard.PRICE_PLANS.items()}
        return catalogs.models_from_documents(catalogs.plan_documents(spark, plans))

    readings = metering.meter(events(("a", ACME, "llm.tokens.input", 99, {}, 1)), meters)
    runs = {v: rating.rate(readings, tenant_plan, models(v)) for v in (1, 2)}
    same = rating.rerating_report(runs[1], rating.rate(readings, tenant_plan, models(1))).first()
    assert (same.same_id, same.delta_minor) == (True, 0)
    new = rating.rerating_report(runs[1], runs[2]).first()
    assert (new.same_id, new.delta_minor) == (False, 0)


def test_small_catalogs_are_broadcast_and_metering_shuffles_once(events, meters, tenant_plan, models):
    df = rating.rate(metering.meter(events(("a", ACME, "m", 1, {}, 1)), meters), tenant_plan, models)
    plan_text = df._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan_text and "Python" not in plan_text


def test_price_without_tiers_is_refused(spark):
    bare = [{"plan_code": "p", "version": 1, "currency": "AUD", "meters": {"m": {"type": "TIERED", "tiers": []}}}]
    documents = spark.createDataFrame(bare, catalogs.PLAN_DOCUMENT)
    assert [r.violation for r in rating.ladder_violations(documents).collect()] == ["empty_ladder"]
    assert catalogs.flatten_plans(documents).isEmpty()
    with pytest.raises(ValueError, match="empty_ladder"):
        rating.checked_models(documents)
