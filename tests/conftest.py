import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tallywork import build_session, schemas  # noqa: E402
from tallywork.plans import standard  # noqa: E402
from tallywork.sources import catalogs  # noqa: E402

ACME, GLOBEX, INITECH = standard.TENANT_PLANS
NOBODY = "99999999-9999-9999-9999-999999999999"
BASE = datetime(2026, 7, 8, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return BASE + timedelta(seconds=seconds)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        4,
        {
            "spark.ui.enabled": "false",
            "spark.sql.streaming.stateStore.providerClass": (
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
            ),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def meters(spark):
    return catalogs.meter_catalog(spark, {**standard.METERS, "peak": "MAX"})


@pytest.fixture(scope="session")
def tenant_plan(spark):
    return catalogs.tenant_plans(spark, standard.TENANT_PLANS)


@pytest.fixture(scope="session")
def models(spark):
    return catalogs.models_from_documents(catalogs.plan_documents(spark, standard.PRICE_PLANS))


@pytest.fixture
def events(spark):
    """Usage events from (key, tenant, meter, quantity, dimensions, second)."""

    def make(*rows):
        data = [
            (1, key, tenant, meter, quantity, dims, at(second), at(second))
            for key, tenant, meter, quantity, dims, second in rows
        ]
        return spark.createDataFrame(data, schemas.USAGE_EVENT)

    return make


@pytest.fixture
def charges(spark):
    """Charges from (id, tenant, meter, quantity, amount, day), one minute long."""

    def make(*rows):
        data = [
            (
                1, key, tenant, meter, (at(day * 86400), at(day * 86400 + 60)), {}, quantity, amount,
                "AUD", 1,
            )
            for key, tenant, meter, quantity, amount, day in rows
        ]
        return spark.createDataFrame(data, schemas.CHARGE)

    return make
