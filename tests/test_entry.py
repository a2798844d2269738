import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    if not Path(SMALL).exists():
        pytest.skip("no test tables")
    rows = entry.entry(spark).collect()
    assert rows and sum(r.balance_minor for r in rows) == 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_floating_point_money():
    import tallywork.schemas as schemas

    for table in vars(schemas).values():
        if hasattr(table, "fields"):
            assert not {f.dataType.typeName() for f in table.fields} & {"double", "float"}


def own_modules():
    return sorted(p for p in (ROOT / "tallywork").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts)


@pytest.mark.parametrize("path", own_modules(), ids=lambda p: p.name)
def test_jobs_stay_distributed(path):
    """No cross joins, local checkpoints, row-at-a-time UDFs or unbounded broadcasts."""
    text = path.read_text()
    assert not re.search(r"crossJoin|localCheckpoint|F\.udf|toPandas|\.rdd\b", text)
    # Only the bounded set of dominating keys is broadcast by hint.
    assert path.name == "dedup.py" or ".broadcast(" not in text
