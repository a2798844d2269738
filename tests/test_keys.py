import hashlib
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tallywork.functions import keys as K
from tallywork.session import SHUFFLE_CLEANUP, staged

MAP = "map<string,string>"


def dims(spark, value):
    return spark.createDataFrame([(value,)], f"m {MAP}")


@pytest.mark.parametrize(
    ("value", "key"),
    [
        (None, ""),
        ({}, ""),
        ({"region": "ap-southeast-2", "model": "gpt-4o"}, "model=gpt-4o;region=ap-southeast-2"),
        ({"model": "gpt-4o", "region": "ap-southeast-2"}, "model=gpt-4o;region=ap-southeast-2"),
        # By UTF-16 code unit a surrogate pair sorts before U+FF21, by code point after it.
        ({"Ａ": "1", "\U0001f600": "2"}, "\U0001f600=2;Ａ=1"),
    ],
)
def test_dimension_key(spark, value, key):
    assert dims(spark, value).select(K.dimension_key(F.col("m"))).first()[0] == key


def test_canonical_dimensions_never_null(spark):
    assert dims(spark, None).select(K.canonical_dimensions(F.col("m"))).first()[0] == {}


@pytest.mark.parametrize(
    ("ts", "text"),
    [
        ("2026-07-08 00:00:00", "2026-07-08T00:00:00Z"),
        ("2026-07-08 00:00:00.12", "2026-07-08T00:00:00.120Z"),
        ("2026-07-08 00:00:00.000007", "2026-07-08T00:00:00.000007Z"),
        ("1969-12-31 23:59:59.5", "1969-12-31T23:59:59.500Z"),
    ],
)
def test_iso_instant(spark, ts, text):
    got = spark.range(1).select(K.iso_instant(F.lit(ts).cast("timestamp"))).first()[0]
    assert got == text


def test_name_uuid_sets_version_and_variant(spark):
    names = [str(i) for i in range(300)]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.u for r in rows.select("n", K.name_uuid(F.col("n")).alias("u")).collect()}
    for n in names:
        assert got[n] == str(uuid.UUID(bytes=hashlib.md5(n.encode()).digest(), version=3))


@pytest.mark.parametrize(
    ("value", "version", "want"),
    [
        ({"model": "gpt-4o"}, 7, "47477059-ce30-36e4-9a88-3bbdc7ddcb16"),
        ({}, 1, "227faf64-d74d-397f-9547-75e3da2ef4ef"),
    ],
)
def test_charge_id(spark, value, version, want):
    window = F.struct(
        F.lit("2026-07-08 00:00:00").cast("timestamp").alias("start"),
        F.lit("2026-07-08 00:01:00").cast("timestamp").alias("end"),
    )
    got = dims(spark, value).select(
        K.charge_id(
            F.lit("11111111-1111-1111-1111-111111111111"),
            F.lit("llm.tokens.input"),
            window,
            K.sorted_entries(F.col("m")),
            F.lit(version),
        )
    )
    assert got.first()[0] == want


def test_packed_ids_come_back_and_differ(spark):
    plain = "0fda01c2-0000-3a00-8b00-00000000000a"
    texts = [plain, plain.upper(), plain[:-1] + "g", plain[1:9] + "0" + plain[9:], plain.replace("-", ""), "-" * 36]
    texts += ["", "a", "x" * 15, "x" * 16, "x" * 17, "é" * 18, "\0" * 17, plain[:-2] + "-a", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", K.packed_id(F.col("text")).alias("packed"))
    got = rows.select("*", K.unpacked_id(F.col("packed")).alias("back")).collect()
    assert [r.back for r in got] == texts
    assert len({r.packed and bytes(r.packed) for r in got}) == len(texts)
    assert [r.text for r in got if r.packed is not None and len(r.packed) == 16] == [plain]


def test_lean_staging_leaves_no_shuffle_files(spark):
    def files():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (kept.apply(i).getName() for i in range(kept.size())) if n.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP)
    counted = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), lean=True)
    ends = time.time() + 30
    while files() - before and time.time() < ends:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert counted.agg(F.sum("count")).first()[0] == 1000
