import glob
import tempfile
import time

import pytest

from corpaudit.storage import CLEANUP, stored


def shuffle_files(spark):
    top = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    return set(glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data"))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(5000).selectExpr("id", "id % 7 as k")
    held = [stored(rows.groupBy("k").count().join(rows, "k").repartition(5, "id"), "rows") for _ in range(3)]
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    sizes = [len(range(k, 5000, 7)) for k in range(7)]
    for table in held:
        assert table.count() == 5000 and table.agg({"count": "sum"}).first()[0] == sum(n * n for n in sizes)


@pytest.mark.parametrize("own", [None, "true", "false"])
def test_the_users_setting_is_as_before(spark, own):
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.unset(CLEANUP) if own is None else spark.conf.set(CLEANUP, own)
        stored(spark.range(10).repartition(3), "rows")
        assert spark.conf.get(CLEANUP, None) == own
        with pytest.raises(Exception, match="refused"):
            stored(spark.range(10).selectExpr("assert_true(id < 0, 'refused')"), "rows")
        assert spark.conf.get(CLEANUP, None) == own
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def test_broadcasts_go_by_measured_sizes_meanwhile(spark):
    from corpaudit.storage import ADAPTIVE_LIMIT, LIMIT, measured_broadcasts

    before = spark.conf.get(LIMIT), spark.conf.get(ADAPTIVE_LIMIT, None)
    with measured_broadcasts(spark):
        assert spark.conf.get(LIMIT) == "-1" and spark.conf.get(ADAPTIVE_LIMIT) == (before[1] or before[0])
    assert (spark.conf.get(LIMIT), spark.conf.get(ADAPTIVE_LIMIT, None)) == before
