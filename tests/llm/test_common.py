import pytest
from pyspark.sql import functions as F

from fathomline.llm import common


@pytest.mark.parametrize("total", [10, 1_000_000])
def test_keyed_join_is_a_left_join(spark, total):
    left = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 2, 3), ("", 1, 4), (None, 1, 5), ("\x00", 1, 6), ("a", None, 7)], "k string, j int, id long")
    right = spark.createDataFrame([("a", 1, 2, None), ("", 1, 1, 8), ("\x00", 1, 1, 9), ("zz", 1, 5000, 7)], "k string, j int, n long, x int")
    got = {r.id: r.x for r in common.keyed_join(left, right, ["k", "j"], "n", total, F.col("id")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 8, 5: None, 6: 9, 7: None}


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

        getConf = lambda self: self

    class Session:
        conf, sparkContext = Conf(), Conf()

    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_batches_are_bounded_inside_and_put_back_outside(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    seen = []

    @common.bounded_batches
    def inside(df, fail):
        seen.append(spark.conf.get(key))
        if fail:
            raise KeyError("x")
        return df.mapInArrow(lambda batches: ([b for b in batches]), "v binary").count()

    big = spark.range(40, numPartitions=1).selectExpr("cast(repeat('x', 1000000) as binary) as v")
    assert inside(big, False) == 40 and spark.conf.get(key) == before
    with pytest.raises(KeyError):
        inside(big, True)
    assert spark.conf.get(key) == before and set(seen) == {str(common.BATCH_BYTES)}
