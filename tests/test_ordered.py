"""Range-based numbering against plain windows, on groups of very unequal size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import metrics as M
from ledgerline.operators import ordered as O

from tests.conftest import rows


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randrange(400), i, rng.choice([None, i])) for i in range(3000)]
    return spark.createDataFrame(data, "run string, at int, id int, value int").cache()


def test_numbering(frame):
    w = Window.partitionBy("run").orderBy("at", "id")
    assert rows(O.numbered(frame, ["run"], ["at", "id"], "n").select("id", "n")) == rows(frame.select("id", F.row_number().over(w)))
    whole = Window.orderBy("at", "id")
    assert rows(O.numbered(frame, [], ["at", "id"], "n").select("id", "n")) == rows(frame.select("id", F.row_number().over(whole)))


def test_sums_and_carries(frame):
    once = frame.dropDuplicates(["run", "at"])
    w = Window.partitionBy("run").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    assert rows(O.running_sum(once, ["run"], "at", "id", "s").select("id", "s")) == rows(once.select("id", F.sum("id").over(upto)))
    assert rows(O.previous(once, ["run"], "at", "p").select("id", "p")) == rows(once.select("id", F.lag("at").over(w)))
    order = Window.partitionBy("run").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(O.last_known(frame, ["run"], ["at", "id"], "value", "v").select("id", "v")) == rows(frame.select("id", F.last("value", ignorenulls=True).over(order)))


def test_moving_rate(frame):
    f = frame.select("run", "id", F.timestamp_seconds("at").alias("ts"), F.lit(1).alias("one"))
    w = Window.partitionBy("run").orderBy(F.unix_micros("ts")).rangeBetween(-60_000_000, 0)
    assert rows(M.moving_rate(f, "run", "ts", "one", 60).select("id", "moving_rate")) == rows(f.select("id", F.sum("one").over(w) / 60.0))


def test_hot_group_is_spread(spark, frame):
    cut = O.ranged(frame, "at", 16)
    sizes = [r["count"] for r in cut.filter("run = 'hot'").groupBy(O.RANGE).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 0.2 * sum(sizes)


def test_bytes_and_empty(spark):
    f = spark.createDataFrame([("b",), ("a",), ("ab",), ("é",), ("Z",), ("aaaaaaaab",), ("aaaaaaaaa",)], "k string")
    assert [r["k"] for r in sorted(M.byte_ranked(f, "k").collect(), key=lambda r: r["rank"])] == sorted(["b", "a", "ab", "é", "Z", "aaaaaaaab", "aaaaaaaaa"], key=str.encode)
    assert M.byte_ranked(f.limit(0), "k").count() == 0 and O.numbered(f.limit(0), [], ["k"], "n").count() == 0
