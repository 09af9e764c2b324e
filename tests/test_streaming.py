"""Running baskets against the batch ledger: ten batches, clears, batches done twice, events that come again, a restart."""

import pytest
from pyspark.sql import functions as F

from provender.operators.ordered import ledger
from provender.streaming.jobs import baskets_now, into_baskets, running_ledger

EVENTS = "user long, seq long, op string, product_id string, quantity double"


@pytest.fixture(scope="module")
def events(spark):
    """The events of sf0.01 as changes of baskets of 20 products; one in eighty is a clear."""
    op = F.element_at(F.array(*map(F.lit, ["add", "add", "update", "remove", "add"])), (F.col("event_id") % 5 + 1).cast("int"))
    op = F.when(F.col("event_id") % 80 == 0, "clear").otherwise(op)
    rows = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    return rows.select((F.col("user_id") % 40).alias("user"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") * 7 % 23 % 20).cast("string").alias("product_id"), F.floor(F.col("value")).cast("double").alias("quantity")).orderBy("seq").limit(4000).cache()


def items(df):
    return sorted(tuple(r) for r in df.select("user", "product_id", "quantity", "ord").collect())


def test_ten_batches(spark, events, tmp_path):
    last = events.agg(F.max("seq")).first()[0]
    first = events.agg(F.min("seq")).first()[0]
    step = (last - first) // 10 + 1
    into, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for i in range(10):
        part = events.where(f"seq between {first + i * step} and {first + (i + 1) * step - 1}")
        again = events.where(f"seq between {first + (i - 1) * step} and {first + i * step - 1}").limit(50)  # delivered twice
        part.union(again).coalesce(1).write.mode("append").json(into)
        # each batch is a query of its own, which starts from the checkpoint
        into_baskets(running_ledger(spark.readStream.schema(EVENTS).json(into), slices=2), out, mark).awaitTermination()
        if i in (3, 9):
            now = baskets_now(spark.read.parquet(out))
            assert items(now) == items(ledger(events.where(f"seq < {first + (i + 1) * step}")))
    changes = spark.read.parquet(out)
    assert changes.where("deleted").count() > 50 and changes.select("batch").distinct().count() == 10

    # the last batch done again, as after a failure between its output and its commit
    for f in (tmp_path / "mark" / "commits").glob("*9*"):
        f.unlink()
    into_baskets(running_ledger(spark.readStream.schema(EVENTS).json(into), slices=2), out, mark).awaitTermination()
    assert items(baskets_now(spark.read.parquet(out))) == items(ledger(events))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_emptied_basket(spark, tmp_path):
    """A clear is told of each item; what goes and comes again in one batch is new; unknown updates say nothing."""
    into, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    batches = [
        [(1, 1, "add", " a", None), (1, 2, "add", "b", None), (2, 3, "update", "a", 5.0), (2, 4, "add", "undefined", None)],
        [(1, 5, "clear", None, None), (2, 6, "clear", "x", None)],
        [(1, 7, "add", "b", None), (1, 8, "remove", "b", None), (1, 9, "add", "b", None), (1, 10, "update", "b", float("nan")), (1, 11, "update", "b", 4.0)],
        [(1, 12, "add", "a", None), (1, 13, "clear", None, None), (1, 14, "remove", "a", None)],
    ]
    want = [[(1, "a", 1.0, 1, 1, False), (1, "b", 1.0, 2, 2, False)], [(1, "a", None, None, 5, True), (1, "b", None, None, 5, True)], [(1, "b", 4.0, 9, 11, False)], [(1, "a", None, None, 13, True), (1, "b", None, None, 13, True)]]
    for n, (batch, expected) in enumerate(zip(batches, want)):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").json(into)
        into_baskets(running_ledger(spark.readStream.schema(EVENTS).json(into)), out, mark).awaitTermination()
        got = spark.read.parquet(f"{out}/batch={n}")
        assert sorted(tuple(r) for r in got.select("user", "product_id", "quantity", "since", "seq", "deleted").collect()) == expected
    assert baskets_now(spark.read.parquet(out)).count() == 0
