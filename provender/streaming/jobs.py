"""The batch jobs that also make sense over arriving data."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from provender.operators.classify import classified
from provender.operators.ordered import product_key
from provender.plans.traceability import normalize


def incoming_lines(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """(line, record) of files as they arrive, ``files`` at a time; record is null where a line isn't JSON. Blank lines are left out."""
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    return reader.text(path).where("trim(value) <> ''").select(F.col("value").alias("line"), F.try_parse_json("value").alias("record"))


def incoming_records(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Trace records of JSON-lines files as they arrive, normalised and classified; see incoming_faults for lines that aren't JSON."""
    rows = incoming_lines(spark, path, files).where("record is not null")
    return classified(normalize(rows.select(F.try_variant_get("record", "$._pos", "long").alias("_pos"), "record")))


def incoming_faults(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """(file, line) of what arrives and isn't JSON, with the text as it came: a stream beside that of the records."""
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.try_parse_json("value").alias("record"))
    return rows.where("record is null and trim(line) <> ''").drop("record")


def running_class_counts(records: DataFrame) -> DataFrame:
    """(classification, n, anomalies) of all records so far; each class that a batch touches is told anew."""
    return records.groupBy("classification").agg(F.count("*").alias("n"), F.count_if("hasAnomaly").alias("anomalies"))


def into_counts(counts: DataFrame, path: str, checkpoint: str, whole: bool = True) -> StreamingQuery:
    """Write the counts of all classes after each batch to one folder, the last in place of those before."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = counts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete")
    return (writer.trigger(availableNow=True) if whole else writer).start()


def apply_event(basket: dict[str, float], op: str, product: str | None, quantity: float | None) -> None:
    """One event on a basket in order of insertion; ids are trimmed already, null where they say nothing."""
    if op == "clear":
        basket.clear()
        return
    if product is None:
        return
    if op == "add":
        basket[product] = basket.get(product, 0.0) + 1
    elif op == "update" and product in basket and quantity is not None and math.isfinite(quantity) and quantity > 0:
        basket[product] = quantity
    elif op == "remove":
        basket.pop(product, None)


class BasketItems(StatefulProcessor):
    """The items of one slice of a user's basket, an entry of the state each: product to {since, quantity}.

    Only entries that events name are read or written, but for a clear, which reads the slice. Events up to the
    last one that was applied are left out, so what is delivered twice counts once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "product_id string", "since long, quantity double")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        events = pd.concat(list(rows)).sort_values("seq")
        if last is not None:
            events = events[events["seq"] > last]
        if events.empty:
            return
        changed: dict[str, tuple[int | None, float | None, int]] = {}

        def item(product: str) -> tuple[int | None, float | None]:
            if product in changed:
                return changed[product][:2]
            return tuple(self.items.getValue((product,))) if self.items.containsKey((product,)) else (None, None)

        for seq, op, product, quantity in zip(events["seq"].tolist(), events["op"], events["product_id"], events["quantity"]):
            if op == "clear":
                there = {k[0] for k in self.items.keys()} | {p for p, x in changed.items() if x[0] is not None}
                changed |= {p: (None, None, seq) for p in there if item(p)[0] is not None}
                continue
            since, held = item(product)
            if op == "add":
                changed[product] = (seq if since is None else since, (held or 0.0) + 1, seq)
            elif op == "remove" and since is not None:
                changed[product] = (None, None, seq)
            elif op == "update" and since is not None and quantity is not None and math.isfinite(quantity) and quantity > 0:
                changed[product] = (since, quantity, seq)
        self.last.update((int(events["seq"].iloc[-1]),))
        for product, (since, quantity, _) in changed.items():
            if since is not None:
                self.items.updateValue((product,), (since, quantity))
            elif self.items.containsKey((product,)):
                self.items.removeKey((product,))
        out = [(key[0], p, q, since, seq, since is None) for p, (since, q, seq) in changed.items()]
        yield pd.DataFrame(out, columns=["user", "product_id", "quantity", "since", "seq", "deleted"]).astype({"since": "Int64"})


CHANGES = "user long, product_id string, quantity double, since long, seq long, deleted boolean"


def running_ledger(events: DataFrame, slices: int = 16) -> DataFrame:
    """Changes of baskets as events (user, seq, op, product_id, quantity) arrive: user, product_id, quantity, since, seq, deleted.

    A record says how an item stands after event seq; deleted marks one that was taken out, by itself or by a
    clear. since is the event that put it in. A user's events have to arrive in order of seq across batches; within one
    they are put in order, and those that come again change nothing. A user's products are dealt into slices, so
    that a user with very many events is the work of several tasks; a clear goes to all of them. The query needs
    a state store with entries, which ``into_baskets`` asks for.
    """
    own = F.when(F.col("op") != "clear", product_key(F.col("product_id")))
    rows = events.select("user", F.col("seq").cast("long").alias("seq"), "op", own.alias("product_id"), F.col("quantity").cast("double").alias("quantity")).where("op = 'clear' or product_id is not null")
    slice_ = F.explode(F.when(F.col("op") == "clear", F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.pmod(F.xxhash64("product_id"), F.lit(slices)).cast("int"))))
    rows = rows.withColumn("slice", slice_)
    return rows.groupBy("user", "slice").transformWithStateInPandas(BasketItems(), CHANGES, "Update", "None")


def baskets_now(changes: DataFrame) -> DataFrame:
    """(user, product_id, quantity, ord) of the baskets after all changes: as ``ledger`` gives them from the events."""
    last = changes.groupBy("user", "product_id").agg(F.max_by(F.struct("quantity", "since", "deleted"), "seq").alias("x")).where("not x.deleted")
    return last.select("user", "product_id", "x.quantity", (F.row_number().over(Window.partitionBy("user").orderBy("x.since")).cast("long") - 1).alias("ord"))


@contextmanager
def entries_as_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile keep single entries in their state; the session's setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def into_parquet(stream: DataFrame, path: str, checkpoint: str, whole: bool = True) -> StreamingQuery:
    """Append arriving rows to Parquet files; ``whole``: what is there now, in batches, and then stop.

    The checkpoint holds what was read, so a query that starts again goes on where it stopped.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if whole else writer).start()


def into_baskets(stream: DataFrame, path: str, checkpoint: str, whole: bool = True) -> StreamingQuery:
    """Write each batch of running_ledger's changes to a folder of its own number, so that a batch done twice is there once."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update")
    with entries_as_state(stream.sparkSession):
        return (writer.trigger(availableNow=True) if whole else writer).start()
