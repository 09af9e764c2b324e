"""Operators that go by source order: first wins, numbering, grouping in order, merging, ledgers.

Order is always a column that the source wrote (``_pos`` by default); results don't depend on how
rows are dealt.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.functions.text import clean, filled, finite, has_display_value, plain_key, script_trimmed
from provender.sources.shared import dealt, kept

POS = "_pos"


def first_wins(df: DataFrame, key: Column | list[Column], order: str | Column = POS) -> DataFrame:
    """Of the rows with a key, the first: a grouped minimum, so a common key is reduced where its rows lie.

    Rows are moved whole; where they are wide, find the first positions on narrow ones and join.
    """
    keys = [k.alias(f"_k{i}") for i, k in enumerate(key if isinstance(key, list) else [key])]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def numbered(df: DataFrame, key: str, order: str = POS, name: str = "n", each: int = 100_000) -> DataFrame:
    """Add each row's number from 1 among the rows of its key in order, a whole number.

    Rows are numbered within spans of ``each`` positions, and spans are counted, so a common key
    isn't put in order in one place.
    """
    rows = df.withColumn("_span", F.expr(f"floor(`{order}` / {each})"))
    n = rows.groupBy(key, "_span").agg(F.count("*").alias("_c"))
    n = n.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), (F.sum("_c").over(Window.partitionBy(key).orderBy("_span")) - F.col("_c")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_span").orderBy(order))
    joined = rows.withColumn("_w", within).join(n, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s")))
    return joined.withColumn(name, F.col("_before") + F.col("_w")).drop("_span", "_w", "_k", "_s", "_before")


def occurrence_ids(df: DataFrame, base: Column, name: str, order: str = POS) -> DataFrame:
    """Add base as an identifier; from its second row on with ``:duplicate-n``."""
    rows = numbered(df.withColumn("_base", base), "_base", order, "_n")
    return rows.withColumn(name, F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(":duplicate-"), "_n"))).drop("_n", "_base")


def group_rows(df: DataFrame, key: Column, order: str = POS, each: int = 100_000) -> DataFrame:
    """The rows with ``key`` (trimmed, null if blank), ``group_no`` (groups from 0 by their first row), ``first_pos`` and ``place`` (from 1).

    Each row without a key is a group of its own. A group stays as many rows as it has: first positions are
    grouped minima, and places and group numbers are counted by spans of ``each`` positions, so a key with very many
    rows is nobody's work alone. Columns of these names are replaced.
    """
    rows = df.drop("key", "group_no", "first_pos", "place").withColumn("key", F.when(filled(key), clean(key)))
    rows = rows.withColumn("_own", F.when(F.col("key").isNull(), F.col(order)))  # tells the groups without a key apart
    groups = rows.groupBy("key", "_own").agg(F.min(order).alias("first_pos"))
    groups = numbered(groups.withColumn("_all", F.lit(0)), "_all", "first_pos", "_g", each).select(F.col("key").alias("_k"), F.col("_own").alias("_o"), "first_pos", (F.col("_g") - 1).alias("group_no"))
    rows = rows.join(groups, F.col("key").eqNullSafe(F.col("_k")) & F.col("_own").eqNullSafe(F.col("_o"))).drop("_k", "_o", "_own")
    return numbered(rows, "first_pos", order, "place", each)


def nested(flat: DataFrame, columns: list[str], records: str = "records") -> DataFrame:
    """One row for each group of ``group_rows``: key, first_pos and its rows in order, as an array of structs of the columns.

    For writers that need the rows of a group in one record: a group must not hold more than that can.
    """
    whole = F.struct(F.col("place").alias("_o"), F.struct(*columns).alias("r"))
    out = flat.groupBy("key", "first_pos").agg(F.array_sort(F.collect_list(whole)).alias("_r"))
    return out.select("key", "first_pos", F.transform("_r", lambda x: x["r"]).alias(records))


def grouped(df: DataFrame, key: Column, order: str = POS, records: str = "records") -> DataFrame:
    """(key, position of the first row, records in order); each row without a key is a group of its own. See ``nested``."""
    return nested(group_rows(df, key, order), df.columns, records)


def duplicates(df: DataFrame, key: Column, blank_counts: bool = True) -> DataFrame:
    """One row: how many keys stand there more than once, how many rows beyond the first of each, and how many rows in all."""
    rows = df.select(key.alias("_k"))
    if not blank_counts:
        rows = rows.where(filled(F.col("_k")))
    n = rows.groupBy("_k").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.expr("n > 1")).alias("values"), F.coalesce(F.sum(F.expr("if(n > 1, n - 1, 0)")), F.lit(0)).alias("surplus"), F.coalesce(F.sum(F.expr("if(n > 1, n, 0)")), F.lit(0)).alias("records"))


def merge_index(df: DataFrame, key: Column, category: str = "category", order: str = POS) -> DataFrame:
    """The first row of each key, with the first category that isn't empty."""
    found = F.min_by(category, F.when(F.coalesce(F.col(category), F.lit("")) != "", F.col(order)))
    row = F.min_by(F.struct(*df.columns), order)
    out = df.groupBy(key.alias("_key")).agg(row.alias("r"), found.alias("_c"))
    return out.select(*(F.coalesce("_c", F.col(f"r.{c}")).alias(c) if c == category else F.col(f"r.{c}").alias(c) for c in df.columns))


def merge_brands(brands: DataFrame, order: str = POS) -> DataFrame:
    """Brands of the same key as one: the first row's fields, the first description that isn't empty,
    its own products and links as they are, and those of the others that it hasn't yet.

    brands: name, description, products array<struct<name, ..>>, external_links array<struct<.., url>>.
    """
    rows = brands.withColumn("_key", plain_key(F.col("name")))
    said = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.col(order))
    first = rows.groupBy("_key").agg(F.min(order).alias("_first"), F.min_by(F.struct(*brands.columns), order).alias("_row"), F.min_by("description", said).alias("_text"))

    def others(column: str, key: Column, needed: bool) -> DataFrame:
        """What brands after the first add: an item that none before it has, where it first stands."""
        flat = rows.select("_key", F.col(order).alias("_o"), F.posexplode(column).alias("_at", "item")).withColumn("_item", key)
        place = F.struct("_o", "_at")
        met = flat.groupBy("_key", "_item").agg(F.min(place).alias("_p"), F.min_by("item", place).alias("item"))
        new = met.join(first.select("_key", "_first"), "_key").where((F.col("_p._o") != F.col("_first")) & (F.col("_item") != "" if needed else F.lit(True)))
        return new.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "item"))), lambda x: x["item"]).alias(f"_{column}"))

    out, merged = first, {"description": F.coalesce("_text", F.lit(""))}
    for column, key, needed in (("products", plain_key(F.col("item.name")), True), ("external_links", F.col("item.url"), False)):
        empty = F.array().cast(brands.schema[column].dataType)
        out = out.join(others(column, key, needed), "_key", "left")
        merged[column] = F.concat(F.coalesce(F.col(f"_row.{column}"), empty), F.coalesce(f"_{column}", empty))
    return out.select(*(merged[c].alias(c) if c in merged else F.col(f"_row.{c}") for c in brands.columns))


def decide(results: DataFrame, most: int = 5, group: str = "business_id", rank: str = "rank") -> DataFrame:
    """Add ``decision`` and ``reason`` to search results, and leave out those after the last one needed.

    results: url, excluded (why an address isn't looked at, or null), refused (why evidence isn't
    enough, or null). In order of rank, and of url where ranks tie, an address is excluded, or repeats
    one accepted before, or is refused, or accepted, until ``most`` are. Results of a group with the
    same rank and url are one. Only grouped minima and the first ``most`` of a group are looked for, so
    a large group isn't put in order in one place.
    """
    order = F.struct(F.col(rank).alias("r"), F.col("url").alias("u"))
    rows = results.dropDuplicates([group, rank, "url"]).withColumns({"_o": order, "_would": F.col("excluded").isNull() & F.col("refused").isNull() & F.col("url").isNotNull()})
    first = rows.where("_would").groupBy(group, "url").agg(F.min("_o").alias("_first"))
    top = first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_first"))).where(F.col("_n") <= most)
    cut = top.groupBy(group).agg(F.max("_first").alias("_last"), F.count("*").alias("_k"))
    rows = rows.join(first, [group, "url"], "left").join(cut, group, "left")
    rows = rows.where((F.coalesce("_k", F.lit(0)) < most) | (F.col("_o") <= F.col("_last")))
    accept = F.coalesce(F.col("_would") & (F.col("_o") == F.col("_first")), F.lit(False))
    repeat = F.coalesce(F.col("url").isNotNull() & (F.col("_o") > F.col("_first")), F.lit(False))
    reason = F.coalesce(F.col("excluded"), F.when(F.col("url").isNull(), "invalid_url"), F.when(repeat, "duplicate_url"), F.when(~accept, F.col("refused")), F.lit("business_name_or_number_match"))
    kept = [c for c in results.columns if c not in ("excluded", "refused")]
    return rows.select(*kept, F.when(accept, "accepted").otherwise("excluded").alias("decision"), reason.alias("reason"))


def product_key(product_id: Column) -> Column:
    """A product's id as baskets know it: trimmed; null if it says nothing."""
    return F.when(has_display_value(product_id.cast("string")), script_trimmed(product_id.cast("string")))


def good_quantity(q: Column) -> Column:
    return finite(q) & F.coalesce(q.cast("double") > 0, F.lit(False))


def ledger(events: DataFrame, user: str = "user", order: str = "seq", each: int = 100_000, slices: int = 16) -> DataFrame:
    """(user, product_id, quantity, ord): baskets after events (user, seq, op, product_id, quantity) in order.

    add puts one more in, update sets the quantity of what is there to a number above 0, remove and
    clear take out; ord is the place of the first add since the product last went. Ids are trimmed, and
    products whose id says nothing don't count. seq tells the events of a user apart.

    Events are folded by spans of ``each`` positions: of a product's run of events it is enough to know
    whether it was taken out, the first add and the last good update since, and the adds after that. Folds
    of spans are composed the same way. A user's products are dealt into ``slices``, and clears go to
    each of them, so neither a user nor a product with very many events is one task's work; nothing is joined. Events
    are counted before, so that no task puts more of them in order as there are more.
    """
    n = events.agg(F.sum(F.when(F.col("op") == "clear", slices).otherwise(1))).first()[0] or 0
    key, part = [user, "_slice", "product_id"], [user, "_slice"]
    rows = events.where("op in ('add', 'update', 'remove', 'clear')").select(user, F.col(order).alias("_s"), "op", F.when(F.col("op") != "clear", product_key(F.col("product_id"))).alias("product_id"), F.col("quantity").cast("double").alias("_q"))
    rows = rows.where("op = 'clear' or product_id is not null")
    mine = F.pmod(F.xxhash64("product_id"), F.lit(slices)).cast("int")
    rows = rows.withColumn("_slice", F.explode(F.when(F.col("op") == "clear", F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(mine)))).withColumn("_span", F.expr(f"floor(_s / {each})"))
    rows = dealt(rows, n, *part, "_span")

    good = F.when((F.col("op") == "update") & good_quantity(F.col("_q")), F.col("_s"))
    pair, all_ = Window.partitionBy(user, "_slice", "_span", "product_id"), Window.partitionBy(user, "_slice", "_span")
    # the wider windows first: what is dealt for them serves the others too
    rows = rows.withColumn("_c", F.max(F.when(F.col("op") == "clear", F.col("_s"))).over(all_)).withColumn("_r", F.max(F.when(F.col("op") == "remove", F.col("_s"))).over(pair))
    out_at = F.greatest("_r", "_c")  # null if there is neither
    rows = rows.withColumn("_in", out_at.isNull() | (F.col("_s") > out_at)).withColumn("_good", F.when(F.col("_in"), good))
    rows = rows.withColumn("_u", F.max("_good").over(pair))
    add = F.col("_in") & (F.col("op") == "add")
    folds = rows.groupBy(*part, "_span", "product_id").agg(
        F.max("_c").alias("_c"), F.max("_r").isNotNull().alias("_out"), F.min(F.when(add, F.col("_s"))).alias("_a"), F.max("_u").alias("_u"), F.max_by("_q", "_good").alias("_set"), F.count_if(add & (F.col("_u").isNull() | (F.col("_s") > F.col("_u")))).alias("_n")
    )

    pair = Window.partitionBy(*key)
    folds = dealt(folds, n, *part)
    folds = folds.withColumn("_cleared", F.max(F.when(F.col("_c").isNotNull(), F.col("_span"))).over(Window.partitionBy(*part))).withColumn("_from", F.max(F.when(F.col("_out"), F.col("_span"))).over(pair))
    folds = folds.withColumn("_in", (F.coalesce("_from", F.col("_span")) <= F.col("_span")) & (F.coalesce("_cleared", F.col("_span")) <= F.col("_span")))
    last = F.when(F.col("_in"), F.col("_u"))
    folds = folds.withColumn("_last", F.max(F.when(last.isNotNull(), F.col("_span"))).over(pair))
    found = folds.where("_in and product_id is not null").groupBy(*key).agg(
        F.min("_a").alias("_a"), F.max("_u").alias("_u"), F.max_by("_set", "_u").alias("_set"), F.sum(F.when(F.col("_last").isNull() | (F.col("_span") >= F.col("_last")), F.col("_n"))).alias("_n")
    )
    out = found.where("_a is not null").select(user, "product_id", (F.when(F.col("_u") > F.col("_a"), F.col("_set")).otherwise(0.0) + F.coalesce("_n", F.lit(0))).alias("quantity"), "_a")
    return dealt(out, n, user).withColumn("ord", F.row_number().over(Window.partitionBy(user).orderBy("_a")).cast("long") - 1).drop("_a")


def restored(items: DataFrame, user: str = "user", order: str = "ord") -> DataFrame:
    """(user, product_id, quantity, ord): saved baskets (user, ord, product_id, quantity) as they are taken up again.

    Of each product the first row counts that has an id, trimmed, and a finite quantity above 0; places
    are given anew. Rows that share a place go by quantity and product.
    """
    rows = items.select(user, F.col(order).alias("_o"), product_key(F.col("product_id")).alias("product_id"), F.col("quantity").cast("double").alias("quantity"))
    first = rows.where(F.col("product_id").isNotNull() & good_quantity(F.col("quantity"))).groupBy(user, "product_id").agg(F.min(F.struct("_o", "quantity")).alias("_f"))
    return first.select(user, "product_id", "_f.quantity", F.row_number().over(Window.partitionBy(user).orderBy("_f._o", "product_id")).cast("long").alias("ord")).withColumn("ord", F.col("ord") - 1)


def ranked_candidates(df: DataFrame, group: list[str], score: str, *ties: str, name: str = "rank", each: int = 1_000_000, span: int = 250_000) -> DataFrame:
    """Add each row's place in its group: the highest score first, then by ties.

    Groups of up to ``each`` rows are put in order whole. Larger ones are dealt by ranges of (group, score, ties) of about
    ``span`` rows or fewer, numbered within their ranges, and what lies in the ranges before is added: at most one such number for each range.
    Where ties don't tell rows apart, any of them may come first.
    """
    order = [F.desc(score), *map(F.col, ties)]
    large = df.groupBy(*group).agg(F.count("*").alias("_n")).where(f"_n > {each}").select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), "_n")
    whole = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    n = large.agg(F.sum("_n")).first()[0]
    if not n:
        return df.withColumn(name, whole)
    large = F.broadcast(large.drop("_n"))  # one row for each ``each`` rows at most; dealt by group, a group would be one task's
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)))
    small = df.join(large, same, "left_anti").withColumn(name, whole)
    # ranges stay as large as they are however many rows there are
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // span))
    dealt = kept(df.join(large, same, "left_semi").repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    before = dealt.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(*(f"_g{i}" for i in range(len(group)))).orderBy("_r")) - F.col("_n"))
    before = before.where("_before > 0").drop("_n")  # a range begins in one group: no more rows than ranges
    within = dealt.repartition(ranges, "_range").withColumn("_w", F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)))
    placed = within.join(F.broadcast(before), same & (F.col("_range") == F.col("_r")), "left").withColumn(name, (F.col("_w") + F.coalesce("_before", F.lit(0))).cast("int"))
    return small.unionByName(placed.select(*df.columns, name))


def appended(existing: DataFrame, new: DataFrame, order: str = POS) -> DataFrame:
    """new after existing, each in its own order: positions of new begin after the last existing one."""
    last = existing.agg(F.max(order)).first()[0]
    moved = new.withColumn(order, F.col(order) + F.lit(0 if last is None else last + 1))
    return existing.unionByName(moved, allowMissingColumns=True)
