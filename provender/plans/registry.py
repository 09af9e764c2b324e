"""The registry of food businesses: profile and manufacturers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from provender.functions.evidence import number_status
from provender.functions.text import clean, filled
from provender.operators.ordered import group_rows, nested
from provender.sources.io import REGISTRY_COLUMNS, ContractError, manufacturer_rules, manufacturing, require_columns

NAME, NUMBER, ADDRESS, REGISTRATION, ITEM = REGISTRY_COLUMNS
BLANK = "（空白）"  # fixed value: how a blank item is called


def profile(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of counts over registry rows, and the rows by registration item (item, n).

    Businesses are told apart by their number, or by name and address without one.
    """
    require_columns(rows, REGISTRY_COLUMNS)
    flags = {c: F.col(c) if c in rows.columns else F.lit(False) for c in ("_malformed", "_empty")}
    rows = rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in REGISTRY_COLUMNS), *(v.alias(k) for k, v in flags.items()))
    kept, number = rows.where("not _empty"), clean(F.col(NUMBER))
    business = F.when(number != "", F.struct(number.alias("a"), F.lit("").alias("b"))).otherwise(F.struct(F.concat(F.lit("\x1f"), clean(F.col(NAME))).alias("a"), clean(F.col(ADDRESS)).alias("b")))
    counts = kept.agg(
        F.count("*").alias("records"), F.count_if(number != "").alias("with_number"), F.count_if(number == "").alias("without_number"), F.count_if((number != "") & (number_status(F.col(NUMBER)) == "invalid")).alias("malformed_number"),
        F.count_if("_malformed").alias("malformed_rows"), F.countDistinct(business).alias("businesses"), *(F.count_if(~filled(F.col(c))).alias(f"missing_{i}") for i, c in enumerate(REGISTRY_COLUMNS)),
    )
    counts = counts.join(F.broadcast(rows.agg(F.count_if("_empty").alias("empty_rows"))))  # one row each
    by_item = kept.groupBy(F.when(filled(F.col(ITEM)), clean(F.col(ITEM))).otherwise(BLANK).alias("item")).agg(F.count("*").alias("n")).orderBy("item")
    return counts, by_item


def manufacturers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manufacturing rows with their group (unified_number, unified_number_status, group_no, first_pos, place), and one row of counts."""
    flat = group_rows(rows.where(manufacturing(F.col(ITEM))), F.col(NUMBER))
    flat = flat.withColumnRenamed("key", "unified_number").withColumn("unified_number_status", number_status(F.col("unified_number")))
    first = F.col("place") == 1
    n = flat.agg(F.count("*").alias("manufacturing"), F.count_if(first).alias("groups"), *(F.count_if(first & (F.col("unified_number_status") == s)).alias(s) for s in ("valid", "invalid", "missing")))
    return flat, rows.agg(F.count("*").alias("scanned")).join(F.broadcast(n))  # one row each


COUNTERS = ["scanned", "manufacturing", "groups", "valid", "invalid", "missing"]


def write_manufacturers(rows: DataFrame, path: str, stats: DataFrame) -> dict[str, int]:
    """Write the manufacturing rows of a registry with their groups as Parquet; the six counters of what was written.

    Counters and broken rules are taken from the rows on their way into the files, and the scanned ones as they are
    read: nothing is scanned again. If a counter isn't what ``stats`` (as ``manufacturers`` gives it) says, or a row
    breaks a rule, the files are removed and it is an error.
    """
    read, made = Observation(), Observation()
    flat, _ = manufacturers(rows.observe(read, F.count(F.lit(1)).alias("scanned")))
    first, rules = F.col("place") == 1, manufacturer_rules()
    counted = [F.count(F.lit(1)).alias("manufacturing"), F.count_if(first).alias("groups"), *(F.count_if(first & (F.col("unified_number_status") == s)).alias(s) for s in COUNTERS[3:])]
    broken = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"broken {n}") for n, c in rules.items()]
    flat.observe(made, *counted, *broken).write.mode("overwrite").parquet(path)
    found = read.get | made.get
    said = stats.select(*COUNTERS).first().asDict()
    problems = {k: (found[k], said[k]) for k in COUNTERS if found[k] != said[k]} | {f"broken {n}": found[f"broken {n}"] for n in rules if found[f"broken {n}"]}
    if problems:
        at = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        raise ContractError(f"what was written isn't what the stats say: {problems}")
    stats.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_stats")
    return {k: found[k] for k in COUNTERS}


def manufacturer_records(flat: DataFrame) -> DataFrame:
    """(first_pos, unified_number, unified_number_status, records): a record for each group, as it is written to JSON."""
    own = [c for c in flat.columns if c not in ("unified_number", "unified_number_status", "group_no", "first_pos", "place")]
    groups = nested(flat.withColumnRenamed("unified_number", "key"), own)
    return groups.select("first_pos", F.col("key").alias("unified_number"), number_status(F.col("key")).alias("unified_number_status"), "records")
