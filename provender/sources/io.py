"""Reading and writing: JSON envelopes, arrays, registry CSV, products, record files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provender.functions.text import clean, filled

from .shared import spread

# Columns that sources must have.
REGISTRY_COLUMNS = ["公司或商業登記名稱", "公司統一編號", "業者地址", "食品業者登錄字號", "登錄項目"]
TRACE_FIELDS = {"companyName": "公司名稱", "productName": "產品名稱", "packageSpecification": "包裝規格", "traceabilityCode": "產品追溯系統串接碼", "serving": "每一份量", "contentLabel": "內容物標示"}
TRACE_NUTRIENTS = {"calories": "每份熱量", "protein": "每份蛋白質", "fat": "每份脂肪", "saturatedFat": "每份飽和脂肪", "transFat": "每份反式脂肪", "carbohydrates": "每份碳水化合物", "sugar": "每份糖", "sodium": "每份鈉"}


class ContractError(ValueError):
    """An input or output isn't what it has to be."""


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Files as one VARIANT each, which holds some 128 MB; a file that can't be read so is an error with its size."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json(F.regexp_replace("value", r"\A\x{FEFF}", "")).alias("v"), F.col("_metadata.file_size").alias("size"))
    problem = F.raise_error(F.concat(F.lit("not JSON, or too large to be read as one value: "), F.col("size").cast("string"), F.lit(" bytes"))).cast("variant")
    return text.select(F.coalesce("v", problem).alias("v"))


def read_array(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """(_pos, record VARIANT) of a file that is one JSON array of objects; a byte order mark is allowed.

    With the names of the ``fields`` that are wanted, elements are read one after the other whatever the
    size of the file, and a field that is null counts as absent. Without, the file is read as one value,
    which is an error beyond some 128 MB.
    """
    if fields is None:
        return _records(_whole(spark, path).select(F.try_variant_get("v", "$", "array<variant>").alias("r")), "$")
    schema = T.StructType([T.StructField(f, T.VariantType()) for f in fields])
    rows = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    # a file is read by one task in its order; positions go on from file to file, in order of their paths
    files = rows.groupBy("_file").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    files = files.select("_file", "_first", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    rows = spread(rows.join(files, "_file"))
    return rows.select((F.col("_before") + F.col("_id") - F.col("_first")).alias("_pos"), F.to_variant_object(F.map_filter(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f"`{f}`")))), lambda _, v: v.isNotNull())).alias("record"))


def read_envelope(spark: SparkSession, path: str, array_key: str = "records") -> tuple[DataFrame, DataFrame]:
    """The envelope's other fields (one row, VARIANT ``meta``) and its records (_pos, record VARIANT).

    Each record is a value of its own, so only records are bounded in size; ``meta`` reads the file as one value.
    """
    meta = _whole(spark, path).select(F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: k != array_key).alias("meta"))
    schema = T.StructType([T.StructField(array_key, T.ArrayType(T.VariantType()))])
    return meta, _records(spark.read.json(path, schema=schema, multiLine=True).select(F.col(f"`{array_key}`").alias("r")), f"$.{array_key}")


def _records(whole: DataFrame, path: str) -> DataFrame:
    good = F.coalesce(F.forall("r", lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(False))
    checked = F.when(good, F.col("r")).otherwise(F.raise_error(F.lit(f"not an array of objects at {path}")).cast("array<variant>"))
    return spread(whole.select(F.posexplode(checked).alias("_pos", "record")).withColumn("_pos", F.col("_pos").cast("long")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_pos, record VARIANT, bad) of JSON lines that carry their position in ``_pos``; bad is the text of a line that isn't JSON."""
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", F.try_parse_json("value").alias("record"))
    return rows.select(F.try_variant_get("record", "$._pos", "long").alias("_pos"), "record", F.when(F.col("record").isNull(), F.col("value")).alias("bad"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return read_envelope(spark, path, "products")[1]


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines of a file are that, else MS950, the other encoding in which registries come."""
    odd = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "MS950" if odd else "UTF-8"


def read_registry(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A registry CSV as text columns, ``_malformed`` for rows with cells beyond the header, and ``_empty`` for blank ones.

    Missing cells are empty texts. Without an encoding the file is looked through for lines that aren't
    UTF-8, with a byte order mark or without. MS950 needs spark.sql.legacy.javaCharsets to be true in the session, also
    when the rows are used; settings are the caller's, so it is an error if it isn't.
    """
    encoding = encoding or encoding_of(spark, path)
    if encoding == "MS950" and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ContractError("this file is in MS950: set spark.sql.legacy.javaCharsets to true to read it")
    header = spark.read.csv(path, encoding=encoding, multiLine=True).first()
    names = [(c or "").lstrip("﻿").strip() for c in header]
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_bad", T.StringType())])
    rows = spark.read.csv(path, schema=schema, header=True, encoding=encoding, multiLine=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", ignoreLeadingWhiteSpace=False)
    # too few cells are corrupt to Spark too; only too many are malformed here
    filled_in = rows.select(*(F.coalesce(n, F.lit("")).alias(n) for n in names), (F.col("_bad").isNotNull() & F.col(names[-1]).isNotNull()).alias("_malformed"))
    return filled_in.withColumn("_empty", reduce(lambda a, b: a & b, (~filled(F.col(n)) for n in names)))


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    if missing := [c for c in needed if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_fields(records: DataFrame, needed: list[str] = [*TRACE_FIELDS.values(), *TRACE_NUTRIENTS.values()]) -> DataFrame:
    """The first record has to have all fields; later ones may lack some."""
    first = records.orderBy("_pos").select(F.map_keys(F.try_variant_get("record", "$", "map<string,variant>")).alias("k")).first()
    if first is None or (missing := [f for f in needed if f not in first["k"]]):
        raise ContractError(f"missing fields: {', '.join(missing) if first else 'no records'}")
    return records


def catalog_targets(brands: DataFrame, limit: int | None = None) -> DataFrame:
    """(_pos, product_name, brand, catalog_source): products of brands (_pos, name, url, products) in order, the first ``limit``."""
    flat = brands.select("_pos", F.col("name").alias("brand"), F.col("url").alias("catalog_source"), F.posexplode("products").alias("_at", "p"))
    flat = flat.select("_pos", "_at", F.col("p.name").alias("product_name"), "brand", "catalog_source").orderBy("_pos", "_at")
    return (flat if limit is None else flat.limit(limit)).drop("_at")


def first_rows(df: DataFrame, n: int | None, order: str = "_pos") -> DataFrame:
    return df if n is None else df.orderBy(order).limit(n)


def write_records(df: DataFrame, path: str, kind: str = "json", stats: DataFrame | None = None) -> None:
    """Compressed JSON lines or Parquet, and its stats beside it under path + "_stats"; Spark's commit makes a folder whole or not there."""
    writer = df.write.mode("overwrite")
    writer.json(path, compression="gzip") if kind == "json" else writer.parquet(path)
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_stats")


def reconcile(df: DataFrame, **violations: Column) -> DataFrame:
    """df, if no row breaks a rule; rules are named columns that are true where broken."""
    found = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in violations.items())).first().asDict()
    if bad := {n: k for n, k in found.items() if k}:
        raise ContractError(f"rows break rules: {bad}")
    return df


def manufacturer_rules() -> dict[str, Column]:
    """What manufacturing rows with their groups have to keep to: see reconcile."""
    from provender.functions.evidence import number_status

    return {
        "status": F.col("unified_number_status") != number_status(F.col("unified_number")),
        "missing": (F.col("unified_number_status") == "missing") & (F.col("unified_number").isNotNull() | (F.col("place") > 1)),
        "item": ~manufacturing(F.col("登錄項目")),
    }


def manufacturing(item: Column) -> Column:
    # The registration item of manufacturers, with either slash.
    return F.coalesce(clean(item).isin("工廠/製造場所", "工廠／製造場所"), F.lit(False))
