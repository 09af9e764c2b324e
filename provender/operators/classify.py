"""Classes of records, issues of candidates, states of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions.nutrition import complete, complete_non_negative, valid_amount
from provender.functions.text import filled, raised

# Names of classes and issues.
CLASSES = ["complete_nutrition_and_ingredients", "complete_nutrition", "has_ingredients", "incomplete"]
ISSUES = ["missing_brand", "missing_barcode", "missing_serving", "ingredients_parse_error", "nutrition_structure_error"]


def class_of(nutrition_complete: Column, has_ingredients: Column) -> Column:
    return (
        F.when(nutrition_complete & has_ingredients, CLASSES[0])
        .when(nutrition_complete, CLASSES[1])
        .when(has_ingredients, CLASSES[2])
        .otherwise(CLASSES[3])
    )


def classified(records: DataFrame, nutrition: str = "nutrition", label: str = "contentLabel", anomalies: str = "anomalies") -> DataFrame:
    """Add ``classification`` and ``hasAnomaly``."""
    return records.withColumns({"classification": class_of(complete(F.col(nutrition)), filled(F.col(label))), "hasAnomaly": F.coalesce(F.size(anomalies) > 0, F.lit(False))})


def class_counts(df: DataFrame, column: str = "classification", classes: list[str] = CLASSES) -> DataFrame:
    """(column, n) for each class, those without rows too."""
    all_ = df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    return all_.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def issues_of(flags: list[Column], names: list[str] = ISSUES) -> Column:
    """The names whose flags are up, in order."""
    return raised(flags, names)


def candidate_issues() -> Column:
    """Issues of a candidate product by its columns."""
    return issues_of([~filled(F.col("brand")), ~filled(F.col("barcode")), ~valid_amount(F.col("serving")), F.col("ingredientsParseError").isNotNull(), ~complete_non_negative(F.col("nutrition"))])


def issue_category(issues: Column) -> Column:
    return F.when(F.size(issues) == 0, "ready").when(F.size(issues) == 1, F.get(issues, F.lit(0))).otherwise("multiple_issues")


def ingredients_parsed(ingredients: Column, error: Column) -> Column:
    return F.coalesce(error.isNull() & (F.size(ingredients) > 0) & F.forall(ingredients, lambda i: filled(i["name"])), F.lit(False))


def eligible() -> Column:
    """Whether a candidate could become a product: serving, all nutrients and ingredients."""
    return valid_amount(F.col("serving")) & complete_non_negative(F.col("nutrition")) & ingredients_parsed(F.col("ingredients"), F.col("ingredientsParseError"))


def search_state(text: Column, n: Column) -> Column:
    return F.when(~filled(text), "initial").when(n == 0, "not-found").when(n == 1, "success").otherwise("multiple")


def website_status(candidates: Column, error: Column) -> Column:
    return F.when(candidates > 0, "candidates_found").when(error.isNotNull(), "search_error").otherwise("not_found")
