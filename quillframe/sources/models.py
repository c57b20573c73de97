"""A registry of models: which function of which module makes documents, and of what; pages it made one by one become documents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPEC = "id string, name string, entry string, input string, outputs array<string>, params map<string,string>, note string"


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """The registry's rows, one for each id; missing parameters and notes are empty. An id twice, or a row without an entry "module:function", is an error."""
    rows = spark.read.schema(SPEC).option("multiLine", True).json(path)
    n = F.count("*").over(Window.partitionBy("id"))
    wrong = F.when(n > 1, F.concat(F.lit("model twice: "), F.coalesce("id", F.lit("?")))).when(~F.coalesce(F.col("entry").rlike(r"^[\w.]+:\w+\z"), F.lit(False)), F.concat(F.lit("no entry: "), F.coalesce("id", F.lit("?"))))
    checked = rows.withColumn("id", F.when(wrong.isNull(), F.col("id")).otherwise(F.raise_error(wrong).cast("string")))
    return checked.withColumn("params", F.coalesce("params", F.create_map().cast("map<string,string>"))).withColumn("note", F.coalesce("note", F.lit("")))


def load_entry(entry: str) -> Callable:
    """The function that "module:function" names."""
    module, name = entry.split(":")
    return getattr(importlib.import_module(module), name)


def predict(inputs: DataFrame, entry: str, params: dict | None = None) -> DataFrame:
    """What a registered function of a DataFrame makes of inputs."""
    return load_entry(entry)(inputs, **(params or {}))


def merge_pages(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Documents (by, order, fields, pages) of a page or some each -> one for each by: pages in order, numbered anew from 1; other fields are those of its first part."""
    fields = [c for c in parts.columns if c not in (*by, order, "pages")]
    rows = parts.select(*by, F.struct(order, F.struct(*fields, F.lit(0).alias("_")).alias("rest"), F.coalesce("pages", F.array().cast(parts.schema["pages"].dataType)).alias("pages")).alias("x"))
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)).alias("xs"))
    every = F.flatten(F.transform("xs", lambda x: x["pages"]))
    numbered = F.transform(every, lambda p, i: p.withField("page", (i + 1).cast("int")))
    first = F.get("xs", F.lit(0))["rest"]
    return g.select(*by, *(first[c].alias(c) for c in fields), numbered.alias("pages"))
