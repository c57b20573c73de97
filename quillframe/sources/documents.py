"""Element documents, label files, manifests and reports as JSON, a file or a line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.text import LABELS
from quillframe.operators.validation import document_problems, messages

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,tex:string>"
ELEMENT = f"struct<kind:string,bbox:array<double>,text:string,runs:array<{RUN}>,font_size:double,bold:boolean,confidence:double,cells:array<array<string>>,aligns:array<string>,col_rules:array<boolean>,row_rules:array<boolean>,col_widths:array<double>,label:string,level:int,tex:string,label_source:string>"
DOCUMENT = f"source string, extractor string, structurer string, params map<string,string>, ir_version int, pages array<struct<page:int,width:double,height:double,unit:string,elements:array<{ELEMENT}>>>"
LABEL_FILE = "pdf string, blocks array<struct<page:int,bbox:array<double>,label:string,text:string,source:string>>"
MANIFEST = "cases array<struct<id:string,tags:map<string,string>>>"
REPORT = "run_id string, created string, model struct<id:string,name:string>, dataset string, summary map<string,double>, errors int"
#: Versions that are read as the present one.
VERSION, OLDER = 4, (1, 2, 3)


def save_json(df: DataFrame, folder: str) -> None:
    """A row a line; what is null has no key."""
    df.write.mode("overwrite").json(folder)


def load(spark: SparkSession, path: str, schema: str, files: bool = False) -> DataFrame:
    """Rows of JSON files: one a line, or one a file. What is no JSON or lacks all of the schema is left out."""
    rows = spark.read.schema(schema).option("multiLine", files).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    return rows.where(F.coalesce(*(F.col(c).isNotNull() for c in rows.columns)) & F.exists(F.array(*(F.col(c).isNotNull() for c in rows.columns)), lambda x: x))


def load_documents(spark: SparkSession, path: str, check: bool = False, files: bool = False) -> DataFrame:
    """Documents, older versions as the present one; with check, a document with problems is an error that names them."""
    d = load(spark, path, DOCUMENT, files).withColumn("ir_version", F.when(F.col("ir_version").isin(*OLDER), VERSION).otherwise(F.col("ir_version")))
    if check:
        problems = document_problems(F.col("ir_version"), F.col("pages"))
        text = F.concat(F.lit("problems in "), F.coalesce("source", F.lit("?")), F.lit(": "), F.array_join(problems, "; "))
        d = d.withColumn("pages", F.when(F.size(problems) == 0, F.col("pages")).otherwise(F.raise_error(text).cast(d.schema["pages"].dataType)))
    return d


def elements(documents: DataFrame) -> DataFrame:
    """(source, page, ord, element fields, x0 ... y1): an element a row, in page order."""
    p = documents.select("source", F.explode("pages").alias("p"))
    e = p.select("source", F.col("p.page").alias("page"), F.posexplode("p.elements").alias("ord", "e")).select("source", "page", "ord", "e.*")
    return e.select("*", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1")))).drop("bbox")


def label_problems(block: Column) -> Column:
    """Of a block of a label file: unknown labels and sources, boxes of another number than four, or empty or turned ones."""
    box = block["bbox"]
    at = lambda i: F.get(box, F.lit(i))
    return messages({"label is unknown": ~F.coalesce(block["label"].isin(*LABELS), F.lit(False)), "source is unknown": ~F.coalesce(block["source"].isin("auto", "manual", "prelabel"), F.lit(False)), "box has not four numbers": F.size(box) != 4, "box is turned left to right": (F.size(box) == 4) & (at(0) >= at(2)), "box is turned top to bottom": (F.size(box) == 4) & (at(1) >= at(3))})


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, case_id, tags) of the manifest.json files in folder's subfolders; a subfolder without one has no cases."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(folder)
    m = m.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dataset"), F.explode("cases").alias("c"))
    return m.select("dataset", F.col("c.id").alias("case_id"), "c.tags")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The report.json files of folder's subfolders that can be read, no errors counted as 0; newest first by run_id is the reader's orderBy."""
    r = spark.read.schema(REPORT).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").json(folder)
    return r.where("run_id is not null and model.id is not null").withColumn("errors", F.coalesce("errors", F.lit(0)))
