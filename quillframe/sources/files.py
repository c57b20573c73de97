"""Files that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; under a temporary one if that is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quillframe-')}"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_csv(df: DataFrame, folder: str) -> None:
    """Rows as CSV with a header; the committer puts all of the folder in place or none. Cells keep their white space, quotes and lines."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def load_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(folder)


def load_labels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(file, latex) of lines "file, tab, latex"; further tabs are the formula's. A line without a tab is an error, an empty file has no rows."""
    parts = F.split("value", "\t", 2)
    fine = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("no tab in line: "), F.col("value"))).cast("array<string>"))
    return spark.read.text(path).select(fine.alias("p")).select(F.col("p")[0].alias("file"), F.col("p")[1].alias("latex"))


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, category, stem, suffix) of the files of folder's subfolders that fit a glob pattern; contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", F.element_at(F.split("path", "/"), -2).alias("category"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"))


def sample_pairs(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg"), categories: list[str] | None = None) -> DataFrame:
    """(category, stem, image, truth): each truth .txt with the image of the same name, of several the one whose suffix comes first."""
    truth = listing(spark, folder, "*.txt").select("category", "stem", F.col("path").alias("truth"))
    if categories:
        truth = truth.where(F.col("category").isin(categories))
    order = F.array_position(F.array(*(F.lit(s) for s in suffixes)), F.col("suffix"))
    images = listing(spark, folder, "*").where(F.col("suffix").isin(*suffixes)).groupBy("category", "stem").agg(F.min_by("path", order).alias("image"))
    return truth.join(images, ["category", "stem"]).select("category", "stem", "image", "truth")


VERBATIM = r"(?s)\\begin\{(Verbatim|verbatim|lstlisting|minted)\}.*?\\end\{\1\}"


def tex_formulas(sources: DataFrame) -> DataFrame:
    """(source, ord, display, latex) of TeX sources (source, text): without verbatim parts and comments, from the document's beginning; displayed formulas first, then those in lines, blank ones left out."""
    clean = F.regexp_replace(F.regexp_replace("text", VERBATIM, ""), r"(?<!\\)%.*", "")
    start = F.instr(clean, r"\begin{document}")
    body = F.when(start > 0, F.substring(clean, start, F.length(clean))).otherwise(clean)
    found = lambda pattern: F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
    display = F.concat(found(r"(?s)\\\[(.+?)\\\]"), found(r"(?s)\\begin\{(?:equation|align|gather|eqnarray)\*?\}(.+?)\\end\{"))
    inline = F.concat(found(r"(?<![\\$])\$([^$]+?)\$"), found(r"\\\((.+?)\\\)"))
    marked = lambda xs, shown: F.transform(xs, lambda x: F.struct(F.lit(shown).alias("display"), F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "").alias("latex")))
    every = F.filter(F.concat(marked(display, True), marked(inline, False)), lambda x: x["latex"] != "")
    d = sources.select("source", body.alias("body"))
    return d.select("source", F.posexplode(every).alias("ord", "x")).select("source", "ord", "x.display", "x.latex")
