"""Readers and writers: JSON lines, JSON, CSV, text and HTML files, run registries, answer files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.utils import AnalysisException

from millrace.operators.chunking import html_text

QUESTION = "qid string, domain string, split string, question string, options map<string,string>, answer_format string, type string, doc_ids array<string>"
CHUNK = "chunk_id string, doc_id string, domain string, page int, section string, clause_id string, text string, tables array<string>, numbers array<string>, dates array<string>, metadata map<string,string>"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines; a path that doesn't exist is an empty relation, blank lines are skipped."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_questions(spark: SparkSession, root: str, domains: list[str] | None = None) -> DataFrame:
    """All ``*_questions.json`` files below a folder; ``domains`` restricts by file name, so other files aren't read."""
    glob = "*_questions.json" if not domains else "{" + ",".join(f"{d}_questions.json" for d in domains) + "}"
    return spark.read.schema(QUESTION).option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(root)


def files_of(spark: SparkSession, root: str, glob: str = "*.{txt,html,htm,pdf,PDF}") -> DataFrame:
    """(path, name, stem, suffix, content) of the files below a folder; ``content`` is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, "\\.[^.]+$", "").alias("stem"), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).alias("suffix"), "content")


def _decode(content: bytes) -> str:
    for charset in ("utf-8-sig", "gb18030"):
        try:
            return content.decode(charset)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes in UTF-8 (with or without mark) or GB 18030; what is neither is read as UTF-8 without the rest."""
    return content.map(lambda b: None if b is None else _decode(bytes(b)))


def read_pages(spark: SparkSession, root: str, pdf_parser: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, stem, page, text): text and HTML files as one page without number; PDF pages by ``pdf_parser`` where one is given."""
    files = files_of(spark, root)
    flat = files.filter(F.col("suffix").isin("txt", "html", "htm")).withColumn("raw", decoded("content"))
    pages = flat.select("path", "stem", F.lit(None).cast("int").alias("page"), F.when(F.col("suffix") == "txt", F.col("raw")).otherwise(html_text(F.col("raw"))).alias("text"))
    if pdf_parser is None:
        return pages

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, s, i + 1, t) for p, s, c in zip(frame["path"], frame["stem"], frame["content"]) for i, t in enumerate(pdf_parser(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "stem", "page", "text"])

    return pages.unionByName(files.filter("suffix = 'pdf'").select("path", "stem", "content").mapInPandas(parse, "path string, stem string, page int, text string"))


def resolve_documents(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(domain, doc_id, path) by name: equal stem, else the shortest that begins with the id, else the shortest that contains it.

    Files are offered by every run of characters their stem could be asked by only where no equal stem exists; the file table is
    a directory listing, small against the documents.
    """
    exact = wanted.join(files.select("domain", F.col("stem").alias("doc_id"), "path"), ["domain", "doc_id"]).groupBy("domain", "doc_id").agg(F.min("path").alias("path"))
    rest = wanted.join(exact, ["domain", "doc_id"], "left_anti")
    near = rest.join(files, "domain").filter(F.contains(F.col("stem"), F.col("doc_id")))
    order = F.struct((~F.startswith(F.col("stem"), F.col("doc_id"))).alias("inside"), F.length("stem").alias("n"), F.col("path"))
    return exact.unionByName(near.groupBy("domain", "doc_id").agg(F.min_by("path", order).alias("path")))


def read_registry(spark: SparkSession, path: str, usable_only: bool = True) -> DataFrame:
    """Runs of a registry file; another schema version or a repeated name is an error when the result is read."""
    whole = spark.read.option("multiLine", True).schema("schema_version int, runs array<struct<name:string,status:string,usable_for_constraints:boolean,result_path:string,correct_count:int,total_tokens:long,official_score:double,sha256:string,answer_column:string,note:string>>").json(path)
    version = F.when(F.col("schema_version") == 1, F.col("runs")).otherwise(F.raise_error(F.lit("unknown registry version")).cast(whole.schema["runs"].dataType))
    names = F.transform("runs", lambda r: r["name"])
    unique = F.when(F.size(F.array_distinct(names)) == F.size(names), version).otherwise(F.raise_error(F.lit("a run name occurs twice")).cast(whole.schema["runs"].dataType))
    runs = whole.select(F.inline(unique))
    return runs.filter("status = 'verified' and usable_for_constraints") if usable_only else runs


def wide_answers(matrix: DataFrame) -> DataFrame:
    """(run, qid, answer) of a matrix with one column of answers per run."""
    return matrix.unpivot("qid", [c for c in matrix.columns if c != "qid"], "run", "answer").select("run", "qid", "answer")


def answer_rows(results: DataFrame) -> DataFrame:
    """Rows of an answer file: first a ``summary`` row with the token totals, then the answers in order of qid."""
    total = results.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
    head = total.select(F.lit(0).alias("o"), F.lit("summary").alias("qid"), F.lit("").alias("answer"), "*")
    body = results.select(F.lit(1).alias("o"), "qid", "answer", "prompt_tokens", "completion_tokens", "total_tokens")
    return head.unionByName(body).orderBy("o", "qid").drop("o")


def write_answers(results: DataFrame, path: str) -> None:
    """The answer file, UTF-8 with mark. It has one row per question, so one file."""
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        out.write("qid,answer,prompt_tokens,completion_tokens,total_tokens\n")
        for row in answer_rows(results).toLocalIterator():
            out.write(",".join(str(x) for x in row) + "\n")
