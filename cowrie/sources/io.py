"""Readers and writers of the pipeline's formats. Schemas are always given, never inferred."""

from __future__ import annotations

import html.parser
import json
import os
import time
import traceback
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cowrie.functions.text import blank_to_null
from cowrie.operators.records import MissingInputError, keep_last
from cowrie.operators.segment import running_ids

RAW_DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("source_name", "url", "retrieval_date", "licence", "licence_url", "sha256", "raw_text")])
SKIPPED = ("script", "style", "nav", "footer", "header")


class SchemaError(ValueError):
    """A line that is no record of the schema; names the file and the text."""


def need(spark: SparkSession, path: str, stage: str, hint: str = "") -> str:
    """path if it exists, else an error that says which stage writes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise MissingInputError(path, stage, hint)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Records of JSON lines; blank lines are skipped. strict: an unreadable line raises SchemaError when found here;
    otherwise its text is in `_corrupt_record`."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    if not strict:
        return df
    # from the text itself, as Spark doesn't let the corrupt column be asked for alone
    bad = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where("trim(value) <> ''").where(F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()).limit(1).collect()
    if bad:
        raise SchemaError(f"{bad[0]['file']}: {bad[0]['value'][:200]}")
    return df.drop("_corrupt_record")


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines in UTF-8, null fields written; gives the number of rows, counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("ignoreNullFields", "false").json(path)
    return int(seen.get["rows"])


def write_documents(df: DataFrame, path: str) -> None:
    """Raw documents as JSON, one folder per source."""
    df.withColumn("_source", F.col("source_name")).write.partitionBy("_source").option("ignoreNullFields", "false").json(path)


def scan_documents(spark: SparkSession, path: str, schema: T.StructType = RAW_DOCUMENT) -> DataFrame:
    """Documents of one JSON file each below path, with `file`, `slug` (the file's stem) and `number` in the order of their
    paths, on which the ids of later stages depend."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    named = df.withColumn("slug", F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.[^.]+$", ""))
    return running_ids(named, ["file"], "%d").withColumn("number", F.col("id").cast("long")).drop("id")


def read_config(path: str) -> dict:
    """A configuration from JSON, or from YAML where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        if not path.endswith((".yaml", ".yml")):
            return json.load(f)
        try:
            import yaml
        except ModuleNotFoundError:
            raise RuntimeError(f"{path} needs a YAML reader, which is not installed; write it as JSON") from None
        return yaml.safe_load(f)


def setting(config: dict, name: str):
    """A value by its dotted name; a missing one is an error that says which part is missing."""
    out = config
    for part in name.split("."):
        if not isinstance(out, dict) or part not in out:
            raise KeyError(f"configuration lacks {part!r} of {name!r}")
        out = out[part]
    return out


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer) of cached answers; empty if there is no such file. Of repeated questions one answer holds."""
    kinds = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
    try:
        need(spark, path, "")
    except MissingInputError:
        return spark.createDataFrame([], kinds)
    return read_jsonl(spark, path, kinds).where("question is not null and answer is not null").groupBy(F.trim("question").alias("question")).agg(F.min("answer").alias("answer"))


def write_blinding(items: DataFrame, key: DataFrame, items_path: str, key_path: str) -> None:
    """Blinded items and their secret key, apart: items that still name a system, or a key below the items, are an error."""
    if "system_id" in items.columns or key_path.rstrip("/").startswith(items_path.rstrip("/") + "/") or key_path == items_path:
        raise ValueError("the key must lie apart from the items, which must not name systems")
    items.write.json(items_path)
    key.write.json(key_path)


def write_generations(df: DataFrame, path: str) -> None:
    """Generations as JSON lines, one folder per system."""
    df.write.partitionBy("system_id").option("ignoreNullFields", "false").json(path)


def read_generations(spark: SparkSession, path: str, schema: T.StructType, systems: list[str] | None = None) -> DataFrame:
    """Generations of all systems, or those named, whose folders alone are read; a named one without any is an error."""
    df = spark.read.schema(T.StructType([*[f for f in schema.fields if f.name != "system_id"], T.StructField("system_id", T.StringType())])).json(path)
    if systems is None:
        return df
    for s in systems:
        need(spark, f"{path}/system_id={s}", "evaluation", f"system {s} has no generations")
    return df.where(F.col("system_id").isin(*systems))


def read_sheet(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """A CSV sheet with a header, with or without a byte-order mark: rows whose key is filled, nulls as empty text. A
    header that lacks a column is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if lacking := [c for c in columns if c not in raw.columns]:
        raise SchemaError(f"{path} lacks {lacking}")
    return raw.select(*columns).where(blank_to_null(F.col(key)).isNotNull()).na.fill("")


def write_sheet(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with the columns in order; for sheets that people read."""
    df.select(*columns).coalesce(1).write.option("header", True).option("escape", '"').csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): trimmed lines of text files that are not blank."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")


def read_whole_texts(spark: SparkSession, path: str, source: str, licence: str) -> DataFrame:
    """Raw documents from text files, one per file."""
    df = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("raw_text"), F.col("_metadata.file_path").alias("url"))
    return raw_documents(df, F.lit(source), F.lit(licence))


def raw_documents(df: DataFrame, source: Column, licence: Column) -> DataFrame:
    """df (raw_text, url) as raw documents with date and hash; rows without a licence are an error."""
    out = df.select(source.alias("source_name"), "url", F.date_format(F.current_date(), "yyyy-MM-dd").alias("retrieval_date"), licence.alias("licence"), F.lit(None).cast("string").alias("licence_url"), F.sha2("raw_text", 256).alias("sha256"), "raw_text")
    if not out.where(blank_to_null(F.col("licence")).isNull()).isEmpty():
        raise PermissionError("a source without a licence is refused")
    return out


READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(kind: str) -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[kind] = f
        return f

    return register


@reader("manual")
def _manual(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return read_whole_texts(spark, path, options["source"], options["licence"])


@reader("dataset")
def _dataset(spark: SparkSession, path: str, **options: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return raw_documents(rows.select(F.to_json(F.struct(*rows.columns)).alias("raw_text"), F.lit(path).alias("url")), F.lit(options["source"]), F.lit(options["licence"]))


@reader("web")
def _web(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path: a table (url, html) of fetched pages; fetching itself is left to the caller."""
    pages = spark.read.parquet(path).select("url", page_text(F.col("html")).alias("raw_text")).where("trim(raw_text) <> ''")
    return raw_documents(pages, F.lit(options["source"]), F.lit(options["licence"]))


def read_sources(spark: SparkSession, sources: list[dict[str, str]]) -> tuple[DataFrame, list[str]]:
    """All sources of known kinds as one table, and the names of those refused (unknown kind or no licence)."""
    out, refused = spark.createDataFrame([], RAW_DOCUMENT), []
    for s in sources:
        if s.get("kind") in READERS and s.get("licence"):
            out = out.unionByName(READERS[s["kind"]](spark, s["path"], source=s["source"], licence=s["licence"]))
        else:
            refused.append(s.get("source", "?"))
    return out, refused


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.inside += tag in SKIPPED

    def handle_endtag(self, tag: str) -> None:
        self.inside -= tag in SKIPPED and self.inside > 0

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.parts.append(data)


def html_to_text(page: str | None) -> str | None:
    """Text of a page, one line per text node, stripped, without blank lines and page furniture."""
    if page is None:
        return None
    p = _Text()
    p.feed(page)
    p.close()
    return "\n".join(t for part in p.parts for line in part.splitlines() if (t := line.strip()))


@F.pandas_udf(T.StringType())
def _page_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_to_text, na_action="ignore")


def page_text(page: Column) -> Column:
    return _page_text(page)


def page_url(base: Column, slug: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(slug, "^/+", ""))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(text_hash, result) kept so far; empty if there is no table yet. Of repeated hashes the last written holds."""
    try:
        need(spark, path, "")
    except MissingInputError:
        return spark.createDataFrame([], "text_hash string, result string")
    return keep_last(spark.read.parquet(path), ["text_hash"], ["added"]).select("text_hash", "result")


def append_cache(df: DataFrame, path: str) -> None:
    df.select("text_hash", "result").withColumn("added", F.current_timestamp()).write.mode("append").parquet(path)


def write_splits(df: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines, one folder per value."""
    df.write.partitionBy(by).option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str, name: str) -> str:
    """A small result as CSV and as a Markdown table; gives the Markdown."""
    pdf = df.toPandas()
    os.makedirs(path, exist_ok=True)
    pdf.to_csv(os.path.join(path, name + ".csv"), index=False)
    rows = [list(pdf.columns), ["---"] * len(pdf.columns), *pdf.astype(str).to_numpy().tolist()]
    text = "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"
    with open(os.path.join(path, name + ".md"), "w", encoding="utf-8") as f:
        f.write(text)
    return text


class RunManifest:
    """Records a stage's run as one JSON file, whether it ends well or not; errors pass through."""

    def __init__(self, path: str, stage: str, config: dict | None = None, seed: int = 42) -> None:
        self.path, self.record = path, {"run": uuid.uuid4().hex, "stage": stage, "seed": seed, "config": config or {}, "outputs": {}}

    def __enter__(self) -> "RunManifest":
        self.began = time.time()
        return self

    def output(self, name: str, where: str, rows: int | None = None) -> None:
        self.record["outputs"][name] = {"path": where, "rows": rows}

    def __exit__(self, kind, error, trace) -> bool:
        self.record |= {"status": "failed" if kind else "ok", "seconds": round(time.time() - self.began, 3), "ended": time.strftime("%Y%m%dT%H%M%SZ", time.gmtime()), "error": "".join(traceback.format_exception_only(kind, error)).strip() if kind else None}
        os.makedirs(self.path, exist_ok=True)
        with open(os.path.join(self.path, f"{self.record['stage']}-{self.record['run']}.json"), "w", encoding="utf-8") as f:
            json.dump(self.record, f, ensure_ascii=False, indent=1)
        return False
