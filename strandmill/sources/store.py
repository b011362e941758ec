"""Keyed results, events and published documents as files that Spark reads and appends."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions.text import money
from strandmill.operators.order import numbered


def put(results: DataFrame, path: str) -> None:
    """Append ``(stage, key, created_at, ..)`` rows; the newest of a key counts."""
    results.write.mode("append").partitionBy("stage").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    order = Window.partitionBy("stage", "key").orderBy(F.desc("created_at"))
    return spark.read.parquet(path).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def split_work(work: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work whose ``(stage, key)`` has a result, and the rest."""
    keys = known.select("stage", "key")
    return work.join(keys, ["stage", "key"], "left_semi"), work.join(keys, ["stage", "key"], "left_anti")


def batches(work: DataFrame, order: list[Column | str], size: int = 32) -> DataFrame:
    """Number units of ``size`` rows in a given order, which ends in a unique key, inside each stage."""
    placed = numbered(work, ["stage", *order], "_number")
    first = placed.groupBy("stage").agg(F.min("_number").alias("_first"))
    return placed.join(first, "stage").withColumn("unit", F.floor((F.col("_number") - F.col("_first")) / size)).drop("_number", "_first")


def bisected(units: DataFrame, order: list[Column | str]) -> DataFrame:
    """The same rows with each unit split in two, ``2 * unit`` and ``2 * unit + 1``, for a unit that keeps failing as a whole."""
    own = Window.partitionBy("stage", "unit")
    late = F.row_number().over(own.orderBy(*order)) > F.ceil(F.count("*").over(own) / 2)
    return units.withColumn("unit", F.col("unit") * 2 + late.cast("int"))


def log_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(path)


def failures(spark: SparkSession, path: str) -> DataFrame:
    """Recorded failures in order of time."""
    return spark.read.parquet(path).orderBy("created_at")


def schema_hash(schema: dict) -> str:
    """Digest of a JSON schema without its ``$schema`` line."""
    return hashlib.sha256(json.dumps({k: v for k, v in schema.items() if k != "$schema"}, sort_keys=True).encode()).hexdigest()


def to_struct(schema: dict) -> T.DataType:
    """Spark type of a JSON schema of objects, arrays and scalars."""
    kind = schema.get("type", "string")
    kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
    if kind == "object":
        needed = set(schema.get("required", []))
        return T.StructType([T.StructField(k, to_struct(v), k not in needed) for k, v in schema.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(to_struct(schema.get("items", {})))
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def file_set_hash(paths: list[str]) -> str:
    """Digest of a set of driver-side files by name and bytes."""
    digest = hashlib.sha256()
    for p in sorted(map(Path, paths), key=lambda p: p.name):
        digest.update(p.name.encode() + b"\x00" + p.read_bytes() + b"\x00")
    return digest.hexdigest()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file to any store Spark can write to, in place of what is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, payload: object) -> None:
    write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")


def read_json(spark: SparkSession, path: str) -> dict:
    """A published summary or index, back as it was written."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def start_run(spark: SparkSession, path: str, run: str, corpus_sha256: str) -> None:
    """Record that a run began; ``finish_run`` adds how it ended. Records are appended, so the newest of a run counts."""
    _run_record(spark, path, run, corpus_sha256, "started", "")


def finish_run(spark: SparkSession, path: str, run: str, corpus_sha256: str, status: str, notes: str = "") -> None:
    _run_record(spark, path, run, corpus_sha256, status, notes)


def _run_record(spark: SparkSession, path: str, run: str, corpus: str, status: str, notes: str) -> None:
    row = spark.createDataFrame([(run, corpus, status, notes)], "run string, corpus_sha256 string, status string, notes string")
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def record_failures(failed: DataFrame, path: str) -> None:
    """Append ``(stage, unit, kind, detail, attempt)`` with the time."""
    failed.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_documents(spark: SparkSession, documents: list[dict], folder: str) -> list[dict]:
    """Write drafted documents as Markdown with front matter, and an index of them; whatever lay in the folder goes first.

    ``documents`` has ``finding, title, shape, body, evidence`` and ``judgment`` (taken in spite of the floor). There are as
    many as ``max_artifacts`` allows, so the driver writes them.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    index, numbers = [], {}
    for d in sorted(documents, key=lambda d: d["finding"]):
        kind = d["shape"][:3].upper()
        numbers[kind] = numbers.get(kind, 0) + 1
        ident = f"{kind}-{numbers[kind]:02d}"
        name = f"{ident}-{re.sub('[^a-z0-9]+', '-', d['title'].lower()).strip('-')[:50]}.md"
        front = {
            "id": ident, "title": d["title"], "shape": d["shape"], "finding": d["finding"], "review": "draft, not reviewed", "evidence": sorted(d["evidence"]), "judgment": bool(d["judgment"]),
        }
        # JSON values are YAML values too
        head = "\n".join(f"{k}: {json.dumps(v)}" for k, v in front.items())
        write_text(spark, f"{folder}/{name}", f"---\n{head}\n---\n\n{d['body'].strip()}\n")
        index.append(front | {"name": name})
    write_json(spark, f"{folder}/index.json", index)
    return index


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, finding, body)`` of the documents that the index lists; the body is null where the file is gone."""
    index = read_json(spark, f"{folder}/index.json")
    listed = spark.createDataFrame([(d["name"], d["finding"]) for d in index], "name string, finding string")
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("value").alias("body"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))
    return listed.join(found, "name", "left").select("name", "finding", "body")


def report_lines(findings: DataFrame) -> DataFrame:
    """Markdown lines of a report in rank order: a heading a finding, its figures, its reason and its quotes."""
    of = lambda band: F.get(F.filter("derivations", lambda d: d["band"] == band), F.lit(0))["result"]["dollars_per_month"]
    head = F.format_string("## %d. %s", "place", "title")
    figures = F.format_string("%s, %s confidence: %s a month (%s to %s), %d messages in %d instances over %d months, %d people", "status", "confidence", money(of("base")), money(of("low")), money(of("high")), "messages", "instances", "months", "people")
    why = F.when(F.col("status_reason") != "", F.concat(F.lit("Not counted: "), F.col("status_reason")))
    quotes = F.transform("citations_list", lambda c: F.concat(F.lit("> "), F.translate(c["quote"], "\r\n", " "), F.lit("\n> ["), c["citation_id"], F.lit("] "), c["source_path"], F.lit(", lines "), c["line_start"].cast("string"), F.lit(" to "), c["line_end"].cast("string")))
    return findings.select("place", F.concat_ws("\n\n", head, figures, why, F.array_join(quotes, "\n\n")).alias("line")).orderBy("place")
