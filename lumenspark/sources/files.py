"""Scans and sinks: JSON arrays and lines, CSV label sheets, manifests, run logs, vectors and reports."""

from __future__ import annotations

import ctypes
import datetime
import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.functions.text import strip

TABLE = T.ArrayType(T.ArrayType(T.StringType()))
PROGRAM_RECORD = (
    "id string, filename string, pre_text array<string>, post_text array<string>, table array<array<string>>, qa struct<question:string,answer:string,program:string,program_re:string,exe_ans:string,gold_inds:map<string,string>>"
)
SPAN_RECORD = (
    "table struct<uid:string,table:array<array<string>>>, paragraphs array<struct<order:int,text:string>>, "
    "questions array<struct<uid:string,order:int,question:string,answer:string,answer_type:string,answer_from:string,derivation:string,scale:string>>"
)
# The headers of a label sheet.
SHEET = ["pair_id", "is_duplicate (1/0)", "a_question", "b_question", "a_answer", "b_answer", "a_evidence", "b_evidence", "a_report", "b_report"]


def read_arrays(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str, standardize) -> DataFrame:
    """JSON-array files by split, each through `standardize(raw, split)`, united in the order given."""
    parts = [standardize(spark.read.schema(schema).option("multiLine", True).json(p), split) for split, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by an explicit ordinal; all without n."""
    return df if n is None else df.orderBy(order).limit(n)


#: Files of more bytes are hashed piece by piece; these endings are read decompressed, so such files stay whole.
LARGE = 1 << 27
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate|passthrough)$"
_BOM = b"\xef\xbb\xbf"


class _Sha256:
    """SHA-256 whose state another task can take up, which hashlib's objects don't allow: the functions of its OpenSSL."""

    SIZE = 112  # fixed value: OpenSSL's SHA256_CTX

    def __init__(self, state: bytes | None = None):
        self.state = ctypes.create_string_buffer(state or b"", self.SIZE)
        if state is None:
            self.lib().SHA256_Init(self.state)

    @staticmethod
    def lib() -> ctypes.CDLL:
        import _hashlib

        return ctypes.CDLL(_hashlib.__file__)

    def update(self, data: bytes) -> None:
        self.lib().SHA256_Update(self.state, data, ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib().SHA256_Final(out, self.state)
        return out.raw.hex()


def _resumable() -> bool:
    try:
        return bool(_Sha256.lib().SHA256_Init)
    except (ImportError, OSError, AttributeError):
        return False


def _chained_sha256(spark: SparkSession, path: str, size: int, begin: bytes = b"") -> str:
    """The SHA-256 of a file of any size: one task after the other reads a split, and takes up the state of the one before.

    The text source splits files and keeps the bytes of a line as they are, so lines joined by line feeds are the file, but
    for a byte-order mark and a line feed at its end, which its size tells. The splits' order and the size are checked.
    """
    lines = spark.read.option("lineSep", "\n").text(_literal(path)).select(F.col("value").cast("binary"), "_metadata.file_block_start")
    parts = lines.rdd.getNumPartitions()
    sha = _Sha256()
    sha.update(begin)
    state, total, at = sha.state.raw, -1, -1

    def piece(number: int) -> tuple[bytes, int, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen, last = _Sha256(state), total, at
            for b in batches:
                if b.num_rows:
                    starts = b.column(1).to_pylist()
                    if starts != sorted(starts) or starts[0] < last or (last == starts[0] >= 0 and last == at):
                        raise ValueError(f"splits of {path} came out of order")
                    data = b"\n".join(b.column(0).to_pylist())
                    own.update(data if seen < 0 else b"\n" + data)
                    seen, last = seen + len(data) + 1, starts[-1]
            yield pa.RecordBatch.from_arrays([pa.array([own.state.raw]), pa.array([seen]), pa.array([last])], names=["state", "total", "at"])

        return tuple(spark.sparkContext.runJob(lines.mapInArrow(run, "state binary, total long, at long").rdd, list, [number])[0])

    for number in range(parts):
        state, total, at = piece(number)
    left = size - len(begin) - total
    if left in (len(_BOM), len(_BOM) + 1) and not begin:
        return _chained_sha256(spark, path, size, _BOM)
    if left not in (0, 1):
        raise ValueError(f"{path} has {size} bytes, {total + len(begin)} were read")
    sha = _Sha256(bytes(state))
    sha.update(b"\n" * left)
    return sha.hexdigest()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file; contents are hashed where they are read.

    A SHA-256 is one chain over a file's bytes. Files of up to LARGE bytes are read whole; of larger ones, eight side by
    side, each task reads a split and hands the state of the chain, 112 bytes, on to the next.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = [tuple(r) for r in files.select("path", "length").filter(F.col("length") > LARGE).collect()]  # contents aren't read
    told = _hashed_whole(files.filter(F.col("length") <= LARGE))
    chained = [x for x in large if not re.search(PACKED, x[0])] if _resumable() else []
    if rest := [_literal(p) for p, n in large if (p, n) not in chained]:
        told = told.unionByName(_hashed_whole(spark.read.format("binaryFile").load(rest)))
    if not chained:
        return told
    with ThreadPoolExecutor(8) as pool:
        sums = list(pool.map(lambda x: _chained_sha256(spark, *x), chained))
    return told.unionByName(spark.createDataFrame([(*x, y) for x, y in zip(chained, sums, strict=True)], "path string, bytes long, sha256 string"))


def _hashed_whole(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _literal(path: str) -> str:
    """A path as a pattern that matches only itself."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def count_records(rows: DataFrame, nested: str | None = None) -> DataFrame:
    """(path, records) of every file that rows come from; with `nested`, the elements of that array column count."""
    one = F.count("*") if nested is None else F.coalesce(F.sum(F.coalesce(F.size(nested), F.lit(0))), F.lit(0))
    return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(one.cast("long").alias("records"))


def source_manifest(spark: SparkSession, sources: dict[str, dict]) -> DataFrame:
    """One row per source and split: what its registry entry says, url, path, bytes, sha256 and records.

    sources: name to role, homepage, revision, licenses, citation, schema, nested (a column or None) and files, which maps
    a split to (url, path). Files are small enough to be read whole, as JSON arrays are anyway.
    """
    parts = []
    for name, x in sources.items():
        told = [F.lit(name).alias("name"), *[F.lit(x[c]).alias(c) for c in ("role", "homepage", "revision", "citation")], F.array(*map(F.lit, x["licenses"])).alias("licenses")]
        for split, (url, path) in x["files"].items():
            raw = spark.read.schema(x["schema"]).option("multiLine", True).json(path)
            both = manifest(spark, path).join(count_records(raw, x["nested"]).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path", "left")
            parts.append(both.select(*told, F.lit(split).alias("split"), F.lit(url).alias("url"), "path", "bytes", "sha256", F.coalesce("records", F.lit(0)).alias("records")))
    return reduce(DataFrame.unionByName, parts)


def write_sheet(pairs: DataFrame, path: str) -> None:
    """A label sheet as CSV with a byte-order mark in its first header, its named columns in order."""
    pairs.select(*[pairs[f"`{c}`"] for c in SHEET]).withColumnRenamed(SHEET[0], "﻿" + SHEET[0]).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """pair_id and duplicate; an error if any row's label is neither 0 nor 1."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path).toDF(*SHEET)
    label = strip(F.col(f"`{SHEET[1]}`"))
    checked = F.when(label.isin("0", "1"), label == "1").otherwise(F.raise_error(F.concat(F.lit("pair without a label: "), F.coalesce("pair_id", F.lit("?")))).cast("boolean"))
    return raw.select(F.col("pair_id").cast("long").alias("pair_id"), checked.alias("duplicate"))


def report_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, non-ASCII kept."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def log_run(spark: SparkSession, phase: str, config: str, metrics: str, path: str) -> str:
    """Append one run record (config and metrics are JSON texts); returns its unique id."""
    run_id = f"{phase}-{datetime.datetime.now():%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"
    spark.createDataFrame([(run_id, phase, config, metrics)], "run_id string, phase string, config string, metrics string").coalesce(1).write.mode("append").json(path)
    return run_id


def load_runs(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    runs = spark.read.schema("run_id string, phase string, config string, metrics string").json(path)
    return (runs.filter(F.col("phase") == phase) if phase else runs).orderBy("run_id")


def typed_runs(runs: DataFrame) -> DataFrame:
    """runs with config and metrics as VARIANT, which keeps records of any shape; a text that isn't JSON becomes null."""
    return runs.withColumns({c: F.try_parse_json(c) for c in ("config", "metrics")})


def runs_where(runs: DataFrame, column: str, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Runs, and as `found` the number at a JSON path of their config or metrics, where it lies from low to high.

    Runs without such a path, or with something else than a number there, go.
    """
    found = typed_runs(runs).withColumn("found", F.try_variant_get(column, path, "double")).filter("found is not null")
    for bound, keep in ((low, lambda x: F.col("found") >= x), (high, lambda x: F.col("found") <= x)):
        found = found if bound is None else found.filter(keep(bound))
    return found


def write_report(df: DataFrame, path: str) -> None:
    """Each row as one pretty-printed JSON text, non-ASCII kept. For reports of a few rows."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("json")).coalesce(1).write.mode("overwrite").text(path)


#: A page that shows the tables of a report: its data is an object of arrays of objects.
TEMPLATE = """<!doctype html><meta charset="utf-8"><title>Dataset report</title><body><script type="application/json" id="data">__DATA__</script>
<script>for (const [name, rows] of Object.entries(JSON.parse(document.getElementById("data").textContent))) {
  const t = document.body.appendChild(document.createElement("table")); t.createCaption().textContent = name;
  for (const r of rows) { const tr = t.insertRow(); for (const [k, v] of Object.entries(r)) tr.insertCell().textContent = k + ": " + v; }
}</script>"""


def html_report(template: str, data: str) -> str:
    """The template with the JSON put in for its placeholder; closing tags inside the data are escaped."""
    return template.replace("__DATA__", data.replace("</", "<\\/"))


def report_page(sections: dict[str, DataFrame], template: str = TEMPLATE) -> str:
    """A page of named aggregates of a few rows each."""
    return html_report(template, json.dumps({name: [json.loads(r["json"]) for r in report_json(df).collect()] for name, df in sections.items()}, ensure_ascii=False))


def calibration_text(rows: DataFrame, text: str, order: str, n: int = 200) -> DataFrame:
    """The first n texts as one, blank lines between them."""
    first = rows.orderBy(order).limit(n)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


#: Sources by name: role, format, licences and the schema to read them with. Addresses, revisions and files are the user's.
REGISTRY = {
    "program_records": ("training, preference pairs and evaluation", "json array", ["MIT", "CC-BY-4.0"], None, PROGRAM_RECORD),
    "span_records": ("evaluation only", "json array", ["CC-BY-4.0"], "questions", SPAN_RECORD),
}


def registry(spark: SparkSession, told: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per kind of source: name, role, format, licenses, nested (the array whose elements are records), schema,
    homepage, revision and citation. `told` has the last three by name; they are the user's, and null without it."""
    rows = [(name, *x, *((told or {}).get(name) or (None,) * 3)) for name, x in REGISTRY.items()]
    return spark.createDataFrame(rows, "name string, role string, format string, licenses array<string>, nested string, schema string, homepage string, revision string, citation string")
