"""Readers: heterogeneous JSON, JSONL, Parquet and text files to one schema."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.functions.code import UNREADABLE, parsed

SAMPLE = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in (
            "id", "cwe", "cwe_name", "difficulty", "prompt", "entry_point", "insecure_code", "secure_code",
            "functional_tests", "security_tests",
        )),
        T.StructField("mutation_operators", T.ArrayType(T.StringType())),
        *(T.StructField(n, T.StringType()) for n in ("source", "original_id", "source_type")),
    ]
)
VARIATION = T.StructType(SAMPLE.fields + [T.StructField("source_sample_id", T.StringType())])
DETAIL = "sample_id string, cwe string, difficulty string, source_type string, metrics struct<mutation_score double, secure_passes boolean, vuln_detected boolean, mutants_total bigint, mutants_killed bigint>"
BATCH = "custom_id string, error string, response struct<body struct<choices array<struct<message struct<content string>>>>>"


def filtered(samples: DataFrame, difficulty: str | None = None, cwe: str | None = None) -> DataFrame:
    """Samples of a difficulty and a weakness, where these are given."""
    if difficulty is not None:
        samples = samples.where(F.col("difficulty") == difficulty)
    return samples if cwe is None else samples.where(F.col("cwe") == cwe)


def first_path(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return path
    raise FileNotFoundError(", ".join(paths))


def benchmark(spark: SparkSession, path: str, difficulty: str | None = None, cwe: str | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """Samples of JSON files: {"samples": [...]} or a bare list; equality filters. others: paths to try if the first is missing."""
    path = first_path(spark, path, *others) if others else path
    wrapped = T.StructType([T.StructField("samples", T.ArrayType(SAMPLE)), *SAMPLE.fields])
    raw = spark.read.schema(wrapped).json(path, multiLine=True)
    inner = raw.where("samples IS NOT NULL").select(F.explode("samples").alias("s")).select("s.*")
    bare = raw.where("samples IS NULL").select(*SAMPLE.names)
    return filtered(inner.unionByName(bare), difficulty, cwe)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Per-sample results in any of four shapes: results[].detailed_results, detailed_results, details, or a list."""
    details = f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in _fields(DETAIL))}>>"
    shape = f"results array<struct<detailed_results: {details}>>, detailed_results {details}, details {details}, {DETAIL}"
    raw = spark.read.schema(shape).json(path, multiLine=True)
    nested = raw.where("results IS NOT NULL").select(F.explode("results").alias("r")).select(F.explode("r.detailed_results").alias("d"))
    flat = raw.where("results IS NULL").select(F.explode(F.coalesce("detailed_results", "details")).alias("d"))
    bare = raw.where("results IS NULL AND detailed_results IS NULL AND details IS NULL")
    return nested.union(flat).select("d.*").unionByName(bare.select(*(f.split()[0] for f in _fields(DETAIL))))


def _fields(ddl: str) -> list[str]:
    """The top-level fields of a DDL string."""
    out, depth, begin = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[begin:k].strip())
            begin = k + 1
    return [*out, ddl[begin:].strip()]


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """cwe, category, payload rows of a nested payload file; empty payloads are dropped."""
    schema = "map<string, struct<name: string, payloads: map<string, array<string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    by_cwe = raw.select(F.explode("m").alias("cwe", "v"))
    by_category = by_cwe.select("cwe", F.explode("v.payloads").alias("category", "p"))
    return by_category.select("cwe", "category", F.explode("p").alias("payload")).where("payload <> ''")


def variations(spark: SparkSession, path: str) -> DataFrame:
    """Variations with all key fields, of {"variations": [...]}."""
    raw = spark.read.schema(T.StructType([T.StructField("variations", T.ArrayType(VARIATION))])).json(path, multiLine=True)
    rows = raw.select(F.explode("variations").alias("v")).select("v.*")
    need = ("source_sample_id", "secure_code", "insecure_code", "security_tests")
    return rows.where(" AND ".join(f"coalesce({c}, '') <> ''" for c in need))


def split_custom_id(custom_id: Column) -> tuple[Column, Column]:
    """The sample's id and the variant of a request's id, split at the last double underscore."""
    pattern = "(?s)^(.*)__(.*)$"
    return F.regexp_extract(custom_id, pattern, 1), F.regexp_extract(custom_id, pattern, 2)


def batch_output(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, variant, content of a JSONL batch answer; the id is split from the right."""
    raw = spark.read.schema(BATCH).json(path)
    sample, variant = split_custom_id(F.col("custom_id"))
    return raw.select(
        sample.alias("sample_id"), variant.alias("variant"),
        F.get("response.body.choices", 0)["message"]["content"].alias("content"), "error",
    )


def cached_pages(spark: SparkSession, path: str, hours: float | None = 24.0, now: Column | None = None) -> DataFrame:
    """Cached weakness descriptions, without those fetched more hours ago."""
    schema = "cwe_id string, name string, description string, related_cwes array<string>, url string, fetched_at string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    if hours is None:
        return rows
    age = F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros(F.to_timestamp("fetched_at"))
    return rows.where(age <= int(hours * 3600e6))


#: Columns of a sample from outside.
EXTERNAL = ("id", "cwe", "cwe_name", "source", "original_id", "prompt", "code", "language", "metadata")


def external(rows: DataFrame) -> DataFrame:
    """rows with all columns of EXTERNAL, those that are missing as null."""
    return rows.select(*(F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EXTERNAL))


def instruct_samples(spark: SparkSession, path: str) -> DataFrame:
    """Python snippets with their weakness from a JSON list of prompts in many languages.

    Kept are rows whose text is Python, compiles (in a function of its own where it doesn't
    as it stands) and brings the names that it uses along.
    """
    from sievekit.operators.audit import py_compiles
    from sievekit.operators.rules import preprocessed, whole_snippets

    schema = "prompt_id string, cwe_identifier string, language string, origin_code string, test_case_prompt string, file_path string"
    raw = spark.read.schema(schema).json(path, multiLine=True).where("lower(language) = 'python'")
    rows = whole_snippets(raw.withColumn("code", preprocessed(F.col("origin_code"))))
    wrapped = F.concat(F.lit("def snippet():\n    "), F.replace(F.col("code"), F.lit("\n"), F.lit("\n    ")))
    code = F.when(py_compiles("code"), F.col("code")).when(py_compiles(wrapped), wrapped)
    return external(
        rows.withColumn("code", code).where("code IS NOT NULL").select(
            F.substring(F.md5(F.concat_ws(":", "prompt_id", "code").cast("binary")), 1, 12).alias("id"), F.col("cwe_identifier").alias("cwe"),
            F.lit("instruct").alias("source"), F.col("prompt_id").alias("original_id"), F.col("test_case_prompt").alias("prompt"), "code",
            F.lit("python").alias("language"), F.to_json(F.struct("file_path")).alias("metadata"),
        )
    )


def fragment_samples(spark: SparkSession, path: str, cwes: list[str]) -> DataFrame:
    """Samples from Parquet whose code is in fragments of a text field; only known weaknesses and no further packages.

    Columns: id, CWE_ID, task_description, ground_truth (JSON or a literal: code_before, code_after,
    vulnerable_code, patched_code), install_requires (a list as text).
    """
    from sievekit.functions.text import concat_fragments

    parts = "code_before string, vulnerable_code string, patched_code string, code_after string"
    raw = spark.read.parquet(path).withColumn("_t", parse_field(F.col("ground_truth"), parts))
    cwe = F.concat(F.lit("CWE-"), F.regexp_extract(F.col("CWE_ID").cast("string"), r"(\d+)", 1))
    alone = F.regexp_replace(F.coalesce("install_requires", F.lit("")), r"[\s\[\]]", "") == ""

    def whole(middle: str) -> Column:
        return concat_fragments(F.array("_t.code_before", f"_t.{middle}", "_t.code_after"))

    return raw.where(cwe.isin(*cwes) & alone & F.col("_t").isNotNull()).select(
        F.col("id").cast("string").alias("id"), cwe.alias("cwe"), F.lit("fragments").alias("source"),
        F.col("task_description").alias("prompt"), whole("vulnerable_code").alias("insecure_code"), whole("patched_code").alias("secure_code"),
    )


def template_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a JSON resource that maps each weakness to a list of templates; ids are made of weakness and place."""
    template = T.StructType([f for f in SAMPLE.fields if f.name not in ("id", "cwe")])
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(template))).alias("m"))
    rows = raw.select(F.explode("m").alias("cwe", "l")).select("cwe", F.posexplode("l").alias("pos", "t"))
    return rows.select(F.concat_ws("-", "cwe", F.format_string("%03d", F.col("pos"))).alias("id"), "cwe", "t.*").select(*SAMPLE.names)


class SourceManager:
    """Sources by name, each a function that gives its rows; loaded one by one or all together."""

    def __init__(self, loaders: dict[str, Callable[[], DataFrame]]) -> None:
        self.loaders = loaders

    def load(self, name: str, cwe: str | None = None) -> DataFrame:
        """A source's rows with its name in column origin."""
        return filtered(self.loaders[name](), None, cwe).withColumn("origin", F.lit(name))

    def load_all(self, cwe: str | None = None) -> DataFrame:
        """All sources' rows; columns that one lacks are null."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self.load(n, cwe) for n in self.loaders))


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The newest path that fits a glob pattern; null without any."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return max(((f.getModificationTime(), f.getPath().toString()) for f in found or []), default=(0, None))[1]


def security_snippets(spark: SparkSession, path: str) -> DataFrame:
    """External samples from cached JSON: the CWE is in the id's prefix, the id a hash."""
    raw = spark.read.schema("ID string, Prompt string, Insecure_code string").json(path, multiLine=True)
    return raw.select(
        F.substring(F.md5(F.concat("ID", F.coalesce("Insecure_code", F.lit(""))).cast("binary")), 1, 12).alias("id"),
        F.nullif(F.regexp_extract("ID", r"^(CWE-\d+)", 1), F.lit("")).alias("cwe"),
        F.col("Prompt").alias("prompt"), F.col("Insecure_code").alias("code"), F.col("ID").alias("original_id"),
    )


def text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """name (without folder and ending) and value of Python files; glob limits what is listed at all."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.py$", 1).alias("name"), "value")


def text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Task and test files paired by stem."""
    return pair_by_stem(text_files(spark, path))


def pair_by_stem(files: DataFrame) -> DataFrame:
    """stem, task, test of files (name, value) whose names differ in their ending, _task or _test."""
    pattern = r"^(.*)_(task|test)$"
    parts = files.select(F.regexp_extract("name", pattern, 1).alias("stem"), F.regexp_extract("name", pattern, 2).alias("kind"), "value")
    return parts.where("kind = 'task'").select("stem", F.col("value").alias("task")).join(
        parts.where("kind = 'test'").select("stem", F.col("value").alias("test")), "stem"
    )


#: Weaknesses of pairs that no mutation operator aims at: fixed values.
UNTARGETED = ("329", "377", "760", "943")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("source", T.StringType())])))
def unsafe_functions(code: pd.Series) -> pd.Series:
    """Functions of a file with unsafe in their name, tests left out; null if the file doesn't parse."""

    def one(text: str) -> list[dict] | None:
        tree = parsed(text)
        if tree is None:
            return None
        lines = text.split("\n")
        return [
            {"name": n.name, "source": "\n".join(lines[n.lineno - 1 : n.end_lineno])}
            for n in tree.body
            if isinstance(n, ast.FunctionDef) and "unsafe" in n.name and not n.name.startswith("test_")
        ]

    return code.map(lambda text: one(text or ""))


def split_task(task: Column) -> dict[str, Column]:
    """function, imports, prompt, secure_code of a task file: what is before its first function, up to the marker, and the function."""
    name = F.nullif(F.regexp_extract(task, r"(?m)^def\s+(\w+)\s*\(", 1), F.lit(""))
    begin = F.regexp_extract(task, r"(?sm)\A(.*?)^def\s+\w+\s*\(", 1)
    imports = F.btrim(begin, F.lit(WHITE))
    own = F.substring(task, F.length(begin) + 1, F.length(task))
    body = F.regexp_replace(own, r"\n\s*\z", "")
    # Lines up to the first that holds the marker; no prompt if that is before the function.
    before = F.substring(own, F.lit(1), F.instr(own, F.lit(MARKER)) - 1)
    prompt = F.when(begin.contains(MARKER), F.lit("")).otherwise(F.rtrim(F.regexp_replace(before, r"(?:\A|\n)[^\n]*+\z", ""), F.lit(WHITE)))
    return {"function": name, "imports": imports, "prompt": prompt, "secure_code": F.concat(F.when(imports != "", F.concat(imports, F.lit("\n\n\n"))).otherwise(""), body)}


WHITE = " \t\n\r\f\v"
#: The line of a task that the solution follows: fixed value.
MARKER = "# BEGIN SOLUTION"


def pair_samples(files: DataFrame, prefix: str = "cweval", skip: tuple[str, ...] = UNTARGETED) -> DataFrame:
    """One sample for each unsafe function of each pair of files (name, value).

    Columns: id, cwe, original_id, function, unsafe, prompt, secure_code, insecure_code. Left out are tasks without a
    function or the marker, tests that don't parse or name no weakness (in the name, else in the first ten lines), and those of skip.
    """
    pairs = pair_by_stem(files).where(F.col("task").contains(MARKER)).withColumns(split_task(F.col("task"))).where("function IS NOT NULL")
    top = F.array_join(F.slice(F.split("test", "\n"), 1, 10), "\n")
    number = F.coalesce(F.nullif(F.regexp_extract("stem", r"^cwe_(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(top, r"CWE-(\d+)", 1), F.lit("")))
    number = F.nullif(F.regexp_replace(number, "^0+(?=.)", ""), F.lit(""))
    found = pairs.withColumn("number", number).where(F.col("number").isNotNull() & ~F.col("number").isin(*skip))
    each = found.select("*", F.posexplode(unsafe_functions("test")).alias("pos", "f"))
    renamed = F.regexp_replace("f.source", F.concat(F.lit(r"def\s+\Q"), F.col("f.name"), F.lit(r"\E\s*\(")), F.concat(F.lit("def "), F.col("function"), F.lit("(")))
    suffix = F.regexp_replace(F.replace(F.col("f.name"), F.col("function"), F.lit("")), "^_+|_+$", "")
    key = F.concat_ws("_", F.lit(prefix), "stem", F.when(suffix == "", "unsafe").otherwise(suffix), F.col("pos").cast("string"))
    return each.select(
        F.substring(F.md5(key.cast("binary")), 1, 12).alias("id"), F.concat(F.lit("CWE-"), "number").alias("cwe"), F.col("stem").alias("original_id"), "function",
        F.col("f.name").alias("unsafe"), "prompt", "secure_code", F.concat(F.when(F.col("imports") != "", F.concat("imports", F.lit("\n\n\n"))).otherwise(""), renamed).alias("insecure_code"),
    )


def expert_pairs(spark: SparkSession, path: str, cwe: int | None = None, **options) -> DataFrame:
    """pair_samples() of a folder; only files of one weakness are listed and read where one is asked for."""
    glob = None if cwe is None else f"cwe_{{{cwe},0{cwe},00{cwe}}}_*.py"
    return pair_samples(text_files(spark, path, glob), **options)


def example_blocks(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """Lines between markers in text files, comment prefixes stripped; one row a block."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    found = F.regexp_extract_all("value", F.lit(rf"(?s){begin}[^\n]*\n(.*?){end}"), F.lit(1))
    block = F.array_join(F.transform(F.split("block", "\n"), lambda x: F.regexp_replace(x, r"^\s*(//|#|\*)\s?", "")), "\n")
    return raw.select("file", F.posexplode(found).alias("pos", "block")).select("file", "pos", block.alias("block"))


#: What begins and ends an example in a query's comments, whatever the case: fixed values.
EXAMPLE_BEGINS, EXAMPLE_ENDS = ("```python", "// bad"), ("```", "// good")


def query_examples(text: Column) -> Column:
    """The examples in a query's comments: a fold over its lines, with comment signs taken off.

    An example that is not ended is none, nor is one without lines; a line that begins an example within one is left out.
    """
    def holds(line: Column, signs: tuple[str, ...]) -> Column:
        low = F.lower(line)
        return reduce(lambda a, b: a | b, (low.contains(x) for x in signs))

    def struct(inside: Column, lines: Column, found: Column) -> Column:
        return F.struct(inside.alias("inside"), lines.alias("lines"), found.alias("found"))

    def step(s: Column, line: Column) -> Column:
        nothing = F.array().cast("array<string>")
        clean = F.regexp_replace(F.regexp_replace(line, r"^//\s*", ""), r"^\*\s*", "")
        ended = F.when(F.size(s["lines"]) > 0, F.concat(s["found"], F.array(F.array_join(s["lines"], "\n")))).otherwise(s["found"])
        return (
            F.when(holds(line, EXAMPLE_BEGINS), struct(F.lit(True), s["lines"], s["found"]))
            .when(s["inside"] & holds(line, EXAMPLE_ENDS), struct(F.lit(False), nothing, ended))
            .when(s["inside"], struct(s["inside"], F.concat(s["lines"], F.array(clean)), s["found"]))
            .otherwise(s)
        )

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), struct(F.lit(False), F.array().cast("array<string>"), F.array().cast("array<string>")), step, lambda s: s["found"])


def resume(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What an interrupted run has not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


@F.pandas_udf(T.StringType())
def literal_json(text: pd.Series) -> pd.Series:
    """JSON of texts that are JSON or a Python literal, which is read and never run; null for others and for what JSON can't say."""

    def plain(value: object) -> object:
        if isinstance(value, dict):
            return {k if isinstance(k, str) else json.dumps(plain(k)): plain(v) for k, v in value.items()}
        if isinstance(value, list | tuple):
            return [plain(v) for v in value]
        if isinstance(value, set | frozenset):
            return sorted((plain(v) for v in value), key=repr)
        return value

    def one(value: str | None) -> str | None:
        for read in (json.loads, ast.literal_eval):
            try:
                return json.dumps(plain(read(value or "")), ensure_ascii=False)
            except (*UNREADABLE, TypeError):
                continue
        return None

    return text.map(one)


def parse_field(text, schema: str):
    """A field that is JSON or a Python literal (True, None, tuples and sets as arrays), as the schema has it; null for others."""
    return F.from_json(literal_json(text), schema, {"allowSingleQuotes": "true"})


def unjudged(spark: SparkSession, results: str, judged: str) -> DataFrame:
    """file and name of the files that fit the pattern results and have no namesake among those of the pattern judged."""

    def listed(pattern: str) -> DataFrame:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        rows = [(f.getPath().toString(), f.getPath().getName()) for f in found or []]
        return spark.createDataFrame(rows, "file string, name string")

    return listed(results).join(listed(judged).select("name"), "name", "left_anti").select("file", "name")
