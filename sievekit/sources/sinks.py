"""Writers: collections with statistics, splits, results, requests and small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators.curation import collection_stats


def collection_counts(samples: DataFrame, keys: tuple[str, ...] = ("cwe", "difficulty", "source")) -> DataFrame:
    """dimension, value, n by each key, and by quality level and mutation operator where samples have them."""
    keys = (*keys, *(c for c in ("quality_level",) if c in samples.columns))
    out = collection_stats(samples, *keys)
    if "mutation_operators" in samples.columns:
        own = samples.select(F.explode("mutation_operators").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
        out = out.unionByName(own.select(F.lit("operator").alias("dimension"), "value", "n"))
    return out


def save_collection(samples: DataFrame, path: str, keys: tuple[str, ...] = ("cwe", "difficulty", "source")) -> None:
    """Samples as Parquet and their counts as JSON beside them."""
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    collection_counts(samples, keys).orderBy("dimension", F.desc("n"), "value").coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def save_splits(samples: DataFrame, path: str, key: str = "difficulty") -> None:
    """One folder a split."""
    samples.write.mode("overwrite").partitionBy(key).parquet(path)


def save_results(results: DataFrame, path: str, run: str) -> None:
    """Results under their model and run."""
    results.withColumn("run", F.lit(run)).write.mode("append").partitionBy("model", "run").json(path)


def append_checkpoint(results: DataFrame, path: str) -> None:
    """Add finished rows; a later run leaves them out by readers.resume()."""
    results.write.mode("append").parquet(path)


def clear_checkpoint(spark: SparkSession, path: str) -> bool:
    """Delete the finished rows of a run that has ended; whether there were any."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def save_csv(rows: DataFrame, path: str, labels: tuple[str, ...] = ()) -> None:
    """A sheet with empty columns for labels."""
    rows.withColumns({c: F.lit("") for c in labels}).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def requests(samples: DataFrame, variants: DataFrame, model: str) -> DataFrame:
    """custom_id and body of a request for each sample (id, prompt) and variant (a given few); ids have 64 characters at most."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"))
    pairs = samples.crossJoin(F.broadcast(variants))
    return pairs.select(F.substring(F.concat_ws("__", F.col("id").cast("string"), "variant"), 1, 64).alias("custom_id"), body.alias("body"))


def save_requests(samples: DataFrame, variants: DataFrame, path: str, model: str) -> None:
    """The requests as JSONL."""
    requests(samples, variants, model).write.mode("overwrite").json(path)


def save_audit(audited: DataFrame, fingerprint: DataFrame, path: str) -> None:
    """What an audit gives, as JSON: the n-grams, the rows that are not flagged, and the summary (columns of contamination.audit())."""
    from sievekit.operators.contamination import audit_summary

    fingerprint.write.mode("overwrite").json(f"{path}/fingerprint")
    audited.where("NOT flagged").write.mode("overwrite").json(f"{path}/clean")
    audit_summary(audited).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def report(tables: dict[str, DataFrame], title: str, notes: tuple[str, ...] = ()) -> str:
    """Small aggregates under one title, with notes before them, as Markdown."""
    return "\n\n".join([f"# {title}", *notes, *(markdown(t, name) for name, t in tables.items())])


def markdown(table: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table."""
    head = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    return "\n".join(head + ["| " + " | ".join(_cell(x) for x in row) + " |" for row in table.collect()])


def latex(table: DataFrame) -> str:
    """A small aggregate as a LaTeX table."""
    rows = [" & ".join(_cell(x).replace("_", r"\_") for x in row) + r" \\" for row in table.collect()]
    head = " & ".join(c.replace("_", r"\_") for c in table.columns) + r" \\ \midrule"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\toprule", head, *rows, r"\bottomrule", r"\end{tabular}"])


def console(table: DataFrame, title: str) -> str:
    """A small aggregate as aligned text."""
    rows = [table.columns, *([_cell(x) for x in row] for row in table.collect())]
    widths = [max(len(r[k]) for r in rows) for k in range(len(table.columns))]
    return "\n".join([title, "-" * len(title), *("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in rows)])


def _cell(x: object) -> str:
    return "-" if x is None else f"{x:.4f}" if isinstance(x, float) else json.dumps(x, default=str).strip('"')
