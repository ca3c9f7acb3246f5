"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import decontaminate, jaccard, language, packing, secrets
from sievekit.llm.common import drop_path, materialize, scratch

#: A document stays if one language has this share of its letters.
LEAST_SCORE = 0.5
#: Most row keys (a file name and a number each) that are broadcast to drop rows; beyond, a shuffled join does.
MAX_BROADCAST = 200_000

ROW = "__sievekit_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a key for each row: its file's name and its place there.

    Both are the file's own, so they stay however a scan is split and whichever executors
    it runs on. What is not read from files is written first.
    """
    try:
        return docs.withColumn(ROW, _place(docs))
    except AnalysisException:
        docs = materialize(docs, "rows")
        return docs.withColumn(ROW, _place(docs))


def _place(docs: DataFrame) -> Column:
    """The key of a file's row, as one text."""
    meta = docs.metadataColumn("_metadata")
    return F.concat_ws(":", meta["file_path"], meta["row_index"].cast("string"))


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows without those whose key is in dropped."""
    dropped = materialize(dropped, "dropped")
    if dropped.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, ROW, "left_anti").drop(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that no language has most of."""
    model = language.fit(docs.where(~language.held_out()))
    # The row goes along as one column, so that none of its names can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "text")
    found = language.identify(rows, model, keep=["_doc"])
    kept = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(kept).select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of linked documents the one with the least id."""
    rows = _numbered(docs)
    # The least of these is a group's id: no null, then the least doc_id, then the first row.
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("row"))
    found = jaccard.link(rows.select(own.alias("_id"), "text"), id_col="_id")
    dropped = found.where(F.col("component_id.row") != F.col("_id.row")).select(F.col("_id.row").alias(ROW))
    return _without(rows, dropped)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    rows = _numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.matches(rows, items, id_col=ROW)
    return _without(rows, hits.select(F.col("doc_id").alias(ROW)).distinct())


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; n_chars follows the text."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", packed),
]

#: Language ID, verification by edits and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # What the stage wrote on its way, and the one before left, is done with.
        for path in [*before, *made[:-1]]:
            drop_path(spark, path)
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
