"""The stages on a small corpus with odd rows, and the queries' registration."""

import random

import pytest

import corpus_pipeline
from sievekit.llm import registry


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    item = " ".join(rng.choice(words) for _ in range(25))

    def text(n=80):
        return " ".join(rng.choice(words) for _ in range(n))

    docs = [(k, text(), "en", "s", 0) for k in range(40)]
    docs += [(100, docs[0][1], "en", "s", 0), (101, docs[1][1] + " tail", "en", "s", 0)]
    docs += [(200, f"{text(20)} {item} {text(20)}", "en", "s", 0), (201, text() + " password=abcdef123", "en", "s", 0)]
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "1234 !!", "en", "s", 0), (None, text(), "en", "s", 0)]
    return docs, [(1, item), (2, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("most", [corpus_pipeline.MAX_BROADCAST, 0])
def test_stages(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(corpus_pipeline, "MAX_BROADCAST", most)
    docs, items = corpus()
    extra = [(*d, "a", 1, "b", 2) for d in docs]
    spark.createDataFrame(extra, SCHEMA + ", lang_pred string, _row int, spans string, sig int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert out.columns == rows.columns
        rows = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append({r.doc_id for r in rows.collect()})
    everything = {d[0] for d in docs}
    assert kept[0] == everything - {300, 301, 302}
    assert kept[1] == kept[0] - {100, 101}
    assert kept[2] == kept[3] == kept[1] - {200}
    masked = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out3").collect()}
    assert masked[201].text.endswith(" <SECRET>") and masked[201].n_chars == len(masked[201].text) and masked[3].text == docs[3][1]
    assert kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows.count()


def test_row_keys_stay_when_splits_change(spark, tmp_path):
    """As after an executor was lost: other splits, the same documents dropped."""
    docs, items = corpus()
    many = [(k, *d[1:]) for k, d in enumerate(docs * 40)]
    spark.createDataFrame(many, SCHEMA).repartition(3).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    numbered = corpus_pipeline._numbered(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = []
    try:
        for size in ("128m", "7000", "30000"):
            spark.conf.set(key, size)
            rows = corpus_pipeline._numbered(spark.read.parquet(f"{tmp_path}/documents.parquet"))
            out = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
            spark.conf.set(key, "11000")  # between building and reading
            kept.append(([tuple(r) for r in rows.orderBy("doc_id").collect()], sorted(r.doc_id for r in out.collect())))
    finally:
        spark.conf.set(key, before)
    assert kept[0] == kept[1] == kept[2] and numbered.select(corpus_pipeline.ROW).distinct().count() == len(many)
    assert len(kept[0][1]) == len(many) - 40


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = set(registry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert set(registry.oracle_sql()) <= names and 4 <= len(corpus_pipeline.STAGES) <= 5
