"""The pipeline's stages keep the columns of documents and take effect."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from stopflow.llm import toxicity  # noqa: E402
from stopflow.session import passing, shared_dir, stored  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        seen.append(kept.count())
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    clean = {r.doc_id for r in first.select("doc_id").collect()}
    everyone = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(everyone - clean) >= 0.5 * len(toxic) and len(everyone - clean - toxic) <= 0.02 * len(everyone)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in kept.collect())
    assert seen[1] <= seen[0] <= len(everyone)


def test_toxic_documents_go_by_the_threshold_of_their_language(spark, monkeypatch):
    model = toxicity._new_model(1)
    model.thresholds = {"en": 0.9, "de": 0.5}
    monkeypatch.setattr(corpus_pipeline.queries, "toxicity_model", lambda *_: model)
    monkeypatch.setattr(
        toxicity, "with_scores", lambda docs, _, into: docs.withColumn(into, F.col("given"))
    )
    rows = [(1, "en", 0.8), (2, "en", 0.9), (3, "de", 0.4), (4, "de", 0.6), (5, "fr", 0.6)]
    rows += [(6, "fr", 0.7), (7, None, 0.6), (8, None, 0.8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, given double")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5, 7}


AWKWARD = [
    (1, "a plain text of some words that stays here", "en", "web"),
    (2, "a plain text of some words that stays here", "en", "web"),
    (3, None, "en", "web"),
    (4, "", None, None),
    (5, " \n\t ", "de", "web"),
    (None, "no id but some words", None, "books"),
    (None, None, None, None),
    (7, "said twice word for word", "fr", None),
    (7, "said twice word for word", "fr", None),
    (8, "long " * 200_000, "en", "books"),
]


def test_stages_on_awkward_rows(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    rows = [(*r, len(r[1] or "")) for r in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert docs.columns == columns
    names = ("_score", "_score_", "score", "size", "key", "ids", "node", "copy")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept[name] = out.collect()
        assert all(r[c] == f"own {c}" for r in kept[name] for c in names), name
    assert len(kept["toxicity"]) == len(rows)
    assert Counter(r.doc_id for r in kept["near_duplicates"]) == Counter([1, 3, 4, 5, None, None, 7, 7, 8])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert {r.n_tokens for r in out if r.doc_id in (3, 4, 5)} == {0}


def stage_tables(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "stopflow"
    return {p.name.rsplit("-", 1)[0]: p for p in folder.glob("*")} if folder.exists() else {}


def test_stages_keep_no_table_that_nothing_reads(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("stopflow.session.shared_dir", lambda _: str(tmp_path))
    monkeypatch.setitem(globals(), "shared_dir", lambda _: str(tmp_path))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert not stage_tables(spark)
    assert 0 < kept.count() <= docs.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert set(stage_tables(spark)) == {"gone"}
    gone = spark.read.parquet(str(stage_tables(spark)["gone"])).count()
    assert kept.count() == docs.count() - gone


def test_passing_tables_go_with_their_block(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("stopflow.session.shared_dir", lambda _: str(tmp_path))
    monkeypatch.setitem(globals(), "shared_dir", lambda _: str(tmp_path))
    before = stored(spark.range(3), "before")
    with passing(spark):
        with passing(spark):
            stored(spark.range(4), "inner")
            middle = stored(spark.range(5), "middle", outlive=True)
            last = stored(spark.range(6), "last", outlive=True)
        assert set(stage_tables(spark)) == {"before", "middle", "last"}
        assert middle.count() == 5 and last.count() == 6
        after = stored(spark.range(7), "after", outlive=True)
    assert set(stage_tables(spark)) == {"before", "after"}
    assert before.count() == 3 and after.count() == 7


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
