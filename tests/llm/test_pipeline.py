"""The pipeline's stages, each against a brute-force version of its decision."""

from __future__ import annotations

import re

from ravelin.llm import toxicity
from ravelin.llm.lake import Scratch, table
from ravelin.llm.queries import held_out
from tests.conftest import SMALL
from tests.llm.test_dedup import brute_components, brute_removed


def test_stages(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    scratch, columns = Scratch(spark), docs.columns
    labels = table(spark, SMALL, "labels").where(~held_out())
    model = toxicity.fit(docs.where(~held_out()), labels)
    fold = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    benchmark = [fold(r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.flag(docs, model).where("predicted = 0").collect()}
        elif name == "near_dedup":
            want = {i for i, x in brute_components(list(before.items())).items() if x[2]}
        elif name == "suffix_array_dedup":
            want = {i for i, (n, k, _, _) in brute_removed(list(before.items())).items() if k < n or not n}
        elif name == "decontamination":
            want = {i for i, t in before.items() if not any(b in fold(t) for b in benchmark)}
        docs = scratch.keep(stage(spark, docs, SMALL), name)
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            assert docs.groupBy("sequence_id").sum("length").toDF("s", "n").where("n > 2048").count() == 0
        else:
            assert docs.columns == columns
            assert {r["doc_id"] for r in docs.collect()} == want, name


def folder(spark, path, rows, schema):
    """A folder of tables with these documents, and the labels and benchmark of the smallest tables."""
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_edge_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empties, repeats, ties, a long text, and extra columns with the names that operators use."""
    import corpus_pipeline
    from tests.llm.conftest import text_of

    extra = ["rep", "anchor", "component_id", "score", "item", "__covered", "__want", "column1", "place", "key"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} int" for x in extra)
    long, text, other = text_of(1, 30_000), text_of(2, 60), text_of(3, 60)
    base = [(1, None), (2, ""), (3, " \n"), (4, text), (5, text), (6, other), (6, other), (7, long), (None, text_of(4, 40)), (None, None), (8, "one two"), (9, "end " + text)]
    rows = [(i, t, None, None, len(t or ""), *([k] * len(extra))) for k, (i, t) in enumerate(base)]
    sf_dir = folder(spark, tmp_path / "a", rows, schema)
    docs, kept = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark).keep(stage(spark, docs, sf_dir), name)
        assert docs.schema.simpleString() == table(spark, sf_dir, "documents").schema.simpleString(), name
        kept[name] = sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert [i for i, _ in kept["toxicity"]] == [0, 0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert [i for i, _ in kept["near_dedup"]] == [0, 0, 1, 2, 3, 4, 6, 6, 7, 8]
    assert dict(kept["decontamination"])[7] == long and dict(kept["decontamination"])[4] == text
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.where("piece = 0").count() == len(kept["decontamination"])


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline

    sf_dir = folder(spark, tmp_path / "b", [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
