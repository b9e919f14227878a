"""The pipeline stage by stage, each against what its operator says about the stage's own input."""

import corpus_pipeline as pipeline
from kbspark.llm.common import materialise
from kbspark.llm.substring_dedup import words_of


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, []
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf))
        assert docs.columns == names
        seen.append(docs.toPandas().set_index("doc_id"))
    told, clean, unique, cut = seen
    assert len(told) >= len(clean) >= len(unique) == len(cut) > 0.6 * len(told)
    assert (cut.text.str.len() == cut.n_chars).all()
    first = {}
    for i, t in sorted(unique.text.items()):
        w = words_of(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in unique.text.items():
        w = words_of(t)
        gone = any(first[tuple(w[k : k + 13])] < i for k in range(len(w) - 12))
        assert gone == (cut.text[i] != t)
    packed = pipeline.pack(spark, docs, sf).toPandas()
    assert set(packed.doc_id) == set(cut.index) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_near_duplicate_stage_links_from_eighty_percent(spark):
    """Shingle sets of 100 with 88 in common have 0.786, with 90 in common 0.818; nulls, empty texts and repeated rows stay."""
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    swap = lambda n, tag: " ".join(base[: 104 - n] + [f"{tag}{i}" for i in range(n)])
    rows = [(1, " ".join(base)), (2, swap(10, "x")), (3, swap(12, "y")), (4, None), (5, ""), (6, "other words"), (6, "other words"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert pipeline.near_duplicates(spark, docs.filter("false"), "").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], SCHEMA)


def test_near_duplicates_are_judged_by_their_texts(spark):
    """An id that repeats is no reason to drop its other texts; null ids give way to ids, and of equal rows one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    kept = pipeline.near_duplicates(spark, rows_of(spark, [(3, b), (5, b), (5, a), (5, a), (None, b), (None, c), (None, c + " more"), (9, None), (9, None), (1, "")]), "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, b), (5, a), (None, c), (9, None), (9, None), (1, "")], key=str)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, and columns that are named like a stage's own, go through every stage."""
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("doc_id", "text").collect()
    pairs = [(r["doc_id"], r["text"]) for r in sample] + [(None, sample[0]["text"]), (sample[1]["doc_id"], sample[1]["text"]), (900, None), (901, ""), (902, " \n "), (None, None)]
    clash = ["id", "score", "n", "component_id", "kept", "_kb", "words"]
    docs = rows_of(spark, pairs).selectExpr("*", *[f"'x' as {c}" for c in clash])
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns and out.filter("score <> 'x' or score is null").count() == 0, name
        told = {(r["doc_id"], r["text"]) for r in out.collect()}
        assert len(told) > 20 and (name == "substring dedup" or told <= set(pairs)), name
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0, name
    packed = pipeline.pack(spark, docs, "")
    assert packed.filter("doc_id = 900").count() == 1 and pipeline.pack(spark, docs.filter("false"), "").count() == 0
