"""Filter stages act by row, with null and repeated ids."""

from collections import Counter

import corpus_pipeline
from planline.llm import jaccard_join
from planline.llm.shared import DOCUMENT_COLUMNS

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DDL)


def test_near_copies_keeps_one_row_of_a_class(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, one), (1, one), (None, one + " more"), (None, two), (None, two), (7, three), (7, "short other text of seven words in all"), (8, ""), (8, "")]
    out = corpus_pipeline.near_copies(spark, frame(spark, rows), SF)
    assert out.columns == list(DOCUMENT_COLUMNS)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, one), (None, two), *rows[5:]])


def test_decontamination_by_row(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    clean = "nothing to see here but a plain sentence about the weather"
    rows = [(None, passage), (3, passage), (3, clean), (None, clean), (4, clean)]
    out = corpus_pipeline.decontamination(spark, frame(spark, rows), SF)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(3, clean), (None, clean), (4, clean)])


def test_stages_on_odd_rows(spark, odd, empty):
    """Nulls, empty and long texts, repeats and clashing columns; and empty tables."""
    columns = list(DOCUMENT_COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == columns, name
        kept, all_rows = Counter(out.collect()), Counter(odd.select(*columns).collect())
        assert set(kept) <= set(all_rows), name
        if name != "mixing":
            assert not kept - all_rows, name
        if name in ("toxicity", "decontamination"):
            assert kept == all_rows, name  # nothing here is toxic or from the benchmark
        if name == "near_copies":  # equal rows, and the longer text of the same passage, go
            assert sum(r.doc_id == 1 for r in kept.elements()) == 1 and all(r.doc_id is not None for r in kept)
            assert {2, 3, 4, 7, 10} <= {r.doc_id for r in kept} and sum(r.doc_id in (8, 9) for r in kept) == 1
        if name == "mixing":
            assert all(r.text for r in kept)
        assert stage(spark, empty, SF).count() == 0, name
    rows = corpus_pipeline.token_files(spark, odd, SF)
    assert rows.count() == odd.count() and corpus_pipeline.token_files(spark, empty, SF).count() == 0


def test_near_copies_joins_hashes_not_texts(spark, monkeypatch):
    """Texts cross a shuffle where they leave, not where copies are put in order; and working tables go."""
    plans, tables = {}, []
    real = corpus_pipeline.written

    def watched(df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name, *more)

    monkeypatch.setattr(corpus_pipeline, "written", watched)
    real_drop = jaccard_join.dropped
    monkeypatch.setattr(jaccard_join, "dropped", lambda df: (tables.append(df.planline_path.rpartition("/")[2].partition("-")[0]), real_drop(df)))
    text = " ".join(f"w{k}" for k in range(60))
    out = corpus_pipeline.near_copies(spark, frame(spark, [(1, text), (2, text + " more"), (3, "other words")]), SF)
    assert {r.doc_id for r in out.collect()} == {1, 3}
    join = plans["linked"].split("Join", 1)
    assert "md5" not in join[0] and "md5" in join[1]
    assert {"members", "tokens", "sets", "buckets", "links"} <= set(tables)


def test_rows_go_by_their_bits(spark, monkeypatch):
    """Every place of a word of 64 bits, numbers of several partitions, and both joins; the texts stay where they are."""
    docs = frame(spark, [(k, f"text {k}") for k in range(300)]).repartition(3)
    numbered = corpus_pipeline._numbered(docs)
    gone = numbered.where("doc_id % 3 = 0 or doc_id between 100 and 199").select("row")
    left = {k for k in range(300) if k % 3 and not 100 <= k <= 199}
    for most in (corpus_pipeline.MOST_WORDS, 0):
        monkeypatch.setattr(corpus_pipeline, "MOST_WORDS", most)
        out = corpus_pipeline._without(numbered, gone)
        assert {(r.doc_id, r.text) for r in out.collect()} == {(k, f"text {k}") for k in left}
        assert most == 0 or "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert corpus_pipeline._without(numbered, gone.limit(0)).count() == 300
