import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute
from test_near_dedup import brute_groups, brute_print

import corpus_pipeline
from echogrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, every one written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_are_those_asked_for_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    assert all(d.schema == stages[0].schema for d in stages[1:5])


def test_quality_keeps_good_and_drops_bad(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    right = [(d in kept) == bool(q) for d, q in labels.items()]
    assert np.mean(right) > 0.9


def test_each_stage_drops_what_its_operator_says(spark, stages):
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in stages]
    assert all(len(set(i)) == len(i) for i in ids) and all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    texts = {r.doc_id: r.text for r in stages[1].collect()}
    latest = {}
    for d, t in texts.items():
        latest[t] = max(d, latest.get(t, d))
    assert set(ids[2]) == set(latest.values())
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    tops = brute_groups([brute_print(t) for _, t in rows])
    assert set(ids[3]) == {rows[t][0] for t in tops}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(ids[4]) == {r.doc_id for r in stages[3].collect() if not brute(r.text, items)[4]}
    assert sorted(ids[5]) == sorted(ids[4]) and all(r.round_trip for r in stages[5].collect())


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])


def test_odd_rows_pass_through_every_stage(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "a text of no id", "en", "s", 5), (3, "word " * 30_000, "en", "s", 9), (4, "the end", "en", "s", 7), (4, "the end", "en", "s", 7)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            part = stage(spark, part, SF)
        assert part.filter(F.col("doc_id") == 4).count() <= 1


def test_verdict_columns_may_clash_with_those_of_the_documents(spark):
    more = ["score", "predicted", "contaminated", "n_words", "id", "fp", "component_id", "kept_id", "c0", "v1", "v4", "body"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(None, t, "en", "s", 1) for t in (None, "", "no id at all", "No id at all", "another text")], docs.schema)
    plain = docs.union(odd)
    wide = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(more)])
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = stage(spark, plain, SF).localCheckpoint(), stage(spark, wide, SF).localCheckpoint()
        columns = plain.columns
        assert sorted(map(str, plain.collect())) == sorted(map(str, wide.select(*columns).collect())), name
        if name != "encode":
            assert wide.columns == [*columns, *more]
            assert wide.filter(" or ".join(f"not {c} <=> {i}" for i, c in enumerate(more))).isEmpty()


def test_near_copies_are_decided_row_by_row(spark):
    one, two, three, four = ("alpha beta gamma delta epsilon zeta", "red green blue white black grey", "one two three four five six", "north south east west up down")
    rows = [(None, one), (None, one.upper()), (5, two), (None, two.upper()), (3, three), (7, three.upper()), (7, four), (None, four.upper())]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(k for k in kept if k[0] is not None) == [(3, three), (5, two), (7, four)]
    assert len(kept) == 4 and [k for k in kept if k[0] is None][0][1].lower() == one
