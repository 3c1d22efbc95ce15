import hashlib

import corpus_pipeline
import pytest
from compare import connect, rows
from test_exact import BENCH, components_by_force, hits_by_force, key, lines_by_force

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    from quillgraph.llm import common

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), f"test-{name}")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
    assert sizes[0] >= sizes[2] >= sizes[3] > 0
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == docs.columns and run.count() == sizes[-1]


@pytest.mark.parametrize("name", ["op2_warc", "op5_exact_dedup", "op8_line_dedup", "op9_decontaminate"])
def test_query_matches_sql(spark, name):
    from quillgraph.llm import queries

    got = queries.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(connect(SF).execute(queries.SQL[name]).df())


def test_names():
    from quillgraph.llm import queries

    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


@pytest.fixture()
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(100 + i, i % 2, False) for i in range(30)] + [(10, 1, False), (100, 1, False), (None, 1, True)], "doc_id long, quality int, toxic boolean").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_on_hard_rows(spark, rows, frame, sf_dir):
    """Each stage against the plain definition on its own input: nulls, empty and long texts, copies, repeated rows, clashing columns."""
    from quillgraph.llm import common, op3_quality

    extra = [(200, "Q1 q2 " + " ".join(f"Q{i}" for i in range(14)) + "; then a TINY, item!", "en"), (201, "tiny item here", "en")]
    docs = common.materialize(frame(spark, [r for r in rows if r[0] != 30] + extra), "test-hard")
    three = lambda df: [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
    stage = dict(corpus_pipeline.STAGES)
    step = lambda name, df: common.materialize(stage[name](spark, df, sf_dir), f"test-{name}")

    kept = step("quality_classifier", docs)
    model = op3_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = op3_quality.score(docs, model)
    good = three(scored.where(f"{op3_quality.score_name(docs)} >= {op3_quality.THRESHOLD}"))
    assert kept.columns == docs.columns and sorted(map(str, three(kept))) == sorted(map(str, good))

    lines = step("line_dedup", docs)  # all rows again, so that no case is lost to the classifier
    sha = [(r["doc_id"], r["n_chars"] == len(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in lines.collect()]
    assert lines.columns == docs.columns and key(sha) == key([(i, True, h) for i, _, _, h in lines_by_force(three(docs))])

    apart = step("ngram_jaccard_join", lines)
    assert apart.columns == docs.columns and key(i for i, _, _ in three(apart)) == key(i for i, _, c in components_by_force(three(lines)) if i == c)

    clean = step("benchmark_decontamination", apart)
    want = [i for i, _, h, _ in hits_by_force(three(apart), BENCH) if not h]
    assert clean.columns == docs.columns and key(i for i, _, _ in three(clean)) == key(want) and 0 < len(want) < apart.count()

    packed = stage["best_fit_packing"](spark, clean, sf_dir).collect()
    assert key({r["doc_id"] for r in packed}) == key({i for i, _, _ in three(clean)})
    for sequence in {r["sequence_id"] for r in packed}:
        pieces = sorted((r["offset"], r["length"]) for r in packed if r["sequence_id"] == sequence)
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096


def test_stages_on_an_empty_table(spark, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
