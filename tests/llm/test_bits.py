import math
import zlib

import pytest

from quillgraph.llm import op4_ctw as op4


def test_a_model_without_training_takes_eight_bits_a_byte(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    docs = spark.createDataFrame(list(zip(held, ["One two, été", "", "x" * 50])), "doc_id long, text string")
    assert [r["bits_per_byte"] for r in op4.score(docs).collect()] == pytest.approx([8.0] * 3)


def test_score_has_bits_per_byte_with_the_end(docs, empty):
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in docs.collect()}
    out = op4.score(docs).collect()
    assert len(out) == docs.count() and all(r["bits_per_byte"] * sizes[r["doc_id"]] * math.log10(2) == pytest.approx(-r["score"]) for r in out)
    assert "bits_per_byte" in op4.score(empty).columns
