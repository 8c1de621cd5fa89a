"""The pipeline's exact stage leaves one document of each text, also where rows repeat."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import rows


def test_one_row_of_each_text(spark, odd, empty):
    out = corpus_pipeline.exact(spark, odd, "")
    got = Counter(r["text"] or "" for r in out.collect())
    assert out.columns == odd.columns
    assert got == Counter({r[1] or "" for r in rows()})
    assert corpus_pipeline.exact(spark, empty, "").count() == 0
