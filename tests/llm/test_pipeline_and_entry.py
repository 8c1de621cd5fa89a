import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lamina.llm import queries as corpus
from tests.llm.conftest import rows
from tests.oracle import connect, same

ROOT = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.01"


def test_all_ten_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_against_sql(spark, name):
    same(corpus.queries()[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(corpus.oracle_sql()[name]).df())


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns and out.count() <= before
            before = out.count()
        docs = out
    kept = spark.read.parquet(f"file://{tmp_path}/1")
    assert kept.select("text").distinct().count() == kept.count()
    packed = docs.groupBy("sequence_id").agg({"length": "sum"})
    assert packed.agg({"sum(length)": "max"}).first()[0] <= 4096
    assert docs.select("doc_id").distinct().count() == spark.read.parquet(f"file://{tmp_path}/3").count()


def test_odd_documents_pass_all_stages(spark, tmp_path):
    folder = f"{tmp_path}/odd"
    spark.createDataFrame([(r[0], r[1], r[2], "s", None) for r in rows()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{folder}").count() > 0


def test_columns_named_like_the_operators_own_survive(spark, tmp_path):
    """Documents with columns named as those that the stages add keep them, values and all, through the first four stages."""
    text = lambda k: " ".join(f"the word{(k * j) % 97} and house" for j in range(60)) + f" mail a{k}@b.org"
    rows_ = [(k, text(k), "en" if k % 2 else "fr", "s", 5, 0.25 + k, "mine", k, f"h{k}", [k], f"_row{k}", -k, "sha", True) for k in range(1, 12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _i long, _h string, _s array<int>, _row string, keep_id long, sha string, kept boolean"
    docs = spark.createDataFrame(rows_, schema)
    want = {r[0]: (*r[2:4], *r[5:]) for r in rows_}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        got = {r["doc_id"]: (*r[2:4], *r[5:]) for r in docs.collect()}
        assert got and all(got[i] == want[i] for i in got)


def test_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_the_rest_works_without_the_corpus_package(tmp_path):
    for name in ("lamina", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    subprocess.run(["cp", "-r", str(ROOT / "lamina"), str(tmp_path / "lamina")], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lamina/llm"), str(tmp_path / "__spark_entry__.py")], check=True)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a1_pyramid_mean' in q and 'pipeline' not in q and len(e.oracle_sql()) > 80, len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
