"""The pipeline against a plain version of its stages, over the odd rows of conftest."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from sourcelode.llm import language_id, toxicity

from .conftest import SCHEMA
from .test_llm_operators import brute_components, brute_fingerprint, check_packing, fold


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("Licensed" in (r[1] or "") or "word" in (r[1] or ""))) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "simhash", "packing"]


def test_pipeline_equals_the_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.score(docs, labels).collect() if r["predicted"] == 1}
    kept = [tuple(r) for r in docs.collect() if r["doc_id"] not in bad]
    table = spark.createDataFrame(kept, SCHEMA)
    unknown = {r["doc_id"] for r in language_id.label(table).collect() if r["lang_pred"] == "und"}
    kept = [r for r in kept if r[0] not in unknown]
    last = {}
    for r in kept:  # one row of those with the largest id; rows of a null id give way
        known = last.get(fold(r[1]))
        if known is None or (r[0] is not None and (known[0] is None or r[0] > known[0])):
            last[fold(r[1])] = r
    kept = list(last.values())
    parts = brute_components([brute_fingerprint(r[1]) for r in kept], [r[0] for r in kept])
    kept = [r for r, c in zip(kept, parts, strict=True) if r[0] == c]
    check_packing(corpus_pipeline.run(spark, folder), kept, 2048)


def test_filtering_stages_keep_the_columns_and_clean_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema


def test_pipeline_of_nothing(spark, no_docs, no_labels, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_rest_does_without_this_part(tmp_path):
    """As after deletion: the entry file imports, and has the library's own queries."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = (
        "import sys\nclass No:\n    def find_spec(self, name, *a):\n        if name.startswith(('sourcelode.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q\n"
    )
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
