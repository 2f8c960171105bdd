"""The registered corpus queries: SQL where there is one, and the pipeline's stages."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check_oracles
import corpus_pipeline

import __spark_entry__ as entry_module
from tagloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="tables are not here")


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_module.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    db = check_oracles.connect(SF_DIR)
    assert check_oracles.compare(spark, db, SF_DIR, name, QUERIES[name], ORACLES[name]) is None


@needs_tables
def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).schema.names == docs.columns, name
