"""The stages of the pipeline on repeated ids, defined cases and columns that clash with the operators' own."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from tagloom.llm import similar_texts, suffix_dedup

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHORT, OTHER = "a b c d e f g", "zz yy xx ww vv uu"
LONG = " ".join(f"word{i}" for i in range(40))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def clashing(docs):
    """``docs`` with columns named like those of every operator on the way."""
    names = ["score", "kept", "spans", "n_bytes", "items", "n_words", "n_hit", "row", "class", "root", "digest", "__row"]
    return docs.withColumns({name: F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")) for name in names})


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rows = [(1, SHORT), (2, OTHER), (2, SHORT), (3, LONG), (3, LONG), (None, SHORT), (None, None), (4, LONG + " more"), (5, None), (6, "")]
    left = corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows), SF_DIR)
    # the second LONG is the same document, the fourth id a near copy; null and empty texts are equal sets
    want = [(1, SHORT), (2, OTHER), (3, LONG), (5, None), (None, SHORT), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)


def test_texts_of_one_id_lose_only_what_repeats(spark):
    rows = [(1, LONG), (2, LONG), (2, "unlike " * 2), (3, f"x {LONG}"), (3, OTHER), (None, LONG)]
    found = suffix_dedup.deduplicated(documents(spark, rows).withColumn("kept", F.lit("mine")))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_bytes", "spans", "kept"]
    kept = sorted(((r.doc_id, bytes(r.kept).decode()) for r in found.collect()), key=repr)
    want = [(1, LONG), (2, ""), (2, "unlike unlike "), (3, "x "), (3, OTHER), (None, LONG)]
    assert kept == sorted(want, key=repr)


@needs_tables
def test_clashing_columns_keep_their_values(spark):
    rows = [(1, LONG), (2, f"x {LONG} y"), (3, SHORT), (4, None), (5, "")]
    docs = clashing(documents(spark, rows))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert (r.score, r.kept, r.spans, r["items"], r.root) == tuple(f"{c} {r.doc_id}" for c in ("score", "kept", "spans", "items", "root")), name
    coded = corpus_pipeline.encoding_stage(spark, docs.withColumn("ids", F.lit("old")).withColumn("n_tokens", F.lit("old")), SF_DIR)
    assert len(set(coded.columns)) == len(coded.columns)
    assert {r.doc_id: r.n_tokens == len(r.ids) for r in coded.collect()} == dict.fromkeys(range(1, 6), True)


@needs_tables
def test_empty_table(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0, name


def test_hooked_links_connect_alike(spark):
    links = [(10, 1), (10, 2), (11, 2), (12, 2), (12, 3), (13, 9), (9, 4)]
    found = [tuple(r) for r in similar_texts.hooked(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(found) == [(2, 1), (3, 2), (9, 4), (10, 1), (11, 2), (12, 2), (13, 9)]


@pytest.mark.parametrize("members", [60, 120, 240])
def test_a_group_of_near_copies_has_few_links(spark, members):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[: i % 120] + [f"x{i}"] + base[i % 120 + 1 :]) for i in range(members)]
    rows = similar_texts.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "doc_id AS row", "text"))
    found = similar_texts.hooked(similar_texts.candidates(rows)).count()
    assert found < 3 * members
