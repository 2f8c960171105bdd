"""Similar texts against all pairs compared, and the near-duplicate stage of the pipeline."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from tagloom.llm import similar_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(texts):
    """The least place linked to each text by pairs of similarity 0.8 or more, or by equal sets."""
    sets, at = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                x, y = sorted((root(i), root(j)))
                at[y] = x
    return [root(i) for i in range(len(texts))]


def planted(copies=14):
    """Texts of 30 to 300 words, copies with a few words changed, and defined cases."""
    rng, texts = random.Random(11), []
    for _ in range(copies):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(base))
        for share in (0.005, 0.012, 0.02, 0.05):
            copy = list(base)
            for i in rng.sample(range(len(base)), max(1, int(len(base) * share))):
                copy[i] = f"x{rng.randrange(4000)}"
            texts.append(" ".join(copy))
    return [*texts, None, "", " \n", "a b", "A b", "a c", texts[0].upper(), texts[5]]


@pytest.mark.parametrize("tile", [256, 2])
def test_similar_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(similar_texts, "TILE", tile)
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.component_id for r in similar_texts.similar(docs).collect()}
    assert found == dict(enumerate(plain_components(texts)))
    assert similar_texts.similar(docs.limit(0)).count() == 0


def test_stage_drops_copies_of_five_word_similarity(spark):
    texts = planted(6)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)] * 2
    left = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    want = sorted(set(plain_components(texts)))
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in left) == 2


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(9)]
    found = similar_texts.shared_counts(sets)
    assert all(found[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
