"""Large documents cut by many tasks against the same documents read whole."""

import json
import random

import pytest

from tagloom.sources.landed import json_items, markdown_rows, read_documents
from tagloom.sources.large_lists import large_json_items, large_markdown_rows


@pytest.fixture
def small_splits(spark):
    for name, value in (("maxPartitionBytes", "397"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    yield
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def land(folder, documents):
    for i, text in enumerate(documents):
        path = folder / "source=lever" / f"company=c{i}"
        path.mkdir(parents=True)
        (path / "list.txt").write_text(text)
    return str(folder)


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice('ab,"\\[]{}é \n:') for _ in range(rng.randint(0, 30)))
    if kind < 4:
        return rng.choice([1, -2.5, True, None, "jobs"])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i},": value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def rows(frame):
    listed = frame.selectExpr("company_slug", "pos", "to_json(raw) AS raw").collect()
    return sorted(map(tuple, listed))


def both(spark, root, key):
    whole = rows(json_items(read_documents(spark, root), key))
    return rows(large_json_items(spark, root, key)), whole


def test_bare_lists(spark, tmp_path, small_splits):
    rng = random.Random(5)
    lists = [[value(rng) for _ in range(rng.randint(0, 40))] for _ in range(12)]
    texts = [json.dumps(x, indent=rng.choice([None, 1]), ensure_ascii=False) for x in lists]
    texts += ["[]", " [ ] ", "[1]", '{"a": [1, 2]}', "[1, 2", "[1, x, 2]", '["a, 2]', "7", "[[1, 2], [3]]", "[,]", "[1 2, 3]", "[null]"]
    found, whole = both(spark, land(tmp_path, texts), None)
    assert found == whole and len(found) > 100
    pieces = spark.read.text(str(tmp_path), lineSep=",", recursiveFileLookup=True)
    assert pieces.rdd.getNumPartitions() > 20


def test_text_behind_a_list_is_an_error(spark, tmp_path):
    root = land(tmp_path, ["[1], [2]", "[1, 2]]", "[1, 2] x"])
    assert large_json_items(spark, root, None).count() == 0


def test_lists_under_a_key(spark, tmp_path, small_splits):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        members = {"meta": value(rng, 1), "more": [value(rng, 2) for _ in range(4)], "jobs": [value(rng, 1) for _ in range(rng.randint(0, 30))], "end": value(rng, 1)}
        names = rng.sample(sorted(members), 4)
        texts.append(json.dumps({n: members[n] for n in names}, indent=rng.choice([None, 2]), ensure_ascii=False))
    texts += ['{"jobs": []}', '{"jobs": {"a": 1, "b": [2, 3]}}', '{"jobs": 4, "x": [1, 2]}', '{"x": [1, 2]}', "[1, 2]", '{"jobs": [1, }', '{"x": {"jobs": [1, 2]}}', '{ "jobs" : [ 1 , 2 ] }']
    found, whole = both(spark, land(tmp_path, texts), "jobs")
    assert found == whole and len(found) > 100


def test_tables(spark, tmp_path, small_splits):
    rng = random.Random(7)
    lines = ["# Roles", "| title | place | url |", "|---|---|---|"]
    for i in range(60):
        url = f"[View](https://x.example/c/jobs/view/A{i:03d}.md)"
        lines.append(rng.choice([f"| T{i} | P | {url} |", f"| T{i} | — | https://y |", "| too | few |", "", "text"]))
    root = land(tmp_path, ["\n".join(lines), "\r\n".join(lines[:9]), "", "no table"])
    columns = ["title", "place", "url"]
    whole = markdown_rows(read_documents(spark, root), columns, "url")
    found = large_markdown_rows(spark, root, columns, "url")
    assert found.columns == whole.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
