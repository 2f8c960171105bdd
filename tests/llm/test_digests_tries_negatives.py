"""Quartile digests, the conversation trie with list ranking, and hard negatives against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import conversation_trie, hard_negatives, list_rank, quartile_digest

# --- digests -----------------------------------------------------------------------------------


def plain_digest(data):
    counts = [0] * 256
    for i in range(len(data) - 2):
        counts[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 24] += 1
    ordered = sorted(counts)
    q = ordered[63], ordered[127], ordered[191]
    codes = [sum(c > x for x in q) for c in counts]
    head = [min(255, math.floor(8 * math.log2(len(data) + 1))), 16 * q[0] // (q[2] + 1) * 16 + 16 * q[1] // (q[2] + 1)]
    body = [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4)]
    return bytes(head + body).hex()


def plain_likeness(a, b):
    a, b = bytes.fromhex(a), bytes.fromhex(b)
    score = abs(a[0] - b[0]) + abs(a[1] // 16 - b[1] // 16) + abs(a[1] % 16 - b[1] % 16)
    for x, y in zip(a[2:], b[2:]):
        for shift in (0, 2, 4, 6):
            apart = abs((x >> shift & 3) - (y >> shift & 3))
            score += 6 if apart == 3 else apart
    return 1 - min(416, score) / 416


def texts(rng, n):
    words = ["ta", "ri", "on", "é", "ßo", "the", "中"]
    return [" ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_edited_documents_equal_the_plain_version(spark):
    rng = random.Random(1)
    listed = [*texts(rng, 40), None, "", "a", "ab", "abc", "x" * 5000, " ".join(texts(rng, 300))]
    rows = [(i * 3 - 20, t, f"f{i}") for i, t in enumerate(listed)] + [(None, "null id", "x"), (1, listed[7], "y"), (1, listed[7], "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    found = quartile_digest.edited(frame)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def tie(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    order = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    want = []
    for (doc, text), (_, after) in zip(order, [*order[1:], order[0]]):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, changed, follows = (plain_digest(t.encode()) for t in (text, edited, after))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want.append((doc, len(text), sha, own, changed, plain_likeness(own, changed), plain_likeness(own, follows)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert quartile_digest.edited(frame.limit(0)).count() == 0


def test_pieces_of_long_texts_count_alike(monkeypatch):
    data = [t.encode() for t in texts(random.Random(2), 50)]
    whole = quartile_digest.digests(data)
    monkeypatch.setattr(quartile_digest, "PIECE", 37)
    assert np.array_equal(quartile_digest.digests(data), whole)
    assert [plain_digest(d) for d in data] == [r.tobytes().hex() for r in whole]


def test_columns_compared(spark):
    rows = [(i, t) for i, t in enumerate([*texts(random.Random(3), 6), None, ""])]
    prints = quartile_digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    both = prints.crossJoin(prints.select(F.col("fingerprint").alias("other"))).withColumn("none", F.lit(None).cast("string"))
    for r in quartile_digest.compared(both, "fingerprint", "other").collect():
        assert r.likeness == plain_likeness(r.fingerprint, r.other)
    assert {r.likeness for r in quartile_digest.compared(both, "none", "other").collect()} == {None}


# --- the trie ------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def hashed(role, text):
    h = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashed(role or "", text or ""), text or ""))
    own = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        line = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
        for d in range(len(line) + 1):
            members[line[:d]].append(c)
        ends[line].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    return [
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children.get(n, ())), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    ]


def found_trie(frame, **named):
    found = conversation_trie.families(frame, **named)
    assert found.columns == [*NODE, "enter", "exit"]
    rows = found.collect()
    # the tour visits every arc once and children lie inside their parents
    places = sorted(p for r in rows for p in (r.enter, r.exit))
    assert places == list(range(1, 2 * len(rows) + 1))
    at = {(r.conv_id, r.depth): (r.enter, r.exit) for r in rows}
    for r in rows:
        if r.depth:
            above = at[r.parent_conv_id, r.depth - 1]
            assert above[0] < r.enter < r.exit < above[1]
    return [tuple(r[c] for c in NODE) for r in rows]


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(4)
    rows = [
        (rng.choice([None, *range(-12, 40)]), rng.choice([None, *range(7)]), rng.choice(["user", None]), rng.choice(["a", "é", None]))
        for _ in range(250)
    ]
    # one long conversation, repeated turns, and many conversations alike
    rows += [(15, i, "u", f"t{i}") for i in range(120)] + [(15, 7, "u", "t7")] * 30
    return rows + [(1000 + 5 * i, t, "u", f"same {t}") for i in range(40) for t in range(3)]


@pytest.mark.parametrize("rows_a_task", [list_rank.ROWS, 90])
def test_trie_equals_the_plain_version(spark, conversations, rows_a_task):
    frame = spark.createDataFrame(conversations, TURNS).withColumn("depth", F.lit("mine")).repartition(5)
    found = found_trie(frame, rows=rows_a_task)
    assert sorted(found, key=repr) == sorted(plain_trie(conversations), key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 1, "u", "x")],
        [(8, 1, "u", "x")],  # h is 1 there and its family has no first conversation: a turnless one
        [(0, None, None, None)],
        [(5, 1, "u", "x"), (6, 1, "u", "y")],
    ],
)
def test_small_tries(spark, rows):
    found = found_trie(spark.createDataFrame(rows, TURNS))
    assert sorted(found, key=repr) == sorted(plain_trie(rows), key=repr)


def test_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 20)
    rows = [(c, d, c * 1000 + m) for c in range(3) for d in range(2) for m in range(c * 50 + 1)]
    found = conversation_trie.ends_digests(spark.createDataFrame(rows, "conv_id long, depth long, member long").repartition(7))
    for r in found.collect():
        ids = ",".join(str(r.conv_id * 1000 + m) for m in range(r.conv_id * 50 + 1))
        assert r.ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()


@pytest.mark.parametrize("rows_a_task", [1000, 20])
def test_list_ranks(spark, rows_a_task):
    rng = random.Random(5)
    keys = rng.sample([(a, b) for a in range(-20, 20) for b in range(9)], 300)
    lists = [keys[:1], keys[1:120], keys[120:]]
    weight = {k: rng.randint(-3, 9) for k in keys}
    elements, want = [], set()
    for one in lists:
        total = 0
        for place, key in enumerate(one, 1):
            total += weight[key]
            want.add((*key, place, total))
            after = one[place] if place < len(one) else (None, None)
            elements.append((*key, *after, 1, weight[key]))
    frame = spark.createDataFrame(elements, "a1 long, a2 long, b1 long, b2 long, place long, w long").repartition(4)
    assert {tuple(r) for r in list_rank.ranks(frame, ["place", "w"], rows_a_task).collect()} == want
    assert list_rank.ranks(frame.limit(0), ["place", "w"]).count() == 0


# --- hard negatives ------------------------------------------------------------------------------


def plain_negatives(rows):
    kept = set()
    for v, label, e in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.add((v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, tuple(math.floor(256 * x) for x in e)))
    kept = list(kept)
    width = max((len(e) for *_, e in kept), default=0)
    vectors = np.array([e + (0,) * (width - len(e)) for *_, e in kept], np.int64).reshape(len(kept), width)
    out = []
    for i, (v, label, _) in enumerate(kept):
        if v is None or v % 100:
            continue
        scores = (vectors @ vectors[i]).tolist()
        order = sorted(range(len(kept)), key=lambda j: (-scores[j], kept[j][0] is None, kept[j][0] or 0, kept[j][1]))
        for p in [j for j in order if j != i and kept[j][1] == label][:5]:
            far = [j for j in order if kept[j][1] != label and 30 * scores[p] <= 100 * scores[j] <= 90 * scores[p]]
            out += [(v, kept[p][0], rank, kept[j][0], scores[p], scores[j]) for rank, j in enumerate(far[:10], 1)]
    return sorted(out, key=repr)


def found_negatives(frame, **named):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, label=label, **named).collect()), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(6)
    parts = [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]  # many scores tie
    rows = [
        (rng.choice([None, *range(0, 1000, 50), *range(1, 300)]), rng.choice([None, 0, 1, 2]),
         rng.choice([None] + [[rng.choice(parts) for _ in range(rng.choice([3, 20, 20]))] for _ in range(9)]))
        for _ in range(500)
    ]
    rows += [(100, 1, [1.0, None]), (200, 1, [float("nan")]), (300, 1, [float("inf")]), (400, 2, []), (500, 2, [3e9, 1.0])]
    # many copies of one vector, and whole rows repeated
    return rows + [(5000 + i, 1, [0.5] * 20) for i in range(200)] + rows[:80]


VECTORS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("values", [hard_negatives.VALUES, 900])
def test_negatives_equal_all_pairs(spark, vectors, values):
    frame = spark.createDataFrame(vectors, VECTORS).withColumn("rank", F.lit("mine")).repartition(3)
    assert found_negatives(frame, values=values) == plain_negatives(vectors)


def test_small_tables_of_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert found_negatives(empty) == []
    for rows in ([(100, 1, [])], [(100, 1, [1.0])], [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [1.0])]):
        assert found_negatives(spark.createDataFrame(rows, VECTORS)) == plain_negatives(rows)


def test_the_index_omits_what_norms_cover(spark):
    rng = np.random.default_rng(7)

    def block(data, low):
        n = len(data)
        row = {"n": n, "width": data.shape[1], "kind": "<i8", "data": data.astype("<i8").tobytes(), "unnamed": np.zeros(n, bool).tobytes()}
        ids = np.arange(n).tobytes()
        wanted = {"run": ids, "wanted": ids, "low": np.full(n, low, np.int64).tobytes(), "high": np.full(n, 1 << 60, np.int64).tobytes()}
        return hard_negatives.Block({**row, "keys": ids, "ids": ids, "labels": ids, **wanted})

    decaying = (rng.normal(size=(300, 32)) * 100 / np.arange(1, 33)).astype(np.int64)
    queries = (rng.normal(size=(9, 32)) * 100 / np.arange(1, 33)).astype(np.int64)
    scores = queries @ decaying.T
    low = int(np.quantile(scores, 0.99))
    index = hard_negatives.Index(block(decaying, 0), block(queries, low))
    # far fewer entries than numbers, and yet every score at or above the threshold
    assert sum(index.indexed) * hard_negatives.GROUP < decaying.size / 2
    everything = np.arange(np.count_nonzero(index.groups))
    for q in range(len(queries)):
        rows, own = index.reaching(q, everything, low)
        assert sorted(index.rows[rows].tolist()) == np.flatnonzero(scores[q] >= low).tolist()
        assert (own == scores[q][index.rows[rows]]).all()
