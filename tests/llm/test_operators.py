"""Each corpus operator against a plain version, on rows with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import (
    bm25,
    contamination,
    quality,
    rank_bpe,
    simhash_ball,
    suffix_array,
    suffix_dedup,
    token_files,
    toxicity,
    transcripts,
    warc,
)
from tagloom.llm.graph import components
from tagloom.session import scratch_path

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "on", "é", "ßo", "the"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 90)) for _ in range(60)]
    shared = sentence(rng, 40)
    texts += [shared, f"x {shared} y", f"{texts[3]}.", texts[3], texts[3].upper(), f"{shared} {texts[5]}"]
    texts += [None, "", " \n\t ", "a", "<|endoftext|>", " a  b\n\n c \n", "x" * 5000, "ab" * 3000, "don't STOP\r\n　é\x1c<|endoftext|>z"]
    texts += [sentence(rng, 12_000)]
    out = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), len(t or ""), "kept") for i, t in enumerate(texts)]
    return [*out, out[4], (None, shared, None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def multiset(found):
    return sorted(found, key=repr)


def test_rank_bpe_equals_the_library(docs, none, rows):
    library = Tokenizer.from_file(BYTE_BPE)
    coded = rank_bpe.decode(rank_bpe.encode(docs, BYTE_BPE), BYTE_BPE)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert multiset((r.doc_id, tuple(r.ids), r.decoded) for r in coded.collect()) == multiset(want)
    assert rank_bpe.encode(none, BYTE_BPE).count() == 0
    once = rank_bpe.round_trip(docs, BYTE_BPE)
    assert once.columns == coded.columns
    assert multiset((r.doc_id, tuple(r.ids), r.decoded) for r in once.collect()) == multiset(want)
    assert rank_bpe.round_trip(none, BYTE_BPE, decoded="text").count() == 0


def test_rank_bpe_on_random_characters():
    library, own, rng = Tokenizer.from_file(BYTE_BPE), rank_bpe.load(BYTE_BPE), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t'.aAsdtlmrevé9٣ß中  \x1c😀") for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_merge_alike():
    bpe, rng = rank_bpe.load(BYTE_BPE), random.Random(6)
    for _ in range(200):
        word = bytes(rng.choice(b"theinga ") for _ in range(rng.randint(2, 90)))
        assert bpe.merge(word) == bpe._merge_long([bpe.byte_ids[b] for b in word])


def test_token_files(spark, docs, none, rows):
    library = Tokenizer.from_file(WORD_BPE)
    found = token_files.round_trip(spark, docs, WORD_BPE, 2).collect()
    want, start = [], 0
    for row in sorted(found, key=lambda r: r.start):
        assert row.start == start
        start += row.n_tokens
    for doc, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert multiset((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in found) == multiset(want)
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert token_files.round_trip(spark, none, WORD_BPE, 2).count() == 0


def test_words_by_pieces_equal_the_library():
    library, own, rng = Tokenizer.from_file(WORD_BPE), token_files.WordEncoder(WORD_BPE), random.Random(8)
    assert own.by_pieces
    marks = [*" \n\t\r'.,-<|>!aAsSdDtTlLmMrReEvVéÉßØ×÷²ªµ9٣中\u0301İΣﬁ\x1c\x85\u00a0😀", "<|endoftext|>", "'ll", "'RE"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, "q" * 200]
    for begin in range(0, len(texts), 500):
        some = texts[begin : begin + 500]
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in some]
        assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(some, 2)] == want
    assert not token_files.WordEncoder(BYTE_BPE).by_pieces


def test_contamination(spark, docs, none, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(text):
        return word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    items = [(1, rows[60][1]), (10, rows[3][1].upper()), (2, rows[60][1]), (3, "The"), (4, ""), (5, None), (None, "ta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        own = split(text)
        for i in range(max(1, len(own) - 12) if own and item is not None else 0):
            windows.setdefault(tuple(own[i : i + 13]), set()).add(str(item))
    want = []
    for doc, text, *_ in rows:
        own, hit, found = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in windows:
                    found |= windows[tuple(own[i : i + size])]
                    hit |= set(range(i, i + size))
        want.append((doc, len(own), len(hit), tuple(sorted(found))))
    got = contamination.contamination(docs, bench).collect()
    assert multiset((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == multiset(want)
    for r in got:
        spanned = sum(len(split(r.text[s.start : s.end])) for s in r.spans)
        assert spanned == r.n_hit
    assert contamination.contamination(none, bench).count() == 0
    assert {r.n_hit for r in contamination.contamination(docs, bench.limit(0)).collect()} == {0}


def test_benchmark_size_is_checked(spark, docs, monkeypatch):
    monkeypatch.setattr(contamination, "MOST_BYTES", 3)
    with pytest.raises(ValueError, match="give it in parts"):
        contamination.contamination(docs, spark.createDataFrame([(1, "four")], "item_id long, text string"))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash(docs, none, rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    least = {}
    roots = plain_components(fps)
    for (doc, *_), r in zip(rows, roots):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    want = [(doc, f"{fp:016x}", least.get(r)) for (doc, *_), fp, r in zip(rows, fps, roots)]
    found = simhash_ball.near_duplicates(docs).select("doc_id", simhash_ball.hex_digits().alias("h"), "component_id")
    assert multiset(map(tuple, found.collect())) == multiset(want)
    assert simhash_ball.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("parts", "most"), [(2, 8192), (2, 3), (1, 8192)])
def test_links_connect_exactly_the_near_fingerprints(spark, parts, most):
    rng, fps = random.Random(parts + most), []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            near = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                near ^= 1 << b
            fps.append(near)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    linked = {r.u: r.v for r in components(simhash_ball.links(frame, parts=parts, most=most)).collect()}
    by_root = {}
    for f, r in zip(signed, plain_components(fps)):
        by_root.setdefault(r, set()).add(f)
    for own in by_root.values():
        assert {linked.get(f, f) for f in own} == {min(own)}


def test_components_of_paths_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (100, 101)]
    found = {r.u: r.v for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(rows):
    out = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for other, more, *_ in rows if doc is not None else []:
            if other is not None and other < doc and more:
                for i in range(len(data) - 49):
                    if data[i : i + 50] in more.encode():
                        gone[i : i + 50] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc, len(data), int(gone.sum()), int((edges == 1).sum()), sha(kept)))
    return out


@pytest.mark.parametrize("crowded", [1 << 20, 60])
def test_suffix_dedup(spark, rows, none, crowded):
    short = [r for r in rows if len(r[1] or "") < 4000]
    frame = spark.createDataFrame(short, SCHEMA).repartition(3)
    found = suffix_dedup.deduplicated(frame, shards=5, crowded=crowded).collect()
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), sha(bytes(r.kept))) for r in found]
    assert multiset(got) == multiset(plain_removal(short))
    assert {r.ids for r in found} == {"kept", None}
    assert suffix_dedup.deduplicated(none).count() == 0


@pytest.mark.parametrize("small", [1024, 0])
def test_suffix_arrays(monkeypatch, small):
    monkeypatch.setattr(suffix_array, "SMALL_ALPHABET", small)
    rng = random.Random(8)
    for _ in range(300):
        k = rng.choice([1, 2, 3, 26])
        t = [rng.randint(1, k) for _ in range(rng.randint(1, 60))] + [0]
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_array.suffix_array(np.array(t), k + 1).tolist() == want
        common = suffix_array.permuted_prefixes(np.array(t), np.array(want))
        for a, b in zip(want, want[1:]):
            n = 0
            while a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert common[b] == n


def test_warc(spark, tmp_path):
    rng = random.Random(9)
    pages = [(i, f"http://h{i % 7}.example.org/p{i % 40}?q={i}", sentence(rng, 5), 1) for i in range(90)]
    pages += [(100 + i, "http://h1.example.org/same", pages[3][2], 1) for i in range(5)]
    pages += [(200, None, None, 1), (201, "not a url\r\nX: y", "", 1), (202, "http://[bad", "é" * 9, 1), (-5, "http://a.b/", pages[3][2], 1)]
    pages += [(None, "http://a.b/", pages[4][2], 1), pages[0]]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, refers_to int").repartition(3)
    folder = scratch_path(spark, "warc-test")
    captures = warc.write(frame, f"{folder}/records")
    shards = warc.index(captures, f"{folder}/index")
    back = warc.read(warc.look_up(shards, f"{folder}/index", frame.select("url")), f"{folder}/records").collect()
    most = {}
    for page, _, html, _ in pages:
        if page is not None:
            most[html or ""] = max(page, most.get(html or "", page))
    want = []
    for page, _, html, _ in pages:
        data = (html or "").encode()
        refers = most[html or ""] if page is not None and page < most[html or ""] else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, "revisit" if refers is not None else "response", refers))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert multiset(got) == multiset(want)
    texts = {(p, h or "") for p, _, h, _ in pages}
    assert all((r.page_id, r.payload.decode()) in texts for r in back if r.record_type == "response")
    asked = spark.createDataFrame([("http://h1.example.org/same",), ("http://none/",)] * 2, "url string")
    one = warc.look_up(shards, f"{folder}/index", asked).collect()
    assert sorted(r.page_id for r in one) == [100, 101, 102, 103, 104]
    assert warc.write(frame.limit(0), f"{folder}/none").count() == 0


def test_bm25_equals_scoring_everything(spark, docs, none, rows):
    index = bm25.index(docs, shard_bytes=3000)
    asked = [(1, rows[60][1]), (2, "ta the the rion é"), (3, None), (4, "unknownword"), (5, rows[7][1]), (5, "on on on")]
    queries = spark.createDataFrame(asked, "item_id long, text string")
    found = bm25.search(index, queries, k=4).collect()
    texts = [(d, [w.decode() for w in contamination.words(t or "")]) for d, t, *_ in rows]
    mean = sum(len(w) for _, w in texts) / len(texts)
    want = []
    for item, text in asked:
        own = [w.decode() for w in contamination.words(text or "")]
        scores = []
        for doc, held in texts:
            total = 0
            for w in set(own) & set(held):
                df = sum(w in other for _, other in texts)
                weight = own.count(w) * np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
                tf = held.count(w)
                total += bm25.scored(float(weight), tf, bm25.norm(len(held), mean))
            if total:
                scores.append((-total, -(1 << 63) if doc is None else doc))
        want += [(item, i + 1, None if d == -(1 << 63) else d, -s / 1e6) for i, (s, d) in enumerate(sorted(scores)[:4])]
    assert multiset(map(tuple, found)) == multiset(want)
    assert bm25.search(bm25.index(none), queries).count() == 0


def test_bm25_index_holds_counts_not_words(spark, docs, monkeypatch):
    built = []
    monkeypatch.setattr(bm25, "saved", lambda found, name: found)
    monkeypatch.setattr(bm25, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: built.append(run))
    bm25.index(docs)
    texts = [" ".join(f"w{(i * j) % 500}" for j in range(4000)) for i in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc", "text"]) for i, t in enumerate(texts)]
    tracemalloc.start()
    rows = sum(b.num_rows for b in built[0](iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500 and peak < 5 * sum(map(len, texts))


def judged(spark, n=700):
    rng, out = random.Random(11), []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        words = sentence(rng, rng.randint(8, 60)).split()
        words = [w.upper() + "!!" for w in words] if bad else words
        words = words + [rng.choice(["moron", "scum", "idiot"])] * 2 if toxic else words
        out.append((i, " ".join(words), "en", "s1", len(words), int(not bad), int(toxic)))
    docs = spark.createDataFrame([r[:5] for r in out], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], r[6]) for r in out if r[0] % 3], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: (r[5], r[6]) for r in out}


def test_quality_on_held_out_documents(spark, docs, none):
    own, labels, truth = judged(spark)
    found = quality.score(own, labels).where("doc_id % 3 = 0").collect()
    right = [(r.score >= 0.5) == truth[r.doc_id][0] for r in found]
    assert np.mean(right) > 0.97
    model = quality.fit(own, labels)
    odd = quality.apply(docs.withColumn("score", F.lit("x")), model)
    assert odd.count() == docs.count() and odd.where("score IS NULL OR isnan(score)").count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.apply(none, model).count() == 0


def test_toxicity_on_held_out_documents(spark, docs, none):
    own, labels, truth = judged(spark)
    labels = labels.withColumn("low", 1 - F.col("quality"))
    found = toxicity.score(own, labels, ["low", "toxic"]).where("doc_id % 3 = 0").collect()
    assert np.mean([(r.p_toxic >= 0.5) == truth[r.doc_id][1] for r in found]) > 0.97
    odd = toxicity.score(docs.union(own.select("*", F.lit("x"))), labels, ["low", "toxic"])
    assert odd.where("p_toxic IS NULL").count() == 0
    assert toxicity.score(none.union(own.select("*", F.lit("x")).limit(0)), labels.limit(0), ["toxic"]).count() == 0


def talks(spark, n=120):
    rng, out = random.Random(12), []
    for c in range(n):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * rng.randint(1, 4)
        for turn, role in enumerate(roles):
            size = {"user": 8, "assistant": 60, "system": 12}[role]
            out.append((c, turn, role, "\n".join(sentence(rng, size) for _ in range(1 + (role == "assistant")))))
    return out, spark.createDataFrame(out, "conv_id long, turn long, role string, text string")


def test_transcripts_recover_held_out_roles(spark):
    rows, table = talks(spark)
    table = table.union(spark.createDataFrame([(None, 1, "user", "x"), (999, None, "user", "x"), (998, 0, "user", None)], table.schema))
    lines = transcripts.written_out(table)
    model = transcripts.fit(lines.where("conv % 2 = 0"))
    found = transcripts.turns(transcripts.labelled(lines, model)).where("conv % 2 = 1").collect()
    truth = {(c, t): (r, x) for c, t, r, x in rows if c % 2}
    right = [truth.get((r.conv, r.turn), ("", ""))[0] == r.role for r in found]
    assert np.mean(right) > 0.93
    one = found[0]
    assert one.rendered == f"<|{one.role}|>\n{one.text}\n<|end|>"


@pytest.mark.parametrize("piece", [1, 3, 1 << 40])
def test_viterbi_in_chunks_equals_the_whole(spark, piece):
    rng, model = random.Random(13), transcripts.default_model()
    lines = [
        (c, i, rng.choice(["User: a?", "Assistant: " + "b " * 90, "", None, "plain line", "System: c", "more " * 70]))
        for c in range(6)
        for i in range(rng.randint(1, 25))
    ]
    frame = spark.createDataFrame(lines, "conv long, pos long, line string")
    found = transcripts.labelled(frame, model, piece).collect()
    for c in range(6):
        own = [x for d, _, x in lines if d == c]
        want = [transcripts.STATES[s] for s in transcripts.viterbi(model, own)]
        assert [(r.role, r.begins) for r in sorted(found, key=lambda r: r.pos) if r.conv == c] == want
    assert transcripts.labelled(frame.limit(0), model).count() == 0
