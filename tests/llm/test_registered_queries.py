"""The registered queries and the pipeline over a small folder of planted tables, against brute force."""

import base64
import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from tagloom.llm.queries import BYTE_BPE, END_ID, QUERIES, WORD_BPE

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "on", "é", "the", "Mo", "ßu", "x1"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(21)
    items = [sentence(rng, n) for n in (30, 14, 13, 4)]
    passage = sentence(rng, 60)
    texts = [sentence(rng, rng.randint(20, 160)) for _ in range(40)]
    texts += [f"{sentence(rng, 10)} {item} {sentence(rng, 10)}" for item in items]
    texts += [f"{sentence(rng, 30)} {passage} {sentence(rng, 25)}" for _ in range(3)]
    words = texts[7].split(" ")
    near = [" ".join([*words[:5], "changed", *words[6:]]), texts[7], texts[7].upper()]
    texts += [*near, None, "", " \n ", "a", "<|endoftext|> don't", "Ünï中\r\n\x1c", "ab" * 400, f"{items[1]} end"]
    docs = [(i * 2, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i * 2, int(i % 5 > 0), int(i % 9 == 0)) for i in range(0, len(texts), 2)]
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 50, "<p>b</p>"]
    pages = [(i, f"https://h{i % 3}.example/p/{i}", h) for i, h in enumerate(html)]
    return {"documents": docs, "labels": labels, "benchmark": list(enumerate([*items, None])), "pages": pages}


SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
}


@pytest.fixture(scope="module")
def folder(spark, planted, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    for name, rows in planted.items():
        spark.createDataFrame(rows, SCHEMAS[name]).repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(spark, folder, name, *columns):
    found = QUERIES[name](spark, folder)
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)


def test_op3(spark, folder, planted):
    pages = [(p, (h or "").encode()) for p, _, h in planted["pages"]]
    want = []
    for page, payload in pages:
        original = max(p for p, other in pages if other == payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page, len(payload), digest, "response" if page == original else "revisit", None if page == original else original))
    found = rows_of(spark, folder, "op3_warc_index", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert found == sorted(want, key=repr)


def test_op4(spark, folder, planted):
    prints = {}
    for doc, text, *_ in planted["documents"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {d: d for d in prints}
    for _ in prints:
        least = {d: min(least[o] for o in prints if (prints[d] ^ prints[o]).bit_count() <= 4) for d in prints}
    want = [(d, f"{p:016x}", least[d]) for d, p in prints.items()]
    assert rows_of(spark, folder, "op4_simhash_ball", "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_op6(spark, folder, planted):
    texts = [(d, (t or "").encode()) for d, t, *_ in planted["documents"]]
    seen, want = set(), []
    for doc, text in sorted(texts):
        own = {text[i : i + 50] for i in range(len(text) - 49)}
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - 49):
            if text[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen |= own
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(text, gone) if not g)
        want.append((doc, len(text), int(gone.sum()), runs, sha(kept)))
    found = rows_of(spark, folder, "op6_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(want, key=repr)


def test_op7(spark, folder, planted):
    library, want = Tokenizer.from_file(BYTE_BPE), []
    library.no_truncation(), library.no_padding()
    for doc, text, *_ in planted["documents"]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = rows_of(spark, folder, "op7_rank_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(want, key=repr)


def test_op9(spark, folder, planted):
    library, want, start = Tokenizer.from_file(WORD_BPE), [], 0
    library.no_truncation(), library.no_padding()
    for doc, text, *_ in sorted(planted["documents"]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, END_ID]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = rows_of(spark, folder, "op9_token_files", "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == sorted(want, key=repr)


def judged(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    hit, met = set(), set()
    for item, wanted in items:
        asked = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (wanted or "").translate(ASCII_LOWER))
        size = min(13, len(asked))
        parts = {tuple(asked[i : i + size]) for i in range(len(asked) - size + 1)} if asked else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in parts:
                hit |= set(range(i, i + size))
                met.add(str(item))
    return len(words), len(hit), len(met), sha(",".join(sorted(met))), bool(hit) and 20 * len(hit) >= len(words)


def test_op10(spark, folder, planted):
    want = [(doc, *judged(text, planted["benchmark"])) for doc, text, *_ in planted["documents"]]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows_of(spark, folder, "op10_contamination", *columns) == sorted(want, key=repr)
    assert sum(r[-1] for r in want) >= 4


def test_op2_and_op8_judge_every_document(spark, folder, planted):
    ids = sorted(d[0] for d in planted["documents"])
    for name, scores in (("op2_toxicity_chain", ["p_low_quality", "p_toxic"]), ("op8_quality", ["content_score", "metadata_score", "score"])):
        rows = QUERIES[name](spark, folder).collect()
        assert sorted(r.doc_id for r in rows) == ids
        assert all(0 <= r[c] <= 1 for r in rows for c in scores)


def test_pipeline(spark, folder, planted):
    """Each stage on what its predecessor kept, against plain versions; the classifier's decisions are taken from op8."""
    docs = {d: t for d, t, *_ in planted["documents"]}
    kept = {r.doc_id for r in QUERIES["op8_quality"](spark, folder).collect() if r.kept}
    sets = {d: frozenset(zip(*[(docs[d] or "").encode().lower().split()[i:] for i in range(5)])) or frozenset([tuple((docs[d] or "").encode().lower().split())]) for d in kept}
    least = {d: d for d in kept}
    alike = {d: [o for o in kept if sets[d] == sets[o] or len(sets[d] & sets[o]) * 5 >= len(sets[d] | sets[o]) * 4] for d in kept}
    for _ in range(len(kept)):
        least = {d: min(least[o] for o in alike[d]) for d in kept}
    seen, left = set(), {}
    for doc in sorted(d for d in kept if least[d] == d):
        text = (docs[doc] or "").encode()
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 49):
            if text[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen |= {text[i : i + 50] for i in range(len(text) - 49)}
        cut = bytes(b for b, g in zip(text, gone) if not g).decode("utf-8", "ignore")
        left[doc] = cut if gone.any() else docs[doc]
    library, want = Tokenizer.from_file(BYTE_BPE), []
    for doc, text in left.items():
        if not judged(text, planted["benchmark"])[-1]:
            ids = library.encode(text or "", add_special_tokens=False).ids
            want.append((doc, library.decode(ids, skip_special_tokens=False), len(ids), ids))
    found = corpus_pipeline.run(spark, folder)
    rows = sorted(((r.doc_id, r.text, r.n_tokens, list(r.ids)) for r in found.collect()), key=repr)
    assert rows == sorted(want, key=repr)
    assert 0 < len(rows) < len(kept)
