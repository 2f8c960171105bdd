"""Exact BM25 top-k: sharded inverted indexes, searched by block-max WAND and merged.

A task turns its documents into shards of about ``SHARD_BYTES`` of text, each with its own inverted index,
so building shuffles nothing. A posting list is cut into blocks of ``BLOCK`` documents that carry the
largest term frequency and the least length in them, which bound a block's score whatever the
corpus statistics turn out to be. Document frequencies, the number of documents and the mean length
are summed over all shards, and every shard is searched with them; the best ``k`` of each shard then
contain the best ``k`` of all.

A term's part of a score is rounded to millionths, so a score is the same in whatever order its parts
are summed; equal scores rank by document id.

Queries come in blocks of at most ``QUERY_BLOCK`` whose terms go to every task; the postings sent to a
search are those of the block's terms alone.

Defined cases: a null or empty text is a document of length zero without terms; a null document id
ranks before others at equal scores; a query without known words finds nothing; documents without a
word of the query are not found; repeated documents are found as often as they occur; repeated query
ids with different texts are separate queries of one id; empty tables give no rows; other columns are
left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import lean, saved
from tagloom.llm.contamination import words

K1, B = 1.2, 0.75
MICRO = 1e6
BLOCK = 64
SHARD_BYTES = 16 << 20
QUERY_BLOCK = 1000
#: Index rows that a task hands over at once.
ROWS = 10_000
NO_DOCUMENT = -(1 << 63)
#: A row a block of a term's postings. A shard's documents, their lengths and the sum of these (in
#: ``most``) are the row whose term is null.
INDEX = "shard long, term string, block int, size int, docs binary, counts binary, most int, least int"


def _counted(text: str, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's distinct words, new words numbered on, and how often each occurs."""
    found = Counter(words(text))
    terms = np.fromiter((number.setdefault(w, len(number)) for w in found), "<i4", len(found))
    return terms, np.fromiter(found.values(), "<i4", len(found))


def _shard_rows(
    shard: int, docs: list[tuple[int, np.ndarray, np.ndarray]], number: dict[bytes, int]
) -> Iterator[list[tuple]]:
    """The index rows of one shard; documents are numbered in the order of their ids."""
    docs.sort(key=lambda d: d[0])
    lengths = np.array([c.sum() for _, _, c in docs], "<i4")
    ids = np.array([i for i, _, _ in docs], "<i8")
    yield [(shard, None, 0, len(docs), ids.tobytes(), lengths.tobytes(), int(lengths.sum()), 0)]
    term = np.concatenate([t for _, t, _ in docs])
    order = np.argsort(term, kind="stable")
    term, counts = term[order], np.concatenate([c for _, _, c in docs])[order]
    place = np.repeat(np.arange(len(docs), dtype="<i4"), [len(t) for _, t, _ in docs])[order]
    docs.clear()
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, int)
    rows = []
    for name, begin, end in zip(number, starts.tolist(), [*starts[1:].tolist(), len(term)]):
        for block, a in enumerate(range(begin, end, BLOCK)):
            b = min(a + BLOCK, end)
            most, least = int(counts[a:b].max()), int(lengths[place[a:b]].min())
            rows.append((shard, name.decode(), block, b - a, place[a:b].tobytes(), counts[a:b].tobytes(), most, least))
        if len(rows) > ROWS:
            yield rows
            rows = []
    yield rows


def index(documents: DataFrame, doc: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``documents``, kept in the shared folder."""
    given = documents.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    names = [part.split(" ")[0] for part in INDEX.split(", ")]

    # of a document only its counts are held: its words as a list take ten times the text
    @lean
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, size, shard = [], {}, 0, TaskContext.get().partitionId() << 24

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal held, number, size, shard
            for rows in _shard_rows(shard, held, number):
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            held, number, size, shard = [], {}, 0, shard + 1

        for batch in batches:
            for doc, content in zip(batch.column(0), batch.column(1)):
                content = content.as_py()
                held.append((NO_DOCUMENT if not doc.is_valid else doc.as_py(), *_counted(content or "", number)))
                size += len(content or "")
                if size > shard_bytes:
                    yield from built()
        if held:
            yield from built()

    return saved(given.mapInArrow(shards, INDEX), "bm25-index")


class Term:
    """A cursor over one term's postings in a shard."""

    def __init__(self, weight: float, blocks: list[dict], norms: np.ndarray, bound):
        self.weight = weight
        self.lasts = [int(b["docs"][-1]) for b in blocks]
        self.bounds = [scored(weight, b["most"], bound(b["least"])) for b in blocks]
        self.bound = max(self.bounds)
        self.blocks, self.norms = blocks, norms
        self.block, self.at = 0, 0
        self.docs = blocks[0]["docs"].tolist()
        self.doc = self.docs[0]

    def seek(self, doc: int, end: int) -> None:
        """Move to the first posting at or behind ``doc``; ``end`` where there is none."""
        block = self.block
        while block < len(self.lasts) and self.lasts[block] < doc:
            block += 1
        if block == len(self.lasts):
            self.block, self.doc = block, end
            return
        if block != self.block:
            self.block, self.at = block, 0
            self.docs = self.blocks[block]["docs"].tolist()
        docs, at = self.docs, self.at
        while docs[at] < doc:
            at += 1
        self.at, self.doc = at, docs[at]

    def block_bound(self, doc: int) -> tuple[int, int]:
        """The bound of the block that may hold ``doc``, and the last document it speaks for."""
        block = self.block
        while block < len(self.lasts) and self.lasts[block] < doc:
            block += 1
        return (self.bounds[block], self.lasts[block]) if block < len(self.lasts) else (0, 1 << 62)

    def score(self) -> int:
        return scored(self.weight, int(self.blocks[self.block]["counts"][self.at]), float(self.norms[self.doc]))


def scored(weight: float, count: int, norm: float) -> int:
    """A term's part of a score in millionths."""
    return math.floor(weight * (count * (K1 + 1)) / (count + norm) * MICRO + 0.5)


def norm(length, mean: float):
    return K1 * (1 - B + B * length / mean)


def wand(terms: list[Term], end: int, k: int) -> list[tuple[int, int]]:
    """The best (score, -document) of a shard, by block-max WAND."""
    best: list[tuple[int, int]] = []
    terms = [t for t in terms if t.doc < end]
    while terms:
        terms.sort(key=lambda t: t.doc)
        least = best[0][0] if len(best) == k else -1
        # documents come in the order of their ids, so one that only equals the last of the best loses
        total, pivot = 0, -1
        for i, t in enumerate(terms):
            total += t.bound
            if total > least:
                pivot = i
                break
        if pivot < 0:
            break
        doc = terms[pivot].doc
        while pivot + 1 < len(terms) and terms[pivot + 1].doc == doc:
            pivot += 1
        bounds = [t.block_bound(doc) for t in terms[: pivot + 1]]
        if sum(b for b, _ in bounds) <= least:
            # no document of these blocks can enter: go behind the first block that ends
            after = min([last + 1 for _, last in bounds] + [t.doc for t in terms[pivot + 1 : pivot + 2]])
            after = max(after, doc + 1)
            for t in terms[: pivot + 1]:
                if t.doc < after:
                    t.seek(after, end)
        elif terms[0].doc == doc:
            score = sum(t.score() for t in terms[: pivot + 1])
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            elif (score, -doc) > best[0]:
                heapq.heapreplace(best, (score, -doc))
            for t in terms[: pivot + 1]:
                t.seek(doc + 1, end)
        else:
            for t in terms[:pivot]:
                if t.doc < doc:
                    t.seek(doc, end)
        terms = [t for t in terms if t.doc < end]
    return sorted(best, reverse=True)


def _searched(index: DataFrame, queries: list[tuple], k: int, totals: tuple[int, int], kind: str) -> DataFrame:
    """The best documents of each shard for a block of queries (id, terms with their numbers)."""
    spark = index.sparkSession
    listed = sorted({t for _, own in queries for t in own})
    known = spark.createDataFrame([(t,) for t in listed], "term string")
    rows = index.join(known, "term", "left_semi").select(*index.columns)
    held = rows.groupBy("term").agg(F.sum("size").alias("df")).collect()
    documents, length = totals
    mean = length / documents if length else 1.0
    weight = {r.term: math.log(1 + (documents - r.df + 0.5) / (r.df + 0.5)) for r in held}
    queries = [(q, {t: n * weight[t] for t, n in own.items() if t in weight}) for q, own in queries]

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, postings, ids, norms = None, {}, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if postings:
                        yield results(postings, ids, norms)
                    shard, postings = row["shard"], {}
                docs = np.frombuffer(row["docs"], "<i8" if row["term"] is None else "<i4")
                counts = np.frombuffer(row["counts"], "<i4")
                if row["term"] is None:
                    ids, norms = docs, norm(counts.astype(float), mean)
                else:
                    block = {"docs": docs, "counts": counts, "most": row["most"], "least": row["least"]}
                    postings.setdefault(row["term"], []).append(block)
        if postings:
            yield results(postings, ids, norms)

    def results(postings: dict, ids: np.ndarray, norms: np.ndarray) -> pa.RecordBatch:
        found = []
        for number, (_, own) in enumerate(queries):
            terms = [
                Term(w, postings[t], norms, lambda least: norm(float(least), mean)) for t, w in own.items() if t in postings
            ]
            found += [(number, int(ids[-doc]), score) for score, doc in wand(terms, len(ids), k)]
        columns = list(zip(*found)) or [()] * 3
        kinds = (pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query", "doc", "score"])

    # a shard's documents come first, then each term's blocks in order
    rows = rows.union(index.where("term IS NULL"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "term", "block")
    found = dealt.mapInArrow(search, "query int, doc long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(queries)], f"query int, query_id {kind}")
    doc = F.when(F.col("doc") != NO_DOCUMENT, F.col("doc"))
    return found.join(F.broadcast(names), "query").select(
        "query_id", "rank", doc.alias("doc_id"), (F.col("score") / MICRO).alias("score")
    )


def search(index: DataFrame, queries: DataFrame, k: int = 10, query: str = "item_id", text: str = "text") -> DataFrame:
    """query_id, rank, doc_id and score of the ``k`` best documents of each query."""
    given = queries.select(F.col(f"`{query}`").alias("query_id"), F.col(f"`{text}`").alias("text"))
    kind = given.schema["query_id"].dataType.simpleString()
    totals = index.where("term IS NULL").agg(F.sum("size"), F.sum("most")).first()
    empty = given.sparkSession.createDataFrame([], f"query_id {kind}, rank int, doc_id long, score double")
    if not totals[0]:
        return empty
    # the queries are a stated set; their texts are read block by block
    blocks = -(-given.count() // QUERY_BLOCK)
    numbered = given.withColumn("block", F.pmod(F.xxhash64("query_id", "text"), F.lit(max(1, blocks))))
    found = empty
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).orderBy(F.col("query_id").asc_nulls_first(), "text").collect()
        own = [(r.query_id, Counter(w.decode() for w in words(r.text))) for r in rows if r.text]
        if any(c for _, c in own):
            found = found.union(_searched(index, own, k, tuple(totals), kind))
    return found
