"""The named queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import (
    bm25,
    contamination,
    conversation_trie,
    hard_negatives,
    quality,
    quartile_digest,
    rank_bpe,
    simhash_ball,
    suffix_dedup,
    token_files,
    toxicity,
    transcripts,
    warc,
)
from tagloom.llm.common import table
from tagloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query by its function's name."""
    QUERIES[run.__name__] = run
    return run


@query
def op1_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item whose id is divisible by 20."""
    index = bm25.index(table(spark, sf_dir, "documents"))
    asked = table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0)
    return bm25.search(index, asked)


ORACLES["op1_bm25_wand"] = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+')) AS word
    FROM documents),
asked AS (
    SELECT item_id, word, count(*) AS uses FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[0-9a-z\x{80}-\x{10FFFF}]+')) AS word
        FROM benchmark WHERE item_id % 20 = 0)
    GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS length FROM words GROUP BY doc_id),
total AS (
    SELECT (SELECT count(*) FROM documents) AS documents,
        (SELECT sum(length) FROM lengths)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
postings AS (
    SELECT doc_id, word, count(*) AS uses FROM words
    WHERE word IN (SELECT word FROM asked) GROUP BY ALL),
weights AS (
    SELECT word, ln(1 + (documents - count(*) + 0.5) / (count(*) + 0.5)) AS weight
    FROM postings, total GROUP BY word, documents),
parts AS (
    SELECT a.item_id, p.doc_id,
        floor(a.uses * w.weight * (p.uses * 2.2::DOUBLE)
            / (p.uses + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l.length / t.mean))
            * 1000000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS part
    FROM asked a JOIN postings p USING (word) JOIN weights w USING (word)
        JOIN lengths l USING (doc_id), total t),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS micro FROM parts GROUP BY ALL),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY micro DESC, doc_id) AS rank FROM scores)
SELECT item_id AS query_id, rank::INTEGER AS rank, doc_id, micro / 1000000.0::DOUBLE AS score
FROM ranked WHERE rank <= 10
"""


@query
def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of each labelled category for every document, low quality before toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    found = toxicity.score(docs, labels, ["low_quality", "toxic"])
    flag = F.col("p_toxic") >= toxicity.TOXIC_FROM
    return found.select("doc_id", "p_low_quality", "p_toxic", flag.alias("toxic"))


@query
def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back through the capture index."""
    pages = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    shards = warc.index(warc.write(pages, f"{folder}/records"), f"{folder}/index")
    captures = warc.look_up(shards, f"{folder}/index", pages.select("url"))
    back = warc.read(captures, f"{folder}/records")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLES["op3_warc_index"] = r"""
WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
digests AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS original FROM payloads),
lettered AS (
    -- base 32: five hex digits are four letters
    SELECT *, array_to_string(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i * 5 + 1, 5))::BIGINT >> s) & 31) + 1, 1)))), '') AS digest
    FROM digests)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM lettered
"""


@query
def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_ball.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_ball.hex_digits().alias("fingerprint"), "component_id")


@query
def op5_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns recovered from conversations written out as raw transcripts."""
    lines = transcripts.written_out(table(spark, sf_dir, "conversations"))
    model = transcripts.fit(lines)
    found = transcripts.turns(transcripts.labelled(lines, model))
    return found.select(F.col("conv").alias("conv_id"), "turn", "role", "n_lines", "text", "rendered")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to documents with smaller ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.deduplicated(docs)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = rank_bpe.decode(rank_bpe.encode(docs, BYTE_BPE).drop("text"), BYTE_BPE)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality scores of every document and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, table(spark, sf_dir, "labels"))
    kept = F.col("score") >= quality.REJECT_BELOW
    return found.select("doc_id", *quality.SCORES, kept.alias("kept"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as flat token files and read back."""
    docs = table(spark, sf_dir, "documents")
    back = token_files.round_trip(spark, docs, WORD_BPE, END_ID)
    # the ids are little-endian 32-bit integers, of which crc32 takes the bytes
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contamination.contaminated().alias("contaminated"),
    )


ORACLES["op10_contamination"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents),
asked AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
    SELECT item, least(len(w), 13) AS size, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
        lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) AS part
    FROM asked WHERE len(w) > 0),
places AS (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS place
    FROM texts, (SELECT DISTINCT size FROM windows)),
hits AS (
    SELECT DISTINCT doc_id, place, p.size, item
    FROM places p JOIN windows x ON x.size = p.size
        AND x.part = array_to_string(list_slice(p.w, p.place, p.place + p.size - 1), ' ')),
covered AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit
    FROM (SELECT doc_id, unnest(range(place, place + size)) AS spot FROM hits) GROUP BY doc_id),
found AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op11_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest against that of its edited text and that of the next document."""
    return quartile_digest.edited(table(spark, sf_dir, "documents"))


ORACLES["op11_quartile_digest"] = r"""
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS text, lead(doc_id) OVER (ORDER BY doc_id) AS next_id,
        coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next
    FROM documents),
docs AS (
    SELECT doc_id, coalesce(next_id, min(doc_id) OVER ()) AS next_id, text,
        left(text, length(text) - length(text) // 4) || left(next, length(text) // 4) AS edited
    FROM given),
texts AS (
    SELECT doc_id, 0 AS kind, text FROM docs UNION ALL SELECT doc_id, 1, edited FROM docs),
listed AS (
    SELECT doc_id, kind, strlen(text) AS n,
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b
    FROM texts),
hashed AS (
    SELECT doc_id, kind, unnest(list_transform(range(1, n - 1), lambda i:
        (b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 2654435761 % 4294967296 // 16777216)) AS bucket
    FROM listed),
counted AS (SELECT doc_id, kind, bucket, count(*) AS c FROM hashed GROUP BY ALL),
filled AS (
    SELECT l.doc_id, l.kind, k.bucket, coalesce(c, 0) AS c
    FROM (SELECT doc_id, kind FROM listed) l, (SELECT unnest(range(256)) AS bucket) k
        LEFT JOIN counted x ON x.doc_id = l.doc_id AND x.kind = l.kind AND x.bucket = k.bucket),
sorted AS (SELECT doc_id, kind, list_sort(list(c)) AS s FROM filled GROUP BY ALL),
heads AS (
    SELECT doc_id, kind, s[64] AS q1, s[128] AS q2, s[192] AS q3,
        least(255, floor(8 * log2(n + 1)))::BIGINT AS size,
        16 * s[64] // (s[192] + 1) AS lower, 16 * s[128] // (s[192] + 1) AS middle
    FROM sorted JOIN listed USING (doc_id, kind)),
codes AS (
    SELECT doc_id, kind, bucket, (c > q1)::BIGINT + (c > q2)::BIGINT + (c > q3)::BIGINT AS code
    FROM filled JOIN heads USING (doc_id, kind)),
packed AS (
    SELECT doc_id, kind, bucket // 4 AS place, sum(code * (1 << (2 * (3 - bucket % 4))::INTEGER))::BIGINT AS byte
    FROM codes GROUP BY ALL),
prints AS (
    SELECT doc_id, kind, printf('%02x%02x', size, lower * 16 + middle) || string_agg(printf('%02x', byte), '' ORDER BY place) AS print
    FROM packed JOIN heads USING (doc_id, kind) GROUP BY doc_id, kind, size, lower, middle),
couples AS (
    SELECT doc_id, 1 AS which, doc_id AS other, 1 AS kind FROM docs
    UNION ALL SELECT doc_id, 2, next_id, 0 FROM docs),
bodies AS (
    SELECT c.doc_id, which, sum(CASE WHEN abs(a.code - b.code) = 3 THEN 6 ELSE abs(a.code - b.code) END) AS body
    FROM couples c JOIN codes a ON a.doc_id = c.doc_id AND a.kind = 0
        JOIN codes b ON b.doc_id = c.other AND b.kind = c.kind AND b.bucket = a.bucket
    GROUP BY ALL),
likes AS (
    SELECT c.doc_id, c.which, 1 - least(416, body + abs(a.size - b.size) + abs(a.lower - b.lower) + abs(a.middle - b.middle))::DOUBLE / 416 AS alike
    FROM couples c JOIN bodies USING (doc_id, which)
        JOIN heads a ON a.doc_id = c.doc_id AND a.kind = 0
        JOIN heads b ON b.doc_id = c.other AND b.kind = c.kind)
SELECT d.doc_id, length(d.text)::BIGINT AS n_chars, sha256(d.edited) AS edited_sha256, p.print AS fingerprint,
    e.print AS edited_fingerprint, x.alike AS near_edited, y.alike AS near_next
FROM docs d JOIN prints p ON p.doc_id = d.doc_id AND p.kind = 0 JOIN prints e ON e.doc_id = d.doc_id AND e.kind = 1
    JOIN likes x ON x.doc_id = d.doc_id AND x.which = 1 JOIN likes y ON y.doc_id = d.doc_id AND y.which = 2
"""


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations."""
    found = conversation_trie.families(table(spark, sf_dir, "conversations"))
    return found.drop("enter", "exit")


ORACLES["op12_conversation_trie"] = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
    -- crc32 bit by bit over the decimal digits
    SELECT conv_id, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
            lambda ch: list_transform(range(8), lambda i: (ascii(ch)::BIGINT >> i) & 1)))),
        lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
    SELECT i.conv_id, 0 AS part, t.pos, t.role, t.text
    FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 5 AND t.pos <= i.h
    UNION ALL
    SELECT i.conv_id, 1, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h),
steps AS (
    SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size,
        string_agg(md5(length(role) || ':' || role || text), '') OVER w AS prefix
    FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
rows AS (
    SELECT conv_id, 0 AS depth, 0 AS size, '' AS prefix FROM ids
    UNION ALL SELECT conv_id, depth, size, prefix FROM steps),
nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM rows GROUP BY ALL),
parents AS (
    SELECT n.*, p.prefix AS above, p.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = left(n.prefix, length(n.prefix) - 32)),
children AS (SELECT above AS prefix, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
subtree AS (
    -- a node hangs below each prefix of its smallest member's turns
    SELECT r.prefix, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
    FROM nodes n LEFT JOIN children c USING (prefix) JOIN rows r ON r.conv_id = n.conv_id AND r.depth <= n.depth
    GROUP BY ALL),
ends AS (
    SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM rows GROUP BY conv_id) GROUP BY ALL)
SELECT p.conv_id, p.depth, p.parent_conv_id, p.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
    s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM parents p LEFT JOIN children c USING (prefix) JOIN subtree s USING (prefix) LEFT JOIN ends e USING (prefix)
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for each anchor and positive, anchors being the ids divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label=label)


ORACLES["op13_hard_negatives"] = r"""
WITH vectors AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same)
    WHERE place <= 5),
negatives AS (
    SELECT p.*, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""
