"""Large landed documents, one a file, cut into their list elements or table rows by many tasks.

A JSON document is read as text with the comma as line end, so Spark deals its splits to tasks like
those of any text file. A first pass counts each split's quotes and brackets, once for the case that
it begins inside a string and once for the case that it does not; running sums over the splits of a
file tell which case holds and how deep the split begins. A second pass puts pieces together up to
the commas that separate elements. Only what reaches over the end of a split meets the next one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.session import scratch_path
from tagloom.sources.landed import table_rows

_ESCAPED = re.compile(r"\\.", re.S)
_MARKS = re.compile(r'["\\{}\[\]]')
_MEMBER = re.compile(r'\s*("(?:[^"\\]|\\.)*")\s*:', re.S)


def _split_columns(pieces: DataFrame) -> DataFrame:
    """The text with its file and the place of its split."""
    return pieces.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        "value",
    )


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], list]]:
    """(path, at, values, further columns) of the rows of one split in a batch, in order."""
    for batch in batches:
        path, at, *rest = (c.to_pylist() for c in batch.columns)
        begin = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] != at[begin] or path[i] != path[begin]:
                yield path[begin], at[begin], rest[0][begin:i], [c[begin] for c in rest[1:]]
                begin = i


def _balance(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split's quotes and change of depth, outside strings by either case at its begin."""
    found: dict[tuple[str, int], list[int]] = {}
    for path, at, values, _ in _runs(batches):
        now = found.setdefault((path, at), [0, 0, 0])
        parts = _ESCAPED.sub("", ",".join(values)).split('"')
        even, odd = (sum(map(_balance, parts[i::2])) for i in (0, 1))
        # a batch that begins after an odd number of quotes is seen from the other side
        first, second = (even, odd) if now[0] % 2 == 0 else (odd, even)
        now[0] += len(parts) - 1
        now[1] += first
        now[2] += second
    rows = [(*key, *value) for key, value in found.items()]
    columns = [list(c) for c in zip(*rows)] if rows else [[]] * 5
    kinds = [pa.string(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "at", "quotes", "outside", "inside"]
    )


_SEGMENT = "path string, at long, seq long, begins int, member string, text string, ends int"
_SEGMENT_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]


class _Cutter:
    """The state of a split while its pieces pass: depth, string, the segment so far."""

    def __init__(self, path: str, at: int, in_string: bool, depth: int, level: int):
        self.path, self.at, self.in_string, self.depth, self.level = path, at, in_string, depth, level
        fresh = at == 0 or (not in_string and 1 <= depth <= level)
        self.begins = depth if fresh else None
        self.member: str | None = None
        self.seq, self.held = 0, []

    def step(self, piece: str) -> None:
        """Take in a piece's quotes and brackets."""
        if _MARKS.search(piece):
            for part in re.split('(")', _ESCAPED.sub("", piece)):
                if part == '"':
                    self.in_string = not self.in_string
                elif not self.in_string:
                    self.depth += _balance(part)

    def segment(self, ends: int | None) -> tuple:
        text = ",".join(self.held)
        if self.begins is not None and self.begins < self.level:
            # a member of the document begins here; its key says where the next elements belong
            named = _MEMBER.match(text.lstrip().removeprefix("{") if self.begins == 0 else text)
            try:
                self.member = json.loads(named.group(1)) if named else ""
            except ValueError:
                self.member = ""
        row = (self.path, self.at, self.seq, self.begins, self.member, text, ends)
        self.seq, self.held, self.begins = self.seq + 1, [], ends
        return row

    def cut(self, pieces: list[str]) -> Iterator[tuple]:
        for piece in pieces:
            self.held.append(piece)
            self.step(piece)
            if not self.in_string and 1 <= self.depth <= self.level:
                yield self.segment(self.depth)

    def rest(self) -> Iterator[tuple]:
        if self.held:
            yield self.segment(None)


def _segments(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Cutter | None = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(_SEGMENT_KINDS)
            names = [c.split()[0] for c in _SEGMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _SEGMENT_KINDS)], names)

        for path, at, values, (in_string, depth) in _runs(batches):
            rows = []
            if now is None or (now.path, now.at) != (path, at):
                rows += now.rest() if now else []
                now = _Cutter(path, at, in_string, depth, level)
            rows += now.cut(values)
            yield table(rows)
        if now:
            yield table(list(now.rest()))

    return run


def large_json_items(spark: SparkSession, root: str, list_key: str | None) -> DataFrame:
    """``json_items`` of the documents that ``read_documents`` would read whole from ``root``.

    One row per element of the job list with source, kind, company_slug, detail_url, ``pos``
    and the variant ``raw``. A document that is not balanced, has an unreadable element or text
    behind its end, names the list twice or has no list there gives no rows; of other members
    only the balance is looked at. Two jobs run here: the splits' counts and the cut segments are stored, of which
    a row a split is read in one place.
    """
    level = 1 if list_key is None else 2
    pieces = _split_columns(spark.read.text(root, lineSep=",", recursiveFileLookup=True))
    counted = pieces.mapInArrow(_summaries, "path string, at long, quotes long, outside long, inside long")
    counted = counted.groupBy("path", "at").agg(*[F.sum(c).alias(c) for c in ("quotes", "outside", "inside")])
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    in_string = (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("in_string")
    splits = counted.select("*", in_string)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    splits = splits.select("path", "at", "in_string", "quotes", change.alias("change"))
    splits = splits.withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    splits = _saved(splits, "list-splits")

    # a row a split: Spark broadcasts it while its stored size is below the broadcast limit
    known = pieces.join(splits.select("path", "at", "in_string", "depth"), ["path", "at"])
    known = known.select("path", "at", "value", "in_string", "depth")
    cut = _saved(known.mapInArrow(_segments(level), _SEGMENT), "list-segments")

    # segments are numbered through a file; members reach over the splits that name none
    by_split = cut.groupBy("path", "at").agg(
        F.count("ends").alias("ended"), F.max_by("member", F.when(F.col("member").isNotNull(), F.col("seq"))).alias("named")
    )
    offsets = by_split.select(
        "path", "at",
        F.coalesce(F.sum("ended").over(earlier), F.lit(0)).alias("before"),
        F.last("named", ignorenulls=True).over(earlier).alias("came"),
    )
    offsets = _saved(offsets, "list-offsets")
    numbered = cut.join(offsets, ["path", "at"]).select(
        "path", "at", "begins", "text", "ends", "seq",
        (F.col("before") + F.col("seq")).alias("number"),
        F.coalesce("member", "came").alias("member"),
    )
    # what begins or ends at a split's edge is put together; all other segments are whole
    edge = F.col("begins").isNull() | F.col("ends").isNull()
    parts = numbered.where(edge).groupBy("path", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), ",").alias("text"),
        F.max("begins").alias("begins"),
        F.max("ends").alias("ends"),
        # a fragment inherits the member that its first one names
        F.min_by("member", "at").alias("member"),
    )
    names = ["path", "number", "begins", "ends", "member", "text"]
    segments = numbered.where(~edge).select(*names).unionByName(parts.select(*names))

    starts = F.col("begins") < level
    text = F.col("text")
    if list_key is None:
        inner = F.when(starts, F.regexp_extract(text, r"^(?s)\s*\[(.*)$", 1)).otherwise(text)
        closing = r"(?s)\]\s*$"
    else:
        segments = segments.where(F.col("member") == list_key)
        opening = r'^(?s)\s*\{?\s*"(?:[^"\\]|\\.)*"\s*:\s*\[(.*)$'
        inner = F.when(starts, F.regexp_extract(text, opening, 1)).otherwise(text)
        closing = r"(?s)\]\s*\}?\s*$"
    last = F.col("ends").isNull() | (F.col("ends") < level)
    opened = ~starts | F.rlike(text, F.lit(r"^(?s)\s*\[" if list_key is None else opening))
    closed = ~last | F.rlike(inner, F.lit(closing))
    element = F.when(last, F.regexp_replace(inner, closing, "")).otherwise(inner)
    rows = segments.select("path", "number", starts.alias("starts"), (opened & closed).alias("ok"), element.alias("element"), last.alias("last"))
    # a list without elements is one blank segment
    blank = F.col("starts") & F.col("last") & F.rlike("element", F.lit(r"^\s*\z"))
    # read inside a list in an object, where text after a complete value or list is an error
    alone = F.try_parse_json(F.concat(F.lit('{"x":['), "element", F.lit("]}")))
    rows = rows.withColumn("blank", blank).withColumn("alone", F.try_variant_get(alone, "$.x", "array<variant>"))
    balanced = splits.groupBy("path").agg(F.sum("change").alias("depth"), F.sum("quotes").alias("quotes"))
    fine = F.bool_and(F.col("ok") & (F.coalesce(F.size("alone") == 1, F.lit(False)) | F.col("blank")))
    files = rows.groupBy("path").agg(fine.alias("fine"), F.min("number").alias("first"), F.count_if("starts").alias("lists"))
    files = files.where("fine AND lists = 1").join(balanced.where("depth = 0 AND quotes % 2 = 0"), "path")
    kept = rows.where("NOT blank").join(files.select("path", "first"), "path")
    return kept.select(
        F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"),
        F.lit("list").alias("kind"),
        F.regexp_extract("path", "/company=([^/]+)/", 1).alias("company_slug"),
        F.lit(None).cast("string").alias("detail_url"),
        (F.col("number") - F.col("first")).cast("int").alias("pos"),
        F.get("alone", F.lit(0)).alias("raw"),
    )


def large_markdown_rows(
    spark: SparkSession, root: str, columns: Sequence[str], url_column: str
) -> DataFrame:
    """``markdown_rows`` of the documents below ``root``, read line by line.

    Lines are those of a text file; ``pos`` counts them from 0 through splits, of which a row
    each is read in one place.
    """
    lines = _split_columns(spark.read.text(root, recursiveFileLookup=True))
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("path", "at").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    splits = _saved(splits.select("path", "at", "least", before), "table-splits")
    numbered = lines.join(splits, ["path", "at"]).select(
        F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"),
        F.lit("list").alias("kind"),
        F.regexp_extract("path", "/company=([^/]+)/", 1).alias("company_slug"),
        F.lit(None).cast("string").alias("detail_url"),
        (F.col("id") - F.col("least") + F.col("before")).cast("int").alias("pos"),
        F.col("value").alias("line"),
    )
    return table_rows(numbered, columns, url_column)
