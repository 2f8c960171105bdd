"""Transcript parsing: a hidden Markov model over lines recovers who speaks, then turns are rendered.

A line's state is a role and whether the line begins a turn. What is seen of a line is the kind of
speaker marker it begins with and a few of its features (length, question, place after a blank
line). Start, transition and emission tables come from labelled lines by smoothed counts; they are
aggregated over all of those lines and have a fixed size.

The best path is found by Viterbi in pieces, so that a transcript of any length is spread: (1) each
chunk of lines yields its best score from every state before it to every state at its end, a small
matrix; (2) the matrices of a transcript, one for thousands of lines, are run through to fix the state
at each chunk's ends; (3) each chunk retraces its path between its ends. Maxima of sums combine in any
grouping, so the path's score is that of the whole transcript.

Defined cases: a null or empty line is an empty line; rows with a null transcript or place are left out;
lines that share a place are ordered by their text, and repeated ones all stay; an empty table gives
no rows; other columns are left out. Equal scores prefer the state listed first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ROLES = ["user", "assistant", "system"]
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
CHUNK = 4096
RENDERED = "<|{role}|>\n{text}\n<|end|>"

_NAMES = {
    "user": r"user|human|question|q|customer|student|me|prompter",
    "assistant": r"assistant|ai|bot|answer|a|agent|teacher|model|gpt",
    "system": r"system|instructions?|context|developer",
}
MARKER = re.compile(
    r"^\s*(?:(?:#{1,6}|\*\*|>+|-|\[|<\|?|\|)\s*)?(?:"
    + "|".join(f"(?P<{role}>{names})" for role, names in _NAMES.items())
    + r")\s*(?:\*\*|\]|\|?>|\|)?\s*(?::|-|>|\)|$)(?:\*\*)?\s*",
    re.IGNORECASE,
)
MARKERS = ["", *ROLES]
LENGTHS = [1, 30, 80, 160, 320, 640]


def marker(line: str | None) -> tuple[str, str]:
    """The role that a line's speaker marker names, or nothing, and the line behind the marker."""
    match = MARKER.match(line) if line else None
    return (match.lastgroup, line[match.end() :]) if match else ("", line or "")


def observed(line: str | None) -> tuple[int, int, int]:
    """What is seen of a line: its marker, its length's class, and whether it asks."""
    role, rest = marker(line)
    return MARKERS.index(role), int(np.searchsorted(LENGTHS, len(rest), "right")), int(rest.rstrip().endswith("?"))


SIZES = (len(MARKERS), len(LENGTHS) + 1, 2)


class Model:
    """Log probabilities: of the first state, from state to state, and of what is seen in a state."""

    def __init__(self, first: np.ndarray, moves: np.ndarray, seen: list[np.ndarray]):
        """Counts, of which a smoothed share is taken."""
        legal = np.array([[begins or role == before for role, begins in STATES] for before, _ in STATES])
        opens = np.array([begins for _, begins in STATES])
        self.first = np.log((first + 0.5) / (first + 0.5).sum())
        self.first[~opens] = -1e9
        self.moves = np.log((moves + 0.5) / (moves + 0.5).sum(1, keepdims=True))
        self.moves[~legal] = -1e9
        self.seen = [np.log((s + 0.5) / (s + 0.5).sum(1, keepdims=True)) for s in seen]

    def emitted(self, lines: list[str | None]) -> np.ndarray:
        """The log probability of each line in each state."""
        codes = np.array([observed(line) for line in lines], np.int64).reshape(len(lines), 3)
        return sum(table.T[codes[:, i]] for i, table in enumerate(self.seen))


def default_model() -> Model:
    """A model without labels: markers name their role, roles take turns, answers are long."""
    first = np.array([60, 0, 10, 0, 30, 0.0])
    moves = np.zeros((6, 6))
    for i, (role, _) in enumerate(STATES):
        for j, (other, begins) in enumerate(STATES):
            moves[i, j] = 50 if not begins and other == role else 0
            if begins and other != role:
                moves[i, j] = {"user": 20, "assistant": 30, "system": 1}[other]
    marks = np.zeros((6, len(MARKERS)))
    for i, (role, begins) in enumerate(STATES):
        marks[i, 0] = 30 if begins else 99
        marks[i, MARKERS.index(role)] = 70 if begins else 1
    lengths = np.ones((6, SIZES[1])) * 10
    lengths[2:4, 4:] = 30
    asks = np.array([[60, 40], [85, 15], [97, 3], [97, 3], [99, 1], [99, 1]], float)
    return Model(first, moves, [marks, lengths, asks])


def fit(lines: DataFrame) -> Model:
    """A model from labelled lines: columns conv, pos, line, role and begins (whether it opens a turn)."""
    known = lines.where(F.col("role").isin(ROLES) & F.col("conv").isNotNull() & F.col("pos").isNotNull())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [observed(line) for line in batch.column(2).to_pylist()]
            states = [STATES.index(s) for s in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            columns = [pa.array(c, pa.int32()) for c in (states, *zip(*codes))] if codes else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], kinds)

    kinds = ["conv", "pos", "state", "mark", "length", "asks"]
    conv = known.schema["conv"].dataType.simpleString()
    given = known.select("conv", "pos", "line", "role", "begins")
    rows = given.mapInArrow(coded, f"conv {conv}, pos long, state int, mark int, length int, asks int")
    # the state before a line, within pieces of a transcript so that a long one is not sorted in one task
    piece = F.floor(F.col("pos") / PIECE)
    before = F.lag("state").over(Window.partitionBy("conv", piece).orderBy("pos"))
    rows = rows.withColumn("before", F.when(F.col("state") % 2 == 1, F.coalesce(before, F.col("state"))).otherwise(before))
    opens = F.col("before").isNull() & (F.col("pos") < PIECE)
    counts = rows.groupBy("state", "before", "mark", "length", "asks", opens.alias("opens")).count().collect()
    first, moves = np.zeros(6), np.zeros((6, 6))
    seen = [np.zeros((6, n)) for n in SIZES]
    for r in counts:
        for table, code in zip(seen, (r["mark"], r["length"], r["asks"])):
            table[r["state"], code] += r["count"]
        if r["before"] is not None:
            moves[r["before"], r["state"]] += r["count"]
        elif r["opens"]:
            first[r["state"]] += r["count"]
    return Model(first, moves, seen)


PIECE = CHUNK << 32


def through(model: Model, emitted: np.ndarray) -> np.ndarray:
    """Best scores to each state at the lines' end: from a transcript's beginning, then from each state before them."""
    best = np.vstack([model.first, model.moves]) + emitted[0]
    for row in emitted[1:]:
        best = (best[:, :, None] + model.moves).max(1) + row
    return best


def retraced(model: Model, emitted: np.ndarray, before: int, end: int) -> np.ndarray:
    """The best states of the lines between a state before them (-1: none) and their last state."""
    best = (model.first if before < 0 else model.moves[before]) + emitted[0]
    back = np.zeros((len(emitted), 6), np.int8)
    for i, row in enumerate(emitted[1:], 1):
        paths = best[:, None] + model.moves
        back[i] = paths.argmax(0)
        best = paths.max(0) + row
    out = np.empty(len(emitted), np.int8)
    out[-1] = end
    for i in range(len(emitted) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def viterbi(model: Model, lines: list[str | None]) -> np.ndarray:
    """The states of one transcript, held as a whole."""
    emitted = model.emitted(lines)
    best = model.first + emitted[0]
    for row in emitted[1:]:
        best = (best[:, None] + model.moves).max(0) + row
    return retraced(model, emitted, -1, int(best.argmax()))


def labelled(lines: DataFrame, model: Model, piece: int = PIECE) -> DataFrame:
    """conv, pos, line, chunk, role and begins of every line of the transcripts (conv, pos, line).

    ``pos`` orders a transcript's lines; ``piece`` is the span of places in a chunk, which must hold
    few enough lines for one task.
    """
    chunk = F.floor(F.col("pos") / piece).alias("chunk")
    given = lines.where("conv IS NOT NULL AND pos IS NOT NULL").select("conv", chunk, "pos", "line")
    conv = given.schema["conv"].dataType.simpleString()
    conv_kind = to_arrow_type(given.schema["conv"].dataType)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(groups(batches, 2)):
            made = [
                (*key, through(model, model.emitted([r[3] for r in rows])).ravel().tolist()) for key, rows in part
            ]
            kinds = [conv_kind, pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["conv", "chunk", "best"])

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(groups(batches, 1)):
            made = []
            for _, rows in part:
                matrices = [np.array(r[2]).reshape(7, 6) for r in rows]
                scores, back = matrices[0][0], []
                for matrix in matrices[1:]:
                    paths = scores[:, None] + matrix[1:]
                    back.append(paths.argmax(0))
                    scores = paths.max(0)
                states = [int(scores.argmax())]
                for step in reversed(back):
                    states.append(int(step[states[-1]]))
                states.reverse()
                made += [(r[0], r[1], b, e) for r, b, e in zip(rows, [-1, *states[:-1]], states)]
            kinds = [conv_kind, pa.int64(), pa.int32(), pa.int32()]
            names = ["conv", "chunk", "before", "last"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(groups(batches, 2)):
            made = []
            for _, rows in part:
                emitted = model.emitted([r[3] for r in rows])
                states = retraced(model, emitted, rows[0][4], rows[0][5])
                made += [(*r[:4], i, *STATES[s]) for i, (r, s) in enumerate(zip(rows, states))]
            kinds = [conv_kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], NAMES)

    dealt = given.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos", "line")
    summaries = dealt.mapInArrow(ends, f"conv {conv}, chunk long, best array<double>")
    summaries = summaries.repartition("conv").sortWithinPartitions("conv", "chunk")
    fixes = summaries.mapInArrow(fixed, f"conv {conv}, chunk long, before int, last int")
    both = given.join(fixes, ["conv", "chunk"]).select("conv", "chunk", "pos", "line", "before", "last")
    both = both.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos", "line")
    kind = f"conv {conv}, chunk long, pos long, line string, place long, role string, begins boolean"
    return both.mapInArrow(path, kind)


NAMES = ["conv", "chunk", "pos", "line", "place", "role", "begins"]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows that share the first ``keys`` columns, of batches sorted by them."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, own in groupby(rows, lambda row: row[:keys]):
        yield key, list(own)


def pieces(found: Iterator, most: int = 256) -> Iterator[list]:
    """Lists of at most ``most`` groups."""
    while part := list(islice(found, most)):
        yield part


def turns(lines: DataFrame) -> DataFrame:
    """conv, turn, role, n_lines, text (without the speaker marker) and rendered of labelled lines.

    A turn's number is the turns of its transcript's earlier chunks, a sum over one row a chunk, and
    those begun before it in its own.
    """
    own = Window.partitionBy("conv", "chunk").orderBy("pos", "place").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("own", F.sum(F.col("begins").cast("long")).over(own))
    begun = lines.groupBy("conv", "chunk").agg(F.sum(F.col("begins").cast("long")).alias("begun"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("conv", "chunk", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("earlier"))
    rows = rows.join(begun, ["conv", "chunk"]).withColumn("turn", F.col("earlier") + F.col("own") - 1)
    held = F.struct("pos", "place", "line", "begins", "role")
    grouped = rows.groupBy("conv", "turn").agg(F.sort_array(F.collect_list(held)).alias("held"))

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for listed in batch.column(2).to_pylist():
                texts = [x["line"] or "" for x in listed]
                texts[0] = marker(texts[0])[1] if listed[0]["begins"] else texts[0]
                role, text = listed[0]["role"], "\n".join(texts).strip("\n")
                made.append((role, len(listed), text, RENDERED.format(role=role, text=text)))
            columns = list(zip(*made)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["conv", "turn", "role", "n_lines", "text", "rendered"],
            )

    conv = grouped.schema["conv"].dataType.simpleString()
    return grouped.mapInArrow(assembled, f"conv {conv}, turn long, role string, n_lines long, text string, rendered string")


def written_out(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts of labelled lines: conv, pos, line, role, begins.

    A conversation's id decides how its speakers are marked (five styles, among them lines without a
    colon), and one turn in eight has no marker at all, so roles must be inferred there.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    name = {
        "user": ["User: ", "### Human: ", "**Q:** ", "<|user|> ", "[USER] - "],
        "assistant": ["Assistant: ", "### AI: ", "**A:** ", "<|assistant|> ", "[BOT] - "],
        "system": ["System: ", "### System: ", "**Context:** ", "<|system|> ", "[SYSTEM] - "],
    }
    marks = F.lit("")
    for role, listed in name.items():
        chosen = F.element_at(F.array(*map(F.lit, listed)), (style + 1).cast("int"))
        marks = F.when(F.col("role") == role, chosen).otherwise(marks)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    given = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    text = F.concat(F.when(bare, F.lit("")).otherwise(marks), F.coalesce("text", F.lit("")))
    lines = given.select("conv_id", "turn", "role", F.posexplode(F.split(text, "\n")).alias("number", "line"))
    pos = F.shiftleft(F.col("turn").cast("long"), 32) + F.col("number")
    return lines.select(
        F.col("conv_id").alias("conv"), pos.alias("pos"), "line", "role", (F.col("number") == 0).alias("begins")
    )
