"""The prefix trie of conversations by Euler tour: subtree sums from prefix sums along the tour.

A node is a distinct sequence of first turns. A turn is known by two 64-bit hashes of its role and text,
a sequence by two polynomials of its turns' hashes (128 bits together), which running sums give in one
pass over the rows in order. So no conversation is gathered, however long. A node is named by its
smallest member and its depth. Each node has an enter and an exit arc; an arc's successor is the first
child's enter arc, the own exit arc, the next sibling's enter arc or the parent's exit arc. The tour is
list-ranked (``list_rank``), carrying the position and the running sums of leaves and of savings, and
a subtree's sum is the difference of those at its exit and its enter arc.

Rows are dealt by ranges of their order, so one conversation, first turn or family of siblings may hold
any share of the rows; what crosses from one partition into the next is one record a partition. The ids
that end at a node are hashed in pieces of ``PIECE`` characters, in order, never held together.

Defined cases: rows without a conversation id take no part; a null role or text is empty; a null turn
comes first; rows that share a turn, repeated ones too, are turns of their own, by role, then by the hash
of the text; an empty table gives no rows, not even a root; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import list_rank
from tagloom.llm.common import lean, saved
from tagloom.llm.ordered import dealt

# odd factors of the two polynomials of turn hashes, modulo 2**64
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PIECE = 1 << 16
_ALL = (1 << 64) - 1
TURN = ["h1", "h2", "n_bytes"]
HASHES = ["s1", "s2", "p1", "p2"]
NODE = ["conv_id", "depth"]


def hashed_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, h1, h2 and n_bytes of every row of (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    second = F.xxhash64(F.lit("turn"), "text", "role")
    return given.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("h1"), second.alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"))


def _running(conv: np.ndarray, hashes: list[np.ndarray], state: tuple):
    """Positions and polynomials of sorted rows that follow ``state`` (conv, position, two sums)."""
    n = len(conv)
    starts = np.concatenate([[True], conv[1:] != conv[:-1]])
    goes_on = state[0] is not None and conv[0] == state[0]
    first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    pos = np.arange(n) - first + 1
    opened = first == 0
    if goes_on:
        pos[opened] += state[1]
    sums, befores = [], []
    for i, (values, factor) in enumerate(zip(hashes, FACTORS)):
        steps = np.concatenate([[factor], np.full(n - 1, factor)]).astype(np.uint64)
        power = np.cumprod(steps)[pos - np.where(opened & goes_on, state[1], 0) - 1]
        if goes_on:
            power = np.where(opened, power * np.uint64(pow(factor, state[1], 1 << 64)), power)
        own = values.view(np.uint64) * power
        total = np.cumsum(own)
        total -= (total - own)[first]
        if goes_on:
            total[opened] += np.uint64(state[2 + i])
        sums.append(total)
        befores.append(total - own)
    return pos, sums, befores, (int(conv[-1]), int(pos[-1]), *(int(s[-1]) for s in sums))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """conv_id, pos and ``TURN`` and ``HASHES`` of rows with (conv_id, ``TURN``) in the order of ``order``.

    The first pass counts within partitions and leaves one record a partition of what goes on in the
    next one; the second adds what came before.
    """
    names = ["conv_id", "pos", *TURN, *HASHES, "pid", "edge"]

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, state, begun = TaskContext.get().partitionId(), (None, 0, 0, 0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, h1, h2 = (batch.column(i).to_numpy() for i in range(3))
            begun = int(conv[0]) if begun is None else begun
            pos, sums, befores, state = _running(conv, [h1, h2], state)
            made = [pa.array(x.view(np.int64)) for x in (*sums, *befores)]
            tail = [pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(np.zeros(batch.num_rows, bool))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), *batch.columns[1:4], *made, *tail], names)
        if begun is not None:
            # the first conversation's id stands as h1, the last one with its count and sums
            sums = [np.array([s], np.uint64).view(np.int64) for s in state[2:]]
            row = [[state[0]], [state[1]], [begun], [0], [0], *sums, [0], [0]]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in row), pa.array([pid], pa.int32()), pa.array([True])], names)

    longs = ", ".join(f"{c} long" for c in names[:-2])
    rows = dealt(df, *order).select("conv_id", *TURN)
    rows = saved(rows.mapInArrow(counted, f"{longs}, pid int, edge boolean"), "numbered")
    carried, running = {}, None
    for edge in sorted(rows.where("edge").collect(), key=lambda r: r.pid):
        if running is not None and edge.h1 == running[0]:
            carried[edge.pid] = running
        own = (edge.conv_id, edge.pos, edge.s1 & _ALL, edge.s2 & _ALL)
        running = _after(running, own) if edge.pid in carried and edge.h1 == edge.conv_id else own

    @lean
    def carried_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).copy() for c in batch.columns[:-1]]
            conv, pid = columns[0], columns[-1]
            for p in np.unique(pid):
                if (came := carried.get(int(p))) is not None:
                    at = (pid == p) & (conv == came[0])
                    columns[1][at] += came[1]
                    for i, factor in enumerate(FACTORS):
                        for j in (5 + i, 7 + i):
                            value = columns[j][at].view(np.uint64) * np.uint64(pow(factor, came[1], 1 << 64))
                            columns[j][at] = (value + np.uint64(came[2 + i])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:-1]], names[:-2])

    return rows.where("NOT edge").mapInArrow(carried_on, longs)


def _after(came: tuple, own: tuple) -> tuple:
    """The state of a conversation after ``own`` rows that follow ``came``."""
    sums = [(c + pow(f, came[1], 1 << 64) * o) & _ALL for c, o, f in zip(came[2:], own[2:], FACTORS)]
    return own[0], came[1] + own[1], *sums


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, part, pos and ``TURN``: the turns of each conversation with its family's first ones.

    Conversation c begins with the first h turns of c - c % every, h being the crc32 of its decimal id
    modulo ``most``, and goes on with its own turns after its first h. ``turns`` has positions.
    """

    def head(c: str) -> F.Column:
        return F.crc32(F.col(c).cast("string").cast("binary")) % most

    step = F.explode(F.sequence(F.when(F.col("conv_id") <= 0, F.lit(1 - every)).otherwise(0), F.when(F.col("conv_id") >= 0, F.lit(every - 1)).otherwise(0)))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select("conv_id", "pos", *TURN, step.alias("step"))
    first = first.select(F.try_add("conv_id", F.col("step").cast("long")).alias("conv_id"), "pos", *TURN)
    there = turns.where("pos = 1").select("conv_id")
    first = first.where(F.col("pos") <= head("conv_id")).join(there, "conv_id", "left_semi")
    own = turns.where(F.col("pos") > head("conv_id"))
    return first.select("conv_id", F.lit(0).alias("part"), "pos", *TURN).unionByName(own.select("conv_id", F.lit(1).alias("part"), "pos", *TURN))


def _next_siblings(nodes: DataFrame) -> DataFrame:
    """``NODE`` and next_conv, the next child of the same parent in order of conv_id."""
    names = ["conv_id", "depth", "parent_conv_id", "next_conv", "pid", "edge"]

    @lean
    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held = TaskContext.get().partitionId(), None

        def rows(table: pa.RecordBatch, nexts: pa.Array, edge: str | None) -> pa.RecordBatch:
            n = table.num_rows
            return pa.RecordBatch.from_arrays([*table.columns, nexts, pa.array(np.full(n, pid, np.int32)), pa.array([edge] * n, pa.string())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                yield rows(batch.slice(0, 1), pa.nulls(1, pa.int64()), "first")
                joint = batch
            else:
                joint = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            conv, depth, parent = (c.to_numpy() for c in joint.columns)
            same = (depth[1:] == depth[:-1]) & (parent[1:] == parent[:-1])
            yield rows(joint.slice(0, joint.num_rows - 1), pa.array(conv[1:], mask=~same), None)
            held = joint.slice(joint.num_rows - 1)
        if held is not None:
            yield rows(held, pa.nulls(1, pa.int64()), "last")

    given = dealt(nodes, "parent_conv_id", "depth", "conv_id").select("conv_id", "depth", "parent_conv_id")
    schema = "conv_id long, depth long, parent_conv_id long, next_conv long, pid int, edge string"
    found = saved(given.mapInArrow(shifted, schema), "siblings")
    firsts = sorted(found.where("edge = 'first'").collect(), key=lambda r: r.pid)
    over = [(a.pid, b.parent_conv_id, b.depth, b.conv_id) for a, b in zip(firsts, firsts[1:])]
    over = nodes.sparkSession.createDataFrame(over, "pid int, parent_conv_id long, depth long, over long")
    plain = found.where("edge IS NULL").select(*NODE, "next_conv")
    lasts = found.where("edge = 'last'").join(over, ["pid", "parent_conv_id", "depth"], "left")
    return plain.unionByName(lasts.select(*NODE, F.col("over").alias("next_conv")))


def ends_digests(members: DataFrame) -> DataFrame:
    """``NODE`` and ends_sha256 over (conv_id, depth, member): the members' decimal ids in order."""
    names = ["conv_id", "depth", "first", "ids"]

    @lean
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, node, first, ids, size = [], None, 0, [], 0
        for batch in batches:
            for conv, depth, member in zip(*(c.to_pylist() for c in batch.columns)):
                if node != (conv, depth) or size > PIECE:
                    if ids:
                        made.append((*node, first, ",".join(ids)))
                    node, first, ids, size = (conv, depth), member, [], 0
                ids.append(str(member))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 4, kinds)], names)
            made = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*node, first, ",".join(ids)), kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    @lean
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            made = []
            for conv, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == (conv, depth):
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    made.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256(ids.encode())
            yield table(made)
        if node is not None:
            yield table([(*node, digest.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.string()])], [*NODE, "ends_sha256"])

    cut = dealt(members, "conv_id", "depth", "member").select(*NODE, "member").mapInArrow(pieces, "conv_id long, depth long, first long, ids string")
    ordered = cut.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return ordered.mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def _tour(nodes: DataFrame) -> DataFrame:
    """Enter (even a2) and exit (odd a2) arcs of ``nodes`` with their successors and weights."""
    enter, leave = F.col("depth") * 2, F.col("depth") * 2 + 1
    down, on, up = F.col("first_child").isNotNull(), F.col("next_conv").isNotNull(), F.col("depth") > 0
    into = F.struct(
        F.col("conv_id").alias("a1"),
        enter.alias("a2"),
        F.coalesce("first_child", "conv_id").alias("b1"),
        F.when(down, enter + 2).otherwise(leave).alias("b2"),
        F.when(down, 0).otherwise(1).cast("long").alias("leaves"),
        F.col("saving").alias("saved"),
        F.lit(1).cast("long").alias("place"),
    )
    nothing = F.lit(0).cast("long")
    out = F.struct(
        F.col("conv_id").alias("a1"),
        leave.alias("a2"),
        F.coalesce("next_conv", "parent_conv_id").alias("b1"),
        F.when(on, enter).when(up, leave - 2).alias("b2"),
        nothing.alias("leaves"),
        nothing.alias("saved"),
        F.lit(1).cast("long").alias("place"),
    )
    return nodes.select(F.explode(F.array(into, out)).alias("arc")).select("arc.*")


def trie(sequences: DataFrame, conversations: DataFrame, rows: int = list_rank.ROWS) -> DataFrame:
    """The nodes over (conv_id, pos, ``TURN``, ``HASHES``); ``conversations`` has every conv_id, turnless ones too.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and enter and exit, the places of the node's arcs in the tour (from 1).
    """
    spark = sequences.sparkSession
    least, n_all = conversations.agg(F.min("conv_id"), F.count("*")).first()
    if not n_all:
        kinds = ", ".join(f"{c} long" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        return spark.createDataFrame([], f"{kinds}, ends_sha256 string, enter long, exit long")
    key = ["pos", "s1", "s2"]
    prefixes = sequences.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    prefixes = saved(prefixes.withColumnRenamed("pos", "depth"), "trie-prefixes")
    above = prefixes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = prefixes.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    below = prefixes.where("depth > 1").join(above, ["depth", "p1", "p2"])
    saving = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs"]
    nodes = saved(top.select(*columns, saving).unionByName(below.select(*columns, saving)), "trie-nodes")
    root = spark.createDataFrame([(least, 0, None, n_all, 0)], "conv_id long, depth long, parent_conv_id long, n_convs long, saving long")

    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    linked = nodes.unionByName(root).join(children, NODE, "left").join(_next_siblings(nodes), NODE, "left")
    linked = saved(linked, "trie-linked")

    places = list_rank.ranks(_tour(linked), ["place", "leaves", "saved"], rows)
    in_or_out = F.when(F.col("a2") % 2 == 0, -1).otherwise(1)
    sums = places.groupBy(F.col("a1").alias("conv_id"), F.shiftright("a2", 1).alias("depth")).agg(
        F.sum(in_or_out * F.col("leaves")).alias("leaves"),
        F.sum(in_or_out * F.col("saved")).alias("saved"),
        F.min("place").alias("enter"),
        F.max("place").alias("exit"),
    )

    last = sequences.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end")).select(F.col("conv_id").alias("member"), "end.*")
    named = prefixes.select(F.col("depth").alias("pos"), "s1", "s2", "conv_id")
    ended = last.join(named, key).select("conv_id", F.col("pos").alias("depth"), "member")
    turnless = conversations.join(sequences.where("pos = 1").select("conv_id"), "conv_id", "left_anti")
    turnless = turnless.select(F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    ends = ends_digests(ended.unionByName(turnless))

    # an enter arc's own weight is in its running sum
    childless = F.when(F.col("n_children").isNull(), 1).otherwise(0)
    full = linked.join(sums, NODE).join(ends, NODE, "left")
    return full.select(
        *columns,
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("leaves") + childless).alias("n_leaves"),
        (F.col("saved") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "enter",
        "exit",
    )


def sequences(df: DataFrame) -> DataFrame:
    """The conversations of (conv_id, turn, role, text) as they are, with positions and prefix hashes."""
    return numbered(hashed_turns(df), "conv_id", "turn", "role", "h1", "h2")


def families(df: DataFrame, rows: int = list_rank.ROWS) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text); see ``rebuilt`` and ``trie``."""
    turns = saved(sequences(df).select("conv_id", "pos", *TURN), "turns")
    found = saved(numbered(rebuilt(turns), "conv_id", "part", "pos"), "rebuilt")
    return trie(found, turns.where("pos = 1").select("conv_id"), rows)
