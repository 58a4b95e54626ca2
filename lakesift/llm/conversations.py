"""Repair of the order of turns in conversations: the cheapest edits, and of those the least in ASCII order.

Rows are sorted over all tasks at once, so a conversation may lie in many of them, and are worked on in blocks of at most
``BLOCK`` rows. A block costs what its rows cost from each state to each state; states are what the roles so far
leave open. One pass over blocks gives the costs behind each of them; inside a block, optimal edits are arcs between nodes
(row, state), which are ranked by the edits of 1, 2, 4, 8 ... steps from them. The ranks select each node's arc, and doubled pointers give
the way from a block's beginning to its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import dealt, materialise, small_batches

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
BLANK, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

# States: nothing yet, after the system's turn, after a user's, after an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES, INITIALS = "-sua", "sua"
DELETE, INSERT, KEEP, REROLE = range(4)  # in the order of their letters
LETTERS = b"DIKR"
FAR = 1 << 40
#: The state after a user or assistant is put in or made of another role.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept row of each initial (s, u, a, another); -1 where it can't stay.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: What insertions at the end of a conversation cost.
LAST = np.array([0, 4, 2, 0])
#: Cost of insertions from state to state.
INSERTED = np.array([[0, FAR, 2, 4], [FAR, 0, 2, 4], [FAR, FAR, 0, 2], [FAR, FAR, 2, 0]])


def _edit_costs() -> np.ndarray:
    """Cost of a row's own edit by kind of row, from state to state: 0 has to go; 1 + 2 * initial + truncated."""
    out = np.full((9, 4, 4), FAR)
    for kind in range(9):
        initial, cut = divmod(kind - 1, 2)
        for s in range(4):
            out[kind, s, s] = 3
            if kind:
                out[kind, s, NEXT[s]] = min(out[kind, s, NEXT[s]], 2 + cut)
                if KEPT[s, initial] >= 0:
                    out[kind, s, KEPT[s, initial]] = min(out[kind, s, KEPT[s, initial]], cut)
    return out


EDITS = _edit_costs()


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest costs through two steps: the smallest sum over the states between."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


ROWS = _then(INSERTED[None], EDITS)


# ------------------------------------------------------------------------------- damage
def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of ``conv_id:turn`` chooses; nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = word("role"), word("text")
    code = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    changed = conversations.where(code != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(code == 3, 2).otherwise(1).alias("__times"),
    )
    return changed.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).drop("__times", "__copy")


# ------------------------------------------------------------------------------- rows in order, and their faults
def in_order(turns: DataFrame) -> DataFrame:
    """conv, place, turn, role, text, of ``turns`` (conv_id, turn, role, text): places ascend by conversation, turn (nulls
    first), role and text. Equal rows may lie in unlike tasks; ``conv`` tells a null conv_id from all others."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    rows = dealt(turns).select(conv.alias("conv"), "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("at")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.withColumn("place", F.monotonically_increasing_id()).drop("at"), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """conv, place, block, turn, initial (0 to 3: s, u, a, another), fault (blank, duplicate, truncated or null) and kind."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    text, initial = F.col("text"), F.substring("role", 1, 1)
    plain = rows.select(
        "conv", "place", "turn", F.unhex(same).alias("same"), (~text.rlike(BLANK)).alias("blank"), (~text.rlike(ENDED)).alias("open"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
    )
    first = plain.groupBy("conv", "same").agg(F.min("place").alias("first_place")).select("first_place")
    seen = plain.join(first, F.col("place") == F.col("first_place"), "left")  # by place: nothing meets in one task
    fault = F.when(F.col("blank"), "blank").when(F.col("first_place").isNull(), "duplicate").when(F.col("open"), "truncated")
    must_go = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    kind = F.when(must_go, 0).otherwise(1 + 2 * F.col("initial") + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int"))
    out = seen.select("conv", "place", F.shiftright("place", BLOCK_BITS).alias("block"), "turn", "initial", fault.alias("fault"))
    return out.withColumn("kind", kind)


# ------------------------------------------------------------------------------- blocks
def _runs(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]:
    """A block's rows in order, the beginnings and sizes of its conversations' runs, and their names."""
    rows = rows.take(pa.array(np.argsort(np.asarray(rows.column("place"))))).combine_chunks()
    conv = pa.chunked_array(rows.column("conv").chunks, pa.string()).combine_chunks()
    code = np.asarray(conv.dictionary_encode().indices)
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return rows, begins, np.diff(np.concatenate([begins, [len(code)]])), conv.take(pa.array(begins))


_SUMMARY = "conv string, block long, costs array<long>, first_initial int, last_initial int, illegal long, first_turn long, last_turn long, n_turns long, n_blank long, n_duplicate long, n_truncated long"


def _summary(key: tuple, rows: pa.Table) -> pa.Table:
    """What each conversation's run of rows in a block costs from state to state, and its counts."""
    rows, begins, sizes, names = _runs(rows)
    kind, initial = np.asarray(rows.column("kind")), np.asarray(rows.column("initial"))
    costs = np.tile(np.where(np.eye(4) > 0, 0, FAR).astype(np.int64), (len(begins), 1, 1))
    for j in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > j)
        costs[own] = _then(costs[own], ROWS[kind[begins[own] + j]])
    run = np.repeat(np.arange(len(begins)), sizes)
    inner = np.flatnonzero(run[1:] == run[:-1])
    pair = initial[inner] * 4 + initial[inner + 1]
    illegal = np.bincount(run[inner][~np.isin(pair, LEGAL)], minlength=len(begins))
    turn = rows.column("turn").combine_chunks()
    turn = turn.chunk(0) if isinstance(turn, pa.ChunkedArray) else turn
    valid = np.asarray(pc.is_valid(turn))
    value = np.asarray(pc.fill_null(turn, 0))
    there = np.flatnonzero(valid)
    new = there[np.concatenate([[True], (value[there][1:] != value[there][:-1]) | (run[there][1:] != run[there][:-1])])] if len(there) else there
    ends = begins + sizes - 1  # nulls come first: a run with any turn ends with one
    head = np.full(len(begins), -1)
    head[run[new][::-1]] = new[::-1]
    fault = rows.column("fault").combine_chunks()
    counts = [np.bincount(run[np.asarray(pc.fill_null(pc.equal(fault, x), False))], minlength=len(begins)) for x in ("blank", "duplicate", "truncated")]
    return pa.table([
        names, pa.array([key[0].as_py()] * len(begins), pa.int64()), pa.array(list(costs.reshape(-1, 16)), pa.list_(pa.int64())), pa.array(initial[begins].astype(np.int32)), pa.array(initial[ends].astype(np.int32)), pa.array(illegal.astype(np.int64)),
        pa.array(value[np.maximum(head, 0)], pa.int64(), mask=head < 0), pa.array(value[ends], pa.int64(), mask=~valid[ends]), pa.array(np.bincount(run[new], minlength=len(begins)).astype(np.int64)), *[pa.array(c.astype(np.int64)) for c in counts],
    ], names=[x.split()[0] for x in _SUMMARY.split(", ")])


LEGAL = [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")]


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run with the costs behind it; runs come by conversation, the last first. One run is held at a time."""
    held, behind, first_initial, first_turn = None, LAST, -1, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            last = r["conv"] != held
            if last:
                held, behind, first_initial, first_turn = r["conv"], LAST, -1, None
            crossed = not last and r["last_initial"] * 4 + first_initial not in LEGAL
            shared = r["last_turn"] is not None and r["last_turn"] == first_turn
            own = np.minimum((np.array(r["costs"]).reshape(4, 4) + behind[None, :]).min(1), FAR)
            out.append((r["conv"], r["block"], behind.tolist(), last, int(own[NOTHING]), int(crossed), int(shared)))
            behind, first_initial, first_turn = own, r["first_initial"], r["first_turn"]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64(), pa.int64())], names=["conv", "block", "behind", "is_last", "cost", "crossed", "shared"])


def least_ways(label: np.ndarray, target: np.ndarray, steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pointers of 1, 2, 4, ... steps along the least way from each node, and the arc that each node takes.

    ``label`` and ``target`` hold up to four arcs of each node, 0 for none; a node has one arc of a label at most, and none at the end.
    A node's rank after k rounds orders nodes by their first 2**k labels; an end comes before all else.
    """
    nodes = np.arange(len(label))
    open_label = np.where(label > 0, label, 9)
    arc = open_label.argmin(1)
    ends = open_label[nodes, arc] == 9
    rank = np.unique(np.where(ends, 0, label[nodes, arc]), return_inverse=True)[1]
    pointer = np.where(ends, nodes, target[nodes, arc])
    for _ in range(max(steps - 1, 1).bit_length()):
        rank = np.unique(rank * len(nodes) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
    arc = np.where(label > 0, open_label * len(nodes) + rank[target], np.iinfo(np.int64).max).argmin(1)
    pointers = [np.where(ends, nodes, target[nodes, arc])]
    for _ in range(max(steps, 1).bit_length()):
        pointers.append(pointers[-1][pointers[-1]])
    return pointers, np.where(ends, -1, arc)


_WAYS = "conv string, block long, place long, entry int, head boolean, leaves int, edits string"


def _ways(key: tuple, rows: pa.Table) -> pa.Table:
    """For each state in which a run can begin: the edits at each of its rows, two letters each (edit, state), and the state that it leaves."""
    rows, begins, sizes, names = _runs(rows)
    kind = np.asarray(rows.column("kind")).astype(np.int64)
    heads = rows.take(pa.array(begins))
    behind = np.array(heads.column("behind").to_pylist(), dtype=np.int64)
    is_first, is_last = (np.asarray(heads.column(c).combine_chunks().to_numpy(zero_copy_only=False)).astype(bool) for c in ("is_first", "is_last"))
    n_runs, n_rows = len(begins), len(kind)
    place_of = np.arange(n_rows) + np.repeat(np.arange(n_runs), sizes)  # of each row; one more behind each run
    exits = begins + sizes + np.arange(n_runs)
    cost = np.full((n_rows + n_runs, 4), FAR)
    cost[exits] = behind
    for j in range(int(sizes.max()) - 1, -1, -1):
        own = np.flatnonzero(sizes > j)
        row = begins[own] + j
        cost[place_of[row]] = np.minimum((ROWS[kind[row]] + cost[place_of[row] + 1][:, None, :]).min(-1), FAR)
    # optimal arcs of node 4 * place + state
    total, states = len(cost) * 4, np.arange(4)
    label, target = np.zeros((total, 4), dtype=np.int64), np.zeros((total, 4), dtype=np.int64)
    at = (place_of[:, None] * 4 + states).ravel()
    own, after = cost[place_of], cost[place_of + 1]
    stays = np.flatnonzero((own == 3 + after).ravel())
    label[at[stays], DELETE], target[at[stays], DELETE] = DELETE + 1, at[stays] + 4
    initial, cut, goes = (kind - 1) // 2, (kind - 1) % 2, kind == 0
    for edit, to, price in ((KEEP, KEPT[:, initial].T, cut), (REROLE, np.tile(NEXT, (n_rows, 1)), cut + 2)):
        fits = (to >= 0) & ~goes[:, None] & (own == price[:, None] + np.take_along_axis(after, np.maximum(to, 0), 1))
        hit = np.flatnonzero(fits.ravel())
        label[at[hit], edit], target[at[hit], edit] = edit + 1, ((place_of[:, None] + 1) * 4 + to).ravel()[hit]
    inner = np.ones(len(cost), dtype=bool)
    inner[exits[~is_last]] = False  # insertions there are the next block's
    more = np.flatnonzero(((cost == 2 + cost[:, NEXT]) & inner[:, None]).ravel())
    label[more, INSERT], target[more, INSERT] = INSERT + 1, more // 4 * 4 + NEXT[more % 4]
    pointers, arc = least_ways(label, target, 3 * int(sizes.max()) + 6)
    # the ways from all states in which a run can begin: the nodes after 0, 1, 2, ... steps by doubled pointers
    run = np.repeat(np.arange(n_runs), np.where(is_first, 1, 4))
    entry = np.concatenate([np.arange(1 if f else 4) for f in is_first])
    start = (begins[run] + run) * 4 + entry
    length = np.zeros(total, dtype=np.int64)
    length[arc >= 0] = 1
    for p in pointers[:-1]:
        length = length + length[p]
    leaves = start
    for p in reversed(pointers[:-1]):
        leaves = p[leaves]
    leaves = pointers[-1][leaves] % 4
    n = length[start]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    node = np.repeat(start, n)
    for k, p in enumerate(pointers):
        node = np.where(step >> k & 1, p[node], node)
    taken = arc[node]
    to = np.where(taken == DELETE, 0, target[node, taken] % 4)
    letters = np.stack([np.frombuffer(LETTERS, dtype=np.uint8)[taken], np.frombuffer(STATES.encode(), dtype=np.uint8)[to]], 1).ravel()
    way = np.repeat(np.arange(len(start)), n)
    # insertions behind a run's last row are that row's
    row = np.minimum(node // 4 - run[way], (begins + sizes - 1)[run[way]])
    own_rows = sizes[run]
    first = np.cumsum(own_rows) - own_rows
    slot = first[way] + row - begins[run[way]]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=int(own_rows.sum())) * 2)]).astype(np.int32)
    edits = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    of = np.repeat(np.arange(len(start)), own_rows)
    at_row = np.arange(len(of)) - first[of] + begins[run[of]]
    return pa.table([
        names.take(pa.array(run[of])), pa.array([key[0].as_py()] * len(of), pa.int64()), pa.array(np.asarray(rows.column("place"))[at_row]), pa.array(entry[of].astype(np.int32)),
        pa.array(at_row == begins[run[of]]), pa.array(leaves[of].astype(np.int32)), edits,
    ], names=[x.split()[0] for x in _WAYS.split(", ")])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each run does begin; runs come by conversation, the first first, with all their entries."""
    held, block, entry, after = None, None, NOTHING, NOTHING
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["conv"] != held:
                held, block, entry, after = r["conv"], r["block"], NOTHING, NOTHING
            elif r["block"] != block:
                block, entry = r["block"], after
            if r["entry"] == entry:
                out.append((r["conv"], r["block"], entry))
                after = r["leaves"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32()))], names=["conv", "block", "entry"])


# ------------------------------------------------------------------------------- repair
def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of ``turns`` (conv_id, turn, role, text), and counts by conversation.

    Edits: conv_id, conv, place, step, edit (Keep, Rerole, Delete, Insert by their initials), turn, role and text as they are after it; in
    order of place and step they give the repaired conversation, without those deleted. Counts: conv, gaps, blank, duplicate, truncated,
    illegal, cost.

    Null turns come before all others; rows of one turn are ordered by role, then text; repeated rows are duplicates. A null or
    unknown role is another role: its row can't stay. A conversation of any length is spread over blocks. Empty table: empty
    results. Other columns are left aside.
    """
    rows = in_order(turns)
    marked = materialise(faults(rows), "faults")
    runs = materialise(marked.select("conv", "place", "block", "turn", "initial", "fault", "kind").groupBy("block").applyInArrow(_summary, _SUMMARY), "runs")
    ordered = runs.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    behind = materialise(ordered.mapInArrow(_behind, "conv string, block long, behind array<long>, is_last boolean, cost long, crossed long, shared long"), "behind")
    total = lambda c: F.sum(c).alias(c.removeprefix("n_"))
    both = runs.drop("costs").join(behind.drop("behind"), ["conv", "block"])
    counts = both.groupBy("conv").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("n_turns") + F.sum("shared"), F.lit(0)).alias("gaps"), total("n_blank"), total("n_duplicate"), total("n_truncated"),
        (F.sum("illegal") + F.sum("crossed")).alias("illegal"), F.min_by("cost", "block").alias("cost"), F.min("block").alias("first_block"),
    )
    counts = materialise(counts, "conversations")
    placed = behind.join(counts.select(F.col("conv").alias("__conv"), "first_block"), F.col("conv") == F.col("__conv")).select("conv", "block", "behind", "is_last", (F.col("block") == F.col("first_block")).alias("is_first"))
    ways = materialise(marked.select("conv", "place", "block", "kind").join(placed, ["conv", "block"]).groupBy("block").applyInArrow(_ways, _WAYS), "ways")
    taken = ways.where("head").select("conv", "block", "entry", "leaves").repartition("conv").sortWithinPartitions("conv", "block", "entry").mapInArrow(_entries, "conv string, block long, entry int")
    chosen = ways.join(taken, ["conv", "block", "entry"]).select(F.col("place").alias("__place"), "edits")
    steps = F.expr("posexplode(transform(sequence(0, length(edits) div 2 - 1), k -> substring(edits, cast(k * 2 + 1 as int), 2)))")
    opened = rows.join(chosen, F.col("place") == F.col("__place")).select("conv_id", "conv", "place", "turn", "role", "text", steps.alias("step", "own"))
    edit, named = F.substring("own", 1, 1), F.when(F.substring("own", 2, 1) == "u", "user").otherwise("assistant")
    edits = opened.select("conv_id", "conv", "place", "step", edit.alias("edit"), "turn", F.when(edit.isin("I", "R"), named).otherwise(F.col("role")).alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))
    return edits, counts.drop("first_block")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation; edits come in order, and one text is held at a time."""
    held, letters, digest, some = None, bytearray(), hashlib.sha256(), False
    for batch in batches:
        out = []
        for conv, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "role", "text")), strict=True):
            if conv != held:
                if held is not None:
                    out.append((held, letters.decode(), digest.hexdigest()))
                held, letters, digest, some = conv, bytearray(), hashlib.sha256(), False
            letters += edit.encode()
            if edit != "D":
                digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], names=["conv", "audit", "repaired_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (held, letters.decode(), digest.hexdigest())], names=["conv", "audit", "repaired_sha256"])


def audit(conversations: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``conversations``.

    ``turns`` are its rows as they are to be repaired, by default the rows themselves with nulls as one space. A conversation without
    any: zeros, an empty audit and the digest of the empty text. The digest of a conversation reads it in order, so one task
    reads a conversation's edits, a text at a time. Empty table: empty result.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role"), word("text")) if turns is None else turns
    edits, counts = repair(turns)
    in_turn = small_batches(edits.select("conv", "place", "step", "edit", "role", "text")).repartition("conv").sortWithinPartitions("conv", "place", "step")
    written = in_turn.mapInArrow(_written, "conv string, audit string, repaired_sha256 string")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    all_of = conversations.select("conv_id").distinct().withColumn("conv", conv)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = all_of.join(counts, "conv", "left").join(written, "conv", "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
