"""Conversation structure repair by a shortest path with scalar big-integer weights.

*Paths.* The rows of a conversation, in order, are read by an automaton of the role initials ``(s?(ua)+)?`` with four
states: nothing yet, after s, after u, after a. A row is kept, reroled or deleted, and a turn may be inserted in front of it
(or behind the last one). Two inserted turns in a row are never cheapest: inside a conversation they lead back to the
state they started from, and an s that needs both behind it is cheaper to delete.

*Weights.* Every edge weighs one integer: the cost in the high digits, and in the low digits the letters of its edits, in a
field of fixed width at the row's position, padded with zeros at the end. A field's letters (``I?`` and the row's own) are
prefix-free, so comparing fields one by one compares the audits. An ordinary minimum of integers per row and state decides
the cost and, among equal costs, the ASCII-least audit.

*Long conversations.* Rows are range-partitioned and sorted by conversation and turn, so a conversation may lie in several
partitions. One that lies whole inside a partition and has ``BLOCK_ROWS`` rows at most is repaired where it stands. Of the
others, blocks of that many rows become nodes with a weight for each state before and after them; ``FAN`` neighbouring
nodes are folded into one by the same minimum, their audits standing in as ranks, until each conversation is one node, and
the choice goes down the same levels again. No task holds more than a block or ``FAN`` nodes of a conversation; only the
digest of a repaired text reads its blocks one after another.

Defined results: null roles and texts are one blank; a null ``conv_id`` is a conversation; null turns come first; rows of one
turn are ordered by role and a digest of role and text; repeated rows are rows of their own (and so duplicates); a
conversation of which no row is left has zeros, an empty audit and nothing to hash; very long texts are kept whole, in blocks
of their own; roles count by their first character, an empty one has none; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import located, tidied, written

BLOCK_ROWS = 256
BLOCK_BYTES = 2 << 20
#: Nodes that are folded into one: 2**FAN_BITS.
FAN_BITS = 6
STATES = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3

BLANK_CHARACTERS = " \t\n\x0b\x0c\r"

#: Letters by their ASCII order; zero is the padding.
_CODES = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTERS = {code: letter for letter, code in _CODES.items()}
_LETTER_BITS, _FIELD_BITS = 3, 6
#: The state after an own turn of that initial, and the one after an inserted or reroled turn.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_TURN = {0: 2, 1: 2, 2: 3, 3: 2}
_ROLES = {2: "user", 3: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage with what later steps need: blank, cut, digest; ``gone`` rows only name their conversation."""
    rows = located(conversations, "conv_id", "turn", "role", "text")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    copies = F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        (harm == 0).alias("gone"),
        F.when(harm != 0, F.when(harm == 4, "user").otherwise(text_of("role"))).alias("role"),
        F.when(harm != 0, text).alias("text"),
        "place",
        F.explode(copies).alias("copy"),
    )
    end = F.substring(F.rtrim("text", F.lit(BLANK_CHARACTERS)), -1, 1)
    return rows.select(
        "*",
        (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("cut"),
        F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"),
    )


# --- the shortest path -------------------------------------------------------------------

_edges: dict[tuple, list] = {}


def edges(initial: str, must: bool, cut: bool) -> list[list[tuple[int, int, int]]]:
    """For each state before a row, (state after it, cost, field): the least of each pair of states."""
    key = (initial if initial in ("s", "u", "a") else "", must, cut)
    if key not in _edges:
        out = []
        for state in STATES:
            least: dict[int, tuple[int, int]] = {}
            for inserted in (False, True):
                at = _TURN[state] if inserted else state
                ways = [("D", at, DELETE)]
                if not must:
                    more = CUT if cut else 0
                    ways.append(("R", _TURN[at], REROLE + more))
                    if (at, initial) in _STEP:
                        ways.append(("K", _STEP[at, initial], more))
                for letter, to, cost in ways:
                    code = _CODES[letter]
                    field = (_CODES["I"] << _LETTER_BITS) + code if inserted else code << _LETTER_BITS
                    way = (cost + (INSERT if inserted else 0), field)
                    least[to] = min(least.get(to, way), way)
            out.append([(to, *way) for to, way in least.items()])
        _edges[key] = out
    return _edges[key]


#: The end of a conversation: an inserted assistant closes an open user turn.
_END = [[(0, 0, 0)], [], [(3, INSERT, _CODES["I"] << _LETTER_BITS)], [(3, 0, 0)]]


def shortest(layers: list[list[list[tuple[int, int, int]]]], start: int) -> dict[int, int]:
    """State after all layers -> least weight, from ``start``. Cost stands above ``len(layers)`` fields."""
    high = _FIELD_BITS * len(layers)
    best, shift = {start: 0}, high
    for layer in layers:
        shift -= _FIELD_BITS
        after: dict[int, int] = {}
        for state, weight in best.items():
            for to, cost, field in layer[state]:
                total = weight + (cost << high) + (field << shift)
                if to not in after or total < after[to]:
                    after[to] = total
        best = after
    return best


def split_weight(weight: int, fields: int) -> tuple[int, int]:
    return weight >> _FIELD_BITS * fields, weight & ((1 << _FIELD_BITS * fields) - 1)


def audit_of(low: int, fields: int) -> str:
    """The letters of ``fields`` fields."""
    digits = [low >> _LETTER_BITS * i & 7 for i in reversed(range(2 * fields))]
    return "".join(_LETTERS[d] for d in digits if d)


def apply(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The repaired turns (role, text) of rows edited as the audit says, from ``state``."""
    out, left = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        state = _STEP[state, row["role"][:1]] if letter == "K" else _TURN[state]
        role = row["role"] if letter == "K" else _ROLES[state]
        out.append({"role": role, "text": row["text"] if row else ""})
    return out


def faults(rows: list[dict], repeated: set[int]) -> list[str]:
    """The first fault of each row, or an empty text; ``repeated``: places of rows seen before."""
    return [
        "blank" if r["blank"] else "duplicate" if i in repeated else "truncated" if r["cut"] else ""
        for i, r in enumerate(rows)
    ]


def repeats(rows: list[dict]) -> set[int]:
    first: dict[str, int] = {}
    return {i for i, r in enumerate(rows) if first.setdefault(r["digest"], i) != i}


def layers_of(rows: list[dict], found: list[str]) -> list:
    return [edges(r["role"][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, found)]


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def facts(rows: list[dict], found: list[str]) -> dict:
    """Counts of a conversation or a block of it, and what its neighbours need."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "low": turns[0] if turns else None,
        "high": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "blank": found.count("blank"),
        "duplicate": found.count("duplicate"),
        "truncated": found.count("truncated"),
        "illegal": sum(not _legal(a["role"], b["role"]) for a, b in zip(rows, rows[1:])),
    }


def gaps(of: dict) -> int:
    return 0 if of["low"] is None else of["high"] - of["low"] + 1 - of["turns"]


def repaired(rows: list[dict]) -> dict:
    """Everything about one whole conversation."""
    found = faults(rows, repeats(rows))
    layers = [*layers_of(rows, found), _END]
    cost, low = split_weight(min(shortest(layers, 0).values()), len(layers))
    audit, of = audit_of(low, len(layers)), facts(rows, found)
    counts = {k: of[k] for k in ("blank", "duplicate", "truncated", "illegal")}
    return counts | {"gaps": gaps(of), "cost": cost, "audit": audit, "repaired": apply(rows, audit, 0)}


# --- conversations and blocks of sorted partitions ---------------------------------------

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = "array<struct<role:string,text:string>>"
_ROWS = "array<struct<turn:long,role:string,text:string,blank:boolean,cut:boolean,digest:string>>"
_ROW_NAMES = ("turn", "role", "text", "blank", "cut", "digest")
_ARROW_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ARROW_ROWS = pa.list_(
    pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("blank", pa.bool_()), ("cut", pa.bool_()), ("digest", pa.string())])
)


def _batches(records: Iterator[tuple[int, dict]], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Records (with about so many bytes each) as Arrow batches of a few MB."""
    held, size = [], 0
    for n, record in records:
        held.append(record)
        size += n + 200
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _id_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def cut_pieces(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Conversations that lie whole in a sorted partition, repaired, and the blocks (part, number) of all others."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "place", "copy"]
    names = ["conv_id", "gone", *_ROW_NAMES]
    kind = _id_type(rows)
    schema = pa.schema(
        [("conv_id", kind), ("part", pa.int32()), ("number", pa.int64()), *[(c, pa.int64()) for c in _COUNTS],
         ("audit", pa.string()), ("repaired", _ARROW_TURNS), ("rows", _ARROW_ROWS)]
    )

    @tidied
    def run(batches):
        part = TaskContext.get().partitionId()

        def records():
            number, held, size, conv, opened, first, begun = 0, [], 0, None, False, True, False

            def block():
                return size, {"conv_id": conv, "part": part, "number": number, "rows": held}

            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in names]
                for conv_id, gone, *values in zip(*columns):
                    if begun and conv_id != conv:
                        # The first conversation may have begun in the partition before this one.
                        if first or opened:
                            yield block()
                            number += 1
                        else:
                            yield size, {"conv_id": conv} | repaired(held)
                        held, size, opened, first = [], 0, False, False
                    conv, begun = conv_id, True
                    if gone:
                        continue
                    if held and (len(held) >= block_rows or size >= block_bytes):
                        yield block()
                        number, held, size, opened = number + 1, [], 0, True
                    held.append(dict(zip(_ROW_NAMES, values)))
                    size += len(values[2])
            # The last one may go on in the next partition.
            if begun:
                yield block()

        yield from _batches(records(), schema)

    ranged = rows.select(*names, "place", "copy").repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part int, number long, "
    ddl += ", ".join(f"{c} long" for c in _COUNTS) + f", audit string, repaired {_TURNS}, rows {_ROWS}"
    return ranged.select(*names).mapInArrow(run, ddl)


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with ``at``, their place among all blocks in order, and ``repeated``, the places of rows seen before."""
    counts = blocks.groupBy("part").agg((F.max("number") + 1).alias("n")).orderBy("part").collect()  # one row a partition
    before, ahead = 0, []
    for r in counts:
        ahead.append((r["part"], before))
        before += r["n"]
    offsets = blocks.sparkSession.createDataFrame(ahead, "part int, ahead long")
    placed = blocks.join(F.broadcast(offsets), "part").select(
        "conv_id", (F.col("ahead") + F.col("number")).alias("at"), "rows"
    )
    listed = placed.select("conv_id", "at", F.posexplode("rows").alias("i", "row")).select(
        "conv_id", "at", "i", F.col("row.digest").alias("digest"), F.struct("at", "i").alias("here")
    )
    first = (
        listed.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
        .agg(F.min("here").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    again = listed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    again = again.filter("here != first").groupBy("at").agg(F.collect_list("i").alias("repeated"))
    return written(placed.join(again, "at", "left"), "conversation-blocks")


# --- folding blocks and choosing on the way back -----------------------------------------

_NODE = "at long, costs array<long>, ranks array<int>, kids array<long>, paths array<array<int>>"
_ARROW_NODE = [
    ("at", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("kids", pa.list_(pa.int64())),
    ("paths", pa.list_(pa.list_(pa.int32()))),
]


def ranked(weights: dict[tuple[int, int], tuple[int, int]]) -> tuple[list, list]:
    """Costs and the ranks of the audits of (before, after) -> (cost, audit), 16 of each; null: no way."""
    order = {audit: i for i, audit in enumerate(sorted({audit for _, audit in weights.values()}))}
    found = [weights.get((p, q)) for p in STATES for q in STATES]
    return [w and w[0] for w in found], [w and order[w[1]] for w in found]


def fold(costs: list[list], ranks: list[list]) -> tuple[list, list, list]:
    """Costs, ranks and paths (states before, between and after the nodes) of neighbouring nodes as one."""
    n = len(costs)
    high = 4 * n
    weights, paths = {}, {}
    for start in STATES:
        best = {start: (0, (start,))}
        for i in range(n):
            after: dict[int, tuple] = {}
            for state, (weight, path) in best.items():
                for to in STATES:
                    cost = costs[i][4 * state + to]
                    if cost is not None:
                        total = weight + (cost << high) + (ranks[i][4 * state + to] << 4 * (n - 1 - i))
                        if to not in after or total < after[to][0]:
                            after[to] = (total, (*path, to))
            best = after
        for to, (weight, path) in best.items():
            weights[start, to] = (weight >> high, weight & ((1 << high) - 1))
            paths[start, to] = list(path)
    return (*ranked(weights), [paths.get((p, q)) for p in STATES for q in STATES])


def _leaves(blocks: DataFrame) -> DataFrame:
    kind, arrow = blocks.schema["conv_id"].dataType.simpleString(), _id_type(blocks)

    @tidied
    def run(batches):
        def records():
            for batch in batches:
                for block in batch.to_pylist():
                    rows = block["rows"]
                    layers = layers_of(rows, faults(rows, set(block["repeated"] or ())))
                    ways = {
                        (p, q): split_weight(w, len(layers)) for p in STATES for q, w in shortest(layers, p).items()
                    }
                    costs, ranks = ranked(ways)
                    yield 500, {"conv_id": block["conv_id"], "at": block["at"], "costs": costs, "ranks": ranks}

        yield from _batches(records(), pa.schema([("conv_id", arrow), *_ARROW_NODE]))

    return blocks.mapInArrow(run, f"conv_id {kind}, {_NODE}")


def _folded(nodes: DataFrame) -> DataFrame:
    """One level up: up to 2**FAN_BITS neighbours of a conversation as one node."""
    kind, arrow = nodes.schema["conv_id"].dataType.simpleString(), _id_type(nodes)

    def run(key, table):
        table = table.sort_by("at")
        costs, ranks, paths = fold(table["costs"].to_pylist(), table["ranks"].to_pylist())
        node = {"conv_id": key[0].as_py(), "at": key[1].as_py(), "costs": costs, "ranks": ranks}
        node |= {"kids": table["at"].to_pylist(), "paths": paths}
        return pa.Table.from_pylist([node], schema=pa.schema([("conv_id", arrow), *_ARROW_NODE]))

    up = F.shiftright("at", FAN_BITS).alias("up")
    return nodes.groupBy("conv_id", up).applyInArrow(run, f"conv_id {kind}, {_NODE}")


def _chosen(blocks: DataFrame) -> DataFrame:
    """at, p, q, tail: the states before and after every block, and whether the conversation ends with an insert there."""
    ends = blocks.groupBy("conv_id").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    bits = ends.filter("a < b").agg(F.max(F.length(F.bin(F.col("a").bitwiseXOR(F.col("b")))))).first()[0] or 0
    levels = [written(_leaves(blocks), "conversation-nodes")]
    for _ in range(-(-bits // FAN_BITS)):
        levels.append(written(_folded(levels[-1]), "conversation-nodes"))
    # From nothing to a closed or, with one more insert, an open user turn; then by cost, audit, end.
    ways = F.array(
        *[
            F.when(
                F.get("costs", F.lit(q)).isNotNull(),
                F.struct(
                    (F.get("costs", F.lit(q)) + more).alias("cost"), F.get("ranks", F.lit(q)).alias("rank"),
                    F.lit(tail).alias("tail"), F.lit(q).alias("q"),
                ),
            )
            for q, more, tail in ((0, 0, False), (3, 0, False), (2, INSERT, True))
        ]
    )
    best = F.array_min(F.filter(ways, lambda w: w.isNotNull()))
    picked = levels[-1].select("conv_id", "at", best.alias("w"))
    picked = picked.select("conv_id", "at", F.lit(0).alias("p"), F.col("w.q").alias("q"), F.col("w.tail").alias("tail"))
    for level in reversed(levels[1:]):
        of = level.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "kids", "paths")
        down = picked.join(of, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")))
        down = down.select(
            "conv_id", "kids", F.get("paths", 4 * F.col("p") + F.col("q")).alias("path"), "tail", F.posexplode("kids").alias("k", "kid")
        )
        picked = down.select(
            "conv_id", F.col("kid").alias("at"), F.get("path", F.col("k")).alias("p"), F.get("path", F.col("k") + 1).alias("q"),
            (F.col("tail") & (F.col("k") == F.size("kids") - 1)).alias("tail"),
        )
    return picked.select("at", "p", "q", "tail")


_FACTS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost")


def _edited(blocks: DataFrame) -> DataFrame:
    """Every block after its edits, with what the sums over its conversation need."""
    kind, arrow = blocks.schema["conv_id"].dataType.simpleString(), _id_type(blocks)
    schema = pa.schema(
        [("conv_id", arrow), ("at", pa.int64()), *[(c, pa.int64()) for c in _FACTS], ("first", pa.string()),
         ("last", pa.string()), ("audit", pa.string()), ("repaired", _ARROW_TURNS)]
    )

    @tidied
    def run(batches):
        def records():
            for batch in batches:
                for block in batch.to_pylist():
                    rows = block["rows"]
                    found = faults(rows, set(block["repeated"] or ()))
                    layers = layers_of(rows, found)
                    cost, low = split_weight(shortest(layers, block["p"])[block["q"]], len(layers))
                    audit = audit_of(low, len(layers))
                    if block["tail"]:
                        cost, audit = cost + INSERT, audit + "I"
                    out = {"conv_id": block["conv_id"], "at": block["at"], "cost": cost, "audit": audit}
                    out |= facts(rows, found) | {"repaired": apply(rows, audit, block["p"])}
                    if rows:
                        out |= {"first": rows[0]["role"], "last": rows[-1]["role"]}
                    yield sum(len(r["text"]) for r in rows), out

        yield from _batches(records(), schema)

    ddl = f"conv_id {kind}, at long, " + ", ".join(f"{c} long" for c in _FACTS)
    ddl += f", first string, last string, audit string, repaired {_TURNS}"
    joined = blocks.join(_chosen(blocks), "at")
    return written(joined.mapInArrow(run, ddl), "conversation-edits")


def _summed(edited: DataFrame) -> DataFrame:
    """One row per conversation of blocks, which are read one after another: a digest can't be made in parts."""
    kind, arrow = edited.schema["conv_id"].dataType.simpleString(), _id_type(edited)
    schema = pa.schema([("conv_id", arrow), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    @tidied
    def run(batches):
        def records():
            conv, total = None, None
            for batch in batches:
                for block in batch.to_pylist():
                    if total is None or block["conv_id"] != conv:
                        if total is not None:
                            yield 0, finished(conv, total)
                        conv = block["conv_id"]
                        total = dict.fromkeys((*_COUNTS, "turns"), 0) | {"low": None, "high": None, "last": None, "hash": hashlib.sha256(), "lines": 0, "audit": []}
                    add(total, block)
            if total is not None:
                yield 0, finished(conv, total)

        def add(total, block):
            for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                total[c] += block[c]
            if block["low"] is not None:
                # Turns ascend, so only the border can hold one turn twice.
                total["turns"] -= total["high"] == block["low"]
                total["low"] = block["low"] if total["low"] is None else total["low"]
                total["high"] = block["high"]
            if block["first"] is not None:
                total["illegal"] += total["last"] is not None and not _legal(total["last"], block["first"])
                total["last"] = block["last"]
            total["audit"].append(block["audit"])
            for turn in block["repaired"]:
                line = f"{turn['role']}:{turn['text']}"
                total["hash"].update((f"\n{line}" if total["lines"] else line).encode())
                total["lines"] += 1

        def finished(conv, total):
            out = {c: total[c] for c in _COUNTS} | {"conv_id": conv, "gaps": gaps(total)}
            return out | {"audit": "".join(total["audit"]), "repaired_sha256": total["hash"].hexdigest()}

        yield from _batches(records(), schema)

    ddl = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    order = edited.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at")
    return order.select("conv_id", *_FACTS, "first", "last", "audit", "repaired").mapInArrow(run, ddl)


def text_digest(turns: Column) -> Column:
    """SHA-256 of ``role:text`` lines."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(summary, turns)`` of conversations (conv_id, turn, role, text) after the test damage.

    ``summary``: one row per original conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. ``turns``: conv_id, block (its order) and repaired (array of role and text).
    """
    pieces = written(cut_pieces(damaged(conversations), block_rows), "conversation-pieces")
    whole = pieces.filter("part IS NULL")
    edited = _edited(_numbered(pieces.filter("part IS NOT NULL").select("conv_id", "part", "number", "rows")))
    summary = whole.select("conv_id", *_COUNTS, "audit", text_digest(F.col("repaired")).alias("repaired_sha256"))
    turns = whole.select("conv_id", F.lit(0).cast("long").alias("block"), "repaired")
    return (
        summary.unionByName(_summed(edited)),
        turns.unionByName(edited.select("conv_id", F.col("at").alias("block"), "repaired")),
    )


#: CRC-32 of ASCII and other texts, the damage, and the cheapest repair row by row, with two inserts in a row allowed.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 1, 2, 3, 4, 5, 6, 7]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), src AS (
  SELECT row_number() OVER () AS rid, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn,
    COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
    COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS harm FROM src, crc_table
), harmed AS (
  SELECT rid, cid, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE harm WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE harm <> 0
), sorted AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), rid, copy) AS n,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM harmed
), judged AS (
  SELECT cid, n, turn, role, text, left(role, 1) AS c, left(lag(role) OVER (PARTITION BY cid ORDER BY n), 1) || left(role, 1) AS pair,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM sorted
), counts AS (
  SELECT cid, count(*) AS n, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY cid
), ins(p, q, cost, letters, lines) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 2, 3, 'I', chr(10) || 'user:'),
  (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), step(p, letter, c, q, cost, role) AS (VALUES
  (0, 'D', NULL, 0, 4, NULL), (1, 'D', NULL, 1, 4, NULL), (2, 'D', NULL, 2, 4, NULL), (3, 'D', NULL, 3, 4, NULL),
  (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL),
  (0, 'R', NULL, 2, 3, 'user'), (1, 'R', NULL, 2, 3, 'user'), (3, 'R', NULL, 2, 3, 'user'), (2, 'R', NULL, 3, 3, 'assistant')
), moves AS (
  SELECT ins.p, step.q, step.c, step.letter, ins.cost + step.cost AS cost, ins.letters || step.letter AS letters, ins.lines, step.role
  FROM ins JOIN step ON ins.q = step.p
), path(cid, n, state, best, lines) AS (
  SELECT DISTINCT cid, 0::BIGINT, 0, '000000000', '' FROM src
  UNION ALL
  SELECT cid, n, q, min(best), arg_min(lines, best) FROM (
    SELECT path.cid, judged.n, moves.q,
      printf('%09d', left(best, 9)::BIGINT + moves.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END)
        || substr(best, 10) || moves.letters AS best,
      path.lines || moves.lines || CASE WHEN letter = 'D' THEN '' ELSE chr(10) || COALESCE(moves.role, judged.role) || ':' || text END AS lines
    FROM path JOIN judged ON judged.cid = path.cid AND judged.n = path.n + 1 JOIN moves ON moves.p = path.state
    WHERE (moves.c IS NULL OR moves.c = judged.c) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
  ) GROUP BY cid, n, q
), ended AS (
  SELECT path.cid, path.n, printf('%09d', left(best, 9)::BIGINT + ins.cost) || substr(best, 10) || ins.letters AS best, path.lines || ins.lines AS lines
  FROM path JOIN ins ON ins.p = path.state WHERE ins.q IN (0, 3)
), chosen AS (
  SELECT cid, min(best) AS best, arg_min(lines, best) AS lines FROM ended LEFT JOIN counts USING (cid)
  WHERE ended.n = COALESCE(counts.n, 0) GROUP BY cid
)
SELECT conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0)::BIGINT AS blank, COALESCE(duplicate, 0)::BIGINT AS duplicate,
  COALESCE(truncated, 0)::BIGINT AS truncated, COALESCE(illegal, 0)::BIGINT AS illegal, left(best, 9)::BIGINT AS cost,
  substr(best, 10) AS audit, sha256(substr(lines, 2)) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM src) JOIN chosen USING (cid) LEFT JOIN counts USING (cid)
"""
