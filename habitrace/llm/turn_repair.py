"""Repair of conversation structure by a min-plus scan of 4 x 4 matrices.

Legal roles are ``(s?(ua)+)?``, which four states read: nothing yet, after the
system turn, after a user turn, after an assistant turn. A turn is a matrix
over (cost, audit): what it costs, and which edits it takes, to get from one
state to another by keeping, reroling or deleting the turn and then inserting
any empty turns. Products of such matrices are associative: the turns of a
conversation are multiplied in blocks of at most 256, the blocks in groups of
64, those again, wherever the rows lie, until one matrix is left.

Where two ways cost the same, the audit that is ASCII-least wins. Comparing
audits of parts is enough: two audits over the same turns at one cost are never
one the beginning of the other, as the rest would be insertions, which cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitrace.llm.store import settled, written

START, SYSTEM, USER, ASSISTANT = range(4)
#: State before, role initial, state after.
STEPS = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER), (USER, "a", ASSISTANT))
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}

BLOCK_BITS, GROUP = 8, 64

#: (cost, audit) by state before and after; what is missing is impossible.
Matrix = dict[tuple[int, int], tuple[int, str]]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: costs add, audits join, the least (cost, audit) stays."""
    made: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for (k2, j), (more, rest) in b.items():
            if k == k2 and ((i, j) not in made or (cost + more, audit + rest) < made[i, j]):
                made[i, j] = (cost + more, audit + rest)
    return made


def inserts() -> Matrix:
    """The closure of insertions: nothing, or the cheapest run of inserted user and assistant turns."""
    nothing: Matrix = {(i, i): (0, "") for i in range(4)}
    one = nothing | {(i, j): (INSERT, "I") for i, role, j in STEPS if role != "s"}
    return reduce(times, [one] * 4, nothing)


@lru_cache(maxsize=64)
def turn_matrix(initial: str, fault: str) -> Matrix:
    """Of a turn by its role's initial and its fault ('blank', 'duplicate', 'truncated' or '')."""
    made: Matrix = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        made |= {(i, j): (REROLE + extra, "R") for i, role, j in STEPS if role in NAMES}
        made |= {(i, j): (extra, "K") for i, role, j in STEPS if role == initial}
    return times(made, inserts())


def product(turns: list[tuple[str, str, int]]) -> Matrix:
    """Of turns (initial, fault, copies); all copies but the first are duplicates."""
    made: Matrix | None = None
    for initial, fault, copies in turns:
        if initial not in "sua":
            initial = ""
        own = turn_matrix(initial, fault)
        if copies > 1:
            n = copies - 1
            own = times(own, times({(i, i): (DELETE * n, "D" * n) for i in range(4)}, inserts()))
        made = own if made is None else times(made, own)
    return made or {}


def _packed(matrix: Matrix) -> list[dict]:
    return [{"i": i, "j": j, "cost": cost, "audit": audit} for (i, j), (cost, audit) in sorted(matrix.items())]


def _unpacked(cells: list[dict]) -> Matrix:
    return {(c["i"], c["j"]): (c["cost"], c["audit"]) for c in cells}


CELLS = T.ArrayType(T.StructType().add("i", "integer").add("j", "integer").add("cost", "long").add("audit", "string"))
_ARROW_CELLS = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _multiplied(rows: DataFrame, take) -> DataFrame:
    """(_row, cells): ``take`` makes a matrix of what a row holds in ``list``; the other columns stay in ``_row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_packed(take(held)) for held in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, _ARROW_CELLS)], names=["_row", "cells"])

    packed = rows.select(F.struct(*(c for c in rows.columns if c != "list")).alias("_row"), "list")
    return packed.mapInArrow(run, packed.select("_row").schema.add("cells", CELLS)).select("_row.*", "cells")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    A null is one space in texts, roles and the hashed key.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"),
        (F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20).alias("way"),
    )
    way = F.col("way")
    return rows.filter(way != 0).select(
        "conv_id",
        "turn",
        F.when(way == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(way == 1, "").when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(way == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faulted(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, copies), equal rows as one, in order of ``at``, with the first fault of each.

    A conversation's turns are ordered by turn number (nulls first), role and
    text. They are sorted over all partitions by ranges, so a conversation of
    any length is cut where it needs to be; ``at`` numbers the sorted rows. A
    duplicate is a row whose role and text come first at an earlier turn.
    """
    solid = r"[^\x20\x09-\x0D]"
    one = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", F.sha2("text", 256))
    # turns before all others: a null turn number sorts first
    first = one.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    known = one.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")))
    last = F.regexp_extract("text", rf"({solid})[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(solid), "blank")
        .when(~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    marked = known.select("conv_id", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return written(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")


def _blocks(turns: DataFrame) -> DataFrame:
    """A row per block of a conversation: what it adds up to, its matrix, and where its first row stands."""
    copies = F.col("copies")
    more = lambda c: F.when(c, copies - 1).otherwise(0)
    fault = F.col("fault")
    light = turns.select("conv_id", F.shiftright("at", BLOCK_BITS).alias("block"), "at", "turn", "initial", "fault", "copies")
    listed = light.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "initial", "fault", "copies", "turn"))).alias("list"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("copies").alias("rows"),
        F.sum(F.when(fault == "blank", copies).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "duplicate", copies).otherwise(more(fault != "blank"))).alias("duplicate"),
        F.sum((fault == "truncated").cast("long")).alias("truncated"),
    )
    at = lambda k: F.element_at("list", k)
    wrong = lambda a, b: ~F.concat(a, b).isin("su", "ua", "au")
    inside = F.aggregate(F.zip_with(F.slice("list", 1, F.size("list") - 1), F.slice("list", 2, F.size("list")), lambda a, b: wrong(a["initial"], b["initial"]).cast("long")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    repeated = F.aggregate("list", F.lit(0).cast("long"), lambda s, x: s + x["copies"] - 1)
    numbers = F.array_distinct(F.filter(F.transform("list", lambda x: x["turn"]), lambda t: t.isNotNull()))
    summed = listed.select(
        "*", (inside + repeated).alias("illegal"), F.size(numbers).cast("long").alias("numbers"), at(1)["initial"].alias("begins"), at(-1)["initial"].alias("ends")
    )
    back = Window.partitionBy("conv_id").orderBy("block")
    before = lambda c: F.lag(c).over(back)
    placed = summed.select(
        "*",
        F.coalesce(wrong(before("ends"), F.col("begins")).cast("long"), F.lit(0)).alias("seam"),
        F.coalesce((before("high") == F.col("low")).cast("long"), F.lit(0)).alias("shared"),
        (F.sum("rows").over(back) - F.col("rows")).alias("before"),
        (F.row_number().over(back) - 1).cast("long").alias("place"),
    )
    multiplied = _multiplied(placed.select("conv_id", "block", "place", "before", "low", "high", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("seam")).alias("illegal"), (F.col("numbers") - F.col("shared")).alias("numbers"), F.transform("list", lambda x: F.struct(x["initial"], x["fault"], x["copies"])).alias("list")), lambda held: product([tuple(t.values()) for t in held]))
    return settled(multiplied)


def _reduced(blocks: DataFrame) -> DataFrame:
    """(conv_id, cells): neighbouring matrices are multiplied 64 at a time until a conversation has one."""
    level = blocks.select("conv_id", "place", "cells")
    top = level.agg(F.max("place")).first()[0] or 0
    while True:
        listed = level.groupBy("conv_id", F.floor(F.col("place") / GROUP).alias("place")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "cells"))), lambda x: x["cells"]).alias("list"))
        level = _multiplied(listed, lambda held: reduce(times, map(_unpacked, held)))
        top //= GROUP
        if top == 0:
            return level.select("conv_id", "cells")
        level = settled(level)


def _steps(audit: str) -> Iterator[tuple[int | None, str | None]]:
    """(row, initial) of the turns that stay: row None where one is inserted, initial None where a turn keeps its role."""
    row = 0
    shape = []
    for edit in audit:
        if edit == "I":
            shape.append((None, True))
        else:
            if edit != "D":
                shape.append((row, edit == "R"))
            row += 1
    # pairs of user and assistant are counted from the end, so a system turn in front doesn't matter
    for k, (row, new) in enumerate(shape):
        yield row, ("a" if (len(shape) - k) % 2 else "u") if new else None


def repair(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every id of ``conversations``.

    ``turns`` are (conv_id, turn, role, text, copies). Rows without a
    conversation are one conversation, with a null id; a conversation without
    turns has zeros, an empty audit and the hash of an empty string. Repeated
    rows are copies of one turn. Turns of one number are ordered by role, then
    text. An empty table gives no row; texts are read whole; other columns,
    whatever they are called, are left out. A conversation's audit is one
    value, and its text goes through one hash, row by row. An empty role has no
    initial and fits nowhere: such a turn is reroled or deleted.
    """
    rows = faulted(turns)
    blocks = _blocks(rows)
    ends = F.filter("cells", lambda c: (c["i"] == START) & c["j"].isin(*ENDS))
    with_start = _multiplied(_reduced(blocks).select("conv_id", F.col("cells").alias("list")), lambda held: times(inserts(), _unpacked(held)))
    best = settled(with_start.select("conv_id", F.array_min(F.transform(ends, lambda c: F.struct(c["cost"], c["audit"]))).alias("best")))
    sums = blocks.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("numbers"), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal"))
    )
    hashes = _hashed(rows, blocks, best)
    names = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = lambda a, b: a.conv_id.eqNullSafe(b.conv_id)
    found = names.join(sums, same(names, sums), "left").join(best, same(names, best), "left").join(hashes, same(names, hashes), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select(
        names.conv_id,
        *(zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")),
        zero(F.col("best.cost")).alias("cost"),
        F.coalesce("best.audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _hashed(rows: DataFrame, blocks: DataFrame, best: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): audits are dealt out to the rows, and the lines of a conversation run through its hash in order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = [(conv, k, row, initial) for k, (row, initial) in enumerate(_steps(audit))]
                for at in range(0, len(held), 10_000):
                    part = list(zip(*held[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(part, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "k", "row", "initial"])

    dealt = best.select("conv_id", F.col("best.audit").alias("audit")).mapInArrow(deal, "conv_id long, k long, row long, initial string")
    starts = blocks.select("conv_id", "block", "before")
    inside = Window.partitionBy("conv_id", "block").orderBy("at")
    numbered = rows.withColumn("block", F.shiftright("at", BLOCK_BITS)).withColumn("own", F.sum("copies").over(inside) - F.col("copies"))
    texts = numbered.join(starts, numbered.conv_id.eqNullSafe(starts.conv_id) & (numbered.block == starts.block)).select(numbered.conv_id, (F.col("own") + F.col("before")).alias("row"), "role", "text")
    role = F.when(dealt.initial == "u", NAMES["u"]).when(dealt.initial == "a", NAMES["a"]).otherwise(texts.role)
    lines = dealt.join(texts, dealt.conv_id.eqNullSafe(texts.conv_id) & (dealt.row == texts.row), "left").select(dealt.conv_id, "k", F.concat(role, F.lit(":"), F.coalesce(texts.text, F.lit(""))).alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "k")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for conv, k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (t.as_py() for t in batch.column(2))):
                if state is None or k == 0:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def oracle_sql() -> str:
    """The registered query for DuckDB: a recursive walk over the turns with the best (cost, audit) of each state."""
    add = lambda state, cost, edit: f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} end"
    low = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x is not null))"
    keep = lambda role, state: f"case when initial = '{role}' and not gone then {add(state, 'extra', 'K')} end"
    rerole = lambda state: f"case when not gone then {add(state, '3 + extra', 'R')} end"
    closed = f"q0 as p0, q1 as p1, {low('q2', add('q0', 3, 'I'), add('q1', 3, 'I'), add('q3', 3, 'I'))} as p2, {low('q3', add('q2', 3, 'I'), add('q0', 6, 'II'), add('q1', 6, 'II'))} as p3"
    none = "cast(null as struct(c bigint, a varchar))"
    solid = r"[^\x20\x09-\x0D]"
    crc = _crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")
    return f"""
with recursive base as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as way from conversations),
hurt as (select conv_id, turn, case when way = 4 then 'user' else role end as role, case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case way when 3 then [1, 2] else [1] end) as copy from base where way <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from hurt),
num as (select *, row_number() over (partition by conv_id, role, text order by k) as again, substr(role, 1, 1) as initial from placed),
rows as (select *, case when not regexp_matches(text, '{solid}') then 'blank' when again > 1 then 'duplicate' when regexp_extract(text, '({solid})[\\x20\\x09-\\x0D]*\\z', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
  lag(initial) over (partition by conv_id order by k) || initial as pair from num),
turns as (select *, fault in ('blank', 'duplicate') as gone, case when fault = 'truncated' then 3 else 0 end as extra from rows),
sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(k) as n from turns group by conv_id),
walk as (
  select conv_id, cast(0 as bigint) as k, {closed} from (select conv_id, {{'c': cast(0 as bigint), 'a': cast('' as varchar)}} as q0, {none} as q1, {none} as q2, {none} as q3 from sums)
  union all
  select conv_id, k, {closed} from (
    select w.conv_id, t.k, {add('p0', 4, 'D')} as q0, {low(add('p1', 4, 'D'), keep('s', 'p0'))} as q1,
      {low(add('p2', 4, 'D'), *(f(s) for s in ('p0', 'p1', 'p3') for f in (lambda s: keep('u', s), rerole)))} as q2, {low(add('p3', 4, 'D'), keep('a', 'p2'), rerole('p2'))} as q3
    from walk w join turns t on t.conv_id is not distinct from w.conv_id and t.k = w.k + 1)),
best as (select w.conv_id, {low('p0', 'p3')} as b from walk w join sums s on s.conv_id is not distinct from w.conv_id and s.n = w.k),
edits as (select conv_id, b.c as cost, b.a as audit, unnest(range(1, length(b.a) + 1)) as e from best),
kinds as (select *, audit[e] as kind, count(*) filter (audit[e] <> 'I') over (partition by conv_id order by e) as k, count(*) filter (audit[e] <> 'D') over (partition by conv_id order by e desc) as back from edits),
lines as (select d.conv_id, d.e, case when kind = 'K' then t.role when back % 2 = 1 then 'assistant' else 'user' end || ':' || case when kind = 'I' then '' else t.text end as line
  from kinds d left join turns t on kind <> 'I' and t.conv_id is not distinct from d.conv_id and t.k = d.k where kind <> 'D'),
whole as (select conv_id, sha256(string_agg(line, chr(10) order by e)) as h from lines group by conv_id)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.b.c, 0) as cost, coalesce(b.b.a, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i left join sums s on s.conv_id is not distinct from i.conv_id left join best b on b.conv_id is not distinct from i.conv_id left join whole w on w.conv_id is not distinct from i.conv_id"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a short text for DuckDB, bit by bit."""
    step = lambda c: f"case when {c} & 1 = 1 then xor({c} >> 1, 3988292384) else {c} >> 1 end"
    byte = "x"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: {step('c')})[1]"
    folded = f"list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split({text}, ''), lambda s: cast(ascii(s) as bigint))), lambda h, b: list_transform([xor(h, b)], lambda x: {byte})[1])"
    return f"xor({folded}, 4294967295)"
