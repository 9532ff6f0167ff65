"""Repair of damaged conversations by weighted CYK interval parsing.

A conversation is whole if its role initials read (s?(ua)+)?: nothing, or an optional system
turn and then user and assistant in turns. Rows are kept, rerolled, deleted or have empty rows
inserted before them, each at a cost; wanted is the cheapest repair, and of those the one whose
edits, written as initials (D, I, K, R) in order, come first in ASCII order.

The grammar in Chomsky normal form has a nonterminal <p,q> for each two places p, q of the
pattern, which derives every span that leads from p to q:

    <p,q> -> <p,r> <r,q>        <p,q> -> edited row        <p,q> -> nothing, by insertions

A span's cell for <p,q> holds its least (cost, audit). The insertion closure is the table of
spans without rows; it is part of each single row's cells, before and after the row. Because
the nonterminals tell both ends of a span, all of its derivations go through any one cut, so
each span takes one cut, in place of every one: spans combine bottom-up by length, 1, 2, 4, ...
and n rows make fewer than 2n spans, where the plain triangle has n * n / 2. Strings of equal
cost over the same rows never start with one another (what one has more would be insertions,
which cost), so the least strings of the parts make the least string of the whole.

Spark orders the rows of all conversations by ranges, so a conversation may span many tasks;
each makes one span of what it has, and a last step combines a conversation's spans, at most
one a task. Only the hash of the repaired conversation reads it in one task, row by row: SHA-256
can't be taken in parts. That task holds the conversation's edits and a batch of its rows.

Edges: null roles and texts, and null ids in the damage's hash, stand as one space; rows with a
null conv_id are one conversation. Rows of one turn come in the order of role, then of the
text's SHA-256; equal rows are counted, not kept apart. A role counts by its first character,
so that an unknown role is never kept. A conversation that has lost all rows has zeros, no
edits and the hash of the empty string. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm.common import stored

# Fixed values of the repair: costs of edits, and the pattern's places and steps.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"

FINE, GONE, CUT = 0, 1, 2
#: Spans of up to this many rows are remembered by what they consist of.
REMEMBERED = 16

Cell = tuple[int, str] | None
Span = tuple[tuple[Cell, ...], ...]


def combined(left: Span, right: Span) -> Span:
    """The cells of two neighbouring spans' union."""
    out = []
    for row in left:
        best: list[Cell] = [None] * 4
        for middle, a in enumerate(row):
            if a is None:
                continue
            for q, b in enumerate(right[middle]):
                if b is not None:
                    cost, had = a[0] + b[0], best[q]
                    if had is None or cost < had[0]:
                        best[q] = (cost, a[1] + b[1])
                    elif cost == had[0] and (edits := a[1] + b[1]) < had[1]:
                        best[q] = (cost, edits)
        out.append(tuple(best))
    return tuple(out)


def _closure() -> Span:
    """Spans without rows: what insertions alone lead to."""
    once: list[list[Cell]] = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
    for (p, role), q in STEPS.items():
        if role != "s":
            once[p][q] = (INSERT, "I")
    span = tuple(map(tuple, once))
    while (more := combined(span, span)) != span:
        span = more
    return span


NOTHING = _closure()


def _code(initial: str, fault: int) -> str:
    """A row as a letter: what its edits depend on."""
    return chr(65 + ("s", "u", "a").index(initial) * 3 + fault) if initial in ("s", "u", "a") else chr(74 + fault)


@lru_cache(maxsize=1 << 16)
def spanned(codes: str) -> Span:
    """The cells of a span of rows, from those of its parts."""
    if len(codes) > 1:
        half = 1 << (len(codes) - 1).bit_length() - 1
        return combined(spanned(codes[:half]), spanned(codes[half:]))
    if not codes:
        return NOTHING
    kind, fault = divmod(ord(codes) - 65, 3)
    initial = "sua"[kind] if kind < 3 else ""
    row: list[list[Cell]] = [[(DELETE, "D") if p == q else None for q in range(4)] for p in range(4)]
    if fault != GONE:
        for (p, role), q in STEPS.items():
            if role == initial or role != "s":
                row[p][q] = ((0 if role == initial else REROLE) + (TRUNCATED if fault == CUT else 0), "K" if role == initial else "R")
    return combined(combined(NOTHING, tuple(map(tuple, row))), NOTHING)


class Growing:
    """A span that grows at its end; equal lengths combine, so a few spans wait at a time."""

    def __init__(self):
        self.codes, self.waiting = "", []

    def add(self, codes: str) -> None:
        self.codes += codes
        whole = len(self.codes) // REMEMBERED * REMEMBERED
        for at in range(0, whole, REMEMBERED):
            size, span = REMEMBERED, spanned(self.codes[at : at + REMEMBERED])
            while self.waiting and self.waiting[-1][0] == size:
                span = combined(self.waiting.pop()[1], span)
                size *= 2
            self.waiting.append((size, span))
        self.codes = self.codes[whole:]

    def span(self) -> Span:
        out = spanned(self.codes)
        for _, span in reversed(self.waiting):
            out = combined(span, out)
        return out


def least(span: Span) -> tuple[int, str]:
    """The cheapest repair of a span that is a whole conversation."""
    return min(c for q in ENDS if (c := span[START][q]) is not None)


# ---------------------------------------------------------------- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """conv (a name of conv_id that is never null), turn, role, text, copies: the rows after the damage."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(text_of("conv_id").alias("conv"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    way = F.crc32(F.concat("conv", F.lit(":"), text_of("turn"))) % 20
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    out = rows.withColumn("way", way).where("way <> 0")
    return out.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("way") == 3, 2).otherwise(1).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """One row for each of equal rows, with `known` (its turn isn't null), `copies`, `name` (its
    text's SHA-256) and its `fault`; of several copies only the first may be no duplicate."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("name", F.sha2("text", 256)).withColumn("known", F.col("turn").isNotNull())
    first = rows.groupBy("conv", "role", "name").agg(F.min(F.struct("known", "turn")).alias("first"))
    rows = rows.join(first, ["conv", "role", "name"])
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    seen = ~(F.struct("known", "turn").eqNullSafe(F.col("first")))
    fault = F.when(end == "", "blank").when(seen, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv", "known", "turn", "role", "text", "name", "copies", fault.alias("fault"))


ORDER = ["known", "turn", "role", "name"]
SPAN = "conv string, part int, at int, first string, last string, illegal long, cells array<struct<cost:long,audit:string>>"


def _spans(batches):
    """One span for each conversation that a task has rows of; the rows come in order."""
    part, at, conv, growing, first, last, illegal = TaskContext.get().partitionId(), 0, None, None, "", "", 0

    def done():
        cells = [None if c is None else {"cost": c[0], "audit": c[1]} for row in growing.span() for c in row]
        return {"conv": conv, "part": part, "at": at, "first": first, "last": last, "illegal": illegal, "cells": cells}

    out = []
    for batch in batches:
        for name, role, fault, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "fault", "copies"))):
            initial = role[:1]
            if name != conv or growing is None:
                if growing is not None:
                    out.append(done())
                conv, growing, first, illegal, at = name, Growing(), initial, 0, at + 1
            else:
                illegal += last + initial not in LEGAL
            growing.add(_code(initial, GONE if fault in ("blank", "duplicate") else CUT if fault else FINE))
            if copies > 1:
                growing.add(_code(initial, GONE) * (copies - 1))
                illegal += copies - 1
            last = initial
        yield _rows(out)
        out = []
    if growing is not None:
        yield _rows([done()])


_CELLS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_SPAN = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("at", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("cells", _CELLS)])


def _rows(out: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(out, schema=_SPAN)


def _parsed(batches):
    """The cheapest repair of each conversation, from its spans in order."""
    for batch in batches:
        out = []
        for conv, spans in zip(batch.column("conv").to_pylist(), batch.column("spans")):
            whole, illegal, last = NOTHING, 0, None
            for s in spans.as_py():
                cells = [None if c is None else (c["cost"], c["audit"]) for c in s["cells"]]
                whole = combined(whole, tuple(tuple(cells[4 * p : 4 * p + 4]) for p in range(4)))
                illegal += s["illegal"] + (last is not None and last + s["first"] not in LEGAL)
                last = s["last"]
            out.append((conv, illegal, *least(whole)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["conv", "illegal", "cost", "audit"])


class _Writer:
    """The repaired conversation as a hash, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.hash, self.empty = audit, 0, START, hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
        self.empty = False

    def put(self, text: str) -> None:
        """A row of the role that comes next, user or assistant."""
        role = "assistant" if self.place == USER else "user"
        self.line(role, text)
        self.place = STEPS[self.place, role[0]]

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text)
            self.place = STEPS[self.place, role[0]]
        elif edit == "R":
            self.put(text)

    def end(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _hashed(batches):
    """conv, repaired_sha256: a conversation's edits come first, then its rows in order."""
    conv, writer = None, None
    for batch in batches:
        out = []
        for name, audit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text", "copies"))):
            if audit is not None:
                if writer:
                    out.append((conv, writer.end()))
                conv, writer = name, _Writer(audit)
            else:
                for _ in range(copies):
                    writer.row(role, text)
        yield pa.RecordBatch.from_pydict({"conv": pa.array([o[0] for o in out], pa.string()), "repaired_sha256": pa.array([o[1] for o in out], pa.string())})
    if writer:
        yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [writer.end()]})


def repaired(conversations: DataFrame) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = stored(with_faults(damaged(conversations)), "turns")
    spans = rows.select("conv", *ORDER, "fault", "copies").orderBy("conv", *ORDER).select("conv", "role", "fault", "copies").mapInArrow(_spans, SPAN)
    spans = spans.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "at", "first", "last", "illegal", "cells"))).alias("spans"))
    parsed = stored(spans.mapInArrow(_parsed, "conv string, illegal long, cost long, audit string"), "parsed")

    stream = parsed.select("conv", F.lit(0).alias("kind"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("known", "boolean"), ("turn", rows.schema["turn"].dataType), ("role", "string"), ("name", "string"), ("text", "string"), ("copies", "long"))])
    stream = stream.unionByName(rows.select("conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), *ORDER, "text", "copies"))
    stream = stream.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)
    hashed = stream.select("conv", "audit", "role", "text", "copies").mapInArrow(_hashed, "conv string, repaired_sha256 string")

    amount = lambda fault: F.sum(F.when(F.col("fault") == fault, F.col("copies") if fault != "truncated" else F.lit(1)).otherwise(0))
    again = F.sum(F.when(F.col("fault").isin("", "truncated"), F.col("copies") - 1).otherwise(0))
    turns = rows.groupBy("conv", "turn").agg(amount("blank").alias("blank"), (amount("duplicate") + again).alias("duplicate"), amount("truncated").alias("truncated"))
    number = lambda c: c.cast("decimal(38,0)")
    gaps = number(F.max("turn")) - number(F.min("turn")) + 1 - F.count("turn")
    gaps = F.when(F.count("turn") == 0, 0).otherwise(F.least(gaps, number(F.lit((1 << 63) - 1))).cast("long"))
    counts = turns.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])

    every = conversations.groupBy("conv_id").agg(F.lit(0)).select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"))
    out = every.join(counts, "conv", "left").join(parsed, "conv", "left").join(hashed, "conv", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


# ---------------------------------------------------------------- the same in SQL, left to right


def _sql_least(*cells: str) -> str:
    return f"list_min([{', '.join(cells)}])"


def _sql_step(p: str, cost: int | str, edit: str, line: str) -> str:
    """p: a cell (cost, audit, output) as a struct; the cell after one more edit."""
    return f"struct_pack(c := {p}.c + {cost}, a := {p}.a || '{edit}', o := {p}.o || {line})"


def _sql_closed(q: list[str]) -> str:
    """The places' cells once rows may be inserted."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    u = _sql_least(q[2], *[_sql_step(q[p], INSERT, "I", user) for p in (0, 1, 3)])
    a = _sql_least(q[3], _sql_step(q[2], INSERT, "I", assistant), *[_sql_step(_sql_step(q[p], INSERT, "I", user), INSERT, "I", assistant) for p in (0, 1)])
    return f"struct_pack(q0 := {q[0]}, q1 := {q[1]}, q2 := {u}, q3 := {a})"


def _sql_row() -> str:
    """The next row r.x after the places' cells l.s."""
    extra = f"(case when r.x.fault = 'truncated' then {TRUNCATED} else 0 end)"
    never = "(case when r.x.fault in ('blank', 'duplicate') then 1000000000 else 0 end)"
    out = []
    for q in range(4):
        cells = [_sql_step(f"l.s.q{q}", DELETE, "D", "''")]
        for (p, role), to in STEPS.items():
            if to == q:
                keep = f"(case when r.x.role[1] = '{role}' then 0 else 1000000000 end)"
                cells.append(_sql_step(f"l.s.q{p}", f"{extra} + {never} + {keep}", "K", "chr(10) || r.x.role || ':' || r.x.text"))
                if role != "s":
                    name = "user" if role == "u" else "assistant"
                    cells.append(_sql_step(f"l.s.q{p}", f"{extra} + {never} + {REROLE}", "R", f"chr(10) || '{name}:' || r.x.text"))
        out.append(_sql_least(*cells))
    row = f"struct_pack(q0 := {out[0]}, q1 := {out[1]}, q2 := {out[2]}, q3 := {out[3]})"
    return f"struct_pack(s := list_transform([{row}], lambda y: {_sql_closed([f'y.q{q}' for q in range(4)])})[1], x := r.x)"


_EMPTY, _FAR = "struct_pack(c := 0::bigint, a := '', o := '')", "struct_pack(c := 1000000000000::bigint, a := '', o := '')"
_BIT = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"

ORACLE = f"""
with base as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ascii(ch)::bigint),
            lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: {_BIT}), 4294967295::bigint)) % 20 as way
    from conversations),
hurt as (
    select conv_id, turn, case when way = 4 then 'user' else role end as role, unnest(range(case when way = 3 then 2 else 1 end)) as copy,
        case when way = 1 then '' when way = 2 then translate(text, '.!?', '') else text end as text
    from base where way <> 0),
seen as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as n,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last
    from hurt),
faulty as (
    select *, case when last = '' then 'blank' when again then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault,
        lag(role[1]) over (partition by conv_id order by n) || role[1] as pair
    from seen),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (pair not in ('su', 'ua', 'au')) as illegal,
        list(struct_pack(role, text, fault) order by n) as turns
    from faulty group by conv_id),
closed_rows as (select conv_id, list_reduce(list_prepend(struct_pack(s := {_sql_closed([_EMPTY, _FAR, _FAR, _FAR])}, x := struct_pack(role := '', text := '', fault := '')),
        list_transform(turns, lambda t: struct_pack(s := {_sql_closed([_FAR, _FAR, _FAR, _FAR])}, x := t))),
        lambda l, r: {_sql_row()}).s as s
    from counts),
best as (select conv_id, list_min([s.q0, s.q3]) as b from closed_rows)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(b.o[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) e
left join counts c on e.conv_id is not distinct from c.conv_id left join best on e.conv_id is not distinct from best.conv_id
"""
