"""Conversation structure repair: weighted CYK parsing of turn sequences with a repair grammar over spans.

The legal sequences of role initials are ``(s?(ua)+)?``. Its grammar in Chomsky normal form has a nonterminal for every
pair of places of that sequence ([start, user] derives what leads from the start to a place after a user turn), the binary
rules ``[p, q] -> [p, r] [r, q]``, and rules of one turn: keep it (K), give it another role (R), delete it (D). Inserted
turns (I) derive the empty span and are closed over every cell. A cell holds the least (cost, audit) of every
nonterminal; audits of equal cost over one span are never proper prefixes of each other, so the least of a
concatenation is made of least parts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, materialise, named, ship

ship(__name__)

START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {USER: "user", ASSISTANT: "assistant"}
SPACES = " \t\n\x0b\x0c\r"
# Turns of one chart; the cells of longer stretches are combined pair by pair.
CHART = 12
MOST = (1 << 63) - 1

Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell) -> Cell:
    """All binary rules over two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((r, q))
            if more is not None:
                found = (cost + more[0], audit + more[1])
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def insertions() -> Cell:
    """The cell of the empty span: any number of inserted turns, until nothing gets cheaper."""
    one: Cell = {step: (INSERT, "I") for c in "ua" for step in STEPS[c]}
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    while True:
        more = joined(cell, one)
        closed = {k: min(x[k] for x in (cell, more) if k in x) for k in {**cell, **more}}
        if closed == cell:
            return cell
        cell = closed


EMPTY = insertions()


def turn_cell(code: str) -> Cell:
    """The cell of one turn: ``-`` must go; else the role's initial (``x`` for any other), upper case if truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "-":
        extra = TRUNCATED if code.isupper() else 0
        edits = [(step, (extra, "K")) for step in STEPS.get(code.lower(), ())]
        edits += [(step, (REROLE + extra, "R")) for c in "ua" for step in STEPS[c]]
        for step, edit in edits:
            cell[step] = min(edit, cell.get(step, edit))
    return joined(joined(EMPTY, cell), EMPTY)


# Cells of short stretches, which recur from conversation to conversation; emptied when there are too many.
KNOWN: dict[str, Cell] = {}
REMEMBERED = 1 << 15


def chart(codes: str) -> Cell:
    """The cell of a short stretch of turns, bottom-up by span length over all splits of every span."""
    if codes in KNOWN:
        return KNOWN[codes]
    n = len(codes)
    cells = {(i, 1): chart(c) if n > 1 else turn_cell(c) for i, c in enumerate(codes)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best: Cell = {}
            for k in range(1, length):
                for key, found in joined(cells[i, k], cells[i + k, length - k]).items():
                    if key not in best or found < best[key]:
                        best[key] = found
            cells[i, length] = best
    if len(KNOWN) >= REMEMBERED:
        KNOWN.clear()
    KNOWN[codes] = cells[0, n]
    return cells[0, n]


def parsed(codes: str) -> Cell:
    """The cell of a stretch of any length.

    The nonterminals are pairs of places, so every split of a span gives the same cell; beyond one chart a single split
    is enough, and spans double in length.
    """
    if not codes:
        return EMPTY
    cells = [chart(codes[i:i + CHART]) for i in range(0, len(codes), CHART)]
    while len(cells) > 1:
        cells = [joined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[START, q] for q in ENDS if (START, q) in cell)


class Stretch:
    """What is known of consecutive turns of one conversation."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.last = ""

    def add(self, has_turn: bool, turn: int, initial: str, blank: bool, open_: bool, first: bool, n: int) -> None:
        if has_turn and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.illegal += n - 1 + (bool(self.codes) and self.last + initial not in LEGAL)
        self.first = self.first if self.codes else initial
        self.last = initial
        if blank:
            self.blank += n
            self.codes.append("-" * n)
            return
        self.duplicate += n - first
        if first:
            self.truncated += open_
            code = initial if initial in STEPS else "x"
            self.codes.append(code.upper() if open_ else code)
        self.codes.append("-" * (n - first))

    def row(self, key: str, part: int) -> tuple:
        cell = [(*ends, *least) for ends, least in parsed("".join(self.codes)).items()]
        facts = (self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last, cell)
        return key, part, json.dumps(facts)


STRETCH = "ck string, part int, facts string"


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with reproducible faults, as a test of repairs; nulls of role and text are one space.

    The checksum of ``conv_id:turn`` (a null there is a space too) modulo 20 decides: 0 drops the row, 1 empties its text, 2
    removes ``.``, ``!`` and ``?``, 3 gives the row twice, 4 makes it a user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(named(conv_id).cast("string"), space), F.lit(":"), F.coalesce(named(turn).cast("string"), space))
    fault = F.pmod(F.crc32(key), F.lit(20))
    words, who = F.coalesce(named(text), space), F.coalesce(named(role), space)
    rows = conversations.select(
        named(conv_id).alias("conv_id"), named(turn).alias("turn"), fault.alias("fault"),
        F.when(fault == 4, "user").otherwise(who).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(words, ".!?", "")).otherwise(words).alias("text"),
    ).where("fault <> 0")
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def as_key(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


ORDER = ["ck", "timed", "turn", "role", "th"]


def turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``ck, timed, turn, role, th, text``: the columns that order turns, with the text's digest as the last of them."""
    words = F.coalesce(named(text), F.lit(" "))
    number = named(turn).cast("long")
    return conversations.select(
        as_key(named(conv_id)).alias("ck"), number.isNotNull().alias("timed"), F.coalesce(number, F.lit(0)).alias("turn"),
        F.coalesce(named(role), F.lit(" ")).alias("role"), F.sha2(words, 256).alias("th"), words.alias("text"),
    )


def stretches(rows: DataFrame) -> DataFrame:
    """Every conversation as one or more parsed stretches (``STRETCH``), in order of ``part``.

    Equal rows are counted before they meet; the turns are then dealt out by ranges of the whole order, so a long
    conversation is spread over tasks, each of which parses its own stretch. No text is moved here.
    """
    end = F.rtrim("text", F.lit(SPACES))
    flags = rows.select(
        *ORDER, (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open")
    )
    counted = materialise(flags.groupBy(*ORDER).agg(F.first("blank").alias("blank"), F.first("open").alias("open"), F.count("*").alias("n")))
    seen = counted.groupBy("ck", "role", "th").agg(F.min(F.struct("timed", "turn")).alias("seen"))
    known = counted.join(seen, ["ck", "role", "th"])
    known = known.select(
        *ORDER, F.substring("role", 1, 1).alias("initial"), "blank", "open", "n", (F.col("seen") == F.struct("timed", "turn")).alias("first")
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, key, held, out = TaskContext.get().partitionId(), None, Stretch(), []
        for batch in batches:
            for ck, timed, turn, initial, blank, open_, n, first in batch.itertuples(index=False, name=None):
                if ck != key:
                    if key is not None:
                        out.append(held.row(key, part))
                    key, held = ck, Stretch()
                held.add(timed, turn, initial, blank, open_, first, n)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if key is not None:
            yield pd.DataFrame([held.row(key, part)], columns=columns)

    columns = ["ck", "part", "facts"]
    dealt = materialise(known).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return dealt.select("ck", "timed", "turn", "initial", "blank", "open", "n", "first").mapInPandas(parse, STRETCH)


class Conversation:
    """A conversation put together from its stretches, then repaired turn by turn as its texts go by."""

    def __init__(self) -> None:
        self.cell, self.blank, self.duplicate, self.truncated, self.illegal = {(START, START): EMPTY[START, START]}, 0, 0, 0, 0
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.place, self.at, self.count = START, 0, 0
        self.digest = hashlib.sha256()

    def extend(self, facts: str) -> None:
        blank, duplicate, truncated, illegal, turns, low, high, first, last, cell = json.loads(facts)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (self.last is not None and self.last + first not in LEGAL)
        self.last = last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        self.cell = joined(self.cell, {(p, q): (cost, audit) for p, q, cost, audit in cell})

    def solve(self) -> None:
        # Without turns there is nothing to repair: the empty conversation is legal.
        self.cost, self.audit = cheapest(self.cell)

    def step(self, role: str | None, text: str, edit: str) -> tuple[int, str, str, str]:
        """Put out the next repaired turn; a role of None is the one that the place asks for."""
        place = next(q for p, q in STEPS["a" if self.place == USER else "u"] if p == self.place) if role is None else None
        if place is None:
            place = next(q for p, q in STEPS[role[0]] if p == self.place)
        else:
            role = ROLES[place]
        self.place = place
        self.digest.update((("\n" if self.count else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.count += 1
        return self.count, role, text, edit

    def inserted(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self.step(None, "", "I")

    def turn(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.step(role if edit == "K" else None, text, edit)

    def summary(self, key: str) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, MOST)
        return key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.digest.hexdigest()


SUMMARY = "ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "ck string, position long, role string, text string, edit string"


def _followed(conversations: DataFrame, every: DataFrame | None, conv_id: str, turn: str, role: str, text: str, messages: bool) -> DataFrame:
    """Stretches and texts of every conversation, in order through one task each.

    A conversation's digest and its repaired turns are sequential by nature, so its texts stream through a task one batch
    at a time; only the stretches' cells (a few letters a turn) are held.
    """
    rows = turns(conversations, conv_id, turn, role, text)
    parts = stretches(rows)
    ids = (conversations if every is None else every).select(as_key(named(conv_id)).alias("ck")).distinct()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    names = ["ck", "kind", "o1", "o2", "role", "th", "text", "facts"]
    first = ids.select("ck", F.lit(0), zero, zero, none, none, none, none).toDF(*names)
    middle = parts.select("ck", F.lit(1), F.col("part").cast("long"), zero, none, none, none, "facts")
    texts = rows.select("ck", F.lit(2), F.col("timed").cast("int").cast("long"), "turn", "role", "th", "text", none)
    order = ["ck", "kind", "o1", "o2", "role", "th"]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, solved, out, size = None, None, False, [], 0
        columns = [c.split()[0] for c in (REPAIRED if messages else SUMMARY).split(", ")]

        def end() -> list[tuple]:
            if not solved:
                held.solve()
            rest = list(held.inserted())
            return [(key, *m) for m in rest] if messages else [held.summary(key)]

        for batch in batches:
            for ck, kind, role_, text_, facts in batch.itertuples(index=False, name=None):
                if ck != key:
                    if key is not None:
                        out += end()
                    key, held, solved = ck, Conversation(), False
                if kind == 1:
                    held.extend(facts)
                elif kind == 2:
                    if not solved:
                        held.solve()
                        solved = True
                    for message in held.turn(role_, text_):
                        if messages:
                            out.append((key, *message))
                            size += len(text_)
                if size > 4 << 20:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)
                out, size = [], 0
        if key is not None:
            yield pd.DataFrame(end(), columns=columns)

    united = bounded_batches(first.union(middle).union(texts)).repartition("ck").sortWithinPartitions(*order)
    found = united.select("ck", "kind", "role", "text", "facts").mapInPandas(follow, REPAIRED if messages else SUMMARY)
    kind = (conversations if every is None else every).schema[conv_id].dataType
    back = F.when(F.col("ck") != "", F.expr("substring(ck, 2)")).cast(kind).alias(conv_id)
    return found.select(back, *[named(c) for c in found.columns if c != "ck"])


def audit(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: DataFrame | None = None
) -> DataFrame:
    """One row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Turns are taken by ``turn`` (nulls first), those of one number by role and digest of the text. A null role or text is one
    space; null ids are a conversation of their own. The first fault of a turn counts: blank, duplicate (role and text seen
    earlier in the conversation), truncated (no final ``.``, ``!`` or ``?``). ``audit`` is the cheapest sequence of edits, of equal ones the
    least. Conversations of ``every`` (by the same id column) that have no turn left get zeros and an empty audit. Repeated rows are turns like any
    other; other columns are not read; an empty table gives no row.
    """
    return _followed(conversations, every, conv_id, turn, role, text, False)


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: ``conv_id, position`` (from 1), ``role, text, edit`` (K, R or I), by the cheapest edits of ``audit``."""
    return _followed(conversations, None, conv_id, turn, role, text, True)


def sql() -> str:
    """The same result over damaged ``conversations`` in SQL: place by place along the turns, without spans.

    A state holds cost and audit as one string whose order is that of the pair. The checksum is computed bit by bit.
    """
    bit = "xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end)"
    byte = f"[list_reduce(list_concat([xor(s[1], t[1])], range(8)), lambda x, i: {bit})]"
    codes = "list_transform(string_split(k, ''), lambda b: [ascii(b)::bigint])"
    crc = f"xor(list_reduce(list_concat([[4294967295]], {codes}), lambda s, t: {byte})[1], 4294967295)"

    def edit(state: str, cost: str, letter: str) -> str:
        return f"(lpad((left({state}, 9)::bigint + {cost})::varchar, 9, '0') || substr({state}, 10) || '{letter}')"

    def closed(start: str, system: str, user: str, assistant: str) -> str:
        u = f"least({user}, {edit(start, '2', 'I')}, {edit(system, '2', 'I')}, {edit(assistant, '2', 'I')})"
        a = f"least({assistant}, {edit(user, '2', 'I')}, {edit(start, '4', 'II')}, {edit(system, '4', 'II')})"
        return f"{start} as s0, {system} as s1, {u} as s2, {a} as s3"

    keep = "(not gone and left(role, 1) = '{}')"
    best = {
        "n0": f"{edit('s0', '3', 'D')}",
        "n1": f"least({edit('s1', '3', 'D')}, case when {keep.format('s')} then {edit('s0', 'cut', 'K')} end)",
        "n2": f"least({edit('s2', '3', 'D')}, case when {keep.format('u')} then least({', '.join(edit(s, 'cut', 'K') for s in ('s0', 's1', 's3'))}) end, "
              f"case when not gone then least({', '.join(edit(s, '2 + cut', 'R') for s in ('s0', 's1', 's3'))}) end)",
        "n3": f"least({edit('s3', '3', 'D')}, case when {keep.format('a')} then {edit('s2', 'cut', 'K')} end, case when not gone then {edit('s2', '2 + cut', 'R')} end)",
    }
    return rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
),
faulty as (select *, {crc} % 20 as fault from keyed),
damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from faulty, (values (1), (2)) v(copy) where fault <> 0 and (copy = 1 or fault = 3)
),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid
  from damaged
),
ordered as (select *, row_number() over (partition by conv_id, role, text order by pos) > 1 as again from placed),
judged as (
  select conv_id, turn, role, text, pos, solid = '' as blank, solid <> '' and again as dup, solid = '' or again as gone,
    case when solid <> '' and not again and right(solid, 1) not in ('.', '!', '?') then 1 else 0 end as cut,
    pos > 1 and lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) not in ('su', 'ua', 'au') as wrong
  from ordered
),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate,
    sum(cut) as truncated, count(*) filter (wrong) as illegal, max(pos) as n
  from judged group by conv_id
),
walk(conv_id, pos, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, '000000000', null::varchar, '000000002I', '000000004II' from facts
  union all
  select conv_id, pos, {closed('n0', 'n1', 'n2', 'n3')} from (
    select w.conv_id, j.pos, {', '.join(f'{v} as {k}' for k, v in best.items())}
    from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.pos = w.pos + 1
  )
),
solved as (
  select f.*, left(least(s0, s3), 9)::bigint as cost, substr(least(s0, s3), 10) as audit
  from facts f join walk w on w.conv_id is not distinct from f.conv_id and w.pos = f.n
),
letters as (
  select conv_id, i, audit[i] as e, len(replace(left(audit, i), 'I', '')) as pos, len(replace(left(audit, i), 'D', '')) as place
  from (select conv_id, audit, unnest(range(1, len(audit) + 1)) as i from solved)
),
headed as (select l.*, j.role, j.text, min(case when e = 'K' and left(j.role, 1) = 's' then 1 end) over (partition by l.conv_id) as headed
  from letters l left join judged j on j.conv_id is not distinct from l.conv_id and j.pos = l.pos where e <> 'D'),
written as (
  select conv_id, sha256(string_agg(case when e = 'K' then role when (place - coalesce(headed, 0)) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by i)) as repaired_sha256
  from headed group by conv_id
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
  coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join solved s on s.conv_id is not distinct from c.conv_id left join written w on w.conv_id is not distinct from c.conv_id"""
