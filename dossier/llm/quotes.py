"""Quotation linking: quoted passages joined to the messages they come from (DataFrame expressions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import free_names, materialise, named

# A line that introduces a quotation.
ATTRIBUTION = r"(?i)^\s*(?:on\s.{1,200}\swrote|.{1,120}\sschrieb|.{1,120}\sa écrit|.{1,120}\sescribió)\s*:\s*$"
MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def level_of(line: Column) -> Column:
    """How many quotation marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[ \t]", ""))


def folded(body: Column) -> Column:
    """A passage for comparison: white space squeezed, A-Z lower-cased, so that re-wrapped lines agree."""
    low = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[ \t\x0B\f\r\n]+", " "))


def lines_of(text: Column) -> Column:
    """The lines of a text as ``(level, body)``, without marks and without lines that introduce a quotation."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))
    follows = F.slice(F.concat(F.transform(lines, lambda x: x["level"]), F.array(F.lit(0))), 2, F.size(lines))
    paired = F.arrays_zip(lines.alias("line"), follows.alias("next"))
    kept = F.filter(paired, lambda p: ~((p["line"]["level"] == 0) & (p["next"] > 0) & p["line"]["body"].rlike(ATTRIBUTION)))
    return F.transform(kept, lambda p: p["line"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def passages_of(lines: Column) -> Column:
    """Runs of quoted lines of one level as ``(level, body)``, in order; own lines and other levels end a run."""

    def runs(held: Column) -> Column:
        def level(i: Column) -> Column:
            return F.coalesce(F.get(held, i)["level"], F.lit(0))

        # A run begins and ends where the level changes, so the bounds are found line by line and every body is joined once.
        begins = F.filter(F.transform(held, lambda line, i: i), lambda i: (level(i) > 0) & ((i == 0) | (level(F.greatest(i - 1, F.lit(0))) != level(i))))
        ends = F.filter(F.transform(held, lambda line, i: i), lambda i: (level(i) > 0) & (level(i + 1) != level(i)))
        return F.zip_with(begins, ends, lambda first, last: F.struct(
            level(first).alias("level"),
            F.array_join(F.transform(F.slice(held, first + 1, last - first + 1), lambda line: line["body"]), "\n").alias("body"),
        ))

    return let(lines, runs)


def hashed(bodies: Column) -> Column:
    """Distinct hashes of the passages of an array that are not blank."""
    return F.array_distinct(F.transform(F.filter(bodies, lambda b: folded(b) != ""), lambda b: F.xxhash64(folded(b))))


def link(messages: DataFrame, conversation: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with their text free of quotations, and the columns (renamed where taken) ``reply_to, thread, depth``.

    ``reply_to`` is the place in the conversation of the message that a quotation comes from: the first one whose own text, or a
    paragraph or line of it, agrees with the whole passage, or else with a line of it, and that stands before the
    quoting message. The outermost passages are tried first, in order. ``thread`` is the place of the message that
    the chain of replies begins with (its own without a link), ``depth`` the length of the chain. Ordered by
    conversation, thread, depth and place, every message follows the one it answers.
    ``n_quotes`` counts the quoted passages.

    Null texts stay null. Messages without a conversation or a place are kept and not linked. Rows of one conversation
    and place count as one message. All columns of ``messages`` are kept, in order; an empty table stays empty.

    Quotations meet originals by hash, after all messages with the same passage are reduced to the first of a
    conversation, so a line that very many messages share makes one row; chains are followed by doubling.
    """
    columns = messages.columns
    names = free_names(messages, "reply_to", "thread", "depth", "n_quotes")
    marked = F.coalesce(named(text).rlike("(?m)" + MARKS), F.lit(False))
    lines = F.when(marked, lines_of(named(text)))
    own = F.when(marked, F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n"))
    own = F.coalesce(F.regexp_replace(own, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), named(text))
    keyed = messages.select(named(conversation).alias("c"), named(order).alias("p"), marked.alias("marked"), lines.alias("lines"), own.alias("own"))
    keyed = keyed.where(F.col("c").isNotNull() & F.col("p").isNotNull())

    passages = keyed.where("marked").select("c", "p", F.posexplode(passages_of(F.col("lines"))).alias("at", "q"))
    tried = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.xxhash64(folded(F.col("q.body"))).alias("h"))),
        F.transform(hashed(F.split("q.body", "\n")), lambda h: F.struct(F.lit(1).alias("rank"), h.alias("h"))),
    )
    tries = passages.where(folded(F.col("q.body")) != "").select("c", "p", "at", F.col("q.level").alias("level"), F.explode(tried).alias("t"))
    tries = materialise(tries.select("c", "p", "level", "at", "t.rank", "t.h"))
    if tries.isEmpty():
        chains = None
    else:
        bodies = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
        originals = keyed.select("c", F.col("p").alias("first"), F.explode(hashed(bodies)).alias("h"))
        originals = originals.join(tries.select("c", "h").distinct(), ["c", "h"], "left_semi").groupBy("c", "h").agg(F.min("first").alias("first"))
        found = tries.join(originals, ["c", "h"]).where("first < p")
        best = F.min(F.struct("level", "at", "rank", "first")).alias("best")
        chains = chains_of(found.groupBy("c", "p").agg(best).select("c", "p", F.col("best.first").alias("reply_to")))

    result = messages
    clean = F.coalesce(own, named(text))
    quotes = F.when(marked, F.size(passages_of(lines))).otherwise(0).cast("long")
    if chains is None:
        place = messages.schema[order].dataType
        links = [F.lit(None).cast(place), named(order), F.lit(0).cast("long")]
    else:
        key = free_names(messages, "chain_c", "chain_p", "chain_r", "chain_t", "chain_d")
        chains = chains.select("c", "p", "reply_to", "thread", "depth").toDF(*key)
        result = result.join(chains, (named(conversation) == named(key[0])) & (named(order) == named(key[1])), "left")
        links = [named(key[2]), F.coalesce(named(key[3]), named(order)), F.coalesce(named(key[4]), F.lit(0)).cast("long")]
    own_columns = [clean.alias(c) if c == text else named(c) for c in columns]
    return result.select(*own_columns, *[x.alias(n) for x, n in zip([*links, quotes], names)])


def chains_of(replies: DataFrame) -> DataFrame:
    """``(c, p, reply_to, thread, depth)`` of the replies ``(c, p, reply_to)``; every reply stands after its original."""
    state = materialise(replies.select("c", "p", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = state.select("c", F.col("p").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        longer = state.join(above, ["c", "thread"], "left").select(
            "c", "p", "reply_to", F.coalesce("up", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("up").isNotNull().alias("moved"),
        )
        longer = materialise(longer)
        state = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return state


def sql() -> str:
    """The same result over ``conversations`` in SQL, one row per line and with a recursive walk along the replies."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    attribution = ATTRIBUTION.replace("'", "''")

    def folded(body: str) -> str:
        return rf"trim(regexp_replace(translate({body}, '{upper}', '{lower}'), '[ \t\x0B\f\r\n]+', ' ', 'g'))"

    return rf"""
with recursive rows as (select *, row_number() over () as r from conversations),
lines as (
  select r, conv_id, turn, pos, regexp_replace(line, '{MARKS}', '') as body, length(regexp_replace(regexp_extract(line, '{MARKS}', 1), '[ \t]', '', 'g')) as level
  from (select r, conv_id, turn, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from rows where text is not null)
),
marked as (select distinct r from lines where level > 0),
kept as (
  select * from (select *, coalesce(lead(level) over (partition by r order by pos), 0) as next_level from lines)
  where not (r in (select r from marked) and level = 0 and next_level > 0 and regexp_matches(body, '{attribution}'))
),
runs as (
  select r, conv_id, turn, level, min(pos) as pos, string_agg(body, chr(10) order by pos) as body
  from (select *, row_number() over (partition by r order by pos) - row_number() over (partition by r, level order by pos) as g from kept) where level > 0
  group by r, conv_id, turn, level, g
),
own as (
  select r, regexp_replace(coalesce(string_agg(body, chr(10) order by pos) filter (level = 0), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as body
  from kept where r in (select r from marked) group by r
),
clean as (
  select t.*, case when m.r is null then t.text else coalesce(o.body, '') end as own_text, m.r is not null as quoting
  from rows t left join marked m using (r) left join own o using (r)
),
keys as (
  select conv_id, {folded('part')} as k, min(turn) as first_turn from (
    select conv_id, turn, own_text as part from clean
    union all select conv_id, turn, unnest(string_split_regex(own_text, '\n[ \t]*\n')) from clean
    union all select conv_id, turn, unnest(string_split(own_text, chr(10))) from clean
  ) where conv_id is not null and turn is not null and {folded('part')} <> '' group by all
),
tries as (
  select conv_id, turn, level, pos, 0 as rank, {folded('body')} as k from runs where {folded('body')} <> ''
  union all select conv_id, turn, level, pos, 1, {folded('line')} from (select *, unnest(string_split(body, chr(10))) as line from runs) where {folded('line')} <> ''
),
replies as (
  select conv_id, turn, arg_min(first_turn, (level, pos, rank, first_turn)) as reply_to
  from tries join keys using (conv_id, k) where first_turn < turn group by conv_id, turn
),
walk(conv_id, turn, origin, depth) as (
  select conv_id, turn, reply_to, 1 from replies
  union all select w.conv_id, w.turn, p.reply_to, w.depth + 1 from walk w join replies p on p.conv_id = w.conv_id and p.turn = w.origin
),
chains as (select conv_id, turn, arg_max(origin, depth) as thread, max(depth) as depth from walk group by conv_id, turn)
select c.conv_id, c.turn, c.role, c.own_text as text, p.reply_to, coalesce(h.thread, c.turn) as thread, coalesce(h.depth, 0)::bigint as depth,
  (select count(*) from runs q where q.r = c.r) as n_quotes
from clean c left join replies p on p.conv_id = c.conv_id and p.turn = c.turn left join chains h on h.conv_id = c.conv_id and h.turn = c.turn"""
