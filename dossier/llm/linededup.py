"""Line dedup by the share of a site's pages that hold a line (DataFrame expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import components, free_names, materialise, named

# White space that is not a single space already.
SQUEEZED = r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]"
RATIO = 0.1
MIN_PAGES = 5
# Hosts and boilerplate lines that are broadcast at most (some 20 MB).
BROADCAST_ENTRIES = 1_000_000
# Pages of a host are near copies where the lines of both hold this share of the characters of the lines of either.
SIMILARITY = 0.8
# A pair at 0.8 shares none of the bands with a chance of (1 - 0.8 ** 5) ** 20 = 0.0004.
BANDS, ROWS = 20, 5
# Pages of one part of a band's bucket; the parts meet pair by pair.
PART = 256
WEIGHT = 0xFFFF


def line_key(line: Column) -> Column:
    """What makes lines equal: white space trimmed and squeezed, letters lower-cased. Empty for a blank line."""
    return F.trim(F.regexp_replace(F.lower(line), SQUEEZED, " "))


# Steps from the markup of a page to its visible lines: pattern and what replaces it.
HIDDEN = r"(?is)<(?:(?:script|style)\b[^>]*>.*?</(?:script|style)[^>]*>|!--.*?-->)"
BLOCKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|"
    r"table|td|th|title|tr|ul)\b[^>]*>"
)
MARKUP = [(HIDDEN, " "), (BLOCKS, "\n"), (r"<[^>]*>", "")]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
BLANK = r"\n[ \t\n]+"


def html_lines(html: Column) -> Column:
    """The visible lines of a page as a text: scripts, styles and comments out, a line break at block tags."""
    text = F.replace(F.replace(html, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    for pattern, put in MARKUP:
        text = F.regexp_replace(text, pattern, put)
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, BLANK, "\n"), F.lit(" \t\n"))


def _marks(keys: Column) -> Column:
    """One number per line: 48 bits of its hash and its length, by which a line weighs."""
    return F.transform(keys, lambda k: F.xxhash64(k).bitwiseAND(F.lit(~WEIGHT)).bitwiseOR(F.least(F.length(k), F.lit(WEIGHT)).cast("bigint")))


def _weight(marks: Column) -> Column:
    return F.aggregate(marks, F.lit(0).cast("bigint"), lambda total, m: total + m.bitwiseAND(F.lit(WEIGHT)))


def _bands(host: Column, marks: Column) -> Column:
    """One hash for every band of weighted least hashes: a line is drawn in proportion to its length."""

    def drawn(seed: Column) -> Column:
        def rank(m: Column) -> Column:
            uniform = (F.shiftrightunsigned(F.xxhash64(m, seed), 11) + F.lit(0.5)) * F.lit(2.0**-53)
            return F.log(uniform) / m.bitwiseAND(F.lit(WEIGHT))

        return F.array_max(F.transform(marks, rank))

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(host, b, *[drawn(b * ROWS + r) for r in range(ROWS)]))


def _alike(one: str, other: str) -> Column:
    """Whether two pages (``marks, weight``) share enough of their lines."""
    shared = _weight(F.array_intersect(f"{one}.marks", f"{other}.marks"))
    low, high = F.least(f"{one}.weight", f"{other}.weight"), F.greatest(f"{one}.weight", f"{other}.weight")
    every = F.col(f"{one}.weight") + F.col(f"{other}.weight") - shared
    return (low >= F.lit(SIMILARITY) * high) & (shared >= F.lit(SIMILARITY) * every)


def near_copies(pages: DataFrame) -> DataFrame:
    """``node, root`` of the pages (``node, host, marks``) that have near copies on their host; groups are connected by pairs.

    Candidates share a band of weighted least hashes, and each pair is verified on all its lines. Every page is first held
    against one page, the least that it shares a bucket with; then buckets that still hold several groups are cut into parts
    that meet pair by pair. Only marks of lines are moved, and no pair of one group is put out, so a hot group costs one
    verification a page. In a bucket of pages that are not alike the work grows with the square of its size, in tasks of a fixed size.
    """
    nodes = pages.where(F.size("marks") > 0).select("node", "host", "marks", _weight(F.col("marks")).alias("weight"))
    banded = materialise(nodes.select("node", F.explode(_bands(F.col("host"), F.col("marks"))).alias("value")))
    nodes = nodes.drop("host")
    sizes = banded.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = materialise(banded.join(sizes.where("low <> high").drop("high"), "value"))
    first = shared.where("node <> low").groupBy(F.col("node").alias("b")).agg(F.min("low").alias("a"))
    one, other = (nodes.select(F.col("node").alias(n), F.struct("marks", "weight").alias(f"{n}_")) for n in ("a", "b"))
    found = materialise(first.join(other, "b").join(one, "a").where(_alike("a_", "b_")).select("a", "b"))
    rooted = materialise(components(found))
    placed = shared.join(rooted, "node", "left").select("value", "node", F.coalesce("root", "node").alias("comp"))
    placed = materialise(placed)
    several = placed.groupBy("value").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n")).where("c1 <> c2")
    left = placed.join(several.select("value", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "value")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    left = left.select("value", "node", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    left = left.select("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", "own").join(nodes, "node")
    left = materialise(left)
    x, y = left.where("own = i").alias("x"), left.where("own = j").alias("y")
    meet = (F.col("x.value") == F.col("y.value")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.node") < F.col("y.node"))
    met = x.join(y, meet & once & (F.col("x.comp") != F.col("y.comp")) & _alike("x", "y"))
    more = materialise(met.select(F.least("x.comp", "y.comp").alias("a"), F.greatest("x.comp", "y.comp").alias("b")).distinct())
    return rooted if more.isEmpty() else materialise(components(found.union(more)))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int, near: bool = False) -> DataFrame:
    """Per host the hashes of its boilerplate lines: one row ``(host, hashes)``.

    Pages of equal text count as one page of their host, else the lines of a page with many copies would all be over
    the ratio; such a page counts a line once. With ``near``, a group of ``near_copies`` is one page too, with all its lines.
    The number of such lines of a host is below the mean number of lines of its pages divided by
    ``ratio``, so the list of a host is bounded by the pages' shape and not by their number. Only hashes are shuffled, copies met
    and lines summed on the map side first, so a host with most of the pages is no hot task.
    """
    pages = pages.select(named(host).alias("host"), named(text).alias("text")).where(F.col("host").isNotNull())
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    pages = pages.select("host", F.xxhash64("text").alias("page"), F.array_remove(F.coalesce(keys, F.array().cast("array<string>")), "").alias("keys"))
    hashes = F.transform("keys", lambda k: F.xxhash64(k)).alias("lines")
    # The null line stands for the page itself.
    every = F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "lines")).alias("line")
    if near:
        pages = pages.select("host", "page", hashes, _marks(F.col("keys")).alias("marks"))
        pages = pages.groupBy("host", "page").agg(F.first(F.struct("lines", "marks")).alias("p"))
        pages = materialise(pages.select("host", F.xxhash64("host", "page").alias("node"), "p.*"))
        pages = pages.join(near_copies(pages), "node", "left")
        group = pages.where("root is not null").select("host", "root", every).distinct()
        lines = pages.where("root is null").select("host", every).union(group.select("host", "line"))
    else:
        lines = pages.select("host", "page", hashes).groupBy("host", "page").agg(F.first("lines").alias("lines")).select("host", every)
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = materialise(counts.where(F.col("line").isNull() | (F.col("n") >= min_pages)))
    totals = counts.where(F.col("line").isNull()).select("host", F.col("n").alias("total"))
    over = counts.where(F.col("line").isNotNull()).join(totals, "host").where(F.col("n") > F.lit(float(ratio)) * F.col("total"))
    return over.groupBy("host").agg(F.collect_list("line").alias("hashes"))


def drop_lines(
    pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    counts: tuple[str, str] | None = None, near: bool = False,
) -> DataFrame:
    """``pages`` without the lines that stand on more than ``ratio`` of their host's pages (and on ``min_pages`` or more).

    Lines are equal when they agree but for white space and the case of letters. The remaining lines are joined as they
    were. ``counts`` names two further columns: the lines of the page and those dropped.

    Null texts stay null (no lines), rows with a null host are kept whole and count for no host, blank lines are
    never dropped. Copies of a text count as one page of their host, and all stay; ``near`` also counts near copies as one page. All columns of ``pages`` are kept, in order; an empty table
    stays empty.
    """
    columns = pages.columns
    key, bad = free_names(pages, "rule_host", "rule_hashes")
    rules = boilerplate(pages, host, text, ratio, min_pages, near).select(F.col("host").alias(key), F.col("hashes").alias(bad))
    rules = materialise(rules)
    held = rules.agg(F.count("*") + F.coalesce(F.sum(F.size(named(bad))), F.lit(0))).first()[0]
    if held <= BROADCAST_ENTRIES:
        rules = F.broadcast(rules)  # else adaptive execution joins by host and splits the large ones
    joined = pages.join(rules, named(host) == named(key), "left")
    # One pass over the lines of a page, and only where its host has rules; a blank line is never among them.
    passed = F.filter(F.split(named(text), "\n"), lambda line: ~F.array_contains(named(bad), F.xxhash64(line_key(line))))
    kept = F.transform(F.array(passed), lambda x: F.struct(F.array_join(x, "\n").alias("text"), F.size(x).cast("long").alias("n")))[0]
    (out,) = free_names(joined, "kept")
    result = joined.withColumn(out, F.when(named(bad).isNotNull() & named(text).isNotNull(), kept))
    clean = F.when(named(bad).isNotNull() & named(text).isNotNull(), named(out)["text"]).otherwise(named(text))
    more = []
    if counts:
        size = F.length(named(text)) - F.length(F.replace(named(text), F.lit("\n"), F.lit(""))) + 1
        size = F.coalesce(size, F.lit(0)).cast("long")
        more = [size.alias(counts[0]), F.coalesce(size - named(out)["n"], F.lit(0)).cast("long").alias(counts[1])]
    return result.select(*[clean.alias(c) if c == text else named(c) for c in columns], *more)


def recount(documents: DataFrame, text: str, count: str) -> DataFrame:
    """``documents`` with the number of characters of the text in an existing column (as it is where there is none)."""
    if count not in documents.columns:
        return documents
    kind = documents.schema[count].dataType
    counted = F.when(named(text).isNull(), named(count)).otherwise(F.length(named(text))).cast(kind)
    return documents.select(*[counted.alias(c) if c == count else named(c) for c in documents.columns])


def pages_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same result over ``pages`` in SQL."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'" if "\n" not in value else "chr(10)"

    page = "translate(html, chr(13) || chr(10), '  ')"
    for pattern, put in MARKUP:
        page = f"regexp_replace({page}, {text(pattern)}, {text(put)}, 'g')"
    for name, sign in ENTITIES:
        page = f"replace({page}, {text(name)}, {text(sign)})"
    page = f"trim(regexp_replace({page}, '{BLANK}', chr(10), 'g'), ' ' || chr(9) || chr(10))"
    key = f"trim(regexp_replace(lower(line), '{SQUEEZED}', ' ', 'g'), ' ')"
    return f"""
with read as (
  select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') as host, {page} as text, row_number() over () as r
  from pages
),
lines as (
  select r, host, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from read where text is not null
),
keyed as (select *, {key} as k from lines),
pages_once as (select host, min(r) as r from read where host is not null group by host, text),
counts as (select host, k, count(*) as n from (select distinct r, host, k from keyed semi join pages_once using (r) where k <> '') group by host, k),
totals as (select host, count(*) as total from pages_once group by host),
rules as (select host, k from counts join totals using (host) where n >= {min_pages} and n > {ratio} :: double * total),
kept as (select r, string_agg(line, chr(10) order by pos) as clean, count(*) as n from keyed anti join rules using (host, k) group by r)
select page_id, host, case when text is null then null else coalesce(clean, '') end as text,
  case when text is null then 0 else len(string_split(text, chr(10))) end :: bigint as n_lines,
  case when text is null then 0 else len(string_split(text, chr(10))) - coalesce(n, 0) end :: bigint as n_dropped
from read left join kept using (r)"""
