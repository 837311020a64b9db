"""Section comparison: claims of a filing's section against the same section of an earlier filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import claim_key, claims
from dossier.session import durable


def previous_filing(filings: DataFrame) -> DataFrame:
    """``accession_number, previous_accession_number``: the latest strictly earlier filing of the same
    company and form (greatest accession number on equal dates); no row when there is none.

    Filings are first reduced to one row per company, form and date, so the ordered step handles at
    most one row per calendar day however many filings a company has.
    """
    w = Window.partitionBy("cik", "form_type").orderBy("filing_date")
    days = (
        filings.groupBy("cik", "form_type", "filing_date")
        .agg(F.max("accession_number").alias("last_of_day"))
        .withColumn("previous_accession_number", F.lag("last_of_day").over(w))
        .where(F.col("previous_accession_number").isNotNull())
        .drop("last_of_day")
    )
    keys = ["cik", "form_type", "filing_date"]
    return filings.join(days, keys).select("accession_number", "previous_accession_number")


def first_section(sections: DataFrame) -> DataFrame:
    """The section that stands for its type in a filing: the one with the lowest sequence number."""
    return sections.groupBy("accession_number", "section_type").agg(
        F.min(F.struct("section_sequence", "section_name")).alias("s")
    ).select("accession_number", "section_type", "s.section_sequence", "s.section_name")


def section_evidence(chunks: DataFrame) -> DataFrame:
    """``section_claims`` and, for a section with a chunk that holds no claim, a row of the empty key.

    So every section that has chunks has a row, and one pass over the chunks tells both.
    """
    found = chunks.select(
        "accession_number", "section_sequence", "chunk_id", "source_start", "source_end",
        F.posexplode_outer(claims(F.col("text"))).alias("claim_pos", "claim"),
    ).withColumn("claim_key", F.coalesce(claim_key(F.col("claim")), F.lit("")))
    first = F.min(F.struct("chunk_id", "claim_pos", "claim", "source_start", "source_end")).alias("first")
    return (
        found.groupBy("accession_number", "section_sequence", "claim_key")
        .agg(first)
        .select("accession_number", "section_sequence", "claim_key", "first.*")
    )


def section_claims(chunks: DataFrame) -> DataFrame:
    """Distinct claims of each section, first occurrence wins in chunk and text order.

    ``chunks``: ``accession_number, section_sequence, chunk_id, text`` and citation columns. The
    first occurrence is an aggregate (combined map-side), not a sort of the section.
    """
    return section_evidence(chunks).where(F.col("claim_key") != "")


def sections_compared(pairs: DataFrame) -> DataFrame:
    """``pair_id, side, accession_number, section_sequence``: both sides of every pair."""
    sides = [
        F.struct(F.lit(name).alias("side"), F.col(f"{name}_accession").alias("accession_number"), F.col(f"{name}_sequence").alias("section_sequence"))
        for name in ("current", "prior")
    ]
    return pairs.select("pair_id", F.explode(F.array(*sides)).alias("s")).select("pair_id", "s.*")


def diff_claims(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Claims of each comparison pair labelled ``added``, ``removed`` or ``unchanged``.

    ``pairs``: ``pair_id, current_accession, prior_accession`` plus the section sequence of each side;
    ``found``: their distinct claims. Both sides are keyed by (pair, claim) in one join and meet in one aggregate, dealt by
    pair, so that whoever groups the result by pair moves nothing again.
    """
    rows = sections_compared(pairs).join(found, ["accession_number", "section_sequence"]).repartition("pair_id")
    kept = F.struct(*[c for c in found.columns if c not in ("claim_key", "section_sequence")])
    sides = [F.any_value(F.when(F.col("side") == name, kept), F.lit(True)).alias(name) for name in ("current", "prior")]
    return rows.groupBy("pair_id", "claim_key").agg(*sides).withColumn(
        "change",
        F.when(F.col("prior").isNull(), F.lit("added")).when(F.col("current").isNull(), F.lit("removed")).otherwise(F.lit("unchanged")),
    )


def _citation(role: str, side: Column, section: Column, section_type: Column, url: Column) -> Column:
    return F.struct(
        F.lit(role).alias("filing_role"),
        side["accession_number"].alias("accession_number"),
        side["chunk_id"].alias("chunk_id"),
        section.alias("section_name"),
        section_type.alias("section_type"),
        url.alias("source_url"),
        side["source_start"].alias("source_start"),
        side["source_end"].alias("source_end"),
        side["claim"].alias("snippet"),
    )


def resolve_pairs(requests: DataFrame, filings: DataFrame, sections: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both filings and sections of every comparison request, with the first failing condition as reason, and their distinct claims.

    Only filings of the requested companies and forms, and sections of the filings in the pairs, are looked at. Chunks are read
    once, those of the sections compared: their ``section_evidence`` is written, and it also says which sections have chunks. The
    pairs are a written table, small next to the others and read by several steps.
    """
    filed = filings.select("accession_number", "source_url")
    group = ["cik", "form_type"]
    asked = filings.join(requests.select("accession_number").distinct(), "accession_number", "left_semi").select(*group).distinct()
    earlier = previous_filing(filings.join(asked, group, "left_semi"))
    resolved = (
        requests.join(filed.select("accession_number", F.col("source_url").alias("current_url")), "accession_number")
        .join(earlier, "accession_number", "left")
        .withColumnRenamed("accession_number", "current_accession")
        .withColumn("prior_accession", F.coalesce(F.nullif(F.col("prior_accession_number"), F.lit("")), F.col("previous_accession_number")))
        .drop("previous_accession_number", "prior_accession_number")
    )
    # A prior accession that is asked for explicitly still has to exist.
    known = filed.select(F.col("accession_number").alias("prior_accession"), F.col("source_url").alias("prior_url"))
    resolved = durable(resolved.join(known, "prior_accession", "left").withColumn(
        "prior_accession", F.when(F.col("prior_url").isNotNull(), F.col("prior_accession"))
    ), "compared-filings")

    wanted = resolved.select(F.explode(F.array("current_accession", "prior_accession")).alias("accession_number"), "section_type")
    wanted = wanted.where("accession_number is not null").distinct()
    heads = first_section(sections.join(wanted, ["accession_number", "section_type"], "left_semi"))
    for name in ("current", "prior"):
        key = f"{name}_accession"
        renamed = heads.select(
            F.col("accession_number").alias(key), "section_type",
            F.col("section_sequence").alias(f"{name}_sequence"), F.col("section_name").alias(f"{name}_section"),
        )
        resolved = resolved.join(renamed, [key, "section_type"], "left")
    # Only where both sections are there does it matter what they hold.
    resolved = durable(resolved, "paired-sections")
    place = ["accession_number", "section_sequence"]
    both = sections_compared(resolved.where("current_sequence is not null and prior_sequence is not null"))
    evidence = durable(section_evidence(chunks.join(both.select(*place).distinct(), place, "left_semi")), "compared-evidence")
    chunked = evidence.select(*place).distinct()
    for name in ("current", "prior"):
        keys = [F.col(key).alias(f"{name}_{own}") for key, own in zip(place, ("accession", "sequence"))]
        held = chunked.select(*keys, F.lit(True).alias(f"{name}_chunked"))
        resolved = resolved.join(held, [f"{name}_accession", f"{name}_sequence"], "left")
    reason = (
        F.when(F.col("current_sequence").isNull(), F.lit("current_section_missing"))
        .when(F.col("prior_accession").isNull(), F.lit("previous_filing_missing"))
        .when(F.col("prior_sequence").isNull(), F.lit("prior_section_missing"))
        .when(F.col("current_chunked").isNull() | F.col("prior_chunked").isNull(), F.lit("section_chunks_missing"))
    )
    return durable(resolved.withColumn("reason", reason), "compared-pairs"), evidence.where("claim_key <> ''")


def compare(requests: DataFrame, filings: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Answer comparison requests: ``pair_id, accession_number, section_type, prior_accession_number
    (nullable), max_claims``.

    Counts cover all claims; only the first ``max_claims`` of each kind are listed.
    """
    pairs, found = resolve_pairs(requests, filings, sections, chunks)
    usable = pairs.where(F.col("reason").isNull())
    claim_rows = diff_claims(usable, found).join(
        usable.select("pair_id", "section_type", "max_claims", "current_section", "prior_section", "current_url", "prior_url"),
        "pair_id",
    )
    now = _citation("current", F.col("current"), F.col("current_section"), F.col("section_type"), F.col("current_url"))
    before = _citation("prior", F.col("prior"), F.col("prior_section"), F.col("section_type"), F.col("prior_url"))

    # Claims stand together by pair, so they are numbered and summed up without moving again. Of the changes only the first
    # max_claims per kind are collected; each side's first claim is for the case that no listed change cites that side.
    added = F.col("change") == "added"
    w = Window.partitionBy("pair_id", "change").orderBy(
        F.when(added, F.col("current.chunk_id")).otherwise(F.col("prior.chunk_id")),
        F.when(added, F.col("current.claim_pos")).otherwise(F.col("prior.claim_pos")),
    )
    within = F.col("position") <= F.col("max_claims")
    totals = claim_rows.withColumn("position", F.row_number().over(w)).groupBy("pair_id").agg(
        *[F.count(F.when(F.col("change") == kind, 1)).alias(f"{kind}_count") for kind in ("added", "removed", "unchanged")],
        F.min(F.when(F.col("current").isNotNull(), F.struct(F.col("current.chunk_id"), F.col("current.claim_pos"), now.alias("citation")))).alias("first_current"),
        F.min(F.when(F.col("prior").isNotNull(), F.struct(F.col("prior.chunk_id"), F.col("prior.claim_pos"), before.alias("citation")))).alias("first_prior"),
        *[
            F.sort_array(F.collect_list(F.when((F.col("change") == kind) & within, F.struct("position", side.alias("citation"))))).alias(kind)
            for kind, side in (("added", now), ("removed", before))
        ],
    )
    # A section whose chunks hold no claim at all counts as missing evidence, like one without chunks.
    row = pairs.join(totals, "pair_id", "left")
    has_claims = F.col("first_current").isNotNull() & F.col("first_prior").isNotNull()
    row = row.withColumn(
        "reason", F.when(F.col("reason").isNull() & ~F.coalesce(has_claims, F.lit(False)), F.lit("section_chunks_missing")).otherwise(F.col("reason"))
    )
    ok = F.col("reason").isNull()
    row = row.withColumn("added", F.col("added.citation")).withColumn("removed", F.col("removed.citation"))
    none = F.slice(F.array(F.col("first_current.citation")), 1, 0)
    row = row.withColumn("added", F.coalesce("added", none)).withColumn("removed", F.coalesce("removed", none))
    citations = F.concat(
        F.col("added"),
        F.col("removed"),
        F.when(F.size("added") == 0, F.array(F.col("first_current.citation"))).otherwise(none),
        F.when(F.size("removed") == 0, F.array(F.col("first_prior.citation"))).otherwise(none),
    )
    summary = F.format_string(
        "Compared %s in %s against %s: %d added claim(s), %d removed claim(s), and %d unchanged claim(s).",
        F.col("section_type"), F.col("current_accession"), F.col("prior_accession"),
        F.col("added_count"), F.col("removed_count"), F.col("unchanged_count"),
    )
    listed_when_ok = lambda c: F.when(ok, c).otherwise(none)
    return row.select(
        "pair_id",
        F.col("current_accession").alias("current_accession_number"),
        F.when(~F.coalesce(F.col("reason").isin("current_section_missing", "previous_filing_missing"), F.lit(False)), F.col("prior_accession")).alias(
            "prior_accession_number"
        ),
        "section_type",
        ok.alias("supported"),
        F.when(ok, summary).otherwise(F.lit(K.UNCOMPARABLE_SUMMARY)).alias("summary"),
        listed_when_ok(F.col("added")).alias("added_claims"),
        listed_when_ok(F.col("removed")).alias("removed_claims"),
        F.when(ok, F.col("unchanged_count")).otherwise(F.lit(0)).cast("int").alias("unchanged_claim_count"),
        listed_when_ok(citations).alias("citations"),
        F.col("reason").alias("insufficient_evidence_reason"),
    )
