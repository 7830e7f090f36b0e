"""What stands in the way of completion, of an acceptance, and of submitted pieces: rules over wide rows, read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

MOST_PIECES = 100  # fixed value


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def said(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit(""))


def outstanding(units: DataFrame) -> DataFrame:
    """Adds `problems`, an array of (kind, problem), to rows of units with the facts of their document.

    units: document, unit_no (from 1), units (of the document), accepted, error, blocked, readable, assembled (whether the assembly is of the current
    inputs), keeper (of an approved duplicate that is still there), keeper_present. Documents that were not accepted have only the problems of duplicates.
    """
    short, first, open_ = F.substring(F.col("document").cast("string"), 1, 10), F.col("unit_no") == 1, F.coalesce("accepted", F.lit(True))
    unit = F.concat(short, F.lit(" unit "), F.col("unit_no").cast("string"), F.lit(": "))
    rules = [
        ("extraction failed", open_ & first & (said("error") != ""), F.concat(short, F.lit(": extraction failed: "), said("error"))),
        ("blocked", open_ & (said("blocked") != ""), F.concat(unit, said("blocked"))),
        ("unread", open_ & ~flag("readable"), F.concat(unit, F.lit("unread or unreadable"))),
        ("assembly pending", open_ & first & (F.col("units") > 1) & ~flag("assembled"), F.concat(short, F.lit(": receipt assembly pending"))),
        ("cleanup pending", first & F.col("keeper").isNotNull(), F.concat(short, F.lit(": admin duplicate cleanup pending; retain "), F.substring(F.col("keeper").cast("string"), 1, 10))),
        ("survivor missing", first & F.col("keeper").isNotNull() & ~flag("keeper_present"), F.concat(F.substring(F.col("keeper").cast("string"), 1, 10), F.lit(": selected survivor is missing"))),
    ]
    return units.withColumn("problems", F.array_compact(F.array(*[F.when(when, F.struct(F.lit(kind).alias("kind"), text.alias("problem"))) for kind, when, text in rules])))


def gate(units: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Rows (document, unit_no, kind, problem); none means that all is complete.

    `seen` is told beside the result, in the same pass: units, problems in all, how many of each kind, and the first one.
    """
    marked = outstanding(units)
    if seen is not None:
        kinds = ("extraction failed", "blocked", "unread", "assembly pending", "cleanup pending", "survivor missing")
        of = lambda kind: F.count_if(F.exists("problems", lambda p: p["kind"] == kind)).alias(kind)
        least = F.min(F.when(F.size("problems") > 0, F.struct("document", "unit_no", F.col("problems")[0]["problem"].alias("problem"))))
        marked = marked.observe(seen, F.count("*").alias("units"), F.coalesce(F.sum(F.size("problems")), F.lit(0)).alias("problems"), *map(of, kinds), least.alias("first"))
    return marked.select("document", "unit_no", F.explode("problems").alias("p")).select("document", "unit_no", "p.kind", "p.problem")


def acceptance(units: DataFrame) -> DataFrame:
    """Adds `refusal` to units that a person accepts: the first rule in the way, null if there is none.

    units: pieces (how many), supporting_only, trash, regeneration (status or null), assembly_pending, accepted_matches, source_changed, bad_amounts.
    A unit has at most MOST_PIECES of them.
    """
    pieces = F.coalesce("pieces", F.lit(0))
    refusal = (
        F.when(flag("source_changed"), "source changed")
        .when((pieces == 0) & ~flag("supporting_only"), "no entries and not supporting evidence")
        .when((pieces > 0) & flag("supporting_only"), "supporting evidence with entries")
        .when(flag("trash"), "in trash")
        .when(F.col("regeneration").isNotNull() & (F.col("regeneration") != "completed"), "regeneration unfinished")
        .when(flag("assembly_pending"), "assembly pending")
        .when(F.coalesce("accepted_matches", F.lit(0)) > 0, "accepted matches")
        .when(pieces > MOST_PIECES, "too many entries")
        .when(F.coalesce("bad_amounts", F.lit(0)) > 0, "unreadable amount")
    )
    return units.withColumn("refusal", refusal)


def submitted_lineage(submitted: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (document, pos, piece_id, lineage, problem) of submitted pieces (document, pos, piece_id, parents).

    existing: document, piece_id, parents. lineage: kept (a known id once), added (neither id nor parents), split (of one parent), merged (of
    several), else null with a problem: an id that is unknown or comes again, or a parent that is unknown. A kept piece may name the parents it had.
    Empty ids count as none.
    """
    key = F.nullif(F.trim("piece_id"), F.lit(""))
    rows = submitted.withColumn("piece_id", key).withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    known = existing.select("document", "piece_id", F.coalesce("parents", F.array().cast("array<string>")).alias("had"), F.lit(True).alias("known"))
    first = rows.filter("piece_id is not null").groupBy("document", "piece_id").agg(F.min("pos").alias("first_pos"))
    named = rows.select("document", "pos", F.explode("parents").alias("piece_id")).join(known.select("document", "piece_id"), ["document", "piece_id"], "left_anti")
    unknown = named.groupBy("document", "pos").agg(F.lit(True).alias("orphan"))
    both = rows.join(known, ["document", "piece_id"], "left").join(first, ["document", "piece_id"], "left").join(unknown, ["document", "pos"], "left")
    inherited = flag("known") & (F.col("parents") == F.col("had"))
    wrong = F.col("piece_id").isNotNull() & (~flag("known") | (F.col("pos") > F.col("first_pos")))
    problem = F.when(wrong, "unknown or repeated id").when(flag("orphan") & ~inherited, "unknown parent")
    many = F.size(F.array_distinct("parents"))
    kind = F.when(F.col("piece_id").isNotNull(), "kept").when(many == 0, "added").when(many == 1, "split").otherwise("merged")
    return both.select("document", "pos", "piece_id", F.when(problem.isNull(), kind).alias("lineage"), problem.alias("problem"))
