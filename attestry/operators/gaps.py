"""Checklists against evidence, scores and their bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import blank_to_null, col, extract, strip
from attestry.operators.joins import SALTS, salted_left_join


def requirement_headings(lines: DataFrame) -> DataFrame:
    """(family, control, title, ordinal) of requirement headings.

    ``lines``: file, line_no, line.  Templates are skipped; the family is the
    upper-case file stem.
    """
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]+$", "")
    return lines.where((F.upper(stem) != "TEMPLATE") & col("line").rlike(V.CONTROL_HEADING)).select(
        F.upper(stem).alias("family"), F.regexp_extract("line", V.CONTROL_HEADING, 1).alias("control"),
        strip(F.regexp_replace("line", V.CONTROL_HEADING, "")).alias("title"), "line_no")


def requirement_sections(files: DataFrame) -> DataFrame:
    """Headings with their body text, from whole files ``file, text``."""
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]+$", "")
    parts = files.where(F.upper(stem) != "TEMPLATE").select(
        F.upper(stem).alias("family"), F.posexplode(F.split("text", r"(?m)^(?=## )")).alias("ordinal", "part"))
    found = parts.where(col("part").rlike(V.CONTROL_HEADING))
    head = F.substring_index("part", "\n", 1)
    return found.select(
        "family", F.regexp_extract("part", V.CONTROL_HEADING, 1).alias("control"),
        strip(F.regexp_replace(head, V.CONTROL_HEADING, "")).alias("title"),
        strip(F.substring("part", F.length(head) + 1, F.length("part"))).alias("body"), "ordinal")


def _evidence_counts(index: DataFrame, keys: list[str]) -> DataFrame:
    return index.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(col("status") == "ready").alias("ready"),
        F.count_if(col("status") == "needs_manual_fetch").alias("waiting"))


def resolve_evidence(checklist: DataFrame, index: DataFrame, salts: int = SALTS) -> DataFrame:
    """Evidence counts of every checklist control.

    A row with an empty control counts for its whole family.  Both kinds are
    counted first, so controls meet one total each, not the evidence rows.
    """
    own = _evidence_counts(index.where("control <> ''"), ["family", "control"])
    shared = _evidence_counts(index.where("control = ''"), ["family"]).toDF("family", "n_family", "ready_family", "waiting_family")
    df = salted_left_join(checklist, shared, ["family"], "control", salts).join(own, ["family", "control"], "left")

    def total(c: str) -> Column:
        return F.coalesce(col(c), F.lit(0)) + F.coalesce(col(f"{c}_family"), F.lit(0))

    return df.select(*checklist.columns, total("n").alias("sources"), total("ready").alias("ready"), total("waiting").alias("waiting"))


def judge(resolved: DataFrame, score: str = "score", mixed: str = "incomplete") -> DataFrame:
    """Sufficiency and final score per control.

    No evidence: ``No``, 0.  Evidence waiting to be fetched: ``Incomplete``, no
    score.  Ready evidence: the supplied score, ``Yes`` from seven up, else
    ``Partial``; while no score is supplied, neither.  With both kinds, ``mixed='incomplete'`` defers and ``'ready'``
    scores.
    """
    none = col("sources") == 0
    deferred = (col("waiting") > 0) if mixed == "incomplete" else ((col("waiting") > 0) & (col("ready") == 0))
    given = col(score).cast("int")
    return resolved.withColumns({
        "sufficiency": F.when(none, "No").when(deferred, "Incomplete").when(given >= 7, "Yes")
        .when(given > 0, "Partial").when(given <= 0, "No"),
        "final_score": F.when(none, 0).when(~deferred, given),
    })


def band(score: Column | str) -> Column:
    """Score band; no score is ``fetch``."""
    out = F.when(col(score).isNull(), "fetch")
    for name, low, high in V.SCORE_BANDS:
        out = out.when(col(score).between(low, high), name)
    return out


def bands_by_family(judged: DataFrame) -> DataFrame:
    return judged.groupBy("family", band("final_score").alias("band")).agg(F.count("*").alias("controls"))


def band_totals(judged: DataFrame) -> DataFrame:
    """Controls per family and band, with the totals of each family and of all.

    ``level`` is 0 for a band, 1 for a family's total, 3 for the grand total; a total's open columns are null.
    """
    banded = judged.select("family", band("final_score").alias("band"))
    return banded.rollup("family", "band").agg(F.count("*").alias("controls"), F.grouping_id().cast("int").alias("level"))


def review_queue(judged: DataFrame) -> DataFrame:
    """Borderline scores and controls whose recency is unknown."""
    low, high = V.REVIEW_SCORES
    unsure = col("last_reviewed").isNull() & (col("sources") > 0)
    return judged.where(col("final_score").between(low, high) | unsure)


def review_date(text: Column | str) -> Column:
    """Visible review date of a document, null when it cannot be determined."""
    return F.try_to_timestamp(extract(text, V.REVIEW_DATE, 1), F.lit("yyyy-MM-dd")).cast("date")


def recency(documents: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    """Add ``last_reviewed`` and ``age_days``."""
    df = documents.withColumn("last_reviewed", review_date(text))
    return df.withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), "last_reviewed"))


def gap_rows(lines: DataFrame) -> DataFrame:
    """Five columns of a Markdown gap table; ``9/10`` is 9, ``N/A`` null."""
    df = lines.where(col("line").rlike(r"^\s*\|.*\|\s*$")).withColumn("_c", F.split(strip("line"), r"\|"))
    df = df.where((F.size("_c") >= 7) & ~F.get("_c", F.lit(1)).rlike(r"^\s*(-+|Control)\s*$"))
    names = ["control", "sources", "sufficiency", "score_text", "gaps"]
    df = df.withColumns({n: strip(F.get("_c", F.lit(i + 1))) for i, n in enumerate(names)})
    score = F.try_to_number(blank_to_null(F.regexp_extract("score_text", r"^(\d+)", 1)), F.lit("99")).cast("int")
    return df.withColumn("score", score).drop("_c", "score_text")


def cycle_diff(before: DataFrame, after: DataFrame, keys: list[str] = ("framework", "control")) -> DataFrame:
    """Score change of each control between two cycles."""
    joined = before.select(*keys, col("score").alias("old_score")).join(
        after.select(*keys, col("score").alias("new_score")), list(keys), "full_outer")
    o, n = col("old_score"), col("new_score")
    return joined.withColumn("change", (
        F.when(o.isNull() & n.isNotNull(), "added").when(n.isNull() & o.isNotNull(), "removed")
        .when(o.isNull(), "unscored").when(n > o, "improved").when(n < o, "regressed").when(n < 8, "unremediated").otherwise("held")))
