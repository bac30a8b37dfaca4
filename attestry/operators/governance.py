"""SLA deadlines, publishing, drift, change gates, fingerprints, sensitive text.

The thresholds here are parameters: the rules are fixed, the numbers are policy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.hashing import row_hash
from attestry.functions.text import col, filled


def sla_status(findings: DataFrame, windows: dict[str, int], warn_days: int, now: str) -> DataFrame:
    """Deadline by severity and its tier: on_track, warning, violation.

    ``findings``: severity, opened_at, resolved_at (may be null).  A finding is
    judged at its resolution, or at ``now`` while open; it warns within
    ``warn_days`` of the deadline.
    """
    days = F.lit(None).cast("int")
    for severity, n in windows.items():
        days = F.when(col("severity") == severity, n).otherwise(days)
    due = col("opened_at") + F.make_dt_interval(days=days)
    at = F.coalesce("resolved_at", F.lit(now).cast("timestamp"))
    df = findings.withColumns({"deadline": due, "_at": at})
    tier = (
        F.when(col("deadline").isNull(), "no_window").when(col("_at") > col("deadline"), "violation")
        .when(col("_at") > col("deadline") - F.make_dt_interval(days=F.lit(warn_days)), "warning").otherwise("on_track"))
    return df.withColumn("tier", tier).drop("_at")


def sla_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("severity", "tier").agg(F.count("*").alias("findings"))


def publish_actions(current: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """What to publish, keep and prune."""
    joined = current.select(key, F.lit(True).alias("_now")).join(
        published.select(key, F.lit(True).alias("_was")), key, "full_outer")
    action = F.when(col("_was").isNull(), "publish").when(col("_now").isNull(), "prune").otherwise("keep")
    return joined.select(key, action.alias("action"))


def unexpected(inventory: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Resources nobody expects."""
    return inventory.join(allowed.select(key), key, "left_anti")


def change_gate(changes: DataFrame, risk_labels: list[str], approvals_needed: dict[str, int]) -> DataFrame:
    """Failed gate rules of each change record (F47): risk label, ticket key, approvals."""
    needed = F.lit(1)
    for label, n in approvals_needed.items():
        needed = F.when(col("risk") == label, n).otherwise(needed)
    rules = [
        F.when(~F.coalesce(col("risk").isin(risk_labels), F.lit(False)), "risk label missing"),
        F.when(~F.coalesce(col("title").rlike(r"\b[A-Z][A-Z0-9]+-\d+\b"), F.lit(False)), "ticket key missing"),
        F.when(F.coalesce(col("approvals"), F.lit(0)) < needed, "approvals missing"),
    ]
    failed = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return changes.withColumns({"failed": failed, "passes": F.size(failed) == 0})


def fingerprints(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Content fingerprint per group, whatever the row order.

    Row hashes are combined by count, sum and xor, which partial aggregation
    reduces before the shuffle; groups of any size never meet in one place.
    """
    h = rows.withColumn("_h", row_hash(*columns))
    combined = h.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum(col("_h").cast("decimal(38,0)")).alias("_s"), F.bit_xor("_h").alias("_x"))
    text = F.concat_ws(":", "_n", "_s", "_x")
    return combined.select(*keys, F.md5(text.cast("binary")).alias("fingerprint"))


def changed_since(current: DataFrame, passed: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose fingerprint has not passed yet."""
    return current.join(passed.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def rewrite_changed(rows: DataFrame, keys: list[str], columns: list[str], store: str, passed: DataFrame | None = None) -> DataFrame:
    """Bring a store partitioned by ``keys`` up to date and return the fingerprints it holds now.

    Only groups whose fingerprint has not passed are rewritten, each as a whole, by dynamic
    partition overwrite; the files of all others stay as they are.  Without ``passed`` all are written.
    """
    current = fingerprints(rows, keys, columns)
    changed = current if passed is None else changed_since(current, passed, keys)
    fresh = rows if passed is None else rows.join(changed.select(*keys), keys, "left_semi")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(store)
    return current


def sensitive_hits(documents: DataFrame, text: str = "text", patterns: list[tuple[str, str, list[str]]] = V.SENSITIVE_PATTERNS,
                   allowed: list[str] = V.SENSITIVE_ALLOWED) -> DataFrame:
    """One row per sensitive string: rule and match, allowed forms left out.

    Whole texts are scanned on the JVM; a document's hits are exploded at once.
    """


    def matches(pattern: str, needed: list[str]):
        all_hits = F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))
        if not needed:
            return all_hits
        likely = reduce(lambda a, b: a | b, [F.contains(col(text), F.lit(n)) for n in needed])
        return F.when(likely, all_hits).otherwise(F.array().cast("array<string>"))

    found = F.array(*[F.struct(F.lit(name).alias("rule"), matches(p, needed).alias("hits")) for name, p, needed in patterns])
    keep = [c for c in documents.columns if c != text]
    rows = documents.select(*keep, F.explode(found).alias("f")).where(F.size("f.hits") > 0)
    hits = rows.select(*keep, col("f.rule").alias("rule"), F.posexplode("f.hits").alias("hit_no", "hit"))
    return hits.where(~col("hit").rlike("|".join(allowed)) & filled("hit"))



