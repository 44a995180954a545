"""Roll-ups (A1-A13, K1-K2).

Every count, sum and max here is algebraic, so Spark combines map-side before
the shuffle: a repository holding a third of all files still sends one partial
row per task.  Every ``collect_list`` is bounded: over (repository, type)
counts (one entry per rule), (repository, severity) counts, one snippet's
distinct recommendations, or -- for the nested per-file results -- one file's
hits, bounded by the file size cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysweep import FILE_KEYS, REPO_KEYS
from keysweep import catalog as C

def _sev() -> Column:
    return F.col("severity")


def severity_rank(sev: Column | None = None) -> Column:
    """critical 4 > high 3 > medium 2 > anything else 1 (low or unrecognised)."""
    sev = _sev() if sev is None else sev
    return (F.when(sev == "critical", 4).when(sev == "high", 3).when(sev == "medium", 2).otherwise(1))


def rank_label(rank: Column) -> Column:
    """A1 label of a max rank; no detections (null) -> 'none'."""
    return (F.when(rank.isNull(), F.lit("none")).when(rank == 4, "critical").when(rank == 3, "high")
            .when(rank == 2, "medium").otherwise("low"))


def _severity_counts() -> list[Column]:
    """A3: the four counts; unrecognised severities count in none of them."""
    return [F.count_if(_sev() == s).alias(s) for s in C.SEVERITIES]


def file_results(dets: DataFrame, keys=FILE_KEYS, nested: bool = False) -> DataFrame:
    """A1 + A2: one row per file with >= 1 detection.

    ``nested`` also carries the file's detections as a list in (line, column,
    type) order -- the per-file result shape; bounded by the file size cap."""
    aggs = [F.count(F.lit(1)).alias("detections"), *_severity_counts(),
            F.max(severity_rank()).alias("_rank"), F.min("line").alias("first_line")]
    if nested:
        fields = [c for c in dets.columns if c not in keys]
        order = ["line", "column", "type"] + [c for c in fields if c not in ("line", "column", "type")]
        aggs.append(F.sort_array(F.collect_list(F.struct(*order))).alias("results"))
    return (dets.groupBy(*keys).agg(*aggs)
            .withColumn("severity", rank_label(F.col("_rank"))).drop("_rank"))


def risk_score(c: Column, h: Column, m: Column, low: Column) -> Column:
    """min(100, 10c + 5h + 2m + l)."""
    w = C.SEVERITY_WEIGHTS
    raw = c * w["critical"] + h * w["high"] + m * w["medium"] + low * w["low"]
    return F.least(F.lit(C.MAX_RISK_SCORE).cast("bigint"), raw.cast("bigint")).cast("int")


def compliance(score: Column, c: Column, h: Column) -> Column:
    """A9."""
    return (F.when((c > 0) | (score >= C.NON_COMPLIANT_SCORE), F.lit("non_compliant"))
            .when((h > 0) | (score >= C.AT_RISK_SCORE), F.lit("at_risk"))
            .otherwise(F.lit("compliant")))


def _str_array(items: list[str]) -> Column:
    return F.array(*[F.lit(s) for s in items])


def _empty() -> Column:
    return F.array().cast("array<string>")


def remediation_steps(c: Column, h: Column) -> Column:
    """3 critical steps if c > 0, 2 high steps if h > 0, then 7 always."""
    return F.concat(F.when(c > 0, _str_array(C.CRITICAL_STEPS)).otherwise(_empty()),
                    F.when(h > 0, _str_array(C.HIGH_STEPS)).otherwise(_empty()),
                    _str_array(C.GENERAL_STEPS))


def recommendations(top3: Column, score: Column) -> Column:
    """A13: 'most common types' line if any hit, 2 lines when score >= 70, 3 always.

    ``top3`` is the array<string> of up to three type names, most frequent first."""
    head = F.when(F.size(top3) > 0, F.array(F.concat(F.lit(C.TOP_TYPES_PREFIX), F.array_join(top3, ", "))))
    return F.concat(F.coalesce(head, _empty()),
                    F.when(score >= C.HIGH_RISK_SCORE, _str_array(C.HIGH_RISK_RECOMMENDATIONS)).otherwise(_empty()),
                    _str_array(C.GENERAL_RECOMMENDATIONS))


def type_counts(dets: DataFrame, keys=REPO_KEYS) -> DataFrame:
    """A5: detections per (repository, branch, type)."""
    return dets.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("count"))


def top_types(counts: DataFrame, k: int, keys=REPO_KEYS) -> DataFrame:
    """K1/K2: top k types by count desc, type asc (deterministic tie-break).

    The window partition is one repository's type counts: at most one row per
    catalog rule, however large the repository."""
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), F.asc("type"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_types_array(counts: DataFrame, k: int, keys=REPO_KEYS) -> DataFrame:
    """(keys, top_types ARRAY<STRUCT<type, count>>) -- bounded collect over type counts."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("neg"), "type", "count")))
    return (counts.groupBy(*keys)
            .agg(F.slice(ordered, 1, k).alias("_top"))
            .select(*keys, F.transform("_top", lambda x: F.struct(x["type"].alias("type"),
                                                                   x["count"].alias("count"))).alias("top_types")))


def analyze(dets: DataFrame, keys=REPO_KEYS, repos: DataFrame | None = None) -> DataFrame:
    """A10: severity counts, score, status, steps and recommendations per repository.

    Two aggregations: (repo, type) partial counts with per-severity counts, then
    one per-repository pass summing them and collecting the top-3 types (a list
    bounded by the number of rules).  With ``repos``, every listed repository
    reports (clean ones with zero counts)."""
    per_type = dets.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"), *_severity_counts())
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("type"))))
    agg = per_type.groupBy(*keys).agg(
        F.sum("n").alias("secrets"), *[F.sum(s).alias(s) for s in C.SEVERITIES],
        F.transform(F.slice(ordered, 1, 3), lambda x: x["type"]).alias("top3"))
    base = agg if repos is None else repos.join(agg, list(keys), "left")
    base = base.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                for c in ["secrets", *C.SEVERITIES]], "top3")
    return _analysis_columns(base, keys)


def _analysis_columns(df: DataFrame, keys) -> DataFrame:
    c, h, m, low = (F.col(s) for s in C.SEVERITIES)
    score = risk_score(c, h, m, low)
    top3 = F.coalesce(F.col("top3"), _empty())
    return (df.withColumn("risk_score", score)
            .select(*keys, "secrets", "critical", "high", "medium", "low", "risk_score",
                    compliance(F.col("risk_score"), c, h).alias("compliance_status"),
                    remediation_steps(c, h).alias("remediation_steps"),
                    recommendations(top3, F.col("risk_score")).alias("recommendations"),
                    top3.alias("top3")))


def severity_breakdown(dets: DataFrame, keys=REPO_KEYS) -> DataFrame:
    """A4 as rows: the four fixed keys (zero defaults) plus any other severity seen."""
    per = dets.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("count"))
    seen = F.map_from_entries(F.collect_list(F.struct(F.coalesce("severity", F.lit("")).alias("k"), F.col("count").alias("v"))))
    one = per.groupBy(*keys).agg(seen.alias("_seen"))  # an entry for each severity at most
    fixed = F.array(*[F.struct(F.lit(s).alias("severity"), F.coalesce(F.col("_seen")[s], F.lit(0).cast("bigint")).alias("count"))
                      for s in C.SEVERITIES])
    other = F.transform(F.filter(F.map_entries("_seen"), lambda e: ~e["key"].isin(*C.SEVERITIES)),
                        lambda e: F.struct(F.nullif(e["key"], F.lit("")).alias("severity"), e["value"].alias("count")))
    return one.select(*keys, F.explode(F.concat(fixed, other)).alias("_e")).select(*keys, "_e.severity", "_e.count")


def snippet_advice(dets: DataFrame, keys) -> DataFrame:
    """A11 (and the text's hits ``n`` and severity rank ``rk``, from the same pass): distinct recommendations of a text in first-seen (line, column, type)
    order, then the three fixed lines when there is any hit.

    Pre-aggregated to one row per (text, recommendation), so the collected list
    holds at most one entry per catalog rule."""
    first = (dets.groupBy(*keys, "recommendation")
             .agg(F.min(F.struct("line", "column", "type")).alias("_first"), F.count(F.lit(1)).alias("_n"),
                  F.max(severity_rank()).alias("_rk")))
    ordered = F.sort_array(F.collect_list(F.struct("_first", "recommendation")))
    recs = F.transform(ordered, lambda x: x["recommendation"])
    return first.groupBy(*keys).agg(
        F.array_distinct(F.concat(recs, _str_array(C.SNIPPET_ADVICE))).alias("recommendations"),
        F.sum("_n").alias("n"), F.max("_rk").alias("rk"))
