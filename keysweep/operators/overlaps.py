"""D1 without double counts: of matches that overlap on a line the most specific one stays.

A rule is the more specific the rarer the literals are that its pattern needs (``functions.literals``); rules that need equally
rare ones follow the order of the catalog.  The sweep goes over the spans of a line by their starts: a span that begins behind
the end of all before it begins a new group.  Groups of one span, nearly all, are done then.  In the others spans are taken by
rank, and each one stays if it overlaps none that stayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keysweep import FILE_KEYS
from keysweep import catalog as C
from keysweep.functions.literals import chance, gate
from keysweep.functions.regex import sql_string


def ranks(rules: list[C.Rule] | None = None) -> dict[str, int]:
    """Type -> rank, the most specific rule first; rules without literals last."""
    rules = C.RULES if rules is None else rules

    def rarity(rule: C.Rule) -> float:
        clauses = gate(rule.pattern).clauses
        return chance(clauses[0]) if clauses else 1.0

    order = sorted(range(len(rules)), key=lambda k: (rarity(rules[k]), k))
    return {rules[k].type: place for place, k in enumerate(order)}


def rank_sql(kind: str = "type", rules: list[C.Rule] | None = None) -> str:
    found = ranks(rules)
    return f"CASE {kind} " + " ".join(f"WHEN {sql_string(t)} THEN {k}" for t, k in found.items()) + f" ELSE {len(found)} END"


def most_specific(dets: DataFrame, keys=FILE_KEYS, rules: list[C.Rule] | None = None) -> DataFrame:
    """The rows of ``dets`` (keys, line, column, end_column, type, ...) that no more specific one covers.

    Rows without a type, and those of lines with one match, pass as they are; of equal spans of equal rank one stays.  A group of
    overlapping spans meets in one row; it is no larger than a line's chain of overlapping matches."""
    line = [*keys, "line"]
    starts = Window.partitionBy(*line).orderBy("column", "end_column")
    reach = F.max("end_column").over(starts.rowsBetween(Window.unboundedPreceding, -1))
    rows = dets.withColumn("_new", (reach.isNull() | (F.col("column") > reach)).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(starts.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*line, "_group")))
    alone = rows.where("_n = 1").select(dets.columns)
    rank = F.expr(rank_sql("type", rules))
    spans = (rows.where("_n > 1").groupBy(*line, "_group")
             .agg(F.sort_array(F.collect_list(F.struct(rank.alias("_rank"), F.col("column").alias("_at"), (-F.col("end_column")).alias("_to"),
                                                       F.struct(*dets.columns).alias("row")))).alias("_all")))
    stay = F.expr("aggregate(_all, slice(_all, 1, 0), (kept, x) -> IF(exists(kept, k -> k.row.column <= x.row.end_column "
                  "AND x.row.column <= k.row.end_column), kept, array_append(kept, x)))")
    return alone.union(spans.select(F.explode(stay).alias("x")).select("x.row.*"))
