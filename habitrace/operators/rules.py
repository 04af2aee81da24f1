"""Accessibility and fall-risk rules with three-valued logic.

A missing or untrusted measurement is 'unknown', never safe: it takes no part
in the score, and a scan with nothing evaluable has a NULL score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (code, red, yellow, higher is worse, category, place in reports).
RULES = [
    ("door_width", 0.80, 0.90, False, "passability", 1),
    ("passage_width", 0.90, 1.20, False, "passability", 2),
    ("bathroom_door", 0.75, 0.85, False, "passability", 3),
    ("threshold", 0.02, 0.01, True, "fall_risk", 4),
    ("stairs", None, None, True, "fall_risk", 5),
    ("slope", 0.05, 0.02, True, "fall_risk", 6),
    ("uneven", 0.015, None, True, "fall_risk", 7),
    ("obstacle", None, None, True, "accessibility", 8),
]
WEIGHTS = {"passability": 0.4, "fall_risk": 0.4, "accessibility": 0.2}


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(*r, WEIGHTS[r[4]]) for r in RULES]
    return spark.createDataFrame(rows, "code string, red double, yellow double, higher_worse boolean, category string, place int, weight double")


def rules_sql() -> str:
    """The rule table as a SQL values list called ``rules``."""
    lit = lambda v: "null::double" if v is None else repr(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}"
    rows = ", ".join("(" + ", ".join(map(lit, (*r, WEIGHTS[r[4]]))) + ")" for r in RULES)
    return f"rules(code, red, yellow, higher_worse, category, place, weight) as (values {rows})"


def level(value: Column, red: Column, yellow: Column, higher_worse: Column) -> Column:
    """unknown, red, yellow or green; limits compare strictly. Flags (no limits): any value above zero is red."""
    worse = lambda limit: F.when(higher_worse, value > limit).otherwise(value < limit)
    flag = red.isNull() & yellow.isNull()
    return (
        F.when(value.isNull(), "unknown")
        .when(flag, F.when(value > 0, "red").otherwise("green"))
        .when(F.coalesce(worse(red), F.lit(False)), "red")
        .when(F.coalesce(worse(yellow), F.lit(False)), "yellow")
        .otherwise("green")
    )


LEVEL_SQL = """case when value is null then 'unknown'
  when red is null and yellow is null then case when value > 0 then 'red' else 'green' end
  when coalesce(case when higher_worse then value > red else value < red end, false) then 'red'
  when coalesce(case when higher_worse then value > yellow else value < yellow end, false) then 'yellow'
  else 'green' end"""


def eligible_value(value: Column, eligible: Column) -> Column:
    """A value that failed the confidence gate is unknown; no gate entry means eligible."""
    return F.when(F.coalesce(eligible, F.lit(True)), value)


def evaluate(measures: DataFrame, rules: DataFrame) -> DataFrame:
    """(scan_id, code, place, category, weight, value, level) for each scan and rule.

    ``measures`` has (scan_id, code, value); rules without a measure are unknown.
    """
    codes = measures.select("scan_id").distinct().join(F.broadcast(rules))
    joined = codes.join(measures, ["scan_id", "code"], "left")
    return joined.select("scan_id", "code", "place", "category", "weight", "value", level(F.col("value"), F.col("red"), F.col("yellow"), F.col("higher_worse")).alias("level"))


def level_value(level_col: Column) -> Column:
    return F.when(level_col == "green", 1.0).when(level_col == "yellow", 0.5).when(level_col == "red", 0.0)


def score(levels: DataFrame) -> DataFrame:
    """(scan_id, score, known, total, completeness): worst level per category, weights of the evaluated ones renormalised."""
    per = levels.groupBy("scan_id", "category", "weight").agg(F.min(level_value(F.col("level"))).alias("v"), F.count_if(F.col("level") != "unknown").alias("known"), F.count("*").alias("total"))
    weight = F.when(F.col("v").isNotNull(), F.col("weight"))
    return per.groupBy("scan_id").agg(
        F.try_divide(100 * F.sum(F.col("weight") * F.col("v")), F.sum(weight)).alias("score"),
        F.sum("known").alias("known"),
        F.sum("total").alias("total"),
        (100.0 * F.sum("known") / F.sum("total")).alias("completeness"),
    )
