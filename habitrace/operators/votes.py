"""Label voting, numbering and overlaps over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tallies(votes: DataFrame, keys: list[str], label: str, weight: Column) -> DataFrame:
    """Weight and number of votes per key and label."""
    return votes.groupBy(*keys, label).agg(F.sum(weight).alias("weight"), F.count("*").alias("support"))


def majority(tally: DataFrame, keys: list[str], label: str, value: str, greatest_label: bool) -> DataFrame:
    """The label with most ``value``; ties go to the greatest or the least label."""
    if greatest_label:
        best = F.max_by(label, F.struct(value, label))
    else:
        best = F.min_by(label, F.struct((-F.col(value)).alias("most"), label))
    return tally.groupBy(*keys).agg(best.alias(label), F.max(value).alias("best"), F.sum(value).alias("whole"))


def numbered(rows: DataFrame, scope: list[str], label: str, order: list[Column]) -> DataFrame:
    """``label_001`` numbers per scope and label."""
    k = F.row_number().over(Window.partitionBy(*scope, label).orderBy(*order))
    return rows.withColumn("name", F.format_string("%s_%03d", F.col(label), k))
