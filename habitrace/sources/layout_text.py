"""Layout text: ``wall_0=Wall(...)`` lines to typed rows; malformed lines are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = r"^\s*(wall|door|window|bbox)_(\d+)\s*=\s*(Wall|Door|Window|Bbox)\(([^()]*)\)\s*$"


def parse_layout(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds (kind, item_id, args array<string>); only well-formed lines stay."""
    # a line is matched and cut once: what the generator gives is not computed again by filters on its parts
    parts = F.explode(F.when(F.col(line).rlike(LINE), F.array(F.split(F.trim(F.col(line)), r"\s*[=(),]\s*"))))
    name = F.get("_t", F.lit(0))
    found = lines.select(*lines.columns, parts.alias("_t"))
    typed = {"kind": F.substring_index(name, "_", 1), "item_id": F.substring_index(name, "_", -1).try_cast("int"), "args": F.slice("_t", 3, F.size("_t") - 3)}
    return found.withColumns(typed).drop("_t")


def walls(parsed: DataFrame) -> DataFrame:
    """Walls: two ends, height and thickness; a line with a number missing is dropped."""
    num = lambda i: F.expr(f"try_cast(get(args, {i}) as double)")
    names = ["ax", "ay", "az", "bx", "by", "bz", "height", "thickness"]
    typed = parsed.filter("kind = 'wall'").select(*[c for c in parsed.columns if c not in ("kind", "args")], *(num(i).alias(n) for i, n in enumerate(names)))
    return typed.dropna(subset=names[:7])


def openings(parsed: DataFrame, wall_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Doors and windows with their wall; a child without its wall is dropped."""
    own = F.regexp_extract(F.get("args", F.lit(0)), r"wall_(\d+)", 1)
    num = lambda i: F.expr(f"try_cast(get(args, {i}) as double)")
    kids = parsed.filter("kind in ('door', 'window')").select(*keys, "kind", "item_id", own.try_cast("int").alias("wall_id"), *(num(i + 1).alias(n) for i, n in enumerate(("x", "y", "z", "width", "height"))))
    return kids.join(wall_rows.select(*keys, F.col("item_id").alias("wall_id")), [*keys, "wall_id"])


def boxes(parsed: DataFrame) -> DataFrame:
    """Boxes: class, centre, turn and three sizes; a line with a number missing is dropped."""
    num = lambda i: F.expr(f"try_cast(get(args, {i}) as double)")
    names = ["cx", "cy", "cz", "yaw", "sx", "sy", "sz"]
    kept = [c for c in parsed.columns if c not in ("kind", "args")]
    return parsed.filter("kind = 'bbox'").select(*kept, F.get("args", F.lit(0)).alias("class"), *(num(i + 1).alias(n) for i, n in enumerate(names))).dropna(subset=names)
