"""Records around a scan: references, selections, cameras, documents, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verified(status: Column, *needed: Column) -> Column:
    """Objects and openings that may enter an analysis: verified, with all that is needed."""
    ok = F.coalesce(status == "verified", F.lit(False))
    for c in needed:
        ok = ok & c.isNotNull()
    return ok


def forced_scale(references: DataFrame, key: str) -> DataFrame:
    """(key, reference_id, scale): doors first, then the order given; the first measurable reference wins.

    ``references`` (key, reference_id, kind, metres, measured); a reference
    without a positive measured length is not measurable, the least scale wins ties. What comes of it is
    an estimate of low confidence and never enters a risk.
    """
    usable = references.filter((F.col("measured") > 0) & F.col("metres").isNotNull())
    rank = F.struct(F.when(F.col("kind") == "door", 0).otherwise(1).alias("k"), "reference_id", (F.col("metres") / F.col("measured")).alias("scale"))
    return usable.groupBy(key).agg(F.min(rank).alias("b")).select(key, "b.reference_id", "b.scale")


def scale_from_pixels(pixels: Column, metres: Column, distance: Column, focal: Column) -> Column:
    """Metres a unit from a known length in the image: focal * metres / pixels is its depth. NULL unless all are positive."""
    return F.when((pixels > 0) & (distance > 0) & (focal > 0), focal * metres / pixels / distance)


def scale_from_door(height: Column, standard: float = 2.0) -> Column:
    """Metres a unit if the door has the standard height; NULL without one."""
    return F.when(height > 0, standard / height)


def reference_scale(references: DataFrame, key: str, tolerance: float = 0.15) -> DataFrame:
    """(key, n, scale, status): the median of metres / measured; a bed's length overrides it.

    ``references`` (key, kind, scale). Without a bed, scales that disagree by
    more than ``tolerance`` of the median fail; with one, disagreement does not
    (the reference's rule). One scale alone is of low confidence.
    """
    ok = references.filter("scale > 0")
    per = ok.groupBy(key).agg(F.count("*").alias("n"), F.median("scale").alias("med"), F.max("scale").alias("hi"), F.min("scale").alias("lo"), F.median(F.when(F.col("kind") == "bed", F.col("scale"))).alias("bed"))
    apart = (F.col("hi") - F.col("lo")) / F.col("med") > tolerance
    failed = F.col("bed").isNull() & (F.col("n") > 1) & apart
    status = F.when(F.col("bed").isNotNull(), "bed").when(failed, "failed").when(F.col("n") == 1, "low").otherwise("ok")
    return per.select(key, "n", F.when(~failed, F.coalesce("bed", "med")).alias("scale"), status.alias("status"))


CAMERA = "struct<id:bigint,fx:double,fy:double,cx:double,cy:double,width:int,height:int,rotation:array<array<double>>,position:array<double>>"


def camera(text: Column) -> Column:
    """struct<k, r, t, image_size> of a camera's JSON: the rotation is world to camera, t = -R p."""
    c = F.from_json(text, CAMERA)
    k = F.array(F.array(c["fx"], F.lit(0.0), c["cx"]), F.array(F.lit(0.0), c["fy"], c["cy"]), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    row = lambda i: -(c["rotation"][i][0] * c["position"][0] + c["rotation"][i][1] * c["position"][1] + c["rotation"][i][2] * c["position"][2])
    return F.struct(c["id"].alias("id"), k.alias("k"), c["rotation"].alias("r"), F.array(*(row(i) for i in range(3))).alias("t"), F.array(c["width"], c["height"]).alias("image_size"))


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pinhole pixel of a point in camera coordinates; depths below 1e-6 count as that."""
    depth = F.greatest(z, F.lit(1e-6))
    return fx * x / depth + cx, fy * y / depth + cy


def failure_code(stage: Column, detail: Column) -> Column:
    """What a user is told of a failure: the first cause that the stage and the detail allow."""
    says = lambda *words: F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(detail), w)), True), F.lit(False))
    rebuilding = stage.isin("reconstructing", "extracting")
    return (
        F.when(rebuilding & says("out of memory", "cuda"), "gpu_memory")
        .when(rebuilding & says("weight"), "weights_missing")
        .when(rebuilding & says("ffmpeg"), "frame_extraction")
        .when(rebuilding, "reconstruction")
        .when(stage == "cleaning", "cleaning")
        .when(stage == "understanding", "understanding")
        .otherwise("pipeline")
    )


def with_supplements(frames: DataFrame, clips: DataFrame, keys: list[str], radius: int = 3) -> DataFrame:
    """(keys, clip_id, place, source, frame_no): each clip between its anchors, numbered.

    ``frames`` (keys, frame_no) is the main sequence, ``clips`` (keys, clip_id,
    anchor, length) are inserted at ``anchor``: the ``radius`` frames before,
    the clip's own frames, the ``radius`` frames from the anchor on.
    """
    span = clips.select(*keys, "clip_id", "anchor", F.explode(F.sequence(F.col("anchor") - radius, F.col("anchor") + (radius - 1))).alias("frame_no"))
    anchors = span.join(frames.select(*keys, "frame_no"), [*keys, "frame_no"]).select(*keys, "clip_id", F.when(F.col("frame_no") < F.col("anchor"), 0).otherwise(2).alias("_part"), F.lit("anchor").alias("source"), F.col("frame_no").cast("bigint").alias("frame_no"))
    own = clips.filter("length > 0").select(*keys, "clip_id", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("frame_no")).select(*keys, "clip_id", F.lit(1).alias("_part"), F.lit("clip").alias("source"), F.col("frame_no").cast("bigint").alias("frame_no"))
    place = F.row_number().over(Window.partitionBy(*keys, "clip_id").orderBy("_part", "frame_no")) - 1
    return anchors.union(own).withColumn("place", place.cast("bigint")).drop("_part")


def purification(detector: str, cross: str, purity: str, gap: str, conflict: str, retained: str) -> Column:
    """Quality of an observation, each part in 0 to 1: detector 20 %, cross-view 25, purity 20, depth 15, no conflict 10, points retained (full at 70 %) 10."""
    c = lambda n: F.least(F.greatest(F.col(n), F.lit(0.0)), F.lit(1.0))
    return 0.20 * c(detector) + 0.25 * c(cross) + 0.20 * c(purity) + 0.15 * (1 - c(gap)) + 0.10 * (1 - c(conflict)) + 0.10 * F.least(c(retained) / 0.7, F.lit(1.0))


def purification_status(quality: Column, conflict: Column, rejected: Column, kept: Column) -> Column:
    """The five levels of a purified observation."""
    return (
        F.when(kept <= 0, "rejected")
        .when(conflict >= 0.35, "ambiguous")
        .when((quality >= 0.78) & (rejected < 0.10), "high_quality")
        .when((quality >= 0.60) & (rejected < 0.45), "usable")
        .when(quality >= 0.40, "ambiguous")
        .otherwise("contaminated")
    )


def component_reject(conflict: Column, compatible: Column, gap: Column, cross: Column, share: Column, dominant: Column) -> Column:
    """Why a component of an observation is rejected, the first reason that holds; NULL keeps it."""
    return (
        F.when((conflict >= 0.30) & (compatible < 0.10) & (gap >= 0.45), "candidate_conflict")
        .when((conflict >= 0.35) & (cross < 0.35), "semantic_conflict")
        .when((cross < 0.05) & ~dominant & (compatible < 0.20), "unsupported")
        .when((gap >= 0.45) & (cross < 0.35) & (compatible < 0.20), "depth_gap")
        .when((share < 0.005) & (cross < 0.20), "fragment")
    )


#: The nine factors of completeness and their weights.
COMPLETENESS = {"support_views": 0.13, "view_diversity": 0.15, "area_diversity": 0.04, "boundary_stability": 0.22, "semantic_consistency": 0.13, "cross_view": 0.12, "point_support": 0.08, "fragment_consistency": 0.05, "candidate_consistency": 0.08}


def completeness(factors: dict[str, Column]) -> Column:
    """Weighted completeness in 0 to 1 of the nine factors."""
    if set(factors) != set(COMPLETENESS):
        raise ValueError("completeness needs its nine factors: " + ", ".join(COMPLETENESS))
    whole = F.lit(0.0)
    for name, weight in COMPLETENESS.items():
        whole = whole + weight * factors[name]
    return F.least(F.greatest(whole, F.lit(0.0)), F.lit(1.0))
