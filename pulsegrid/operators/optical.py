"""Pixel reduction, optical descriptors and block-frozen patch weights."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_PIXELS = 4


def skin_gate(r: Column, g: Column, b: Column) -> Column:
    """Experimental chroma gate on 8-bit YCrCb (14-bit fixed-point conversion)."""
    # Fixed values of the conversion: 0.299, 0.587, 0.114, 0.713 and 0.564 times 16384; gates 133-173 and 77-127.
    r, g, b = [F.bround(c, 0).cast("long") for c in (r, g, b)]
    y = F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)
    cr = F.shiftright((r - y) * 11682 + (128 << 14) + 8192, 14)
    cb = F.shiftright((b - y) * 9241 + (128 << 14) + 8192, 14)
    return cr.between(133, 173) & cb.between(77, 127)


def patch_id(df: DataFrame, keys: list[str]) -> DataFrame:
    """2 x 3 cell of each pixel inside its mask's bounding box (an image is a bounded group)."""
    w = Window.partitionBy(*keys)
    y0, y1 = F.min("y").over(w), F.max("y").over(w) + 1
    x0, x1 = F.min("x").over(w), F.max("x").over(w) + 1

    def cell(v, lo, hi, parts):
        edges = [F.floor(lo + (hi - lo) * k / parts) for k in range(1, parts)]
        return sum((v >= e).cast("int") for e in edges)

    return df.withColumn("patch", cell(F.col("y"), y0, y1, 2) * 3 + cell(F.col("x"), x0, x1, 3))


def descriptors(pixels: DataFrame, keys: list[str], min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Mean colour and label-free descriptors per frame and region (or patch); missing below ``min_pixels``."""
    ok = F.coalesce(F.greatest("r", "g", "b") <= 255, F.lit(False)) & F.coalesce(F.least("r", "g", "b") >= 0, F.lit(False))
    total = F.greatest(F.col("r") + F.col("g") + F.col("b"), F.lit(1e-8))
    p = pixels.withColumn("ok", ok)
    for c in "rgb":
        p = p.withColumn(f"c{c}", F.when(F.col("ok"), F.col(c) / total))
    clipped = (F.least("r", "g", "b") <= 1) | (F.greatest("r", "g", "b") >= 254)
    one = lambda c: F.when(F.col("ok"), c)
    skin = skin_gate(F.col("r"), F.col("g"), F.col("b"))
    first = p.groupBy(*keys).agg(
        F.count_if("ok").alias("pixel_count"), F.avg(F.col("ok").cast("double")).alias("finite_fraction"),
        *[F.avg(one(F.col(c))).alias(c) for c in "rgb"], F.avg(one(clipped.cast("double"))).alias("clipped_fraction"),
        F.avg(one(skin.cast("double"))).alias("chroma_compatible_fraction"),
        (F.avg(one((F.col("r") + F.col("g") + F.col("b")) / 3)) / 255).alias("brightness"),
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), *[F.median(f"c{c}").alias(f"m{c}") for c in "rgb"])
    dev = sum(F.abs(F.col(f"c{c}") - F.col(f"m{c}")) for c in "rgb") / 3
    mad = p.select(*keys, "cr", "cg", "cb").join(first.select(*keys, "mr", "mg", "mb"), keys).groupBy(*keys).agg(F.median(dev).alias("spatial_chroma_mad"))
    d = first.drop("mr", "mg", "mb").join(mad, keys)
    enough = F.col("pixel_count") >= min_pixels
    for c in ("r", "g", "b", "clipped_fraction", "chroma_compatible_fraction", "brightness", "spatial_chroma_mad"):
        d = d.withColumn(c, F.when(enough, F.col(c)))
    return d.withColumn("valid", enough)


def patch_weights(patches: DataFrame, roi: DataFrame, evidence: DataFrame | None, keys: list[str], support: float = .95, chroma: float = .5,
                  clip: float = .05, floor: float = .5, least: int = 2) -> DataFrame:
    """Weights per (region, block, patch), with the reason a whole region abstains.

    ``patches`` and ``roi`` hold per-frame descriptors with a ``block`` column; a
    block holds a fixed number of frames, so its medians are bounded.
    """
    b = [*keys, "block"]
    p = patches.groupBy(*b, "patch").agg(F.avg(F.col("valid").cast("double")).alias("support"), F.median("chroma_compatible_fraction").alias("skin"),
                                         F.median("clipped_fraction").alias("clipped"))
    good = F.coalesce((F.col("support") >= support) & (F.col("skin") >= chroma) & (F.col("clipped") <= clip), F.lit(False))
    p = p.withColumns({"eligible": good, "score": F.when(good, F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col("skin") * (1 - F.col("clipped")))))})
    r = roi.groupBy(*b).agg(F.median("chroma_compatible_fraction").alias("proxy"))
    p = p.join(r, b)
    if evidence is not None:
        p = p.join(evidence, b, "left")
    else:
        p = p.withColumn("state", F.lit("unknown"))
    state = F.coalesce("state", F.lit("unknown"))
    w = Window.partitionBy(*b)                      # at most six patches
    p = p.withColumns({"n_eligible": F.count_if("eligible").over(w), "total": F.sum("score").over(w)})
    reason = F.when(F.col("proxy").isNull(), "ABSTAIN_NO_ACQUISITION").when(F.col("proxy") < chroma, "ABSTAIN_WHOLE_ROI_LOW_SKIN_PROXY") \
        .when(state == "verified_non_skin_or_occluded", "ABSTAIN_WHOLE_ROI_INDEPENDENT_OCCLUSION") \
        .when(F.col("n_eligible") < least, "ABSTAIN_TOO_FEW_ELIGIBLE_PATCHES") \
        .when(state == "verified_skin", "ENGINEERING_WITH_INDEPENDENT_SKIN_EVIDENCE").otherwise("ABSTAIN_SKIN_UNVERIFIED")
    used = reason.isin("ENGINEERING_WITH_INDEPENDENT_SKIN_EVIDENCE", "ABSTAIN_SKIN_UNVERIFIED") & F.col("eligible")
    return p.withColumns({"reason": reason, "weight": F.when(used, F.col("score") / F.col("total")).otherwise(0.0)}).drop("total", "n_eligible")


def patch_mix(patches: DataFrame, weights: DataFrame, keys: list[str], clip: float = .05) -> DataFrame:
    """Weighted colour per frame; one unavailable or clipped weighted patch makes the frame missing, never renormalized."""
    j = weights.where("weight > 0").select(*keys, "block", "patch", "weight").join(
        patches.select(*keys, "block", "frame", "patch", "valid", "clipped_fraction", "r", "g", "b"), [*keys, "block", "patch"])
    need = weights.where("weight > 0").groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("need"))
    ok = F.col("valid") & F.coalesce(F.col("clipped_fraction") <= clip, F.lit(False))
    m = j.groupBy(*keys, "block", "frame").agg(F.count_if(ok).alias("n"), *[F.sum(F.when(ok, F.col("weight") * F.col(c))).alias(c) for c in "rgb"])
    m = m.join(need, [*keys, "block"]).withColumn("available", F.col("n") == F.col("need"))
    return m.select(*keys, "block", "frame", "available", *[F.when(F.col("available"), F.col(c)).alias(c) for c in "rgb"])
