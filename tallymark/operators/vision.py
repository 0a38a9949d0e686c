"""Relational parts of image evidence; the pixels are read by adapters (see sources.adapters).

regions: scan_id, pos, x, y, w, h, img_w, img_h, gradient_ratio. contours: scan_id, x, y, w, h, vertices,
rectangularity, image_area. tiles: scan_id, tile_x, tile_y, edge_density, residual_median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGIONS_KEPT, BOXES_KEPT, MIN_TILES = 4, 20, 12
ANOMALY = 0.55
#: Share of an image's height below which a region counts as low.
LOWER = 0.45


def barcode_regions(regions: DataFrame) -> DataFrame:
    """Regions shaped like barcodes, the REGIONS_KEPT best of each scan with their score and rank."""
    aspect, area = F.col("w") / F.greatest("h", F.lit(1)), F.col("w") * F.col("h")
    whole = (F.col("w") > 0.9 * F.col("img_w")) & (F.col("h") > 0.5 * F.col("img_h"))
    kept = regions.where((F.col("w") >= 60) & (F.col("h") >= 30) & (area >= 1500) & (aspect >= 1.25) & ~whole & (F.col("gradient_ratio") >= 2.0))
    lower = F.when(F.col("y") > LOWER * F.col("img_h"), 2.0).otherwise(0.0)
    score = F.col("gradient_ratio") + lower + F.least(area / 20000, F.lit(2.0)) + F.least(aspect / 4, F.lit(2.0))
    ranked = kept.withColumn("score", F.bround(score, 6)).withColumn("region_rank", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("score"), "pos")))
    return ranked.where(F.col("region_rank") <= REGIONS_KEPT)


def sticker_boxes(contours: DataFrame) -> DataFrame:
    """Four-cornered contours of a sticker's size."""
    share = F.col("w") * F.col("h") / F.col("image_area")
    return contours.where(share.between(0.004, 0.12) & (F.col("vertices") == 4) & (F.col("rectangularity") > 0.85))


def shown_boxes(contours: DataFrame) -> DataFrame:
    """The sticker boxes that a response lists: the first BOXES_KEPT of each scan in the order found (pos)."""
    ranked = sticker_boxes(contours).withColumn("tm_rank", F.row_number().over(Window.partitionBy("scan_id").orderBy("pos")))
    return ranked.where(F.col("tm_rank") <= BOXES_KEPT).drop("tm_rank")


def noise_spread(tiles: DataFrame) -> DataFrame:
    """scan_id, n_tiles and noise_signal (0 to 1) from the spread of residual levels over smooth tiles; 0 if too few."""
    level = F.col("residual_median")
    smooth = tiles.where((F.col("edge_density") <= 0.08) & (level >= 0.3))
    spread = F.stddev_pop(level) / (F.avg(level) + 1e-6)
    signal = F.least(F.greatest((spread - 0.6) / 1.4, F.lit(0.0)), F.lit(1.0))
    return smooth.groupBy("scan_id").agg(F.count("*").alias("n_tiles"), F.when(F.count("*") >= MIN_TILES, signal).otherwise(0.0).alias("noise_signal"))


def tampering(contours: DataFrame, tiles: DataFrame) -> DataFrame:
    """scan_id, tampering_score, anomaly_detected for scans that have boxes or tiles."""
    boxes = sticker_boxes(contours).groupBy("scan_id").agg(F.count("*").alias("n_boxes"))
    both = boxes.join(noise_spread(tiles), "scan_id", "full_outer")
    score = F.bround(0.5 * F.least(F.coalesce("n_boxes", F.lit(0)) / 3, F.lit(1.0)) + 0.5 * F.coalesce("noise_signal", F.lit(0.0)), 3)
    return both.select("scan_id", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), score.alias("tampering_score"), (score > ANOMALY).alias("anomaly_detected"))


def tampering_evidence(contours: DataFrame, tiles: DataFrame, mode: str, remote: DataFrame | None = None) -> DataFrame:
    """scan_id, tampering_status, tampering_score by mode: "heuristic" scores the features, "remote" takes the scores
    (scan_id, tampering_score) that a remote scorer gave, "disabled" gives none. Scans without a score are unavailable."""
    if mode not in ("heuristic", "remote", "disabled"):
        raise ValueError(f"unknown tampering mode {mode!r}")
    scans = contours.select("scan_id").unionByName(tiles.select("scan_id")).distinct()
    scored = tampering(contours, tiles).select("scan_id", "tampering_score") if mode == "heuristic" else remote if mode == "remote" else None
    if scored is None:
        return scans.select("scan_id", F.lit("unavailable").alias("tampering_status"), F.lit(None).cast("double").alias("tampering_score"))
    both = scans.join(scored, "scan_id", "left")
    if mode == "heuristic":
        both = both.where("tampering_score is not null")  # scans without boxes and smooth tiles have no features
    return both.select("scan_id", F.when(F.col("tampering_score").isNull(), "unavailable").otherwise("success").alias("tampering_status"), "tampering_score")


def resize_factor(height: Column, width: Column, low: int = 800, high: int = 1800) -> Column:
    """The factor that brings the longer side into a range."""
    side = F.greatest(height, width)
    return F.when(side > high, high / side).when(side < low, low / side).otherwise(1.0)


def decoder_regions(images: DataFrame) -> DataFrame:
    """The crops of an image that decoders look at, cut to whole pixels; of an image with a side under 20 only the full one."""
    w, h = F.col("width"), F.col("height")
    box = lambda n, left, right, top: F.struct(F.lit(n).alias("region"), left.alias("x"), top.alias("y"), (right - left).alias("w"), (h - top).alias("h"))
    at = lambda c, share: F.floor(c * F.lit(share)).cast("int")
    zero = F.lit(0)
    # The crops.
    parts = [box("lower_60", zero, w, at(h, 0.40)), box("lower_40", zero, w, at(h, 0.60)), box("lower_left", at(w, 0.05), at(w, 0.65), at(h, 0.45))]
    full = F.array(box("full", zero, w, zero))
    return images.select("scan_id", F.inline(F.when(F.least(w, h) < 20, full).otherwise(F.concat(full, F.array(*parts)))))
