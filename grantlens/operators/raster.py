"""Raster statistics over a pixel table (image_id, x, y, lum).

Statistics are plain aggregates by image, so partial sums do most of the work before the
shuffle. Neighbour terms come from a stencil: each pixel sends its value to the cells it
touches and the cells sum up what they receive. One huge image spreads over all tasks,
since the key is the cell and not the image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grantlens.functions.banding import js_round

# Luminance weights, kernels, thresholds and scores.
RED, GREEN, BLUE = 0.299, 0.587, 0.114
LAPLACIAN = {(0, 0): -4.0, (1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}
UNSHARP = {(0, 0): 3.4, (1, 0): -0.6, (-1, 0): -0.6, (0, 1): -0.6, (0, -1): -0.6}
OTSU_DEFAULT, OTSU_LOW, OTSU_HIGH = 128, 60, 200
LARGE_IMAGE, LARGE_STEP = 1_000_000, 2
GRID, GRID_STEP, BACKGROUND_FLOOR, BACKGROUND_TARGET = 40, 4, 15, 200


def luminance(r: Column, g: Column, b: Column) -> Column:
    return js_round(F.round(r * RED + g * GREEN + b * BLUE, 6)).cast("int")


def to_luminance(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("lum", luminance(F.col("r"), F.col("g"), F.col("b"))).drop("r", "g", "b")


def clamp(value: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def luminance_stats(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Size, mean and population deviation per image, from exact integer sums."""
    s = pixels.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("lum").alias("s"), F.sum(F.col("lum") * F.col("lum")).alias("ss"),
                                (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)
    return s.select(key, "n", "width", "height", mean.alias("mean_lum"), F.sqrt(variance).alias("std_lum"))


def stencil(pixels: DataFrame, kernel: dict, key: str = "image_id") -> DataFrame:
    """Weighted sum of neighbours per cell, with the number of neighbours that exist."""
    sent = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("lum") * w).alias("v"),
                              F.lit(dx == 0 and dy == 0).alias("own")) for (dx, dy), w in kernel.items()])
    spread = pixels.select(key, "lum", F.explode(sent).alias("t")).select(key, "t.x", "t.y", "t.v", F.when(F.col("t.own"), F.col("lum")).alias("own"))
    return spread.groupBy(key, "x", "y").agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("n_terms"), F.max("own").alias("lum")).filter("lum is not null")


def laplacian_variance(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Population variance of the Laplacian over interior pixels; every second row and column on large images."""
    sizes = pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    inner = stencil(pixels, LAPLACIAN, key).filter(F.col("n_terms") == len(LAPLACIAN)).join(sizes, key)
    step = F.when(F.col("w") * F.col("h") > LARGE_IMAGE, LARGE_STEP).otherwise(1)
    used = inner.filter(((F.col("x") - 1) % step == 0) & ((F.col("y") - 1) % step == 0))
    stats = used.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)
    return sizes.join(stats.select(key, variance.alias("v")), key, "left").select(key, F.coalesce("v", F.lit(0.0)).alias("laplacian_var"))


def otsu_threshold(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Threshold of greatest between-class variance, first one on ties.

    The histogram (at most 256 counts per image) is all that is shuffled and scanned.
    """
    hist = pixels.groupBy(key, "lum").agg(F.count(F.lit(1)).alias("n"))
    bins = hist.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lum", "n"))).alias("bins"), F.sum("n").alias("total"), F.sum(F.col("lum") * F.col("n")).alias("mass"))
    start = F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("s"), F.lit(0.0).alias("best"), F.lit(OTSU_DEFAULT).alias("t"))

    def step(acc: Column, bin_: Column) -> Column:
        w, s = acc.getField("w") + bin_.getField("n"), acc.getField("s") + bin_.getField("lum") * bin_.getField("n")
        rest = F.col("total") - w
        gap = s / w - (F.col("mass") - s) / rest
        between = F.when(rest > 0, F.round(w.cast("double") * rest * gap * gap, 6))
        better = F.coalesce(between > acc.getField("best"), F.lit(False))
        return F.struct(w.alias("w"), s.alias("s"), F.when(better, between).otherwise(acc.getField("best")).alias("best"),
                        F.when(better, bin_.getField("lum")).otherwise(acc.getField("t")).alias("t"))

    return bins.select(key, clamp(F.aggregate("bins", start, step, lambda a: a.getField("t")), OTSU_LOW, OTSU_HIGH).alias("threshold"))


def quality_score(pixels: DataFrame, key: str = "image_id", dimensions: DataFrame | None = None) -> DataFrame:
    """I4: four scores, level, issue and warning codes per image; `dimensions` gives true source sizes."""
    stats = luminance_stats(pixels, key).join(laplacian_variance(pixels, key), key)
    if dimensions is not None:
        stats = stats.drop("width", "height").join(dimensions.select(key, "width", "height"), key)
    return score_metrics(stats, key)


def score_metrics(stats: DataFrame, key: str = "image_id") -> DataFrame:
    """I4 over metrics that are already known: width, height, mean_lum, std_lum, laplacian_var."""
    w, h, area = F.col("width"), F.col("height"), F.col("width") * F.col("height")
    mean, std, lap = F.col("mean_lum"), F.col("std_lum"), F.col("laplacian_var")
    tiny, small = (w < 400) | (h < 400) | (area < 200_000), (F.least(w, h) < 600) | (area < 500_000)
    scaled = lambda v, top: F.least(F.lit(100).cast("bigint"), js_round(v / top * 100))
    scored = stats.withColumns({
        "resolution_score": F.when(tiny, 30).when(small, 65).when(area >= 1_000_000, 100).otherwise(scaled(area, 1_000_000)),
        "brightness_score": F.when(mean < 45, 30).when(mean < 75, 60).when(mean > 250, 40).when(mean > 242, 75).otherwise(100),
        "contrast_score": F.when(std < 15, 20).when(std < 28, 55).otherwise(scaled(std, 60)),
        "sharpness_score": F.when(lap < 40, 25).when(lap < 100, 60).otherwise(scaled(lap, 250)),
        "issues": F.array_compact(F.array(F.when(tiny, "resolution"), F.when(mean < 45, "dark").when(mean > 250, "washed_out"), F.when(std < 15, "flat"), F.when(lap < 40, "blurry"))),
        "warnings": F.array_compact(F.array(
            F.when(~tiny & small, "resolution"), F.when((mean >= 45) & (mean < 75), "dark").when((mean > 242) & (mean <= 250), "bright"),
            F.when((std >= 15) & (std < 28), "low_contrast"), F.when((lap >= 40) & (lap < 100), "mild_blur"))),
    })
    poor = (F.size("issues") > 0) | (F.col("contrast_score") < 30)
    fair = (F.size("warnings") > 0) | (F.col("resolution_score") < 70) | (F.col("sharpness_score") < 70) | (F.col("brightness_score") < 70) | (F.col("contrast_score") < 60)
    level = F.when(poor, "poor").when(fair, "fair").otherwise("good")
    out = scored.withColumn("level", level)
    return out.withColumn("is_usable", (F.col("level") != "poor") | (F.size("issues") <= 1)).select(
        key, "width", "height", "mean_lum", "std_lum", "laplacian_var", "resolution_score", "brightness_score", "contrast_score", "sharpness_score",
        "level", "issues", "warnings", "is_usable")


def quality_gate(quality: DataFrame, key: str = "image_id") -> DataFrame:
    """REJECT / WARN / PASS with reasons; `text_length` and `engine_conf` are used where present."""
    has = lambda c: c in quality.columns
    mean, std, lap = js_round(F.col("mean_lum")), js_round(F.col("std_lum")), js_round(F.col("laplacian_var"))
    unread = F.lit(False)
    doubtful = F.lit(False)
    if has("text_length") and has("engine_conf"):
        unread = (F.col("text_length") < 15) & (F.coalesce("engine_conf", F.lit(0.0)) < 30)
        doubtful = F.coalesce(F.col("engine_conf") < 25, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when((F.col("resolution_score") < 35) | (F.col("width") < 350), "low resolution"), F.when((F.col("sharpness_score") < 30) | (lap < 30), "blurry"),
        F.when(mean < 40, "too dark"), F.when(mean > 252, "washed out / overexposed"), F.when((F.col("contrast_score") < 20) | (std < 12), "low contrast / blank page"),
        F.when(unread, "text not readable"), F.when(doubtful, "low OCR confidence")))
    named = lambda r: F.array_contains("reasons", r)
    severe = (F.size("reasons") >= 2) | named("text not readable") | named("low contrast / blank page") | (named("blurry") & named("low resolution"))
    return quality.withColumn("reasons", reasons).withColumn(
        "gate", F.when(severe, "REJECT").when((F.size("reasons") > 0) | (F.col("level") == "fair"), "WARN").otherwise("PASS"))


def quality_recheck(before: DataFrame, after: DataFrame, key: str = "image_id") -> DataFrame:
    """Whether enhancement recovered an image and whether its fields may be trusted."""
    joined = before.select(key, F.col("level").alias("level_before")).join(after.select(key, F.col("level").alias("level_after")), key)
    recovered = (F.col("level_after") == "good") | ((F.col("level_before") == "poor") & (F.col("level_after") == "fair"))
    return joined.withColumns({"recovered": recovered, "is_trusted": recovered | (F.col("level_after") != "poor")})


def stretch_parameters(quality: DataFrame, key: str = "image_id") -> DataFrame:
    """Factor and shift of the contrast stretch, by the first applying quality flag."""
    dark, washed, low = F.col("brightness_score") < 60, js_round(F.col("mean_lum")) > 220, F.col("contrast_score") < 50
    return quality.select(key, F.when(dark, 1.30).when(washed, 1.40).when(low, 1.35).otherwise(1.20).alias("factor"),
                          F.when(dark, 20).when(washed, -15).otherwise(0).alias("shift"))


def contrast_stretch(pixels: DataFrame, parameters: DataFrame, key: str = "image_id") -> DataFrame:
    """I7."""
    value = (F.col("lum") - 128) * F.col("factor") + 128 + F.col("shift")
    return pixels.join(parameters, key).select(key, "x", "y", js_round(F.round(clamp(value), 6)).cast("int").alias("lum"))


def illumination_normalize(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """I8: divide by the mean of each 40×40 cell, sampled every fourth pixel."""
    cell = [F.floor(F.col("x") / GRID).alias("gx"), F.floor(F.col("y") / GRID).alias("gy")]
    sampled = pixels.filter((F.col("x") % GRID % GRID_STEP == 0) & (F.col("y") % GRID % GRID_STEP == 0))
    background = sampled.groupBy(key, *cell).agg(F.avg("lum").alias("bg"))
    joined = pixels.withColumns({"gx": F.floor(F.col("x") / GRID), "gy": F.floor(F.col("y") / GRID)}).join(background, [key, "gx", "gy"])
    value = F.col("lum") / F.greatest(F.lit(float(BACKGROUND_FLOOR)), F.col("bg")) * BACKGROUND_TARGET
    return joined.select(key, "x", "y", clamp(js_round(F.round(value, 6))).cast("int").alias("lum"))


def binarize(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Black below the image's threshold, white from it on."""
    return pixels.join(otsu_threshold(pixels, key), key).select(key, "x", "y", F.when(F.col("lum") < F.col("threshold"), 0).otherwise(255).alias("lum"))


def convolve3x3(pixels: DataFrame, kernel: dict | None = None, key: str = "image_id", min_side: int = 100) -> DataFrame:
    """Filtered interior, unchanged border; images below `min_side` stay as they are."""
    kernel = UNSHARP if kernel is None else kernel
    sizes = pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    summed = stencil(pixels, kernel, key).join(sizes, key)
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    filtered = (F.col("w") >= min_side) & (F.col("h") >= min_side) & ~edge
    return summed.select(key, "x", "y", F.when(filtered, clamp(js_round(F.round("value", 6))).cast("int")).otherwise(F.col("lum")).alias("lum"))


def choose_profile(quality: DataFrame, key: str = "image_id") -> DataFrame:
    """The single most useful preprocessing profile."""
    mean = js_round(F.col("mean_lum"))
    return quality.select(key, F.when(F.col("sharpness_score") < 60, "sharpened").when((mean < 60) | (F.col("contrast_score") < 50), "contrast")
                          .when(mean > 220, "binarized").otherwise("contrast").alias("profile"))
