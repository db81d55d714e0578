"""Measuring and routing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import KINDS, Routing


def grid_coverage(rects: DataFrame, keys: list[str], width: str = "width", height: str = "height", grid: int = 48) -> DataFrame:
    """Share of a page's grid cells that its rectangles (x0, y0, x1, y1, clipped to the page) touch, overlaps once.

    A rectangle becomes one row per touched grid row with the span of its cells, and the spans of one grid row are
    merged by a running maximum, so a full-page picture costs 48 rows and not 2,304.
    """
    from pyspark.sql import Window

    cell_w, cell_h = F.col(width) / grid, F.col(height) / grid
    x0, y0 = F.greatest("x0", F.lit(0.0)), F.greatest("y0", F.lit(0.0))
    x1, y1 = F.least("x1", F.col(width)), F.least("y1", F.col(height))
    cell = lambda v, size: F.floor(v / size).cast("int")
    clipped = rects.where((x0 < x1) & (y0 < y1) & (cell_w > 0) & (cell_h > 0)).select(
        *keys, F.greatest(F.lit(0), cell(x0, cell_w)).alias("c0"), F.least(F.lit(grid - 1), cell(x1 - 1e-6, cell_w)).alias("c1"),
        F.explode(F.sequence(F.greatest(F.lit(0), cell(y0, cell_h)), F.least(F.lit(grid - 1), cell(y1 - 1e-6, cell_h)))).alias("row"),
    )
    before = Window.partitionBy(*keys, "row").orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("c1") - F.greatest(F.col("c0") - 1, F.coalesce(F.max("c1").over(before), F.lit(-1))))
    filled = clipped.withColumn("n", fresh).groupBy(*keys).agg(F.sum("n").alias("filled"))
    pages = rects.select(*keys).distinct()
    return pages.join(filled, keys, "left").select(*keys, (F.coalesce("filled", F.lit(0)) / float(grid * grid)).alias("coverage"))


def page_images(images: DataFrame, keys: list[str], cfg: Routing = Routing()) -> DataFrame:
    """Per page: real and decorative pictures, the resolution of the largest, whether one fills the page.

    images: keys, width, height, x0, y0, x1, y1, px_w, px_h.
    """
    small = (F.col("px_w") < cfg.least_pixels) | (F.col("px_h") < cfg.least_pixels)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    seen = F.greatest(F.least("x1", "width") - F.greatest("x0", F.lit(0.0)), F.lit(0.0)) * F.greatest(F.least("y1", "height") - F.greatest("y0", F.lit(0.0)), F.lit(0.0))
    dpi = F.col("px_w") / ((F.col("x1") - F.col("x0")) / 72.0)
    wide = ~small & (F.col("x1") - F.col("x0") > 1)
    return images.groupBy(*keys).agg(
        F.count_if(~small).alias("image_count"), F.count_if(small).alias("decorative_image_count"),
        F.coalesce(F.round(F.max_by(F.when(wide, dpi), F.when(wide, F.struct(area, -F.col("x0"), -F.col("y0")))), 1), F.lit(0.0)).alias("raster_dpi"),
        F.coalesce(F.bool_or(~small & (seen / (F.col("width") * F.col("height")) >= cfg.full_page)), F.lit(False)).alias("has_full_page_raster"),
    )


def effective_dpi(native: Column, requested: int = 300, least: int = 150) -> Column:
    """Never over the picture's own resolution, never under ``least``; unknown: as requested."""
    return F.when(native.isNull() | (native <= 0), F.lit(requested)).otherwise(F.greatest(F.lit(least), F.least(F.lit(requested), F.bround(native).cast("int"))))


def table_likeness(rules: Column, repeated_columns: Column) -> Column:
    """0 to 1 from the number of ruled lines and of left edges that three blocks share."""
    import math

    lines = F.least(F.lit(1.0), F.log1p(rules) / math.log(60))
    return F.round(0.6 * lines + 0.4 * F.least(F.lit(1.0), repeated_columns / 5.0), 3)


def route(density: Column, raster: Column, garble: Column, full_page: Column, tables: Column, cfg: Routing = Routing()) -> Column:
    """kind, strategy, has_prior_text, the number of the first rule that holds, and its reason in words."""
    sparse, rastered, garbled, has_text = density < cfg.scan_density, raster >= cfg.raster_share, garble >= cfg.garble, density >= cfg.text_density
    rules = [
        (~has_text & ~rastered, "empty", "skip", F.lit(False), "1"),
        (full_page & has_text & F.lit(cfg.trust_prior_ocr), "digital", "text-layer", F.lit(True), "2a"),
        (full_page, "scanned", "ocr", has_text, "2b"),
        (garbled, "scanned", "ocr", F.lit(True), "3"),
        (sparse & rastered, "scanned", "ocr", F.lit(False), "4"),
        (sparse, "scanned", "ocr", F.lit(False), "5"),
        (rastered, "hybrid", "both", F.lit(False), "6"),
        (tables > 0, "digital", "ocr", F.lit(False), "7"),
        (F.lit(True), "digital", "text-layer", F.lit(False), "8"),
    ]
    share = lambda c: F.format_string("%.0f %%", c * 100)
    why = {
        "1": F.lit("no text and no picture"), "2a": F.lit("a scan with a text layer that is trusted"), "2b": F.lit("one picture covers the page"),
        "3": F.concat(F.lit("text reads as noise in "), share(garble)), "4": F.concat(F.lit("little text, pictures on "), share(raster)), "5": F.lit("little text"),
        "6": F.concat(F.lit("text and pictures on "), share(raster)), "7": F.concat(F.lit("holds "), tables.cast("string"), F.when(tables == 1, " table").otherwise(" tables")), "8": F.lit("dense text"),
    }
    out = None
    for holds, kind, strategy, prior, rule in reversed(rules):
        value = F.struct(F.lit(kind).alias("kind"), F.lit(strategy).alias("strategy"), prior.alias("has_prior_text"), F.lit(rule).alias("rule"), why[rule].alias("reason"))
        out = value if out is None else F.when(holds, value).otherwise(out)
    return out


def kind_counts(pages: DataFrame, key: str) -> DataFrame:
    """Pages of each kind per document, zeros filled, with those that need OCR."""
    return (
        pages.groupBy(key)
        .agg(F.count("*").alias("pages"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
        .withColumn("ocr_pages", F.col("scanned") + F.col("hybrid"))
    )


def dominant_kind(counts: DataFrame, key: str) -> DataFrame:
    """The most frequent kind that is not empty; the first named on ties; else ``empty``."""
    most = F.greatest(*(F.col(k) for k in KINDS[:-1]))
    choice = F.lit(KINDS[-1])
    for k in reversed(KINDS[:-1]):
        choice = F.when((F.col(k) == most) & (most > 0), k).otherwise(choice)
    return counts.select(key, choice.alias("dominant"))


def bench_scores(pages: DataFrame) -> DataFrame:
    """How well each page stands for five kinds of page (density, raster, dpi, garble, kind, table score given)."""
    d, r, dpi = F.col("char_density"), F.col("raster_coverage"), F.col("raster_dpi")
    one = lambda c: F.least(c, F.lit(1.0))
    return pages.withColumns({
        "clean_digital": F.when((F.col("kind") != "digital") | (F.col("garble") > 0), 0.0).otherwise(one(d / 32.0) * (1 - r)),
        "full_scan": F.when((F.col("kind") != "scanned") | ~F.col("has_full_page_raster"), 0.0).otherwise(r * F.when(dpi > 0, one(dpi / 300.0)).otherwise(0.3)),
        "mixed": F.when((r < 0.03) | (d < 8), 0.0).otherwise(F.least(one(d / 30.0), one(r * 3.0))),
        "dense_table": F.when(F.col("kind") == "empty", 0.0).otherwise(F.col("table_score") * (0.7 + 0.3 * one(d / 30.0))),
        "poor_scan": F.when(~F.col("kind").isin("scanned", "hybrid") | (dpi <= 0) | (dpi >= 250), 0.0).otherwise((250.0 - dpi) / 250.0 * one(r * 1.5)),
    })


def bench_picks(scored: DataFrame, key: str = "doc", page: str = "page") -> DataFrame:
    """One page per kind, hardest kind first, from a document not taken yet if one scores at all.

    Five kinds: the five best documents of each settle every choice, so at most 25 small rows reach the driver.
    """
    order = ("poor_scan", "mixed", "full_scan", "dense_table", "clean_digital")
    spark, used, picks = scored.sparkSession, set(), []
    for kind in order:
        per_doc = scored.where(F.col(kind) > 0).groupBy(key).agg(F.max(F.struct(F.col(kind).alias("s"), (-F.col(page)).alias("p"))).alias("best"))
        best = per_doc.orderBy(F.desc("best.s"), key).limit(len(order)).collect()
        chosen = next((r for r in best if r[key] not in used), best[0] if best else None)
        if chosen is not None:
            used.add(chosen[key])
            picks.append((kind, chosen[key], -chosen.best.p, round(chosen.best.s, 3)))
    return spark.createDataFrame(picks, f"category string, {key} string, {page} long, score double")


def char_density(chars: Column, width: Column, height: Column) -> Column:
    """Characters per square inch of a page measured in points; 0 for a page without area."""
    area = width * height / (72.0 * 72.0)
    return F.when(area > 0, chars / area).otherwise(0.0)
