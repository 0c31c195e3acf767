"""Places on pages and in files: page geometry, boxes, tiles, locators, years in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least width, height and area of an image that carries meaning; least overlap with a caption and greatest distance to it.
IMAGE_WIDTH, IMAGE_HEIGHT, IMAGE_AREA, CAPTION_OVERLAP, CAPTION_DISTANCE = 0.04, 0.03, 0.003, 0.15, 0.2
# The spans of the four overlapping crops of a page.
CROPS = [(0.0, 0.55), (0.45, 1.0)]


def shown_point(x: Column, y: Column, crop: Column, rotation: Column) -> Column:
    """A point of the page's own space as it is shown, in points from the lower left of the turned crop box."""
    u, v, w, h = x - crop["x0"], y - crop["y0"], crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    r = F.pmod(rotation, F.lit(360))
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(r == 0, at(u, v)).when(r == 90, at(v, w - u)).when(r == 180, at(w - u, h - v)).when(r == 270, at(h - v, u))


def shown_box(box: Column, crop: Column, rotation: Column) -> Column:
    """A box of the page's own space as shares of the shown page, clipped to it."""
    a, b = shown_point(box["x0"], box["y0"], crop, rotation), shown_point(box["x1"], box["y1"], crop, rotation)
    turned = F.pmod(rotation, F.lit(180)) == 90
    w, h = crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    width, height = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    clip = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    return F.struct(
        clip(F.least(a["x"], b["x"]) / width).alias("x0"),
        clip(F.least(a["y"], b["y"]) / height).alias("y0"),
        clip(F.greatest(a["x"], b["x"]) / width).alias("x1"),
        clip(F.greatest(a["y"], b["y"]) / height).alias("y1"),
    )


def raster_box(box: Column, width: Column, height: Column) -> Column:
    """A pixel box from the upper left as shares from the lower left."""
    clip = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    return F.struct(clip(box["x0"] / width).alias("x0"), clip(1 - box["y1"] / height).alias("y0"), clip(box["x1"] / width).alias("x1"), clip(1 - box["y0"] / height).alias("y1"))


def meaningful_image(box: Column) -> Column:
    w, h = F.greatest(F.lit(0.0), box["x1"] - box["x0"]), F.greatest(F.lit(0.0), box["y1"] - box["y0"])
    return F.coalesce((w >= IMAGE_WIDTH) & (h >= IMAGE_HEIGHT) & (w * h >= IMAGE_AREA), F.lit(False))


def caption_distance(image: Column, caption: Column) -> Column:
    """Vertical distance of an image and a caption that lie one above the other; null where they overlap too little sideways or lie too far apart."""
    overlap = F.greatest(F.lit(0.0), F.least(image["x1"], caption["x1"]) - F.greatest(image["x0"], caption["x0"]))
    narrower = F.least(image["x1"] - image["x0"], caption["x1"] - caption["x0"])
    d = F.when(image["y1"] < caption["y0"], caption["y0"] - image["y1"]).when(caption["y1"] < image["y0"], image["y0"] - caption["y1"]).otherwise(0.0)
    return F.when((narrower > 0) & (overlap / narrower >= CAPTION_OVERLAP) & (d <= CAPTION_DISTANCE), d)


def page_tiles(width: Column, height: Column) -> Column:
    """The whole page and four overlapping crops, in pixels; edges are taken outwards."""
    tile = lambda view, x0, y0, x1, y1: F.struct(F.lit(view).alias("view"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    low = lambda n, s: F.floor(n * s).cast("int")
    high = lambda n, s: F.least(n, F.floor(n * s + 0.5).cast("int"))
    crops = [tile(f"crop{2 * j + i + 1}", low(width, x[0]), low(height, y[0]), high(width, x[1]), high(height, y[1])) for j, y in enumerate(CROPS) for i, x in enumerate(CROPS)]
    return F.array(tile("overview", F.lit(0), F.lit(0), width, height), *crops)


def safe_locator(path: Column) -> Column:
    """A relative path that stays below its folder, whichever slash it uses."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~(path.contains("://") | p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), ".."))


def year_in_text(year: Column, text: Column) -> Column:
    """Whether a text names the year outside DOIs and addresses; white space between its digits is allowed, further digits beside it are not."""
    t = F.regexp_replace(text, r"(?im)\bdoi\s*[:：][^\n]*", "")
    t = F.regexp_replace(t, r"(?i)https?://\S+|10\s*\.\s*[0-9]{4,9}\s*/[^\n]+", "")
    spaced = F.concat(F.lit("(?<![0-9])"), F.array_join(F.split(year.cast("string"), ""), r"\s*"), F.lit("(?![0-9])"))
    return F.coalesce((year != 0) & F.regexp_like(t, spaced), F.lit(False))


def contains_run(have: Column, want: Column) -> Column:
    """Whether ``want`` stands in ``have`` as one unbroken run."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(have) - F.size(want) + 1, F.lit(1)))
    return (F.size(want) <= F.size(have)) & ((F.size(want) == 0) | F.exists(starts, lambda i: F.slice(have, i, F.size(want)) == want))
