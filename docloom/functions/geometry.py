"""Boxes as four double columns x0, y0, x1, y1; every function is a Column expression.

A box is named by a prefix of its columns, so that joins carry two boxes side by side. Areas of
nothing give 0, never a division error. Null coordinates give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + s) for s in SIDES]


def renamed(df, prefix: str, keep: tuple[str, ...] = ()):
    """df with all columns but `keep` prefixed."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def width(p: str = "") -> Column:
    return F.col(p + "x1") - F.col(p + "x0")


def height(p: str = "") -> Column:
    return F.col(p + "y1") - F.col(p + "y0")


def area(p: str = "") -> Column:
    return F.greatest(width(p), F.lit(0.0)) * F.greatest(height(p), F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(a + "x1"), F.col(b + "x1")) - F.greatest(F.col(a + "x0"), F.col(b + "x0"))
    h = F.least(F.col(a + "y1"), F.col(b + "y1")) - F.greatest(F.col(a + "y0"), F.col(b + "y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.when(whole.isNotNull() & part.isNotNull(), 0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union; touching boxes have 0."""
    both = intersection(a, b)
    return _share(both, area(a) + area(b) - both)


def contained(inner: str, outer: str) -> Column:
    """Share of the inner box that lies in the outer one."""
    return _share(intersection(inner, outer), area(inner))


def gap(a: str, b: str) -> Column:
    """Distance of two boxes, 0 where they overlap."""
    dx = F.greatest(F.col(a + "x0") - F.col(b + "x1"), F.col(b + "x0") - F.col(a + "x1"), F.lit(0.0))
    dy = F.greatest(F.col(a + "y0") - F.col(b + "y1"), F.col(b + "y0") - F.col(a + "y1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def clamped(page_width: float, page_height: float, p: str = "") -> dict[str, Column]:
    """The box within a page, at least one unit wide and high."""
    x0 = F.greatest(F.lit(0.0), F.least(F.col(p + "x0"), F.lit(page_width - 1)))
    y0 = F.greatest(F.lit(0.0), F.least(F.col(p + "y0"), F.lit(page_height - 1)))
    return {
        p + "x0": x0, p + "y0": y0,
        p + "x1": F.greatest(x0 + 1, F.least(F.col(p + "x1"), F.lit(page_width))), p + "y1": F.greatest(y0 + 1, F.least(F.col(p + "y1"), F.lit(page_height))),
    }


def scaled(factor: float, p: str = "") -> dict[str, Column]:
    """Image pixels to page units: divided by dpi / 72."""
    return {p + s: F.col(p + s) / factor for s in SIDES}


def cell_to_page(crop: str, image_width: Column, image_height: Column, offset_x: Column, offset_y: Column, p: str = "") -> dict[str, Column]:
    """A cell in pixels of a crop's image to page units; offset: the crop image's padding."""
    sx, sy = width(crop) / image_width, height(crop) / image_height
    return {
        p + "x0": F.col(crop + "x0") + (F.col(p + "x0") - offset_x) * sx, p + "y0": F.col(crop + "y0") + (F.col(p + "y0") - offset_y) * sy,
        p + "x1": F.col(crop + "x0") + (F.col(p + "x1") - offset_x) * sx, p + "y1": F.col(crop + "y0") + (F.col(p + "y1") - offset_y) * sy,
    }


def thousandths(page_width: float, page_height: float, p: str = "") -> dict[str, Column]:
    """Page units to whole thousandths of the page, fractions cut off."""
    size = {"x": page_width, "y": page_height}
    return {p + s: (F.col(p + s) / size[s[0]] * 1000).cast("int") for s in SIDES}


def from_thousandths(page_width: float, page_height: float, p: str = "") -> dict[str, Column]:
    size = {"x": page_width, "y": page_height}
    return {p + s: (F.col(p + s) / 1000 * size[s[0]]).cast("int") for s in SIDES}


def letterbox(target: float, image_width: Column, image_height: Column) -> tuple[Column, Column, Column]:
    """Scale, and the new whole width and height, of an image fitted into a square."""
    scale = F.least(F.lit(target) / image_width, F.lit(target) / image_height)
    return scale, (image_width * scale).cast("int"), (image_height * scale).cast("int")


def unletterboxed(scale: Column, pad_x: Column, pad_y: Column, p: str = "") -> dict[str, Column]:
    return {p + s: (F.col(p + s) - (pad_x if s[0] == "x" else pad_y)) / scale for s in SIDES}


def padded(share: float, least: float, page_width: float, page_height: float, p: str = "") -> dict[str, Column]:
    """The box grown on each side by a share of its size or `least`, whichever is more, within the page."""
    px, py = F.greatest(width(p) * share, F.lit(least)), F.greatest(height(p) * share, F.lit(least))
    return {
        p + "x0": F.greatest(F.lit(0.0), F.col(p + "x0") - px), p + "y0": F.greatest(F.lit(0.0), F.col(p + "y0") - py),
        p + "x1": F.least(F.lit(page_width), F.col(p + "x1") + px), p + "y1": F.least(F.lit(page_height), F.col(p + "y1") + py),
    }


def snapped(crop: str, refined: str, crop_confidence: Column, refined_confidence: Column) -> dict[str, Column]:
    """A box refined within a crop, put back on the page, with the mean confidence."""
    shifted = {s: F.col(crop + s[0] + "0") + F.col(refined + s) for s in SIDES}
    return shifted | {"confidence": (crop_confidence + refined_confidence) / 2}


def length(p: str = "") -> Column:
    return F.sqrt(width(p) * width(p) + height(p) * height(p))


def horizontal(p: str = "") -> Column:
    return F.abs(height(p)) < F.abs(width(p)) * 0.1


def vertical(p: str = "") -> Column:
    return F.abs(width(p)) < F.abs(height(p)) * 0.1


def centre_in(inner: str, outer: str) -> Column:
    """Whether the inner box's centre lies in the outer box, borders included."""
    cx, cy = (F.col(inner + "x0") + F.col(inner + "x1")) / 2, (F.col(inner + "y0") + F.col(inner + "y1")) / 2
    return cx.between(F.col(outer + "x0"), F.col(outer + "x1")) & cy.between(F.col(outer + "y0"), F.col(outer + "y1"))
