"""Affine transforms, boxes and the resolution policy, as column expressions.

A geotransform is nine numbers, the rows of a 3x3 matrix: (a, b, c, d, e, f, 0, 0, 1); x = a col + b row + c and
y = d col + e row + f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


def tile_box(gt: Column, w: Column, h: Column) -> dict[str, Column]:
    """The box of an unrotated tile: the origin is its upper left corner and row steps go down."""
    return {
        "xmin": gt[2],
        "ymin": gt[5] + h * gt[4],
        "xmax": gt[2] + w * gt[0],
        "ymax": gt[5],
    }


def pixel_to_world(gt: Column, col: Column, row: Column) -> tuple[Column, Column]:
    return gt[0] * col + gt[1] * row + gt[2], gt[3] * col + gt[4] * row + gt[5]


def world_to_pixel(gt: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(col, row) by the inverse of the geotransform; without rotation each axis by itself, as that rounds least."""
    dx, dy, det = x - gt[2], y - gt[5], gt[0] * gt[4] - gt[1] * gt[3]
    plain = (gt[1] == 0) & (gt[3] == 0)
    col = F.when(plain, dx / gt[0]).otherwise((gt[4] * dx - gt[1] * dy) / det)
    row = F.when(plain, dy / gt[4]).otherwise((gt[0] * dy - gt[3] * dx) / det)
    return col, row


def pixel_box_to_world(gt: Column, col: Column, row: Column, w: Column, h: Column) -> dict[str, Column]:
    """The box around the four corners of a pixel box, rotation included."""
    corners = [pixel_to_world(gt, c, r) for c in (col, col + w) for r in (row, row + h)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return {"xmin": F.least(*xs), "ymin": F.least(*ys), "xmax": F.greatest(*xs), "ymax": F.greatest(*ys)}


def native_resolution(gt: Column) -> Column:
    return F.greatest(F.abs(gt[0]), F.abs(gt[4]))


def intersects(a: str, b: str) -> Column:
    """Boxes of two aliased tables touch or overlap."""
    c = F.col
    return (c(f"{a}.xmin") <= c(f"{b}.xmax")) & (c(f"{b}.xmin") <= c(f"{a}.xmax")) & (c(f"{a}.ymin") <= c(f"{b}.ymax")) & (c(f"{b}.ymin") <= c(f"{a}.ymax"))


def clipped(a: str, b: str) -> dict[str, Column]:
    """The common part of two boxes."""
    c = F.col
    return {
        "xmin": F.greatest(c(f"{a}.xmin"), c(f"{b}.xmin")),
        "ymin": F.greatest(c(f"{a}.ymin"), c(f"{b}.ymin")),
        "xmax": F.least(c(f"{a}.xmax"), c(f"{b}.xmax")),
        "ymax": F.least(c(f"{a}.ymax"), c(f"{b}.ymax")),
    }


def resolution_policy(res: Column, high_res: bool = False) -> dict[str, Column]:
    """Patch size, upsampling and ground size of an embedded pixel by metres a pixel: below 0.07, below 0.15, above.

    The bounds are strict, so 0.07 and 0.15 fall in the coarser classes; ``high_res`` doubles the upsampling.
    """
    patch = F.when(res < 0.07, 1024).when(res < 0.15, 512).otherwise(256)
    upsample = F.when(res < 0.07, 1).when(res < 0.15, 2).otherwise(4) * (2 if high_res else 1)
    return {"patch_px": patch, "upsample": upsample, "embed_gsd": res * 16 / upsample}


def snap_to_patch(xmin: Column, ymin: Column, xmax: Column, ymax: Column, gt: Column, patch: Column) -> dict[str, Column]:
    """The pixel window around the four corners of a world box, floored and ceiled, then extended right and down to whole
    patches."""
    corners = [world_to_pixel(gt, x, y) for x in (xmin, xmax) for y in (ymin, ymax)]
    cs, rs = [c for c, _ in corners], [r for _, r in corners]
    col0, row0 = F.floor(F.least(*cs)), F.floor(F.least(*rs))
    cols, rows = F.ceil(F.greatest(*cs)) - col0, F.ceil(F.greatest(*rs)) - row0
    whole = lambda n: (F.ceil(n / patch) * patch).cast("bigint")
    return {"col0": col0.cast("bigint"), "row0": row0.cast("bigint"), "w_px": whole(cols), "h_px": whole(rows)}
