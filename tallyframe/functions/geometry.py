"""Rectangles ``[x0, y0, x1, y1]`` (half-open, integer) and run-length masks, without Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..skew import let, let_both

# Thresholds of region matches by kind.
REGION_THRESHOLDS = {
    "identity": {"iou": 0.5, "precision": 0.0, "coverage": 0.0},
    "defect": {"iou": 0.25, "precision": 0.25, "coverage": 0.5},
    "panel": {"iou": 0.5, "precision": 0.5, "coverage": 0.9},
}


def box(x0, y0, x1, y1) -> Column:
    return F.array(*[F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in (x0, y0, x1, y1)])


def box_valid(b: Column) -> Column:
    x0, y0, x1, y1 = (F.get(b, F.lit(i)) for i in range(4))
    return F.coalesce((F.size(b) == 4) & (x0 >= 0) & (x0 < x1) & (y0 >= 0) & (y0 < y1), F.lit(False))


def box_inside(outer: Column, inner: Column) -> Column:
    x = (outer[0] <= inner[0]) & (inner[0] < inner[2]) & (inner[2] <= outer[2])
    return x & (outer[1] <= inner[1]) & (inner[1] < inner[3]) & (inner[3] <= outer[3])


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection_area(a: Column, b: Column) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), width) * F.greatest(F.lit(0), height)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 when the union is empty. Both boxes are taken out of their records once."""
    def ratio(p: Column, q: Column) -> Column:
        return let(intersection_area(p, q), lambda shared: F.coalesce(F.try_divide(shared, area(p) + area(q) - shared), F.lit(0.0)))
    return let_both(a, b, ratio)


def union_length(intervals: Column) -> Column:
    """Length of the union of structs ``(low, high)``; overlaps count once."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("end"))

    def merge(acc: Column, item: Column) -> Column:
        low = F.greatest(item["low"], acc["end"])
        gain = F.greatest(F.lit(0).cast("long"), item["high"] - low)
        return F.struct((acc["total"] + gain).alias("total"), F.greatest(acc["end"], item["high"]).alias("end"))

    return F.aggregate(F.array_sort(intervals), start, merge, lambda acc: acc["total"])


def _interval(low: Column, high: Column) -> Column:
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))


def union_area(required: Column, boxes: Column) -> Column:
    """Exact area of ``required`` covered by the union of ``boxes``.

    Up to two boxes have a closed form, more are summed in strips between distinct x edges.
    """
    def clip(b: Column) -> Column:
        return F.array(
            F.greatest(required[0], b[0]), F.greatest(required[1], b[1]),
            F.least(required[2], b[2]), F.least(required[3], b[3]),
        )

    def strips(clipped: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(clipped, lambda b: F.array(b[0], b[2])))))

        def total(xs: Column) -> Column:
            def strip(left: Column, i: Column) -> Column:
                right = F.get(xs, i + 1)
                inside = F.filter(clipped, lambda b: (b[0] <= left) & (b[2] >= right))
                spans = F.transform(inside, lambda b: _interval(b[1], b[3]))
                return F.coalesce((right - left) * union_length(spans), F.lit(0).cast("long"))
            return F.aggregate(F.transform(xs, strip), F.lit(0).cast("long"), lambda acc, v: acc + v)

        return let(edges, total)

    def covered(clipped: Column) -> Column:
        first, second = clipped[0], clipped[1]
        none = F.lit(0).cast("long")
        return (
            F.when(F.size(clipped) == 0, none).when(F.size(clipped) == 1, area(first).cast("long"))
            .when(F.size(clipped) == 2, (area(first) + area(second) - intersection_area(first, second)).cast("long"))
            .otherwise(strips(clipped))
        )

    return let(F.filter(F.transform(boxes, clip), lambda b: (b[0] < b[2]) & (b[1] < b[3])), covered)


def box_coverage(required: Column, boxes: Column) -> Column:
    """Share of ``required`` covered by the union of ``boxes``."""
    return F.coalesce(F.try_divide(union_area(required, boxes), area(required)), F.lit(0.0))


def covers(required: Column, boxes: Column) -> Column:
    """Whether the union of ``boxes`` covers ``required``.

    One box that holds all of it settles that, and so does a first or last pixel that no box has; only the rest is measured.
    """
    def decide(r: Column, bs: Column) -> Column:
        sound = (r[0] < r[2]) & (r[1] < r[3])
        whole = F.exists(bs, lambda b: (b[0] <= r[0]) & (b[1] <= r[1]) & (r[2] <= b[2]) & (r[3] <= b[3]))
        first = F.exists(bs, lambda b: (b[0] <= r[0]) & (b[1] <= r[1]) & (r[0] < b[2]) & (r[1] < b[3]))
        last = F.exists(bs, lambda b: (b[0] < r[2]) & (b[1] < r[3]) & (r[2] <= b[2]) & (r[3] <= b[3]))
        return F.when(sound & whole, True).when(sound & ~(first & last), False).otherwise(union_area(r, bs) >= area(r))
    return let_both(required, boxes, decide)


def mask_pixels(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r[2] - r[1])


def mask_coverage(runs: Column, boxes: Column) -> Column:
    """Share of mask pixels (runs ``[y, x0, x1]``) covered by the union of ``boxes``."""
    def covered(r: Column) -> Column:
        hit = F.filter(
            boxes, lambda b: (b[1] <= r[0]) & (r[0] < b[3]) & (F.greatest(r[1], b[0]) < F.least(r[2], b[2]))
        )
        return union_length(F.transform(hit, lambda b: _interval(F.greatest(r[1], b[0]), F.least(r[2], b[2]))))
    total = F.aggregate(F.transform(runs, covered), F.lit(0).cast("long"), lambda acc, v: acc + v)
    return F.try_divide(total, mask_pixels(runs))


def mask_valid(size: Column, runs: Column, region: Column) -> Column:
    """Positive size, region inside the image, runs inside the region, no overlap inside a row."""
    frame = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), size[0], size[1])
    inside = F.forall(
        runs,
        lambda r: (F.size(r) == 3) & (region[0] <= r[1]) & (r[1] < r[2]) & (r[2] <= region[2])
        & (region[1] <= r[0]) & (r[0] < region[3]),
    )

    def apart(ordered: Column) -> Column:
        def clear(r: Column, i: Column) -> Column:
            after = F.get(ordered, i + 1)
            return after.isNull() | (after[0] != r[0]) | (after[1] >= r[2])
        return F.forall(F.transform(ordered, clear), lambda ok: ok)

    sound = (size[0] > 0) & (size[1] > 0) & (F.size(runs) > 0) & box_inside(frame, region)
    return F.coalesce(sound & inside & let(F.array_sort(runs), apart), F.lit(False))


def region_match(required: Column, actual: Column, kind: Column) -> Column:
    """Structs ``(image_id, bbox, time)`` match when image and time agree and the boxes pass the kind's thresholds."""
    def passes(shared: Column) -> Column:
        rules = None
        for name, limit in REGION_THRESHOLDS.items():
            rule = (
                (iou(required["bbox"], actual["bbox"]) >= limit["iou"])
                & (shared / area(actual["bbox"]) >= limit["precision"])
                & (shared / area(required["bbox"]) >= limit["coverage"])
            )
            rules = F.when(kind == name, rule) if rules is None else rules.when(kind == name, rule)
        return rules.otherwise(False)
    same = (required["image_id"] == actual["image_id"]) & (required["time"] == actual["time"])
    valid = box_valid(required["bbox"]) & box_valid(actual["bbox"])
    return F.coalesce(
        same & valid & let(intersection_area(required["bbox"], actual["bbox"]), passes), F.lit(False)
    )


def rotation_angle(a: Column, b: Column) -> Column:
    """Angle in degrees between two rotations given as 3x3 arrays: trace(A^T B) is the sum of products."""
    products = F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: x * y)
    trace = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def vector_angle(a: Column, b: Column) -> Column:
    """Angle in degrees between two vectors of the same length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
        )
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def source_box(view: Column, source: Column, display: Column) -> Column:
    """Source pixels of a display-pixel box: low edges floored, high edges ceiled, clipped to the source box."""
    def edge(i: int, snap) -> Column:
        axis = i % 2
        extent = source[axis + 2] - source[axis]
        spot = snap(source[axis] + view[i] * extent / display[axis]).cast("long")
        return F.least(F.greatest(spot, source[axis]), source[axis + 2])
    return F.array(edge(0, F.floor), edge(1, F.floor), edge(2, F.ceil), edge(3, F.ceil))


def normalized_box(unit: Column, source: Column) -> Column:
    """Source pixels of a box in [0, 1] coordinates of the source box."""
    return source_box(unit, source, F.array(F.lit(1), F.lit(1)))
