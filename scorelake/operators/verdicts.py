"""Detection verdicts: best boxes per class, suppression, clause checks.

Detections are cut to the best few per (image, class) before anything is collected, so every
array below is bounded: at most MAX_OBJECTS boxes per class and one entry per class of an image.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.functions.binding import let
from scorelake.functions.geometry import iou, relations
from scorelake.schema import COLORS, DETECTOR_CLASSES

# Thresholds and box limit of the verdicts.
MAX_OBJECTS = 16
MIN_SCORE = 0.3
MIN_SCORE_COUNTING = 0.9
COUNTING_TAG = "counting"


def top_boxes(detections: DataFrame, k: int = MAX_OBJECTS, min_score: float = MIN_SCORE) -> DataFrame:
    """Best k boxes per (image, class) with a score strictly above the threshold.

    Spark turns the rank filter into a group limit before the shuffle, so a hot class sends at
    most k rows per task. A higher threshold can be applied afterwards: the cut is by score.
    """
    tie = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    window = Window.partitionBy("image_id", "class").orderBy(F.desc("score"), F.desc("det_id"), *tie)
    strong = detections.where(F.col("score") > F.lit(min_score))
    return strong.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= k)


def name_classes(detections: DataFrame, names: Sequence[str] = DETECTOR_CLASSES) -> DataFrame:
    """class_id -> class, by place in the detector's fixed name list.

    Boxes of unknown ids have no class to be judged by; `unknown_classes` counts them.
    """
    named = detections.withColumn("class", F.get(F.lit(list(names)), F.col("class_id").cast("int")))
    return named.where(F.col("class").isNotNull()).drop("class_id")


def unknown_classes(images: DataFrame, names: Sequence[str] = DETECTOR_CLASSES) -> DataFrame:
    """(class_id, n) of the boxes of detector output that `detections_long` leaves out."""
    ids = images.select(F.explode("boxes.class_id").alias("class_id"))
    known = F.get(F.lit(list(names)), F.col("class_id").cast("int")).isNotNull()
    return ids.where(~F.coalesce(known, F.lit(False))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def detections_long(images: DataFrame, names: Sequence[str] = DETECTOR_CLASSES) -> DataFrame:
    """Detector output (image_id, boxes: array<struct(class_id, x1, y1, x2, y2, score, color)>) -> one row per box."""
    rows = images.select("image_id", F.posexplode("boxes").alias("det_id", "b"))
    return name_classes(rows.select("image_id", F.col("det_id").cast("long").alias("det_id"), "b.*"), names)


def suppress(boxes: Column, threshold: float) -> Column:
    """Greedy suppression over boxes sorted best first; threshold 1 keeps everything."""
    if threshold == 1:
        return boxes
    return F.aggregate(
        boxes,
        F.slice(boxes, 1, 0),
        lambda kept, x: F.when(
            F.exists(kept, lambda k: iou(k, x) >= F.lit(threshold)), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )


def objects_per_image(
    detections: DataFrame,
    tags: DataFrame,
    nms_threshold: float = 1.0,
    k: int = MAX_OBJECTS,
    min_score: float = MIN_SCORE,
    min_score_counting: float = MIN_SCORE_COUNTING,
) -> DataFrame:
    """(image_id, objects: map<class, array<box>>) for the images of `tags(image_id, tag)`."""
    best = top_boxes(detections, k, min(min_score, min_score_counting))
    floor = F.when(F.col("tag") == COUNTING_TAG, min_score_counting).otherwise(min_score)
    strong = best.join(tags, "image_id").where(F.col("score") > floor)
    box = F.struct("rn", "x1", "y1", "x2", "y2", "score", "color")
    per_class = strong.groupBy("image_id", "class").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kept = per_class.withColumn("boxes", suppress(F.col("boxes"), nms_threshold))
    entries = F.map_from_entries(F.collect_list(F.struct("class", "boxes")))
    return kept.groupBy("image_id").agg(entries.alias("objects"))


def _color_reason(clause: Column, found: Column, colors: Sequence[str]) -> Column:
    def count(name: Column) -> Column:
        return F.size(F.filter(found, lambda o: o["color"] == name))

    listed = F.filter(F.lit(list(colors)), lambda c: F.exists(found, lambda o: o["color"] == c))
    parts = F.transform(listed, lambda c: F.concat(count(c).cast("string"), F.lit(" "), c))
    return F.concat(
        F.lit("expected "), clause["color"], F.lit(" "), clause["class"], F.lit(">="),
        clause["cnt"].cast("string"), F.lit(", found "), count(clause["color"]).cast("string"),
        F.lit(" "), clause["color"], F.lit("; and "), F.array_join(parts, ", "),
    )


def _check_include(state: Column, clause: Column, objects: Column, colors: Sequence[str]) -> Column:
    """Outcome of one clause: struct(matched, reason, found)."""
    counted = F.slice(F.try_element_at(objects, clause["class"]), F.lit(1), clause["cnt"])
    start = F.struct(
        F.coalesce(counted, F.array().cast(f"array<{_BOX}>")).alias("found"),
        F.get(state, clause["tgt"]).alias("target"),
    )
    name, cnt, color, rel = clause["class"], clause["cnt"], clause["color"], clause["rel"]

    def first_miss(s: Column) -> Column:
        """Relations of the first pair that does not hold the wanted one; NULL when all do."""

        def misses(o: Column) -> Column:
            held = F.transform(s["target"]["found"], lambda t: relations(o, t))
            return F.filter(held, lambda r: ~F.array_contains(r, rel))

        return F.get(F.flatten(F.transform(s["found"], misses)), F.lit(0))

    def located(s: Column) -> Column:
        return let(
            F.struct(first_miss(s).alias("miss")),
            lambda m: F.when(
                m["miss"].isNotNull(),
                F.concat(F.lit("expected "), name, F.lit(" "), rel, F.lit(" target, found "),
                         F.array_join(m["miss"], " and "), F.lit(" target")),
            ),
        )

    def reason(s: Column) -> Column:
        n_color = F.size(F.filter(s["found"], lambda o: o["color"] == color))
        return (
            F.when(
                F.size(s["found"]) < cnt,
                F.concat(F.lit("expected "), name, F.lit(">="), cnt.cast("string"),
                         F.lit(", found "), F.size(s["found"]).cast("string")),
            )
            .when(color.isNotNull() & (n_color < cnt), _color_reason(clause, s["found"], colors))
            .when(
                rel.isNotNull() & ~F.coalesce(s["target"]["matched"], F.lit(False)),
                F.concat(F.lit("no target for "), name, F.lit(" to be "), rel),
            )
            .when(rel.isNotNull(), located(s))
        )

    def outcome(s: Column) -> Column:
        return let(
            reason(s),
            lambda why: F.struct(why.isNull().alias("matched"), why.alias("reason"), s["found"].alias("found")),
        )

    return let(start, outcome)


def judge(
    specs: DataFrame, objects: DataFrame, colors: Sequence[str] = COLORS
) -> DataFrame:
    """specs(image_id, tag, ..., include, exclude) x objects -> correct and reason per image.

    include: array<struct(class, cnt, color, rel, tgt)> in clause order, `tgt` the place of an earlier
    clause; exclude: array<struct(class, cnt)>. All includes must match and no exclude may.
    """
    return _judged(specs, objects, colors).drop("objects")


def _judged(specs: DataFrame, objects: DataFrame, colors: Sequence[str]) -> DataFrame:
    """`judge` with the objects it saw."""
    joined = specs.join(objects, "image_id", "left")
    clause = F.col("include")
    start = F.array().cast(_STATE)
    folded = F.aggregate(
        clause,
        start,
        lambda state, c: F.concat(state, F.array(_check_include(state, c, F.col("objects"), colors).cast(_ONE))),
    )
    seen = F.transform(
        F.col("exclude"),
        lambda e: F.struct(
            e["class"].alias("class"),
            e["cnt"].alias("cnt"),
            F.coalesce(F.array_size(F.try_element_at("objects", e["class"])), F.lit(0)).alias("n"),
        ),
    )
    hits = F.transform(
        F.filter(seen, lambda e: e["n"] >= e["cnt"]),
        lambda e: F.concat(F.lit("expected "), e["class"], F.lit("<"), e["cnt"].cast("string"),
                           F.lit(", found "), e["n"].cast("string")),
    )
    # clause outcomes are kept as a column of their own, so the fold runs once
    outcome = joined.withColumn("_state", folded).withColumn("_hits", hits)
    failed = F.filter(F.transform("_state", lambda s: s["reason"]), lambda r: r.isNotNull())
    return outcome.withColumn("_reasons", F.concat(failed, F.col("_hits"))).select(
        *specs.columns,
        (F.size("_reasons") == 0).alias("correct"),
        F.array_join("_reasons", "\n").alias("reason"),
        "objects",
    )


def verdict_rows(specs: DataFrame, objects: DataFrame, colors: Sequence[str] = COLORS) -> DataFrame:
    """`judge` with `metadata` (the specification) and `details` (kept boxes per class) as JSON text."""
    judged = _judged(specs, objects, colors)
    boxes = F.transform_values(
        "objects",
        lambda _, bs: F.transform(bs, lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"], b["score"])),
    )
    spec = F.struct(*[c for c in ("tag", "prompt", "include", "exclude") if c in specs.columns])
    return judged.select(
        *[c for c in judged.columns if c != "objects"],
        F.to_json(spec).alias("metadata"),
        F.coalesce(F.to_json(boxes), F.lit("{}")).alias("details"),
    )


_BOX = "struct<rn:int,x1:double,y1:double,x2:double,y2:double,score:double,color:string>"
_ONE = f"struct<matched:boolean,reason:string,found:array<{_BOX}>>"
_STATE = f"array<{_ONE}>"


def clause_counts(clauses: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per include clause: how many objects of its class were found, and is that enough."""
    per_class = objects.select("image_id", F.explode("objects").alias("class", "boxes"))
    joined = clauses.join(per_class, ["image_id", "class"], "left")
    found = F.least(F.coalesce(F.array_size("boxes"), F.lit(0)), F.col("cnt"))
    return joined.select("image_id", "pos", "class", "cnt", found.alias("found"), (found >= F.col("cnt")).alias("ok"))


def clause_colors(clauses: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per coloured clause: objects among the counted ones that have the colour."""
    per_class = objects.select("image_id", F.explode("objects").alias("class", "boxes"))
    joined = clauses.where(F.col("color").isNotNull()).join(per_class, ["image_id", "class"], "left")
    counted = F.slice(F.col("boxes"), F.lit(1), F.col("cnt"))
    n = F.coalesce(F.array_size(F.filter(counted, lambda o: o["color"] == F.col("color"))), F.lit(0))
    return joined.select("image_id", "pos", "class", "color", n.alias("n_color"), (n >= F.col("cnt")).alias("ok"))
