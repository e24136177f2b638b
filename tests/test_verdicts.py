"""Verdicts with several objects per clause against a plain Python walk over the same boxes."""

import json
import math
import random

import pytest

from scorelake.operators import verdicts as V
from scorelake.schema import COLORS

CLASSES = ("car", "dog", "cup")
BOX = "array<struct<class_id:int,x1:double,y1:double,x2:double,y2:double,score:double,color:string>>"
SPEC = "image_id int, tag string, include array<struct<class:string,cnt:int,color:string,rel:string,tgt:int>>, exclude array<struct<class:string,cnt:int>>"


def overlap(a, b):
    def area(x1, y1, x2, y2):
        return max(x2 - x1 + 1, 0) * max(y2 - y1 + 1, 0)

    inter = area(max(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3]), min(a[4], b[4]))
    union = area(*a[1:5]) + area(*b[1:5]) - inter
    return inter / union if union else 0


def sides(a, b):
    d, full = [], []
    for lo, hi in ((1, 3), (2, 4)):
        off = (a[lo] + a[hi]) / 2 - (b[lo] + b[hi]) / 2
        size = abs(a[hi] - a[lo]) + abs(b[hi] - b[lo])
        full.append(off)
        d.append(math.copysign(max(abs(off) - 0.1 * size, 0), off))
    if max(map(abs, d)) < 1e-3:
        return []
    x, y = (v / math.hypot(*full) for v in d)
    return [n for n, t in (("left of", x < -0.5), ("right of", x > 0.5), ("above", y < -0.5), ("below", y > 0.5)) if t]


def walk(boxes, tag, include, exclude, th):
    floor = 0.9 if tag == "counting" else 0.3
    objects = {}
    for c, name in enumerate(CLASSES):
        best = sorted(((b[5], i, b) for i, b in enumerate(boxes) if b[0] == c and b[5] > floor), reverse=True)[:16]
        kept = []
        for _, _, b in best:
            if th == 1 or all(overlap(k, b) < th for k in kept):
                kept.append(b)
        objects[name] = kept
    reasons, groups = [], []
    for name, cnt, color, rel, tgt in include:
        found, why = objects[name][:cnt], None
        colors = [b[6] for b in found]
        if len(found) < cnt:
            why = f"expected {name}>={cnt}, found {len(found)}"
        elif color and colors.count(color) < cnt:
            listed = ", ".join(f"{colors.count(c)} {c}" for c in COLORS if c in colors)
            why = f"expected {color} {name}>={cnt}, found {colors.count(color)} {color}; and {listed}"
        elif rel and groups[tgt] is None:
            why = f"no target for {name} to be {rel}"
        elif rel:
            bad = [sides(o, t) for o in found for t in groups[tgt] if rel not in sides(o, t)]
            if bad:
                why = f"expected {name} {rel} target, found {' and '.join(bad[0])} target"
        groups.append(None if why else found)
        if why:
            reasons.append(why)
    for name, cnt in exclude:
        if len(objects[name]) >= cnt:
            reasons.append(f"expected {name}<{cnt}, found {len(objects[name])}")
    return not reasons, "\n".join(reasons)


@pytest.mark.parametrize("th", [1, 0.4])
def test_random_scenes(spark, th):
    rng = random.Random(11)
    images, specs, want = [], [], {}
    for i in range(150):
        boxes = []
        for _ in range(rng.randrange(0, 30)):
            x, y = rng.randrange(0, 200), rng.randrange(0, 200)
            boxes.append((rng.randrange(3), x, y, x + rng.randrange(5, 60), y + rng.randrange(5, 60), rng.randrange(100) / 100, rng.choice(COLORS[:3])))
        boxes = [tuple(float(v) if 0 < j < 6 else v for j, v in enumerate(b)) for b in boxes]
        include = []
        for pos in range(rng.randrange(0, 4)):
            rel = rng.choice([None, "left of", "above", "right of"]) if pos else None
            include.append((rng.choice(CLASSES), rng.randrange(1, 3), rng.choice([None, None, "red", "orange"]), rel, rng.randrange(pos) if rel else None))
        exclude = [(rng.choice(CLASSES), rng.randrange(1, 6))] if rng.random() < 0.5 else []
        tag = rng.choice(["counting", "position"])
        images.append((i, boxes))
        specs.append((i, tag, include, exclude))
        want[i] = walk(boxes, tag, include, exclude, th)
    found = V.detections_long(spark.createDataFrame(images, f"image_id int, boxes {BOX}"), CLASSES)
    table = spark.createDataFrame(specs, SPEC)
    objects = V.objects_per_image(found, table.select("image_id", "tag"), th)
    got = {r["image_id"]: (r["correct"], r["reason"]) for r in V.judge(table, objects).collect()}
    assert got == want
    assert 0 < sum(c for c, _ in want.values()) < 150


def test_rows_carry_specification_and_boxes(spark):
    boxes = [(1, 1.0, 2.0, 3.0, 4.0, 0.9, "red")]
    found = V.detections_long(spark.createDataFrame([(1, boxes)], f"image_id int, boxes {BOX}"), CLASSES)
    specs = spark.createDataFrame([(1, "t", [("dog", 1, None, None, None)], []), (2, "t", [("dog", 1, None, None, None)], [])], SPEC)
    rows = {r["image_id"]: r for r in V.verdict_rows(specs, V.objects_per_image(found, specs.select("image_id", "tag"))).collect()}
    assert json.loads(rows[1]["details"]) == {"dog": [[1.0, 2.0, 3.0, 4.0, 0.9]]} and rows[2]["details"] == "{}"
    assert json.loads(rows[1]["metadata"])["include"] == [{"class": "dog", "cnt": 1}]
    assert rows[1]["correct"] and rows[2]["reason"] == "expected dog>=1, found 0"


def test_unknown_class_id_is_dropped(spark):
    box = (99, 0.0, 0.0, 1.0, 1.0, 0.9, "red")
    rows = V.detections_long(spark.createDataFrame([(1, [box, (0,) + box[1:]])], f"image_id int, boxes {BOX}"))
    assert [r["class"] for r in rows.collect()] == ["person"]
