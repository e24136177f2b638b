"""Evaluation roll-ups, detection verdicts, metric monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.geometry import RELATIONS, iou, relations
from scorelake.operators import evaluate as E
from scorelake.operators import verdicts as V
from scorelake.plans import requests
from scorelake.queries.fixtures import table, view
from scorelake.queries.registry import query
from scorelake.schema import DETECTOR_CLASSES

_SCORERS = ("aesthetic", "pick_score", "image_reward")
_IMG_LONG = "l as (" + " union all ".join(
    f"select prompt, '{s}' as scorer, {s} as value from images_v" for s in _SCORERS
) + ")"


@query(
    f"""with {_IMG_LONG} select scorer, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as std,
  count(*) as n_images, count(*) filter (value is null) as n_missing, count(distinct prompt) as n_prompts from l group by scorer"""
)
def reward_summary(spark, sf):
    out = E.reward_summary(view(spark, sf, "images_v"))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    f"""with {_IMG_LONG}, p as (select scorer, prompt, avg(value) as m from l group by all)
select scorer, round(avg(m), 6) as per_prompt_mean from p group by scorer"""
)
def per_prompt_mean(spark, sf):
    out = E.per_prompt_mean(view(spark, sf, "images_v"))
    return out.withColumn("per_prompt_mean", F.round("per_prompt_mean", 6))


@query(
    "select " + ", ".join(f"round(avg({s}), 6) as {s}" for s in _SCORERS) + ", count(*) as n_images from images_v"
)
def mean_scores(spark, sf):
    out = E.mean_scores(view(spark, sf, "images_v"))
    return out.select(*[F.round(s, 6).alias(s) for s in _SCORERS], "n_images")


@query(
    """with r as (select prompt, filename, row_number() over (partition by prompt order by filename) as rn from images_v)
select prompt, string_agg(filename, '|' order by rn) as outputs from r where rn <= 4 group by prompt"""
)
def prompt_grid(spark, sf):
    out = E.prompts_grid(view(spark, sf, "images_v"), 4, "filename", "filename")
    return out.select("prompt", F.array_join("outputs", "|").alias("outputs"))


@query(
    """select item_id, n as sample, lpad(item_id::varchar, 5, '0')||'/samples/'||lpad(n::varchar, 4, '0')||'.png' as path
from benchmark, range(4) t(n)"""
)
def sample_requests(spark, sf):
    out = requests.sample_requests(table(spark, sf, "benchmark"), 4, "item_id")
    return out.select("item_id", F.col("sample").cast("long").alias("sample"), "path")


_TOP = """b as (select *, row_number() over (partition by image_id, class order by score desc, det_id desc, x1, y1, x2, y2) as rn
  from detections_v where score > 0.3::double),
top as (select * from b where rn <= 16)"""


@query(f"with {_TOP} select image_id, class, det_id, rn, round(score, 6) as score from top")
def detections_topk(spark, sf):
    out = V.top_boxes(view(spark, sf, "detections_v"))
    return out.select("image_id", "class", "det_id", F.col("rn").cast("long").alias("rn"), F.round("score", 6).alias("score"))


_AREA = "greatest({x2} - {x1} + 1, 0::double) * greatest({y2} - {y1} + 1, 0::double)"


def _iou_sql(a: str, b: str) -> str:
    inter = _AREA.format(
        x1=f"greatest({a}.x1,{b}.x1)", y1=f"greatest({a}.y1,{b}.y1)", x2=f"least({a}.x2,{b}.x2)", y2=f"least({a}.y2,{b}.y2)"
    )
    area = [_AREA.format(**{c: f"{t}.{c}" for c in ("x1", "y1", "x2", "y2")}) for t in (a, b)]
    return f"coalesce(({inter}) / nullif(({area[0]}) + ({area[1]}) - ({inter}), 0), 0)"


@query(
    f"""with {_TOP} select a.image_id, a.class, a.det_id, round(max({_iou_sql('b', 'a')}), 6) as max_iou
from top a join top b on a.image_id = b.image_id and a.class = b.class and b.rn < a.rn group by all"""
)
def iou_overlaps(spark, sf):
    """Per box: the largest overlap with a better box of its class. At most 16 boxes meet."""
    top = V.top_boxes(view(spark, sf, "detections_v"))
    box = F.struct("rn", "det_id", "x1", "y1", "x2", "y2")
    packed = top.groupBy("image_id", "class").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    better = F.transform(
        "boxes",
        lambda x, i: F.struct(
            x["det_id"].alias("det_id"),
            F.array_max(F.transform(F.slice("boxes", F.lit(1), i), lambda k: iou(k, x))).alias("max_iou"),
        ),
    )
    rows = packed.select("image_id", "class", F.inline(better)).where(F.col("max_iou").isNotNull())
    return rows.withColumn("max_iou", F.round("max_iou", 6))


_NMS = """keep as (
  select image_id, class, 1::bigint as rn, [struct_pack(rn := rn, x1 := x1, y1 := y1, x2 := x2, y2 := y2, color := color)] as kept
  from top where rn = 1
  union all
  select k.image_id, k.class, t.rn,
    case when len(list_filter(k.kept, lambda q: {iou} >= 0.3::double)) > 0 then k.kept
         else list_append(k.kept, struct_pack(rn := t.rn, x1 := t.x1, y1 := t.y1, x2 := t.x2, y2 := t.y2, color := t.color)) end
  from keep k join {top} t on t.image_id = k.image_id and t.class = k.class and t.rn = k.rn + 1)"""


@query(
    f"""with recursive {_TOP}, {_NMS.format(iou=_iou_sql('q', 't'), top='top')},
last as (select image_id, class, arg_max(kept, rn) as kept from keep group by image_id, class)
select image_id, class, len(kept)::bigint as n_kept, array_to_string(list_transform(kept, lambda q: q.rn), ',') as ranks from last"""
)
def greedy_nms(spark, sf):
    top = V.top_boxes(view(spark, sf, "detections_v"))
    box = F.struct("rn", "x1", "y1", "x2", "y2", "score", "color")
    packed = top.groupBy("image_id", "class").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kept = packed.withColumn("kept", V.suppress(F.col("boxes"), 0.3))
    ranks = F.array_join(F.transform("kept", lambda k: k["rn"].cast("string")), ",")
    return kept.select("image_id", "class", F.size("kept").cast("long").alias("n_kept"), ranks.alias("ranks"))


_SPECS = "specs as (select distinct image_id, tag from clauses_v)"
_STRONG = f"""{_TOP}, {_SPECS},
st as (select t.* from top t join specs s on t.image_id = s.image_id
   where t.score > case when s.tag = 'counting' then 0.9::double else 0.3::double end)"""
_OBJ = f"""{_STRONG}, {_NMS.format(iou=_iou_sql('q', 't'), top='st').replace('from top where', 'from st where')},
lastk as (select image_id, class, arg_max(kept, rn) as kept from keep group by image_id, class),
obj as (select image_id, class, unnest(kept, max_depth := 1) as o, generate_subscripts(kept, 1) as k from lastk),
cl as (select c.*, (select count(*) from obj o where o.image_id = c.image_id and o.class = c.class) as n_all from clauses_v c)"""


def _clauses(spark, sf):
    """Nested specs, as the verdict rows carry them: clauses in order, excludes apart."""
    orders = table(spark, sf, "orders")
    include = [("A", (4, 2), None, None, None), ("N", (8, 3), "O", None, None), ("R", (24, 2), None, "left of", 0)]
    count = lambda every, most: 1 + F.floor(F.col("o_orderkey") / every) % most
    n_clauses = (F.col("o_orderkey") % 4 + 1).cast("int")
    fields = ("class", "cnt", "color", "rel", "tgt")
    kinds = ("string", "int", "string", "string", "int")
    rows = F.array(
        *[F.struct(*[(count(*v) if f == "cnt" else F.lit(v)).cast(t).alias(f) for v, t, f in zip(c, kinds, fields)]) for c in include]
    )
    exclude = F.array(F.struct(F.lit("N").alias("class"), F.lit(3).alias("cnt")))
    tag = F.when(F.col("o_orderpriority") == "1-URGENT", "counting").otherwise(F.lower("o_orderpriority"))
    return orders.select(
        F.col("o_orderkey").alias("image_id"),
        tag.alias("tag"),
        (F.col("o_orderkey") % 500).alias("spec_id"),
        F.slice(rows, F.lit(1), F.least(n_clauses, F.lit(3))).alias("include"),
        F.slice(exclude, F.lit(1), F.greatest(n_clauses - 3, F.lit(0))).alias("exclude"),
    )


def _objects(spark, sf):
    specs = _clauses(spark, sf)
    return specs, V.objects_per_image(view(spark, sf, "detections_v"), specs.select("image_id", "tag"), 0.3)


def _flat(specs):
    rows = specs.select("image_id", F.posexplode("include").alias("pos", "c"))
    return rows.select("image_id", "pos", "c.*")


@query(
    f"""with recursive {_OBJ} select image_id, pos::bigint as pos, class, least(n_all, cnt)::bigint as found, n_all >= cnt as ok
from cl where kind = 'include'"""
)
def clause_counts(spark, sf):
    specs, objects = _objects(spark, sf)
    out = V.clause_counts(_flat(specs), objects)
    return out.select("image_id", F.col("pos").cast("long").alias("pos"), "class", F.col("found").cast("long").alias("found"), "ok")


@query(
    f"""with recursive {_OBJ}, n as (select c.image_id, c.pos, count(o.k) filter (o.o.color = c.color and o.k <= c.cnt) as n_color
  from cl c left join obj o on o.image_id = c.image_id and o.class = c.class where c.color is not null group by all)
select c.image_id, c.pos::bigint as pos, c.color, n.n_color::bigint as n_color, n.n_color >= c.cnt as ok
from cl c join n on n.image_id = c.image_id and n.pos = c.pos"""
)
def clause_colors(spark, sf):
    specs, objects = _objects(spark, sf)
    out = V.clause_colors(_flat(specs), objects)
    return out.select(
        "image_id", F.col("pos").cast("long").alias("pos"), "color", F.col("n_color").cast("long").alias("n_color"), "ok"
    )


def _rel_sql(a: str, b: str) -> str:
    def axis(lo, hi):
        off = f"(({a}.{lo} + {a}.{hi}) / 2 - ({b}.{lo} + {b}.{hi}) / 2)"
        ext = f"(abs({a}.{hi} - {a}.{lo}) + abs({b}.{hi} - {b}.{lo}))"
        return off, f"(greatest(abs{off} - 0.1::double * {ext}, 0) * sign{off})"

    ox, dx = axis("x1", "x2")
    oy, dy = axis("y1", "y2")
    length = f"sqrt({ox} * {ox} + {oy} * {oy})"
    near = f"(abs{dx} < 1e-3::double and abs{dy} < 1e-3::double)"
    tests = (f"{dx} < -0.5::double * {length}", f"{dx} > 0.5::double * {length}",
             f"{dy} < -0.5::double * {length}", f"{dy} > 0.5::double * {length}")
    parts = ", ".join(f"case when not {near} and {t} then '{n}' end" for t, n in zip(tests, RELATIONS))
    return f"list_filter([{parts}], lambda z: z is not null)"


@query(
    f"""with {_TOP}, best as (select * from top where rn = 1),
anchor as (select * from best qualify row_number() over (partition by image_id order by class) = 1)
select a.image_id, a.class as class, b.class as target, array_to_string({_rel_sql('a', 'b')}, ' and ') as relation
from best a join anchor b on a.image_id = b.image_id and a.class <> b.class"""
)
def relative_position(spark, sf):
    """Relation of each class's best box to the best box of the image's first class."""
    best = V.top_boxes(view(spark, sf, "detections_v"), k=1)
    one = best.select("image_id", "class", F.struct("x1", "y1", "x2", "y2").alias("box"))
    target = one.groupBy("image_id").agg(F.min_by(F.struct("class", "box"), "class").alias("t"))
    pairs = one.join(target, "image_id").where(F.col("class") != F.col("t.class"))
    relation = F.array_join(relations(F.col("box"), F.col("t.box")), " and ")
    return pairs.select("image_id", "class", F.col("t.class").alias("target"), relation.alias("relation"))


_VERDICT = f"""{_OBJ},
c01 as (select c.image_id, c.pos, c.class,
    case when n_all < cnt then 'expected '||class||'>='||cnt||', found '||n_all
         when color is not null and (select count(*) from obj o where o.image_id = c.image_id and o.class = c.class and o.k <= c.cnt and o.o.color = c.color) < cnt
         then 'expected '||color||' '||class||'>='||cnt||', found '||(select count(*) from obj o where o.image_id = c.image_id and o.class = c.class and o.k <= c.cnt and o.o.color = c.color)
              ||' '||color||'; and '||(select string_agg(n||' '||p, ', ' order by p) from
                (select o.o.color as p, count(*) as n from obj o where o.image_id = c.image_id and o.class = c.class and o.k <= c.cnt group by 1)) end as reason
  from cl c where kind = 'include' and rel is null),
pairs as (select c.image_id, c.pos, c.rel, a.k * 100 + b.k as place, {_rel_sql('a.o', 'b.o')} as held
  from cl c join cl t on t.image_id = c.image_id and t.pos = c.tgt and t.kind = 'include'
    join obj a on a.image_id = c.image_id and a.class = c.class and a.k <= c.cnt
    join obj b on b.image_id = c.image_id and b.class = t.class and b.k <= t.cnt
  where c.kind = 'include' and c.rel is not null),
miss as (select image_id, pos, arg_min(held, place) as held from pairs where not list_contains(held, rel) group by image_id, pos),
rel as (select c.image_id, c.pos, c.class,
    case when c.n_all < c.cnt then 'expected '||c.class||'>='||c.cnt||', found '||c.n_all
         when t.reason is not null then 'no target for '||c.class||' to be '||c.rel
         when m.held is not null
         then 'expected '||c.class||' '||c.rel||' target, found '||array_to_string(m.held, ' and ')||' target' end as reason
  from cl c join c01 t on t.image_id = c.image_id and t.pos = c.tgt left join miss m on m.image_id = c.image_id and m.pos = c.pos
  where c.kind = 'include' and c.rel is not null),
ex as (select image_id, pos, case when n_all >= cnt then 'expected '||class||'<'||cnt||', found '||n_all end as reason
  from cl where kind = 'exclude'),
allr as (select image_id, pos, reason from c01 union all select image_id, pos, reason from rel union all select * from ex),
verdict as (select s.image_id, s.tag, count(reason) = 0 as correct,
    coalesce(string_agg(reason, chr(10) order by pos), '') as reason, s.image_id % 500 as spec_id
  from specs s join allr r on r.image_id = s.image_id group by s.image_id, s.tag)"""


def _verdicts(spark, sf):
    specs, objects = _objects(spark, sf)
    return V.judge(specs, objects, colors=("F", "O", "P"))


@query(
    f"""with recursive {_VERDICT} select v.image_id, v.tag, v.correct, v.reason, least(v.image_id % 4 + 1, 3)::bigint as n_include,
  (select count(*) from obj o where o.image_id = v.image_id and o.class = 'N')::bigint as n_boxes from verdict v"""
)
def verdict_rows(spark, sf):
    """Verdicts as they are written: specification and kept boxes as JSON."""
    specs, objects = _objects(spark, sf)
    rows = V.verdict_rows(specs, objects, colors=("F", "O", "P"))
    length = lambda c, path: F.json_array_length(F.get_json_object(c, path)).cast("long")
    return rows.select(
        "image_id", F.get_json_object("metadata", "$.tag").alias("tag"), "correct", "reason",
        length("metadata", "$.include").alias("n_include"), F.coalesce(length("details", "$.N"), F.lit(0)).alias("n_boxes"),
    )


_NAMES = "[" + ", ".join(f"'{n}'" for n in DETECTOR_CLASSES) + "]"


@query(
    f"""with b as (select l_orderkey as image_id, l_partkey % 90 as id, {_NAMES} as names from lineitem)
select image_id, coalesce(names[id + 1], 'unknown ' || id) as class, count(*) as n from b group by all"""
)
def detections_long(spark, sf):
    """Detector output to named boxes; ids beyond the name list are counted, not lost."""
    zero = F.lit(0.0)
    box = F.struct((F.col("l_partkey") % 90).cast("int").alias("class_id"), *[zero.alias(c) for c in ("x1", "y1", "x2", "y2", "score")], F.col("l_linestatus").alias("color"))
    images = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list(box).alias("boxes"))
    named = V.detections_long(images).groupBy("image_id", "class").agg(F.count(F.lit(1)).alias("n"))
    single = images.select("image_id", F.explode(F.transform("boxes", lambda b: F.array(b))).alias("boxes"))
    unknown = single.where(F.get("boxes", F.lit(0))["class_id"] >= len(DETECTOR_CLASSES))
    ids = V.unknown_classes(unknown).count()
    per_image = unknown.groupBy("image_id", F.concat(F.lit("unknown "), F.get("boxes", F.lit(0))["class_id"].cast("string")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return named.union(per_image) if ids else named


@query(f"with recursive {_VERDICT} select image_id, tag, correct, reason from verdict")
def verdicts(spark, sf):
    return _verdicts(spark, sf).select("image_id", "tag", "correct", "reason")


@query(
    f"""with recursive {_VERDICT} select tag, count(*) as n_images, count(*) filter (correct) as n_correct,
  round(avg(case when correct then 1.0::double else 0 end), 6) as accuracy from verdict group by tag"""
)
def task_accuracy(spark, sf):
    return E.task_accuracy(_verdicts(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    f"""with recursive {_VERDICT}, sp as (select spec_id, bool_or(correct) as any_c from verdict group by spec_id),
tg as (select tag, avg(case when correct then 1.0::double else 0 end) as a from verdict group by tag)
select count(*) as n_images, round(avg(case when correct then 1.0::double else 0 end), 6) as correct_images,
  (select count(*) from sp) as n_prompts, round((select avg(case when any_c then 1.0::double else 0 end) from sp), 6) as correct_prompts,
  round((select avg(a) from tg), 6) as overall from verdict"""
)
def task_overall(spark, sf):
    out = E.task_overall(_verdicts(spark, sf), spec="spec_id")
    return out.withColumns({c: F.round(c, 6) for c in ("correct_images", "correct_prompts", "overall")})


@query(
    """with f as (select *, isnan(value) as bad, row_number() over (partition by series order by ts, event_id) as p from metrics_v),
g as (select *, p - row_number() over (partition by series order by ts, event_id) as run from f where bad)
select series, arg_min(event_id, p) as start_event_id, count(*) as length, count(*) >= 5 as alarm from g group by series, run"""
)
def nonfinite_runs(spark, sf):
    out = E.nonfinite_runs(view(spark, sf, "metrics_v"))
    return out.select("series", "start_event_id", "length", "alarm")


@query(
    f"""with recursive {_VERDICT} select tag, count(*) as n_images, count(*) filter (correct) as n_correct,
  round(avg(case when correct then 1.0::double else 0 end), 6) as accuracy, row_number() over (order by min(image_id), tag) - 1 as place
  from verdict group by tag"""
)
def task_accuracy_ordered(spark, sf):
    """Tags in the order in which they are first seen."""
    return E.task_accuracy_ordered(_verdicts(spark, sf), "image_id").withColumn("accuracy", F.round("accuracy", 6))


@query(
    """with r as (select event_type as series, event_id // 1000 as epoch, event_id // 8 as step,
  case when event_id % 11 <> 0 then value end as v, event_id % 16 + 1 as n from events)
select series, epoch::bigint as epoch, step::bigint as step, round(sum(v * n) / sum(n) filter (v is not null), 6) as mean,
  coalesce(sum(n) filter (v is not null), 0)::bigint as n, count(v) as ranks from r group by series, epoch, step"""
)
def metric_steps(spark, sf):
    """Up to eight ranks report a step; some of them report nothing."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("series"),
        F.floor(F.col("event_id") / 1000).alias("epoch"),
        F.floor(F.col("event_id") / 8).alias("step"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
        (F.col("event_id") % 16 + 1).alias("n"),
    )
    return E.metric_steps(e).withColumn("mean", F.round("mean", 6))


@query(
    """select event_type as series, (event_id // 1000)::bigint as epoch, round(sum(value * (event_id % 16 + 1)) / sum(event_id % 16 + 1), 6) as mean,
  sum(event_id % 16 + 1)::bigint as n from events group by all"""
)
def metric_means(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("series"),
        F.floor(F.col("event_id") / 1000).alias("epoch"),
        "value",
        (F.col("event_id") % 16 + 1).alias("n"),
    )
    return E.metric_means(e).withColumn("mean", F.round("mean", 6))
