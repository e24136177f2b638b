"""Views over the driver tables that stand in for corpora, scores, detections and metrics.

Every view is one SQL text for both engines. Two tokens differ by dialect and are rendered here:
`U(key,'salt')` (uniform hash) and `a DIV b` (integer division).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scorelake.schema import SCORES

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_KEY = "lpad(cast(doc_id as string),12,'0')"
_SHARD = "lpad(cast(doc_id DIV 100 as string),9,'0')"


def _score_columns() -> str:
    parts = []
    for name in SCORES:
        value = f"U(doc_id,'{name}')"
        if name == "image_reward_score":  # some values outside [0, 1]
            value += "*1.4-0.2"
        parts.append(f"cast({value} as float) as {name}")
        twin = f"cast(U(doc_id,'synthetic_{name}') as float)"
        parts.append(f"case when U(doc_id,'twin') < 0.1 then null else {twin} end as synthetic_{name}")
    return ",\n  ".join(parts)


VIEWS = {
    # captions with <PERSON> markers or missing, images missing, sizes missing
    "samples_v": f"""
select {_KEY} as key, {_SHARD} as shard, doc_id,
  case when U(doc_id,'notxt') < 0.08 then null
       when U(doc_id,'person') < 0.3 then concat('<PERSON> ', text) else text end as txt,
  U(doc_id,'noimg') >= 0.05 as has_image,
  case when U(doc_id,'nosize') < 0.06 then null else cast(128 + floor(U(doc_id,'w')*512) as int) end as width,
  case when U(doc_id,'nosize') < 0.06 then null else cast(128 + floor(U(doc_id,'h')*512) as int) end as height,
  source, lang
from documents""",
    # seven scores and their synthetic twins, float32; a tenth of the rows has no twins
    "scores_v": f"""
select {_KEY} as key, {_SHARD} as shard, doc_id,
  {_score_columns()}
from documents""",
    # caption table: only labelled documents appear, toxic ones without a long caption
    "captions_v": f"""
select concat(lpad(cast(d.doc_id as string),12,'0'),'.jpg') as file_name,
  concat(d.lang, ' text from ', d.source) as short_caption,
  case when l.toxic = 1 then null else concat('A page: <PERSON>', d.text) end as long_caption
from documents d join labels l on d.doc_id = l.doc_id""",
    # archive members in archive order: image, caption, JSON; some extensions in upper case
    "members_v": """
select shard, key, concat(key, m.ext) as member, doc_id*4 + m.n as member_idx, m.ext as ext,
  case when m.n = 1 then coalesce(txt, '') when m.n = 2 then concat('{"width": ', coalesce(cast(width as string), 'null'), '}')
       else concat('image ', key) end as content
from samples_v cross join (select 0 as n, '.jpg' as ext union all select 1, '.txt' union all select 2, '.json'
  union all select 3, '.JPG') m
where (m.n = 0 and has_image) or (m.n = 1 and txt is not null) or m.n = 2 or (m.n = 3 and not has_image)""",
    # detector output; det_id makes ties unique
    "detections_v": """
select l_orderkey as image_id, l_returnflag as class,
  cast(l_linenumber as bigint)*100000000 + l_partkey*10000 + l_suppkey as det_id,
  cast(l_partkey % 200 as double) as x1, cast(l_suppkey % 200 as double) as y1,
  l_partkey % 200 + 20 + l_quantity as x2, cast(l_suppkey % 200 + 20 + l_linenumber*5 as double) as y2,
  10*l_discount as score, case when l_linenumber % 3 = 0 then 'P' else l_linestatus end as color
from lineitem""",
    # 1 to 4 ordered clauses per image, of 1 to 3 objects: clause 2 is a relation to clause 0, clause 3 is an exclude
    "clauses_v": """
select o_orderkey as image_id,
  case when o_orderpriority='1-URGENT' then 'counting' else lower(o_orderpriority) end as tag,
  o_orderkey % 500 as spec_id, c.pos, c.class,
  case when c.kind = 'include' then 1 + (o_orderkey DIV c.every) % c.most else 3 end as cnt, c.color, c.rel, c.tgt, c.kind
from orders cross join (
  select 0 as pos,'A' as class,4 as every,2 as most,cast(null as string) as color,cast(null as string) as rel,cast(null as int) as tgt,'include' as kind
  union all select 1,'N',8,3,'O',cast(null as string),cast(null as int),'include'
  union all select 2,'R',24,2,cast(null as string),'left of',0,'include'
  union all select 3,'N',1,1,cast(null as string),cast(null as string),cast(null as int),'exclude') c
where c.pos <= o_orderkey % 4""",
    # reward rows, several images per prompt
    "images_v": """
select concat(lpad(cast(conv_id as string),9,'0'),'/samples/',lpad(cast(turn as string),4,'0'),'.png') as filename,
  concat('prompt ',cast(conv_id DIV 2 as string)) as prompt,
  U(conv_id*100+turn,'aesthetic')*10 as aesthetic, U(conv_id*100+turn,'pick_score') as pick_score,
  U(conv_id*100+turn,'image_reward')*4-2 as image_reward
from conversations""",
    # metric series with NaN stretches long enough to trigger, and to miss, the alarm
    "metrics_v": """
select event_type as series, ts, event_id,
  case when (event_id DIV 40) % 5 = 0 then cast('NaN' as double) else value end as value
from events""",
}

# Spark's own text where the engines need different ones: a generator instead of a join
SPARK_VIEWS = {
    "members_v": VIEWS["members_v"].replace(
        VIEWS["members_v"][VIEWS["members_v"].index(" cross join") : VIEWS["members_v"].index(" m\nwhere") + 2],
        " lateral view inline(array(struct(0 as n, '.jpg' as ext), struct(1 as n, '.txt' as ext),"
        " struct(2 as n, '.json' as ext), struct(3 as n, '.JPG' as ext))) m",
    ),
}


def _reads(text: str) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [name for name in VIEWS if name in words]


def spark_text(text: str) -> str:
    text = re.sub(
        r"U\(([^,()]+),'([^']*)'\)",
        r"(cast(conv(substring(md5(concat_ws('|',cast(\1 as string),'\2')),1,8),16,10) as double)/4294967296.0D)",
        text,
    )
    return re.sub(r"\bDIV\b", "div", text)


def duck_text(text: str) -> str:
    text = re.sub(
        r"U\(([^,()]+),'([^']*)'\)",
        r"(('0x'||substr(md5((\1)::varchar||'|'||'\2'),1,8))::ubigint::double/4294967296.0::double)",
        text,
    )
    return re.sub(r"\bDIV\b", "//", text)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A fixture view as a lazy DataFrame."""
    text = SPARK_VIEWS.get(name, VIEWS[name])
    words = set(re.findall(r"\w+", text))
    inputs = {t: table(spark, sf, t) for t in TABLES if t in words}
    inputs.update({v: view(spark, sf, v) for v in _reads(text)})
    for source in inputs:
        text = re.sub(rf"\b(from|join) {source}\b", rf"\1 {{{source}}}", text)
    text = text.replace("'{\"width\": '", "concat(chr(123), '\"width\": ')").replace("'}'", "chr(125)")
    return spark.sql(spark_text(text), **inputs)


def oracle(text: str) -> str:
    """Oracle SQL with the views it reads put in front as CTEs."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for inner in _reads(VIEWS[name]):
            visit(inner)
        if name not in needed:
            needed.append(name)

    for name in _reads(text):
        visit(name)
    body = text.strip()
    if needed:
        ctes = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed)
        if re.match(r"with\s+recursive\s", body, re.I):
            body = f"with recursive {ctes},\n{re.sub(r'^with +recursive ', '', body, flags=re.I)}"
        elif re.match(r"with\s", body, re.I):
            body = f"with {ctes},\n{body[5:]}"
        else:
            body = f"with {ctes}\n{body}"
    return duck_text(body)
