"""Vector search, url filters, source mixing and the pipeline on small tables."""

import gc
import math
import random
import time
import weakref
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm import ann, bpe, graph, langid, mixing, queries, similar, urls

# --- nearest neighbours


def plain_nearest(rows, k=5):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        a = np.array(a)
        scored = sorted((-float(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), i) for i, b in good if i != q and b.size == a.size)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("part_rows", [8, 64, 4096])
def test_nearest(spark, part_rows):
    rng = np.random.default_rng(part_rows)
    rows = [(i, (rng.standard_normal(24) + 1).tolist()) for i in range(300)]
    hot = rng.standard_normal(24).tolist()
    rows += [(i, hot) for i in range(1000, 1101)]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 24), (2150, [float("nan")] + [1.0] * 23), (2200, [float("inf")] * 24), (2250, [None] + [1.0] * 23), (None, hot), (2300, [1.0, 2.0]), (2301, [1.0, 2.5]), (2350, [1e300] * 24), (2400, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, part int, ids string")
    got = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 50 == 0, part_rows=part_rows).collect()))
    want = plain_nearest([(i, v) for i, v in rows if i != 2350])
    got = [g for g in got if g[0] != 2350]
    near = [(a, b) for a, b in zip(got, want) if a[:2] != b[:2] or (a[2] != b[2] and a[2] != 2350) or abs(a[3] - b[3]) > 1e-9]
    assert len(got) == len(want) and len([1 for a, b in near if a[2] != 2350 and 2350 not in {g[2] for g in got if g[0] == a[0]}]) == 0
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(1)
    codes = ann.Codes(rng.standard_normal((2000, 64)))
    queries_ = rng.standard_normal((50, 64))
    queries_ /= ann.norms(queries_)[:, None]
    guess, error = codes.estimate(queries_)
    off = guess - queries_ @ codes.unit.T
    assert abs(off.mean()) < 0.01 and (np.abs(off) <= ann.SIGMAS * error + 1e-5).mean() > 0.99


# --- urls

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/en/12?x=/es/", "https://a.example.org/es/1", "http://org/", "http://x.org", "http://evilexample.org/es/1", "ftp://b.com/fr/#/de/",
    "http://b.com/de/1", "http://b.com#/de/", "http://a.net/casino/1", "http://cheappills.net/en/1", "http://www.plainname.net/en/2", "http://x.com/de/y://z", "http://ÉÀ.org/\n?q", "http://" + "a" * 300 + ".net/",
]


def plain_url(url):
    import re

    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in (*urls.ALLOW, *urls.BLOCK) if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    html = "<html><script>zzz</script><p>the plain name cheap pills the name</p></html>"
    more = [f"http://{h}.net/en/{i}" for i in range(40) for h in ("casinobets", "plainname", "m.thename")]
    rows = [(i, u, html if i % 3 else None, "x", "y") for i, u in enumerate([*URLS, *URLS, *more])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, token string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, u, *_ in rows:
        host, path, rule = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == ("block" if rule in urls.BLOCK else "allow")
        assert got[i].verdict in ("allow", "block") and 0 <= got[i].score <= 1
    verdict = {u: got[i].verdict for i, u, *_ in rows}
    assert verdict["http://cheappills.net/en/1"] == "block" and verdict["http://a.net/casino/1"] == "block"
    assert verdict["http://www.plainname.net/en/2"] == "allow" and verdict[more[0]] == "block" and verdict[more[1]] == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def test_segmentation():
    costs = {w: -math.log(1000 / n) for w, n in {"cheap": 50, "pills": 40, "the": 300, "chea": 1}.items()}
    assert urls.segment("cheappills", costs, -math.log(1000)) == ["cheap", "pills"]
    assert urls.segment("", costs, -7.0) == [] and "".join(urls.segment("qthexx" * 10, costs, -7.0)) == "qthexx" * 10


# --- mixing


def mixed_documents(spark, rng):
    texts = {"big": 600, "mid": 60, "small": 15, None: 9, "empty": 3}
    rows, doc = [], 0
    for source, n in texts.items():
        for _ in range(n):
            words = 0 if source == "empty" else rng.randint(1, 40)
            rows.append((doc, " ".join("w" * rng.randint(1, 9) for _ in range(words)) or rng.choice([None, "", " "]), "en", source, None, "x"))
            doc += 1
    rows += rows[-1:] + rows[:3]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, weight string")


def test_mixture_against_sql(spark):
    df = mixed_documents(spark, random.Random(6))
    got = mixing.mix(df).collect()
    con = duckdb.connect()
    con.register("documents_arrow", df.toArrow())
    con.execute("create view documents as select * from documents_arrow")
    result = con.execute(queries.ORACLES["op10_mixture"])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, row)) for row in result.fetchall()]
    line = lambda r: (r["doc_id"], r["turn"], r["block"], r["place"], r["n_tokens"], str(r["source"]), round(r["weight"], 9))
    assert sorted(map(line, (r.asDict() for r in got))) == sorted(map(line, want))
    weights = {r.source: r.weight for r in got}
    assert weights["big"] < 0.9 and max(r.turn for r in got) >= 1
    again = mixing.realise(df).collect()
    assert sorted(r.doc_id for r in again) == sorted(r.doc_id for r in got) and mixing.realise(df).columns == df.columns


@pytest.mark.parametrize("target", [mixing.Target(0.7, None), mixing.Target(1.0, 1.5), mixing.Target(None, 3.0), mixing.Target(0.9, 4.0, 5000.0), mixing.Target(None, None)])
def test_targets_hold(spark, target):
    rows = mixing.measured(mixed_documents(spark, random.Random(7)))
    plan = mixing.weights(rows, target).collect()
    total = sum(r.tokens for r in plan)
    share = [r.tokens / total for r in plan]
    passes = [r.budget / r.tokens for r in plan]
    entropy = -sum(r.weight * math.log(r.weight) for r in plan)
    plain = -sum(s * math.log(s) for s in share)
    assert abs(sum(r.weight for r in plan) - 1) < 1e-9 and all(r.tokens > 0 for r in plan)
    if target.repeats is not None:
        assert max(passes) <= max(target.repeats, (target.budget or total) / total) + 1e-6
    if target.entropy is not None and (target.repeats is None or max(passes) < target.repeats - 1e-3) and plain < target.entropy * math.log(len(plan)):
        assert abs(entropy - target.entropy * math.log(len(plan))) < 1e-6
    if target == mixing.Target(None, None):
        assert all(abs(r.weight - s) < 1e-9 for r, s in zip(plan, share))


def test_blocks_hold_the_weights(spark):
    df = mixed_documents(spark, random.Random(8))
    rows = mixing.mix(df, block_tokens=2000).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, {}).setdefault(r.source, 0)
        blocks[r.block][r.source] += r.n_tokens
    inner = [b for n, b in blocks.items() if 0 < n < max(blocks)]
    assert len(inner) >= 3 and all(abs(sum(b.values()) - 2000) <= 41 * 4 for b in inner)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.realise(df.limit(0)).count() == 0


# --- pipeline


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 1, "call +1 (017) 555-7713 the of and is that with this", "en", "src1", 5)], source.schema)
    docs = source.union(odd).union(odd)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    language, unique, private, mixed, coded = seen
    assert all(f.columns == corpus_pipeline.COLUMNS for f in seen[:4])
    assert language.where("text is null or text = ''").count() == 0 and language.count() >= source.count() - 5
    assert unique.count() == similar.near_duplicates(language).select("root").distinct().count()
    # against all pairs: none that stays is near another that stays, none that goes lacks a near text
    shingled = {(r.doc_id, r.text): shingle_set(r.text) for r in language.collect()}
    kept = {(r.doc_id, r.text) for r in unique.collect()}
    near = lambda a, b, least: len(shingled[a] & shingled[b]) >= least * len(shingled[a] | shingled[b])
    assert not [(a[0], b[0]) for a in kept for b in kept if a < b and near(a, b, 0.85)]
    assert all(any(near(a, b, 0.72) for b in shingled if b != a) for a in shingled if a not in kept)
    assert private.count() == unique.count() and private.where(r"text rlike '555-7713'").count() == 0
    assert private.where("n_chars <> length(text)").count() == 0
    assert mixed.count() > 0.8 * private.count()
    coder = bpe.encoding(bpe.default_ranks(), bpe.default_pattern())
    texts = sorted((r.doc_id, tuple(coder.encode_ordinary(r.text))) for r in mixed.collect())
    assert sorted((r.doc_id, tuple(r.token_ids)) for r in coded.collect()) == texts
    assert coded.where("not exact").count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_tokens_are_coded_and_checked_in_one_pass(spark):
    texts = [None, "", " ", "a  b\tc", "é ß 漢字 ", "<|endoftext|>", " " * 5000 + "x", "ab " * 60000]
    docs = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    coded = corpus_pipeline.tokens(spark, docs, "")
    # each Python step of a task is a worker of its own, which the next stages keep
    assert coded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {r.doc_id: r for r in coded.collect()}
    assert coded.columns == ["doc_id", "source", "n_tokens", "token_ids", "exact"]
    plain = {r.doc_id: r.token_ids for r in bpe.encode(docs).collect()}
    assert {i: r.token_ids for i, r in found.items()} == plain
    assert all(r.exact and r.n_tokens == len(r.token_ids) and r.source == "src1" for r in found.values())
    with pytest.raises(ValueError):
        bpe.encode_checked(docs, into="lang")
    assert bpe.encode_checked(docs.limit(0)).count() == 0


def test_a_worker_keeps_one_set_of_dictionaries():
    first = weakref.ref(langid._loaded((("en", b"the of and"),), langid.LEVEL))
    langid._loaded((("de", b"der die das"),), langid.LEVEL)
    gc.collect()
    assert first() is None


def test_components_leave_no_shuffle_files(spark):
    folders = [Path(p) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held = lambda: {p.name for f in folders for p in f.rglob("shuffle_*")}
    before = held()
    found = graph.components(spark.range(2000).selectExpr("id as a", "id + 3 as b"))
    until = time.time() + 10  # files go in the background
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert found.groupBy("root").count().count() == 3
