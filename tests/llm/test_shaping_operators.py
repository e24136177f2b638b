"""Centroid clustering, packing and fill-in-middle against brute-force versions, with the awkward rows of every kind."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorelake.llm import clusters, infill, langid, mixing, packing, simhash, urls

# --- centroid clustering


def plain_clusters(rows, k=8, rounds=10):
    """Every distance of every vector to every centroid, in Python integers."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**40 else 1024 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        centres = [
            [sum(col) // len(mine) for col in zip(*mine)] if (mine := [v for (_, v), o in zip(kept, own) if o == n]) else c for n, c in enumerate(centres)
        ]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    most = 2**63 - 1
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += min(d, most)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, n, min(d, most), min(inertia[n], most), min(sum(inertia.values()), most), names[n]) for i, n, d in found]


def order(rows):
    return sorted(rows, key=repr)


def vectors(spark, rows):
    """Vectors with extra columns whose names the operator uses inside."""
    data = [(i, v, "a", 1, 2, "b") for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, sums string, count int, cluster int, h string").repartition(5)


AWKWARD_VECTORS = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] + [1.0] * 63), (905, [None] + [1.0] * 63), (906, [float("inf")] * 64), (907, [0.0] * 64), (None, [0.5] * 64)]


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(120)]
    hot = rng.standard_normal(64).astype(np.float32).tolist()
    rows += [(i, hot) for i in range(200, 260)] + rows[:5] + AWKWARD_VECTORS
    got = [tuple(r) for r in clusters.cluster(vectors(spark, rows)).collect()]
    assert order(got) == order(plain_clusters(rows))


def test_clusters_of_huge_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(64) * 10.0 ** float(rng.integers(0, 37))).astype(np.float32).tolist()) for i in range(40)]
    got = [tuple(r) for r in clusters.cluster(vectors(spark, rows)).collect()]
    assert order(got) == order(plain_clusters(rows)) and max(r[2] for r in got) == 2**63 - 1


@pytest.mark.parametrize("rows", [[], AWKWARD_VECTORS[:7], [(1, [1.0] * 64)], [(1, [1.0] * 64)] * 3 + [(2, [2.0] * 64)], [(None, [1.0] * 64)]])
def test_clusters_of_few(spark, rows):
    got = [tuple(r) for r in clusters.cluster(vectors(spark, rows)).collect()]
    assert order(got) == (order(plain_clusters(rows)) if any(i == 1 for i, _ in rows) else [])


def test_merging_of_many_tasks(spark):
    rows = [(i, [float(i % 7 + j % 3) for j in range(64)]) for i in range(300)]
    df = vectors(spark, rows).repartition(100)
    first = clusters.start(df)
    total = clusters._merged(clusters.sums(df, first), 100)
    assert sum(n for n, _ in total.values()) == 300
    assert [sum(v[j] for _, v in total.values()) for j in range(64)] == [1024 * sum(int(r[1][j]) for r in rows) for j in range(64)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=64, max_size=64), min_size=1, max_size=12), st.integers(1, 4), st.integers(0, 2**32))
def test_search_is_exact(rows, k, seed):
    rng = np.random.default_rng(seed)
    values = np.array(rows)
    centres = values[rng.integers(0, len(values), size=k)] + rng.integers(-1, 2, size=(k, 64))
    label, distance = clusters.search(values, centres)
    plain = ((values[:, None] - centres[None]) ** 2).sum(axis=2)
    assert label.tolist() == plain.argmin(axis=1).tolist() and distance.tolist() == plain.min(axis=1).tolist()
    as_objects = clusters.search(values.astype(object), centres)
    assert as_objects[0].tolist() == label.tolist() and as_objects[1].tolist() == distance.tolist()


def test_transform_is_coarse_to_fine():
    values = np.arange(64, dtype=np.int64)[None] ** 2
    out = clusters.transform(values)
    assert (out * out).sum() == 64 * (values * values).sum() and out[0, 0] == values.sum()
    # a smooth vector has its weight in the leading coefficients
    assert (out[0, :8] ** 2).sum() > 0.99 * (out**2).sum()


def test_limit_of_64_bits():
    edge = clusters.safe(64) - 1
    values, centres = np.array([[edge] * 64, [-edge] * 64]), np.array([[-edge] * 64, [edge] * 64, [edge - 1] * 64])
    label, distance = clusters.search(values, centres)
    assert label.tolist() == [1, 0] and distance.tolist() == [0, 0]
    assert clusters.search(values[:1], centres[:1])[1].tolist() == [64 * (2 * edge) ** 2]


# --- packing


def plain_filling(lengths, capacity):
    """Best-two-fit, one sequence after the other over single pieces; the sorted lengths of each."""
    left, out = sorted(lengths), []
    while left:
        bin_, gap = [], capacity
        for n in reversed(left):
            if n <= gap:
                bin_.append(n)
                gap -= n
        rest = list((Counter(left) - Counter(bin_)).elements())
        if gap and len(bin_) > 1:
            room, small = gap + bin_[-1], bin_[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(rest) for b in rest[:i] + rest[i + 1 :] if a >= b and small < a + b <= room]
            if pairs:
                bin_[-1:] = max(pairs)[1:]
        left = sorted((Counter(left) - Counter(bin_)).elements())
        out.append(tuple(sorted(bin_)))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_fillings_are_those_of_single_pieces(lengths):
    got = [tuple(sorted(Counter(f).elements())) for times, f in packing.fillings(Counter(lengths), 30) for _ in range(times)]
    assert sorted(got) == plain_filling(lengths, 30)


def test_plan_is_small_and_tight():
    rng = np.random.default_rng(3)
    for counts in (
        {n: int(c) for n, c in enumerate(rng.integers(1, 10**9, size=4096), 1)},
        dict(Counter(np.minimum(4096, rng.lognormal(5.5, 1.2, 200_000).astype(int) + 1).tolist())),
    ):
        plan = packing.Plan(counts, 4096)
        least = -(-sum(n * c for n, c in counts.items()) // 4096)
        assert plan.first.size < 200_000 and least <= plan.sequences <= 1.01 * least + 2


def check_packed(rows, capacity):
    """Every sequence is filled from 0 without gaps or overlaps."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return held


TEXTS = [
    None, "", " \n\t", "a", "a b c", "A  B\tc", "x" * 5000, "word " * 6000, "don't 'stop' <|endoftext|> <|startoftext|>x", "É é 漢字かな　x\x1cy", "1234567890" * 30, "a b c",
    "https://a.example/b?c=d&e=f_g-h." * 5000, "it's...?!" * 20, "́x ́ 'S 'RE'll", "a b c", "", "ß İ ΑΣ ΑΣ. Σ", "\x0b\x0c\x85x",
]


def test_pieces_are_the_librarys(spark):
    own = Tokenizer.from_file(packing.default_tokenizer())
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece string, length int, ids int")
    got = {}
    for r in packing.pieces(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(got[i], key=lambda r: r.piece)
        assert [n for r in parts for n in r.ids] == ids, t[:50]
        assert [r.length for r in parts] == [len(ids[s : s + 4096]) for s in range(0, len(ids), 4096)] and [r.start for r in parts] == [4096 * r.piece for r in parts]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in parts)
    assert packing.pieces(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="abJÉ'stREvd.,-1é́\u030c漢 \n\x1c　<|>ßΣİıª²\xa0\x85", max_size=60), st.text(st.characters(max_codepoint=0x24F), max_size=60), st.text(max_size=30)), max_size=4))
def test_units_keep_every_token(texts):
    own = packing.coder(packing.default_tokenizer())
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in own.encode(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_classes_of_short_characters():
    own = packing.coder(packing.default_tokenizer())
    for code in range(0x250):
        text = f"x{chr(code)}1{chr(code)}.{chr(code)}{chr(code)} '{chr(code)}"
        assert np.frombuffer(own.encode([text])[0], dtype="<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, code


def test_table_of_units_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_UNITS", 50)
    monkeypatch.setattr(packing, "SPAN_CHARS", 200)
    own = packing.Coder(packing.default_tokenizer())
    text = " ".join(f"word{i % 170} the Été {'x' * 70}" for i in range(600))
    assert np.frombuffer(own.encode([text, None, text])[2], dtype="<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.known) < 300 and len(own.older) < 300


def test_very_long_text(spark):
    words = " ".join(f"w{i} and{i % 977}" for i in range(600_000))
    df = spark.createDataFrame([(1, words)], "doc_id long, text string")
    rows = packing.pack(packing.pieces(df, with_ids=False)).collect()
    check_packed(rows, 4096)
    own = packing.coder(packing.default_tokenizer())
    assert sum(r.length for r in rows) == len(own.tokenizer.encode(words, add_special_tokens=False).ids) + 1 and sum(r.length < 4096 for r in rows) <= 1


def test_pack(spark):
    rng = np.random.default_rng(9)
    lengths = [*rng.integers(1, 65, size=700).tolist(), *[17] * 900, *[64] * 50, 1, 1, 1]
    rows = [(None if i % 9 == 0 else i // 2, n, "x", "y", 3) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, length long, row string, number string, bucket int").repartition(7)
    got = packing.pack(df, capacity=64).collect()
    held = check_packed(got, 64)
    assert sorted((r.doc_id or -1, r.length, r.row) for r in got) == sorted((r[0] or -1, r[1], r[2]) for r in rows)
    assert sorted(tuple(sorted(n for _, n in p)) for p in held.values()) == plain_filling(lengths, 64)


def test_pack_refuses(spark):
    df = spark.createDataFrame([(1, 5)], "a long, length long")
    assert packing.pack(df.limit(0)).count() == 0
    for bad in (df.withColumn("length", F.lit(None).cast("long")), df.withColumn("length", F.lit(0)), df.withColumn("length", F.lit(4097)), df.withColumn("offset", F.lit(0))):
        with pytest.raises(ValueError):
            packing.pack(bad)


def test_sequences(spark):
    texts = ["some words of a text " * (i % 40) for i in range(200)] + [None, "long " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = packing.pack(packing.pieces(df, capacity=512), capacity=512)
    ids = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    own = Tokenizer.from_file(packing.default_tokenizer())
    docs = {}
    for r in packed.collect():
        docs.setdefault(r.doc_id, {})[r.piece] = ids[r.sequence_id][r.offset : r.offset + r.length]
    for i, t in enumerate(texts):
        assert [n for p in sorted(docs[i]) for n in docs[i][p]] == own.encode(t or "", add_special_tokens=False).ids + [1]


# --- fill-in-middle


def plain_infill(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


INFILL = [None, "", " ", "a", "<P>", "x<S>y", "<M", "<P<S<M", "<<S>>"[:2], "ab cd, ef", "é漢字 a\n\r\tb́", "\U0001f600x\U0001f600", "word " * 50, "x" * 70000, ", " * 40000, "ab, c" * 30000, "a b" * 21845 + "a", "<" * 100, "P>S>M>", "KK ſ"]


def test_infill(spark):
    texts = [*INFILL * 6, "long words, here. " * 200_000]
    rows = [(None if i == 40 else i // 2 if i < 30 else i, t, "x", "y", 1, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, form string, n int, row_key string")
    made = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted((repr(tuple(r)[:6]), r.back) for r in made.collect())
    assert got == sorted((repr((i, *plain_infill(i, t))), t or "") for i, t, *_ in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in made.select("form").distinct().collect()}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=80), st.sets(st.tuples(st.integers(0, 200_000), st.integers(1, 9000)), max_size=6), st.integers(1, 3))
def test_position_set(single, ranges, every):
    places = np.unique([*single, *(p for lo, n in ranges for p in range(lo, lo + n, every))]).astype(np.int64)
    found = infill.PositionSet()
    for span in np.unique(places >> 16).tolist():
        found.add_span(span, places[places >> 16 == span] & 0xFFFF)
    assert len(found) == places.size
    for i in {0, places.size // 3, places.size // 2, places.size - 1} & set(range(places.size)):
        assert found.select(i) == places[i]
    for i in (-1, places.size):
        with pytest.raises(IndexError):
            found.select(i)


def test_containers_are_the_smallest():
    assert isinstance(infill.part_of(np.arange(0, 9000, 3)), infill.ArrayPart)
    assert isinstance(infill.part_of(np.arange(0, 65536, 2)), infill.BitmapPart)
    assert isinstance(infill.part_of(np.arange(100, 65000)), infill.RunPart)
    for low in (np.arange(0, 9000, 3), np.arange(0, 65536, 2), np.arange(100, 65000), np.array([65535])):
        part = infill.part_of(low)
        assert [part.select(i) for i in range(0, low.size, 7)] == low[::7].tolist()


# --- helpers of earlier operators: clashing names, letters, sizes


CLASHING = "doc_id long, text string, source string, row_hash string, copy_no int, id string, hash string, first string, row string, copy string, fp string, root string, mix_copy string, mix_key int, passes string, h string, end string, source_key string, text_hash string, turn string, first_id string"


def clashing(spark, texts):
    names = [f.split()[0] for f in CLASHING.split(", ")][3:]
    rows = [(i, t, f"s{i % 3}", *(7 if n in ("copy_no", "mix_key") else f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING), rows


def test_clashing_names_come_back(spark):
    texts = [f"one text about thing {i} and some more words of its own {i * i}" for i in range(30)]
    df, rows = clashing(spark, [*texts, texts[3], texts[3], None, ""])
    kept = sorted(map(tuple, simhash.keep_first(df).collect()), key=lambda r: r[0])
    assert set(kept) <= set(rows) and len(kept) == len({r[0] for r in kept}) and {r[0] for r in kept} >= {0, 3, 32} and not {30, 31, 33} & {r[0] for r in kept}
    mixed = [tuple(r) for r in mixing.realise(df).collect()]
    assert mixed and set(mixed) <= set(rows)
    plain = mixing.realise(df.select("doc_id", "text", "source")).collect()
    assert sorted(r[0] for r in mixed) == sorted(r.doc_id for r in plain)


@pytest.mark.parametrize("text", ["½", "² ³", "Ⅷ", "12 ½ 7", "①", "٣", "", " ", "…-", "\u0301"])
def test_texts_without_a_letter_have_no_language(spark, text):
    coders = langid.Compressors({"en": b"the words of a language " * 20, "fr": b"les mots de la langue " * 20}, 6)
    assert coders.judge(text, 0.05) == ("und", 0.0, True)
    assert coders.judge(text + " words of the language", 0.05)[0] == "en"


def test_sample_is_the_same_by_buckets(spark):
    rows = [(f"text number {i} with words {i * 7}", "en" if i % 10 else "fr") for i in range(700)]
    df = spark.createDataFrame(rows, "text string, lang string")
    content = langid.fit(df, sample_rows=20)
    hashed = df.select("text", "lang", F.xxhash64("text").alias("h")).orderBy("h").collect()
    for lang in ("en", "fr"):
        want = sorted([r for r in hashed if r.lang == lang][:20], key=lambda r: (r.lang, r.h))
        assert content[lang].decode() == langid.plain("\n".join(r.text for r in want))


def test_segmentation_is_alike_at_every_size(spark):
    words = {"a": 50_000, "the": 60_000, "be": 4000, "t": 900, "por": 300, "n": 800, "lo": 200, "an": 9000, "se": 500, "x": 400, "plain": 70, "name": 90, "cheapest": 3, "of": 30_000, "w": 944_000}
    labels = spark.createDataFrame([(w,) for w in [*urls.BAD_WORDS.split(), "casinobets", "plainname", "thecheapest", "loanshark", "sexname", "zzyzx"]], "label string")
    seeds = spark.createDataFrame([(w, 0) for w in urls.BAD_WORDS.split()], "word string, n long")

    def split(times):
        counts = spark.createDataFrame([(w, n * times) for w, n in words.items()], "word string, n long").union(seeds)
        return {r.label: r.words for r in urls.split_labels(labels, counts).collect()}

    once = split(1)
    assert once == split(100) == split(10_000)
    assert all(once[w] == [w] for w in urls.BAD_WORDS.split()) and once["casinobets"] == ["casino", "bets"] and once["plainname"] == ["plain", "name"]


def test_hot_hosts_are_judged_alike(spark):
    rows = [(i, f"http://{h}.net/en/{i}", "<p>the plain name cheap pills</p>") for i in range(300) for h in (["casinobets"] if i % 3 else [f"name{'abc'[i % 2]}x{i}"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, urls.judge(df).collect()))
    hot, urls.HOT = urls.HOT, 1
    try:
        assert sorted(map(tuple, urls.judge(df).collect())) == got
    finally:
        urls.HOT = hot
