"""Numbered operators on texts against brute-force versions, with the awkward rows of every kind."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from scorelake.llm import bpe, graph, langid, licences, minhash, pii, repeats, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, token_ids_ string, words int"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", "s", None, "x", "y", 7) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


AWKWARD = [None, "", " ", "\n\t ", "a", "a b", "a b c", "A b C", "a  b\tc", "é ß 漢字 ", "x" * 5000, "w " * 3000, None, "", "a b c", "…\u3000\u00a0-"]


# --- byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.encoding(bpe.default_ranks(), bpe.default_pattern())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab Z9'\n\t.,é漢　ß st1-\u0301", max_size=200))
def test_parts_keep_every_match(text):
    coder = bpe.encoding(bpe.default_ranks(), bpe.default_pattern())
    ids = [i for part in bpe.parts(text, 10) for i in coder.encode_ordinary(part)]
    assert ids == coder.encode_ordinary(text)


@pytest.mark.parametrize("run", [" " * 5000, "\n" * 5000 + " ", " \u3000" * 3000])
@pytest.mark.parametrize("before", ["", "x", "x ."])
@pytest.mark.parametrize("after", ["", "y", " y", "'s"])
def test_long_white_space(coder, run, before, after):
    text = before + run + after
    assert bpe.encode_text(coder, text) == coder.encode_ordinary(text)


def test_bpe_round_trip(spark, coder):
    texts = [*AWKWARD, "<|endoftext|> is text", "ab " * 60000, " " * 300000 + "end"]
    df = table(spark, texts)
    rows = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    for i, t in enumerate(texts):
        ids = bpe.encode_text(coder, t)
        if len(t or "") < 200000:
            assert ids == coder.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].exact
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.decode(bpe.encode(df))
    assert coded.columns == [*df.columns, "token_ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
    with pytest.raises(ValueError):
        bpe.encode(df, into="words")
    assert bpe.round_trip(df.limit(0)).count() == 0
    assert isinstance(coder, tiktoken.Encoding)


# --- SimHash


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def plain_components(values):
    label = list(range(len(values)))
    near = [[j for j, w in enumerate(values) if bin((v ^ w) & (2**64 - 1)).count("1") <= 2] for v in values]
    for _ in values:
        new = [min(label[j] for j in n) for n in near]
        if new == label:
            break
        label = new
    return label


def test_fingerprints(monkeypatch):
    monkeypatch.setattr("scorelake.llm.texts.PIECE", 40)
    rng = random.Random(2)
    for text in [*AWKWARD, *("".join(rng.choice("ab \n") for _ in range(400)) for _ in range(30))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_pieces_lose_nothing():
    from scorelake.llm import texts

    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.choice(b"abc \n") for _ in range(rng.randint(0, 300)))
        for size in (1, 7, 50):
            parts = list(texts.pieces(data, size))
            assert b"".join(parts) == data
            assert [w for p in parts for w in p.split()] == data.split()
    assert texts.word_hashes(b" ab  ab c").tolist()[0] == texts.word_hashes(b"ab")[0]


@pytest.mark.parametrize("crowd", [1, 8, 10_000])
def test_links_of_dense_and_sparse_groups(spark, crowd):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    chain = rng.getrandbits(64)
    for b in range(0, 60, 2):
        values.add(chain := chain ^ (3 << b))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = graph.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), crowd))
    roots = {r.node: r.root for r in found.collect()}
    assert [roots.get(v, v) for v in values] == [values[i] for i in plain_components(values)]


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [*AWKWARD, base, base, base.replace("word7 ", "other "), base.upper()]
    ids = [None, *range(len(texts) - 1, 0, -1)]
    df = table(spark, texts, ids)
    rows = simhash.near_duplicates(df).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    values = [plain_fingerprint(t) for t in texts]
    groups = plain_components(values)
    first = {g: min((i for i, h in zip(ids, groups) if h == g and i is not None), default=None) for g in groups}
    assert Counter((r.doc_id, r.fp, r.component_id) for r in rows) == Counter((i, v, first[g]) for i, v, g in zip(ids, values, groups))
    kept = simhash.keep_first(df.union(df))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert simhash.keep_first(df.limit(0)).count() == 0
    only_nulls = table(spark, ["a", "a", "b c d e f"], [None, None, None])
    assert sorted(r.text for r in simhash.keep_first(only_nulls).collect()) == ["a", "b c d e f"]


# --- language


def test_language(spark):
    pool = {"en": "the of and is that with this ing tion".split(), "de": "der die und ein schon über nicht ung heit".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(pool[lang]) for _ in range(rng.randint(5, 80))), lang, "s") for i, lang in enumerate(["en", "en", "de"] * 40)]
    train = spark.createDataFrame([*rows, (900, None, "fr", "s"), (901, "12 34", "fr", "s"), (902, "text", None, "s")], "doc_id long, text string, lang string, source string")
    model = langid.fit(train)
    assert list(model) == ["en", "de"] and all(len(v) <= langid.SAMPLE_ROWS * (langid.ROW_CHARS * 4 + 1) for v in model.values())
    texts = [None, "", "123 !?", "the and is", "der die und ein schon nicht ung heit", "THE OF AND!!", "the and " * 50000]
    out = {r.doc_id: r for r in langid.predict(table(spark, texts), model).collect()}
    assert [out[i].lang_pred for i in range(7)] == ["und", "und", "und", "en", "de", "en", "en"]
    assert all(0 <= r.score <= 1 for r in out.values()) and [out[i].rejected for i in range(4)] == [True, True, True, False]
    assert sorted(r.doc_id for r in langid.keep_recognised(table(spark, texts), model).collect()) == [3, 4, 5, 6]
    assert langid.fit(train.limit(0)) == {}
    assert {r.lang_pred for r in langid.predict(table(spark, texts), {}).collect()} == {"und"}
    held = spark.createDataFrame([(i, " ".join(rng.choice(pool[lang]) for _ in range(20)), lang, "s") for i, lang in enumerate(["en", "de"] * 30)], train.schema)
    good = held.join(langid.predict(held, model), "doc_id").where("lang = lang_pred").count()
    assert good >= 58


def language_halves():
    """(dictionaries, held-out rows): halves of the driver's documents that have a letter."""
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if langid.plain(r["text"] or "").strip()]
    random.Random(3).shuffle(rows)
    content = {}
    for r in rows[::2]:
        content.setdefault(r["lang"], []).append(r["text"][: langid.ROW_CHARS])
    return {k: langid.plain("\n".join(v[: langid.SAMPLE_ROWS])).encode() for k, v in content.items()}, rows[1::2]


def test_language_of_long_texts(spark):
    content, held = language_halves()
    rng, texts, langs = random.Random(9), [], ["en", "fr"]
    for lang in langs:
        words = [w for r in held if r["lang"] == lang for w in r["text"].split()]
        texts += [" ".join(rng.choice(words) for _ in range(n // 5)) for n in (1000, 4_000_000)]
    out = {r.doc_id: r for r in langid.predict(table(spark, texts), content).collect()}
    assert [out[i].lang_pred for i in range(4)] == ["en", "en", "fr", "fr"] and not any(r.rejected for r in out.values())
    assert out[1].score > 0.5 * out[0].score and out[3].score > 0.5 * out[2].score
    for text in ("", "a", "a b " * 3000, "é" * 5000, texts[1]):
        raw = text.encode()
        assert b"".join(langid.blocks(raw)) == raw and all(0 < len(p) <= langid.BLOCK for p in langid.blocks(raw))


def test_language_margin_at_every_length(spark):
    content, held = language_halves()
    rng, letters = random.Random(7), "abcdefghijklmnopqrstuvwxyz"
    polish = "i w na nie to że jest jak ale czy przez tylko już może być jego które kiedy bardzo jeszcze można trzeba dzień życie człowiek świat wielki nowy pierwszy".split()
    makers = [
        lambda: rng.choice(polish),
        lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9))),
        lambda: "".join(chr(rng.randint(0x430, 0x44F)) for _ in range(rng.randint(2, 9))),
    ]
    for n, most in ((100, 0.8), (300, 0.9), (600, 0.9), (1500, 0.9)):
        texts = [" ".join(make() for _ in range(n))[:n] for make in makers for _ in range(60)]
        out = {r.doc_id: r.rejected for r in langid.predict(table(spark, texts), content).collect()}
        assert all(sum(out[i] for i in range(k, k + 60)) >= most * 60 for k in (0, 60, 120))
    rows = langid.predict(table(spark, [r["text"] for r in held]), content).collect()
    assert sum(r.rejected for r in rows) <= 0.02 * len(held)
    short = [" ".join(r["text"].split()[:8]) for r in held if len(r["text"].split()) > 8]
    assert sum(r.rejected for r in langid.predict(table(spark, short), content).collect()) <= 0.05 * len(short)


def test_language_sample_is_not_used_up_by_copies(spark):
    texts = [f"text{chr(97 + i // 26)}{chr(97 + i % 26)} " * 3 for i in range(60)]
    rows = [(t, "en") for i, t in enumerate(texts) for _ in range(40 if i % 2 else 1)] + [("only one", "de")] * 500
    train = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for sample_rows, found in ((20, 20), (100, 60)):
        model = langid.fit(train, sample_rows=sample_rows, row_chars=1000)
        assert list(model) == ["en", "de"] and model["de"] == b"only one" and len(set(model["en"].split())) == found


# --- MinHash


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] or sets[1] else 1.0


@pytest.mark.parametrize("range_rows", [2, 7, 1000])
def test_minhash_with_edits(spark, range_rows):
    rng = random.Random(range_rows)
    texts = [*AWKWARD, *(" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(rng.randint(1, 300))) for _ in range(30))]
    ids = [3 * i for i in range(len(texts))]
    rows = {r.doc_id: r for r in minhash.with_edits(table(spark, texts, ids), range_rows=range_rows).collect()}
    assert sorted(rows) == ids
    for i, (doc, text) in enumerate(zip(ids, texts)):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        r = rows[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == minhash.fingerprint(text) and r.edited_fingerprint == minhash.fingerprint(edited)
        assert abs(r.near_edited - jaccard(text, edited)) < 0.15 and abs(r.near_next - jaccard(text, after)) < 0.15


def test_minhash_awkward_ids(spark):
    rows = minhash.with_edits(table(spark, ["b b b b", "a a a a", "c", "d", "d"], [1, 1, None, None, 5]), range_rows=1).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 1), (0, 1), (1, 7), (1, 7), (5, 1)]
    one = minhash.with_edits(table(spark, ["only one here"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert minhash.with_edits(table(spark, []).limit(0)).count() == 0
    assert len(minhash.with_edits(table(spark, ["x", "y"], [None, None])).collect()) == 2
    assert {r.fingerprint for r in minhash.fingerprints(table(spark, ["p q", "p  q"])).collect()} == {minhash.fingerprint("p q")}


# --- substring dedup


def plain_repeats(rows, size=13):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        for p in range(len(w) - size + 1):
            if doc is not None:
                k = tuple(w[p : p + size])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[p : p + size])] < doc:
                gone[p : p + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group_rows", [1, 4, 1000])
def test_repeats(spark, group_rows):
    rng = random.Random(group_rows)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(13, 60))] for k in range(5)]
    texts = list(AWKWARD)
    for _ in range(40):
        words = [f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            s = rng.randint(0, 5)
            words[rng.randint(0, len(words)) :][:0] = []
            words += p[s : s + rng.randint(10, 60)] + [f"y{rng.randint(0, 10**6)}"]
        texts.append(" ".join(words))
    texts += [texts[20], texts[20].replace(" ", "\n"), "r " * 40, "r " * 14, "r " * 13, "r " * 12]
    ids = [rng.choice([*range(30), None]) for _ in texts]
    got = repeats.repeats(table(spark, texts, ids), group_rows=group_rows, with_text=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_repeats(list(zip(ids, texts)))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert all(r.n_removed == sum(int(b) - int(a) for a, b in (x.split(":") for x in r.removed.split(",") if x)) for r in got)
    assert repeats.repeats(table(spark, texts, ids).limit(0)).count() == 0


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            odd = [int(c) for c in d[-1::-2]] + [sum(divmod(2 * int(c), 10)) for c in d[-2::-2]]
            return 12 <= len(d) <= 19 and sum(odd) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end(), n) for k, (n, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(n, m.group()))


def base_digest(text):
    return hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in plain_spans(text)).encode()).hexdigest()


PERSONAL = [
    "mail a.b@c.de, x@y, a@b.c@d.e a@b.c_x@d.e é漢 q@r.s..t", "10.0.0.1 300.1.1.1 1.2.3.4.5 0001.002.3.04 1.2.3 ::1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111",
    "+1 (017) 555-7713 +49 30 123456. +1 2 +123456789012345678 ++4912345678", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "ssn 123-45-6789 and Dr. Hans Müller wrote",
    "Thretionorthinganoreaingly averyveryverylongwordwithoutanydigits", "1" * 20000, "1 " * 9000, "a" * 20000 + "@" + "b." * 3000 + "c", "+1" + "(" * 20000 + "2", "x" * 300000,
]


def test_personal_data(spark):
    rng = random.Random(9)
    noise = ["".join(rng.choice("a1.@+- 9(é") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts = [*AWKWARD, *PERSONAL, *noise, *['key: "%040x" end' % rng.getrandbits(160) for _ in range(40)]]
    df = table(spark, texts)
    rows = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        counts = Counter(n for *_, n in plain_spans(t))
        assert rows[i].base_sha256 == base_digest(t), t[:80]
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(counts[k] for k in PLAIN)
        places = [tuple(map(int, s.split(":")[1:])) for s in rows[i].spans.split(",") if s]
        assert places == sorted(places, key=lambda p: p[0]) and all(0 <= a < b <= len(t) for a, b in places)
    assert "secret:9:49" in rows[len(AWKWARD) + 4].spans and "secret" not in rows[len(AWKWARD) + 6].spans
    clean = pii.redact(df)
    assert clean.columns == df.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[0] is None and text[4] == "a" and text[len(AWKWARD) + 4] == 'token = "[secret]" here'
    assert text[len(AWKWARD) + 2].startswith("[card] and ") and all("@c.de" not in (t or "") for t in text.values())
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
    assert pii.redact(df.limit(0).union(table(spark, [None]))).first().text is None


def test_reliabilities_find_the_good_labeler():
    rng = random.Random(3)
    counts = Counter()
    for _ in range(4000):
        true = rng.random() < 0.3
        vote = lambda right: (1 if true else -1) * (1 if rng.random() < right else -1)
        counts["k|" + "|".join(map(str, (vote(0.95), vote(0.85), vote(0.8), vote(0.5))))] += 1
    odds = pii.reliabilities(list(counts.items()))["k"]["odds"]
    strength = [o[1] - o[-1] for o in odds]
    assert strength[0] > strength[1] > strength[3] and abs(strength[3]) < 1.0


# --- licences


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), sorted((i, label) for p, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def test_licences(spark):
    texts = [
        *AWKWARD, "cc by", "CC-BY cc by-NC 4.0 cc", "the general public license, GENERAL public license", "all rights all rights reserved. İ K", "rights reserved", "Licensed under CC BY-NC 4.0.",
        "Released under the MIT License.", "x " * 50 + "Licensed under the Apache License, Version 2.0. " * 300, "apache released license under the", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "all rights reserved " * 2000, "general public", "under",
    ]
    rows = {r.doc_id: r for r in licences.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, places = plain_places(t)
        r = rows[i]
        want = (n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, t[:60]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    named = {texts[i]: r.labels for i, r in rows.items() if texts[i]}
    assert named["Licensed under CC BY-NC 4.0."] == "cc-by,cc-by-nc" and named["Released under the MIT License."] == "mit"
    assert named["apache released license under the"] == "" and rows[texts.index(next(t for t in texts if t and "Apache" in t))].labels == "apache-2.0"
    assert licences.scan(table(spark, texts).limit(0)).count() == 0
