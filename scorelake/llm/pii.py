"""Personal data by weak supervision, in DataFrame functions only.

Base kinds come from patterns and checks: email, ip, card, phone. The method adds kinds the patterns
alone would get wrong: secret (keys and tokens), ident (numbers like 123-45-6789) and person.

Candidates of all kinds are put to four labelers that vote 1, 0 or -1: `shape` (a strict pattern),
`cue` (gazetteer words just before), `frame` (quotes and separators around) and `mixture` (what
characters it is made of). Vote counts by kind, at most 81 a kind, go to the driver, where
expectation-maximisation estimates how reliable each labeler is for each kind. The posteriors are
soft labels of a naive Bayes span classifier over votes and surface features (length, share of
digits, neighbouring characters). It decides on the added kinds; base spans stay whatever it says.

Offsets are code points, ends exclusive. Each pattern is applied once from left to right; a match
that fails its check is dropped. Added spans that overlap a base span are left out. A null text
counts as empty. Repeated rows are judged alike. Extra columns are left out by `find`, kept by
`redact`. Quantifiers are possessive where nothing could be given back, so that long runs take
linear time and no stack.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from scorelake.functions.binding import let
from scorelake.session import materialise as cut

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ident", "person")
KINDS = BASE + ADDED
LABELERS = ("shape", "cue", "frame", "mixture")
FEATURES = ("length", "digits", "left", "right")
ROUNDS = 30
KEPT = 0.5

# fixed values: gazetteers
CUES = {
    "email": "mail e-mail email contact contacto kontakt courriel write",
    "ip": "ip host server address adresse login from",
    "card": "card visa mastercard amex credit karte carte tarjeta",
    "phone": "phone tel call fax mobile telefon handy llame numéro",
    "secret": "token key secret password passwd apikey credential bearer auth",
    "ident": "ssn social security id number no",
    "person": "name named called dear von by signed author regards",
}
HONORIFICS = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora"
FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Susan Thomas Karen Peter Anna "
    "Hans Klaus Jürgen Ursula Pierre Marie Jean Claire José María Carlos Carmen Luis Ana"
)

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_NAME = r"\p{Lu}\p{Ll}++"
_RUN = "A-Za-z0-9+/_-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<![{_RUN}])[{_RUN}]{{20,}}+",
    "ident": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{HONORIFICS.replace(' ', '|')})\.? {_NAME}|(?:{FIRST_NAMES.replace(' ', '|')}))(?: {_NAME})?+",
}
#: a text without this character class has no match
_NEEDS = {"email": "@", "phone": "+"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(m).between(12, 37) & F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,kind_no:int,stop:int,kind:string,match:string,left:string,right:string>>"


def spans(text: Column, kind: str) -> Column:
    """Array of (start, kind_no, stop, kind, match, left, right): valid matches with what stands around them."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    steps = let(
        F.split(text, PATTERNS[kind], -1),
        lambda pieces: F.transform(
            found,
            lambda m, i: F.struct(
                F.length(F.get(pieces, i)).alias("skip"), F.length(m).alias("size"), _valid(kind, m).alias("valid"), m.alias("match"),
                F.right(F.get(pieces, i), F.lit(24)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(4)).alias("right"),
            ),
        ),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["skip"]
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (start + x["size"]).alias("stop"), F.lit(kind).alias("kind"),
            x["match"].alias("match"), x["left"].alias("left"), x["right"].alias("right"),
        )
        more = F.when(x["valid"], F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct((start + x["size"]).alias("at"), more.cast(_SPAN).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    walked = F.aggregate(steps, start, step, lambda s: s["out"])
    none = F.array().cast(_SPAN)
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), walked).otherwise(none) if kind in _NEEDS else walked


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _by_kind(kind: Column, choices: dict[str, Column], other: Column) -> Column:
    chain = None
    for name, value in choices.items():
        chain = F.when(kind == name, value) if chain is None else chain.when(kind == name, value)
    return chain.otherwise(other)


def votes(s: Column) -> dict[str, Column]:
    """The labelers' votes on a span."""
    m, kind, left, right = s["match"], s["kind"], s["left"], s["right"]
    shape = _by_kind(
        kind,
        {
            "email": _vote(m.rlike(r"\.[A-Za-z]{2,12}$"), m.rlike(r"\.[0-9]+$")),
            "ip": _vote(m.rlike(r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"), m.rlike(r"(?:^|\.)0[0-9]")),
            "card": _vote(m.rlike(r"^[3-6]") & F.length(_digits(m)).between(13, 16), m.rlike("^0")),
            "phone": _vote(m.rlike(r"^\+[1-9]"), m.rlike(r"^\+0")),
            "secret": _vote(m.rlike(r"^(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{20,}+)$"), ~m.rlike("[0-9]")),
            "ident": _vote(~m.rlike("^(?:000|666|9)|-00-|-0000$"), m.rlike("^(?:000|666|9)|-00-|-0000$")),
            "person": _vote(m.rlike(rf"^(?:{HONORIFICS.replace(' ', '|')})\.? "), ~m.rlike(" ")),
        },
        F.lit(0),
    )
    cues = {k: left.rlike(r"(?i)(?:^|[^\p{L}])(?:" + "|".join(w.split()) + r")(?:$|[^\p{L}])") for k, w in CUES.items()}
    cue = _by_kind(kind, {k: _vote(c, F.lit(False)) for k, c in cues.items()}, F.lit(0))
    frame = _by_kind(
        kind,
        {
            "secret": _vote(left.rlike(r"[=:]\s*[\"']?$"), left.rlike(r"(?:^|\s)$") & (right.rlike(r"^[\s.,;!?]") | (right == ""))),
            "person": _vote(left.rlike(r"(?:^|[\s(\"])$") & ~right.rlike(r"^\p{L}"), right.rlike(r"^\p{L}")),
        },
        _vote((left.rlike(r"(?:^|[\s(\[<:\"'|])$")) & ~right.rlike("^[A-Za-z0-9]"), left.rlike("[A-Za-z0-9.]$") | right.rlike("^[A-Za-z0-9]")),
    )
    kinds_of_character = F.size(F.array_distinct(F.split(F.lower(m), "")))
    mixture = _by_kind(
        kind,
        {
            "secret": _vote(m.rlike("[0-9].*[0-9].*[0-9]") & m.rlike("[A-Za-z]") & (kinds_of_character >= 8), ~m.rlike("[0-9]") | (kinds_of_character < 5)),
            "email": _vote(kinds_of_character >= 6, kinds_of_character < 4),
            "person": _vote(F.length(m) >= 8, F.length(m) < 5),
        },
        _vote(F.size(F.array_distinct(F.split(_digits(m), ""))) >= 3, F.size(F.array_distinct(F.split(_digits(m), ""))) < 2),
    )
    return {"shape": shape, "cue": cue, "frame": frame, "mixture": mixture}


def features(s: Column) -> dict[str, Column]:
    """Surface features of a span, a few values each."""
    m = s["match"]
    side = lambda c: F.when(c == "", "edge").when(c.rlike(r"^\s$"), "space").when(c.rlike(r"^[\"'=:]$"), "quote").when(c.rlike(r"^[\p{L}\p{N}]$"), "word").otherwise("mark")
    share = F.floor(4 * F.length(_digits(m)) / F.length(m)).cast("string")
    length = F.when(F.length(m) < 12, "0").when(F.length(m) < 20, "1").when(F.length(m) < 32, "2").when(F.length(m) < 48, "3").otherwise("4")
    return {"length": length, "digits": share, "left": side(F.right(s["left"], F.lit(1))), "right": side(F.left(s["right"], F.lit(1)))}


def candidates(text: Column) -> Column:
    """Array of all kinds' candidates in a text, each with its vote pattern and features."""
    whole = F.coalesce(text, F.lit(""))

    def judged(s: Column) -> Column:
        pattern = F.concat_ws("|", s["kind"], *(v.cast("string") for v in votes(s).values()))
        return F.struct(s["start"], s["kind_no"], s["stop"], s["kind"], pattern.alias("pattern"), *(v.alias(n) for n, v in features(s).items()))

    return F.transform(F.concat(*(spans(whole, k) for k in KINDS)), judged)


def reliabilities(counts: list[tuple[str, int]], rounds: int = ROUNDS) -> dict[str, dict]:
    """Expectation-maximisation over counts of vote patterns ('kind|v1|v2|v3|v4').

    Per kind: the share of true spans and, for either class, how often each labeler gives each vote.
    Labelers start, and are smoothed, as a little better than chance.
    """
    model: dict[str, dict] = {}
    for kind, group in itertools.groupby(sorted(counts), key=lambda x: x[0].split("|")[0]):
        rows = [(tuple(map(int, p.split("|")[1:])), n) for p, n in group]
        belief = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows]
        for _ in range(rounds):
            true = sum(n * b for (_, n), b in zip(rows, belief))
            false = sum(n for _, n in rows) - true
            prior = (true + 1) / (true + false + 2)
            odds = []
            for j in range(len(LABELERS)):
                seen = {v: [2.0 if v == 1 else 1.0, 2.0 if v == -1 else 1.0] for v in (-1, 0, 1)}
                for (vote, n), b in zip(rows, belief):
                    seen[vote[j]][0] += n * b
                    seen[vote[j]][1] += n * (1 - b)
                odds.append({v: math.log(seen[v][0] / (true + 4)) - math.log(seen[v][1] / (false + 4)) for v in seen})
            start = math.log(prior / (1 - prior))
            belief = [_belief(start + sum(o[v] for o, v in zip(odds, vote))) for vote, _ in rows]
        model[kind] = {"prior": start, "odds": odds}
    return model


def _belief(logit: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def _table(values: dict[str, float]) -> Column:
    """A literal lookup; its size is bounded by kinds, votes and feature values."""
    return F.create_map(*(F.lit(x) for item in (values or {"": 0.0}).items() for x in item))


def train(found: DataFrame) -> dict[str, dict[str, float]]:
    """Scores of vote patterns and of feature values ('kind|feature|value'), as log odds, from a column `spans`."""
    each = found.select(F.explode("spans").alias("s"))
    counts = [(r[0], r[1]) for r in each.groupBy("s.pattern").agg(F.count(F.lit(1))).collect()]  # 81 a kind at most
    model = reliabilities(counts)
    patterns = {}
    for pattern, _ in counts:
        kind, *vote = pattern.split("|")
        patterns[pattern] = model[kind]["prior"] + sum(o[int(v)] for o, v in zip(model[kind]["odds"], vote))
    belief = F.try_element_at(_table({p: _belief(x) for p, x in patterns.items()}), F.col("s.pattern"))
    named = F.array(*(F.struct(F.concat_ws("|", "s.kind", F.lit(n)).alias("field"), F.col(f"s.{n}").alias("value")) for n in FEATURES))
    sums = each.select(F.explode(named).alias("f"), belief.alias("b")).groupBy("f.field", "f.value").agg(F.sum("b").alias("yes"), F.sum(1 - F.col("b")).alias("no")).collect()
    totals: dict[str, list[float]] = {}
    for r in sums:
        total = totals.setdefault(r["field"], [0.0, 0.0, 0])
        total[0], total[1], total[2] = total[0] + r["yes"], total[1] + r["no"], total[2] + 1
    fields = {}
    for r in sums:
        yes, no, n = totals[r["field"]]
        fields[f"{r['field']}|{r['value']}"] = math.log((r["yes"] + 1) / (yes + n)) - math.log((r["no"] + 1) / (no + n))
    return {"patterns": patterns, "fields": fields}


def kept_spans(found: Column, model: dict, kept: float = KEPT) -> Column:
    """Struct of `base` (spans of the base kinds) and `every` (all that stay), in order of start and kind."""
    patterns, fields = _table(model["patterns"]), _table(model["fields"])

    def stays(s: Column) -> Column:
        logit = F.coalesce(F.try_element_at(patterns, s["pattern"]), F.lit(0.0))
        for name in FEATURES:
            logit = logit + F.coalesce(F.try_element_at(fields, F.concat_ws("|", s["kind"], F.lit(name), s[name])), F.lit(0.0))
        return logit > math.log(kept / (1 - kept))

    plain = lambda s: F.struct(s["start"], s["kind_no"], s["stop"], s["kind"])
    # one walk over the candidates, which may be an expression over the whole text
    staying = F.transform(F.filter(found, lambda s: F.when(s["kind_no"] >= len(BASE), stays(s)).otherwise(True)), plain)
    clear = lambda s, b: ~F.exists(b, lambda x: (x["start"] < s["stop"]) & (s["start"] < x["stop"]))

    def parted(spans_: Column) -> Column:
        base = F.filter(spans_, lambda s: s["kind_no"] < len(BASE))
        every = lambda b: F.filter(spans_, lambda s: (s["kind_no"] < len(BASE)) | clear(s, b))
        return let(base, lambda b: F.struct(b.alias("base"), every(b).alias("every")))

    return let(F.array_sort(staying), parted)


def listed(spans: Column) -> Column:
    """'kind:start:end' joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", kept: float = KEPT) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans, and n_added."""
    found = cut(df.select(F.col(key).alias("doc_id"), candidates(F.col(text)).alias("spans")))
    result = found.select("doc_id", kept_spans(F.col("spans"), train(found), kept).alias("s")).select("doc_id", "s.base", "s.every")
    counts = [_count(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    added = (F.size("every") - F.size("base")).cast("long").alias("n_added")
    return result.select(F.col("doc_id").alias(key), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), added)


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, text: str = "text", kept: float = KEPT) -> DataFrame:
    """`df` with every span of the text replaced by its kind in brackets ('[email]'); nulls stay null.

    Spans that overlap are replaced together, under the name of the first.
    """
    model = train(df.select(candidates(F.col(text)).alias("spans")))
    every = kept_spans(candidates(F.col(text)), model, kept)["every"]
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        more = F.concat(state["out"], F.array(before, F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    def rest(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(F.col(text), state["at"] + 1, F.length(F.col(text))))

    clean = let(every, lambda spans_: F.when(F.size(spans_) > 0, F.aggregate(spans_, empty, step, rest)).otherwise(F.col(text)))
    return df.withColumn(text, clean)
