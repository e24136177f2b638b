"""URL filters: rules first, then naive Bayes over segmented host words and path tokens.

A rule ('example.org/en/1') fits its host and all subdomains if the path starts with the rule's; the
longest wins. Urls that no rule fits are judged by a multinomial naive Bayes. It is taught by all urls: those
with a word known to be bad among their host words or path tokens are examples of `block`, the others
of `allow`, so words that keep bad company are learned.
(Rules are exceptions that others have made; they teach nothing.)

Host names are split into words by unigram Viterbi: counts of the words in the pages' visible text
give the probabilities; a word known to be bad has a least share, an unknown string of n letters a fixed
one times 10^-n, so counts in proportion segment alike. The counts are a table; each distinct
host label meets the ones of its substrings in a join. Path tokens are words; numbers count
by their length. Every count is summed before it is shuffled, and labels, hosts and path shapes are
judged once each, so a host that holds a third of the urls is one row.

A null url or one without '://' has an empty host and path, no rule, and the classifier's verdict on
no tokens at all. Score is the probability of `block`; verdict is block from 0.5 on. Repeated rows
are judged alike, and extra columns are left out.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scorelake.session import materialise as cut


LONGEST_WORD = 24
# shares of all words, so that a host is segmented alike whatever the size of the table
SPOKEN = 2e-5  # the least share of a word known to be bad
UNKNOWN = 1e-6  # of an unknown string, times 10 to the minus its letters
#: at most this many keys hold more than one in so many rows; their rows meet them by a broadcast
HOT = 64
BACKGROUND = 50.0

# fixed values: rules, longest match wins
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
# fixed values: words known to be bad beforehand
BAD_WORDS = "casino poker bet bets win pills cheap viagra xxx adult porn sex spam farm ads track click loan crack warez free"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits, or null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        chosen = F.when(fits, rule).otherwise(chosen)
    return chosen


def word_counts(text: Column, df: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages, words of ASCII letters up to LONGEST_WORD."""
    visible = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*+>", " "), r"<[^>]*+>", " ")
    words = F.regexp_extract_all(F.lower(visible), F.lit(rf"(?<![a-z])[a-z]{{1,{LONGEST_WORD}}}(?![a-z])"), F.lit(0))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment(label: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The words of the most likely split of `label`; `costs` are log probabilities of known words."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = label[start:end]
            cost = costs.get(word)
            options.append((best[start][0] + (unknown - (end - start) * math.log(10.0) if cost is None else cost), start))
        best.append(max(options))
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def split_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct `labels`, each joined with the counts of its substrings."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    known_bad = F.when(F.col("word").isin(BAD_WORDS.split()), F.lit(SPOKEN)).otherwise(F.lit(0.0))
    places = F.explode(F.sequence(F.lit(1), F.length("label")))
    begun = labels.where("label <> ''").select("label", places.alias("at"))
    parts = begun.select("label", F.explode(F.sequence(F.lit(1), F.least(F.length("label") - F.col("at") + 1, F.lit(LONGEST_WORD)))).alias("size"), "at")
    parts = parts.select("label", F.expr("substring(label, at, size)").alias("word")).distinct()
    known = parts.join(counts, "word", "left").groupBy("label").agg(
        F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", F.log(F.greatest(F.col("n") / F.lit(float(total)), known_bad)).alias("cost")))).alias("known")
    )
    floor = math.log(UNKNOWN)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            words = [segment(r["label"], {k["word"]: k["cost"] for k in r["known"]}, floor) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, type=pa.list_(pa.string()))], names=["label", "words"])

    return known.mapInArrow(run, "label string, words array<string>")


def host_labels(host: Column) -> Column:
    return F.filter(F.split(host, r"[^a-z0-9]+"), lambda x: x != "")


def path_shape(path: Column) -> Column:
    """The path lower-cased, every number replaced by '#' and its length."""
    plain = F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}]+", " ")
    parts = F.filter(F.split(plain, " "), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]++$"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x)), " ")


def _met(rows: DataFrame, odds: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with the odds of their key. Keys of more than 1 / HOT of the rows, fewer than HOT, are met by a broadcast."""
    hot = [r[key] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n / HOT).select(key).collect()]
    if not hot:
        return rows.join(odds, key, "left")
    common = F.col(key).isin(hot)
    return rows.where(~common).join(odds, key, "left").union(rows.where(common).join(F.broadcast(odds.where(common)), key, "left"))


def judge(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", allow: tuple = ALLOW, block: tuple = BLOCK) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = df.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("rule", rule_for(F.col("host"), F.col("path"), [*allow, *block])).withColumn("shape", path_shape(F.col("path")))
    parsed = cut(parsed)
    bad_words = BAD_WORDS.split()

    hosts = parsed.select("host").distinct().withColumn("label", F.explode(host_labels(F.col("host"))))
    spoken = word_counts(F.col(html), df).union(df.sparkSession.createDataFrame([(w, 0) for w in bad_words], "word string, n long"))
    words = split_labels(hosts.select("label").distinct(), cut(spoken.groupBy("word").agg(F.sum("n").alias("n"))))
    host_words = cut(hosts.join(words, "label").select("host", F.explode("words").alias("token")))

    bad_hosts = host_words.where(F.col("token").isin(bad_words)).select("host", F.lit(1).alias("bad_host")).distinct()
    bad_shape = F.arrays_overlap(F.split("shape", " "), F.array(*map(F.lit, bad_words)))
    taught = parsed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")).join(bad_hosts, "host", "left")
    taught = cut(taught.select("host", "shape", "n", F.when(F.col("bad_host").isNotNull() | bad_shape, F.col("n")).otherwise(0).alias("bad")))
    sums = [F.sum("bad").alias("bad"), F.sum(F.col("n") - F.col("bad")).alias("good")]
    by_host = taught.groupBy("host").agg(*sums)
    from_hosts = host_words.join(by_host, "host").select(F.concat(F.lit("host "), "token").alias("token"), "bad", "good")
    path_tokens = lambda frame, *keep: frame.select(*keep, F.explode(F.split("shape", " ")).alias("token")).where("token <> ''").withColumn("token", F.concat(F.lit("path "), "token"))
    from_paths = path_tokens(taught.groupBy("shape").agg(*sums), "shape", "bad", "good").select("token", "bad", "good")
    tokens = cut(from_hosts.union(from_paths).groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))

    bad, good = (float(x or 0) for x in tokens.agg(F.sum("bad"), F.sum("good")).first())
    taught_bad, taught_good = (float(x or 0) for x in taught.agg(F.sum("bad"), F.sum(F.col("n") - F.col("bad"))).first())
    prior = math.log((taught_bad + 1) / (taught_good + 1))
    # both classes are smoothed towards the share of the token in all urls, so common tokens say nothing where little was seen
    common = F.lit(BACKGROUND) * (F.col("bad") + F.col("good")) / F.lit(max(1.0, bad + good))
    odds = tokens.select("token", (F.log((F.col("bad") + common) / F.lit(bad + BACKGROUND)) - F.log((F.col("good") + common) / F.lit(good + BACKGROUND))).alias("odds"))

    open_ = parsed.where("rule is null")
    open_hosts = host_words.join(open_.select("host").distinct(), "host", "left_semi").select("host", F.concat(F.lit("host "), "token").alias("token"))
    host_odds = open_hosts.join(odds, "token").groupBy("host").agg(F.sum("odds").alias("host_odds"))
    shape_odds = path_tokens(open_.select("shape").distinct(), "shape").join(odds, "token").groupBy("shape").agg(F.sum("odds").alias("shape_odds"))
    n = parsed.count()
    scored = _met(_met(parsed, host_odds, "host", n), shape_odds, "shape", n)
    logit = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("shape_odds", F.lit(0.0))
    chance = F.when(F.col("rule").isin(*block), 1.0).when(F.col("rule").isNotNull(), 0.0).otherwise(1 / (1 + F.exp(-logit)))
    verdict = F.when(chance >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("page_id").alias(key), "host", "path", "rule", verdict.alias("verdict"), chance.alias("score"))
