"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training texts. The whole text is
compressed with every dictionary, in blocks of `BLOCK` bytes at most that each start from the fresh
dictionary, and gets the language of the smallest sum; ties go to the language with more training
rows, then to the first by name. Before that, dictionary and text are lower-cased and every run of
other characters than letters becomes a space, so that layout does not count. `score` is the share
by which the next language's sum is larger; frame headers do not count. In one stream a long text
would be its own dictionary and the score would fall towards zero; in blocks it does not depend on
the length. A text of fewer than `SHORT` bytes is repeated up to them: the repeats cost the same few
bytes everywhere, and without them zstandard stores such a text as it is and all languages tie.

A text of any length is `rejected` if its score is under `margin`. In the learned languages scores
are about 0.2, in other languages and random letters mostly under 0.03 (the README has the shares).

The dictionaries are fitted on a bounded sample: for each language the `sample_rows` different
texts of the smallest hash give up to `row_chars` characters each, from a place that the hash picks.
Prediction reads whole texts. A null text or one without a letter is `und`, score 0, rejected.
Training rows with a null language, a null text or no letter teach nothing; a table without any
training row makes every prediction `und`. Copies of a text take one place in the sample; for ties, training rows
count as often as they occur.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from scorelake.llm.texts import ROWS, over_rows
from scorelake.session import materialise as cut

SAMPLE_ROWS = 100
ROW_CHARS = 800
LEVEL = 6
BLOCK = 1024
SHORT = 128
MARGIN = 0.05
UNKNOWN = "und"
_BUCKETS = 16
_LETTER = r"\p{L}"
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(_LETTER), F.lit(False))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS) -> dict[str, bytes]:
    """Dictionary content by language. The sample is sample_rows x row_chars characters a language at most."""
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    distinct = cut(hashed.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")))
    # ranked by bucket of the hash first, so that no task sees more of a common language than a few samples
    near = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(_BUCKETS))).orderBy("h"))
    few = distinct.withColumn("near", near).where(F.col("near") <= sample_rows)
    picked = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= sample_rows)
    spare = F.greatest(F.length("text") - row_chars, F.lit(0)) + 1
    excerpt = F.substring("text", F.pmod("h", spare) + 1, F.lit(row_chars))
    taken = hashed.join(F.broadcast(picked.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min(excerpt).alias("text"))
    common = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    content: dict[str, list[str]] = {}
    for row in sorted(taken.collect()):  # bounded by the two parameters
        content.setdefault(row["lang"], []).append(row["text"])
    return {name: plain("\n".join(content[name])).encode() for name in sorted(content, key=lambda n: (-common[n], n))}


def plain(text: str) -> str:
    return _OTHER.sub(" ", text.lower())


def blocks(raw: bytes, size: int = BLOCK) -> list[bytes]:
    """The bytes of `raw` in blocks of at most `size`, about equally long, cut before a space if there is one."""
    start, parts = 0, []
    while start < len(raw):
        rest = len(raw) - start
        end = start + -(-rest // -(-rest // size))
        if end < len(raw):
            space = raw.rfind(b" ", start + 1, end + 1)
            end = space if space > 0 else end
        parts.append(raw[start:end])
        start = end
    return parts


class Compressors:
    """One compressor per language, its dictionary prepared once per worker."""

    def __init__(self, content: dict[str, bytes], level: int):
        self.names = list(content)
        self.coders = []
        for raw in content.values():
            words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.frame = len(self.coders[0].compress(b"")) if self.coders else 0

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        words = plain(text or "").strip()
        # number characters such as fractions and Roman numeral signs are in \w, but no letters
        if not self.coders or not any(map(str.isalpha, words)):
            return UNKNOWN, 0.0, True
        raw = words.encode()
        parts = blocks((raw + b" ") * -(-SHORT // (len(raw) + 1)) if len(raw) < SHORT else raw)
        sizes = [sum(len(c.compress(p)) - self.frame for p in parts) for c in self.coders]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        score = 1.0 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0
        return self.names[order[0]], score, score < margin


@functools.lru_cache(maxsize=1)  # a worker outlives the job; sets of earlier jobs would stay in its memory
def _loaded(items: tuple, level: int) -> Compressors:
    return Compressors(dict(items), level)


def predict(df: DataFrame, content: dict[str, bytes], key: str = "doc_id", text: str = "text", level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """(key, lang_pred, score, rejected) per row."""
    items = tuple(content.items())

    def rows(columns):
        coders = _loaded(items, level)
        found = [coders.judge(t, margin) for t in columns["row_text"]]
        names, scores, rejected = ([f[i] for f in found] for i in range(3))
        return {"row_key": columns["row_key"], "lang_pred": names, "score": scores, "rejected": rejected}

    narrow = df.select(F.col(key).alias("row_key"), F.col(text).alias("row_text"))
    result = over_rows(narrow, ["row_key", "row_text"], "row_key long, lang_pred string, score double, rejected boolean", rows)
    return result.withColumnRenamed("row_key", key)


def keep_recognised(df: DataFrame, content: dict[str, bytes], text: str = "text", level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """The rows of `df` whose text has a language; all columns stay as they are."""
    items, place = tuple(content.items()), df.columns.index(text)

    def run(batches):
        for batch in batches:
            coders = _loaded(items, level)
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                kept = [not coders.judge(t.as_py(), margin)[2] for t in part.column(place)]
                yield part.filter(pa.array(kept, type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
