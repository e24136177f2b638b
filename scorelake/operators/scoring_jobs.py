"""Model application: scorers and encoders as Arrow-batched UDFs, one model per Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scorelake.operators.scores import IDENTITY, require_identity
from scorelake.schema import SCORES
from scorelake.sources.stores import finished_scorers, flush_scores, read_flushed

# A scorer is a factory: called once per Python worker, it loads its model and returns
# predict(*input arrays) -> one float per row.
Factory = Callable[[], Callable[..., np.ndarray]]


class Registry(dict[str, Factory]):
    """Scorers by name."""

    def __missing__(self, name: str) -> Factory:
        raise ValueError(f"no scorer is registered as {name!r}, only {', '.join(sorted(self)) or 'none'}")

    def parse(self, request: str | Sequence[str]) -> list[str]:
        """Names of a request, 'a, b' or a sequence; each must be registered."""
        names = re.findall(r"[^,\s]+", request) if isinstance(request, str) else [*request]
        for name in names:
            self[name]
        return names


SCORERS = Registry()


def register_scorer(name: str, factory: Factory) -> None:
    SCORERS[name] = factory


def score_column(name: str, inputs: Sequence[Column], batch_size: int = 64) -> Column:
    return predict_batch_udf(SCORERS[name], return_type=T.DoubleType(), batch_size=batch_size)(*inputs)


def score_columns(runs: Mapping[str, tuple[str, Sequence[str]]], inputs: Mapping[str, Column], batch_size: int = 64) -> Column:
    """A struct with a number per entry of `runs`, output -> (scorer, names of its inputs).

    All scorers share one pass over the rows: an input goes to the Python worker once, however many scorers read
    it, where a chain of `score_column` sends it once per scorer. A scorer that several outputs ask for with the same
    inputs runs once.
    """
    names = list(inputs)
    calls = list(dict.fromkeys((scorer, tuple(read)) for scorer, read in runs.values()))
    factories = {scorer: SCORERS[scorer] for scorer, _ in calls}
    of_output = {output: calls.index((scorer, tuple(read))) for output, (scorer, read) in runs.items()}
    schema = T.StructType([T.StructField(output, T.DoubleType()) for output in runs])

    @F.pandas_udf(schema)
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        models = {scorer: factory() for scorer, factory in factories.items()}
        for columns in batches:
            arrays = dict(zip(names, (c.to_numpy() for c in columns)))
            found = [_predicted(models[scorer], [arrays[n] for n in read], batch_size) for scorer, read in calls]
            yield pd.DataFrame({output: found[i] for output, i in of_output.items()})

    return score(*inputs.values())


def _predicted(predict: Callable[..., np.ndarray], arrays: Sequence[np.ndarray], batch_size: int) -> np.ndarray:
    out = np.empty(len(arrays[0]))
    for at in range(0, len(out), batch_size):
        part = [a[at : at + batch_size] for a in arrays]
        values = np.asarray(predict(*part), dtype="float64").ravel()
        if len(values) != len(part[0]):
            raise ValueError(f"a scorer gave {len(values)} numbers for {len(part[0])} rows")
        out[at : at + batch_size] = values
    return out


def apply_scorers(df: DataFrame, names: str | Sequence[str], inputs: Sequence[str], store: str, batch_size: int = 64) -> DataFrame:
    """One job per scorer over all rows, flushed when it ends; finished scorers are not run again."""
    require_identity(IDENTITY, samples=df)
    picked = SCORERS.parse(names)
    spark = df.sparkSession
    done = set(finished_scorers(spark, store, picked))
    for name in picked:
        if name not in done:
            value = score_column(name, [F.col(c) for c in inputs], batch_size)
            flush_scores(df.select(*IDENTITY, value.alias("value")), name, store)
    return read_flushed(spark, store, picked)


def encode_text(text: Column, make_encoder: Callable[[], Callable[[list[str]], list]], max_tokens: int = 2048, batch_size: int = 64) -> Column:
    """Caption -> array<array<float>>, cut to `max_tokens`; the encoder is loaded once per worker.

    The encoder maps a list of at most `batch_size` captions to one (tokens, width) array each. Only
    one such batch is held as numpy arrays; an Arrow batch of captions goes back as a chunk for each,
    so its rows x tokens x width must stay below 2^31: lower spark.sql.execution.arrow.maxRecordsPerBatch
    for wide encoders (500 rows of 2,048 x 2,048).
    """

    @F.arrow_udf("array<array<float>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for texts in batches:
            chunks = [_encoded(encoder, texts.slice(at, batch_size).to_pylist(), max_tokens) for at in range(0, len(texts), batch_size)]
            yield pa.concat_arrays(chunks) if chunks else pa.array([], pa.list_(pa.list_(pa.float32())))

    return encode(text)


def _encoded(encoder: Callable[[list[str]], list], texts: list[str | None], max_tokens: int) -> pa.ListArray:
    tokens = [np.asarray(t, dtype="float32")[:max_tokens] for t in encoder([t or "" for t in texts])]
    width = next((t.shape[1] for t in tokens if t.ndim == 2), 0)
    tokens = [t.reshape(-1, width) for t in tokens]
    rows = np.cumsum([0, *map(len, tokens)])
    flat = np.concatenate(tokens).ravel() if tokens else np.empty(0, dtype="float32")
    inner = pa.ListArray.from_arrays(pa.array(np.arange(rows[-1] + 1) * width, pa.int32()), pa.array(flat, pa.float32()))
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), inner)


def collate(df: DataFrame, batch: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User function per batch; a group is one batch, so its size is the batch size."""
    return df.groupBy(batch).applyInPandas(fn, schema)


NAMED_TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def transform_chain(df: DataFrame, steps: Sequence[str | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply DataFrame -> DataFrame steps in order; a string names a registered one."""
    for step in steps:
        fn = NAMED_TRANSFORMS.get(step) if isinstance(step, str) else step
        if not callable(fn):
            raise ValueError(f"step {step!r} is neither a function nor the name of a registered step")
        df = df.transform(fn)
    return df


@dataclass(frozen=True)
class Switches:
    """What a preparation run computes."""

    scores: tuple[str, ...] = field(default_factory=lambda: SCORES)
    synthetic: bool = True
    text: bool = True
    latents_256: bool = False
    latents_512: bool = False

    def __post_init__(self) -> None:
        unknown = [s for s in self.scores if s not in SCORES]
        if unknown:
            raise ValueError(f"unknown scores {unknown}")


# --- light scorers, for dry runs and tests -------------------------------------------------------


def _length_ratio():
    def predict(captions: np.ndarray) -> np.ndarray:
        return np.array([min(len(c) / 1000.0, 1.0) if c is not None else np.nan for c in captions.ravel()])

    return predict


def _vowel_share():
    def predict(captions: np.ndarray) -> np.ndarray:
        return np.array(
            [sum(map(c.count, "aeiou")) / max(len(c), 1) if c is not None else np.nan for c in captions.ravel()]
        )

    return predict


register_scorer("length_ratio", _length_ratio)
register_scorer("vowel_share", _vowel_share)


def _image_and_length():
    """Caption length, weighted by the image's last byte (a digit in the fixtures)."""

    def predict(images: np.ndarray, captions: np.ndarray) -> np.ndarray:
        pairs = zip(images.ravel(), captions.ravel())
        return np.array([min(len(c) / 1000.0, 1.0) * (1 + bytes(i)[-1] % 16) / 10.0 if i and c is not None else np.nan for i, c in pairs])

    return predict


register_scorer("image_and_length", _image_and_length)
