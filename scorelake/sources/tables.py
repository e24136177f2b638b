"""Text tables and image folders: captions, scores, metadata, prompts, JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scorelake.functions.captions import file_stem
from scorelake.plans.requests import prompts_json
from scorelake.schema import DESCRIPTOR, SCORES, SYNTHETIC
from scorelake.sources.quoted import SPLIT_BYTES, QuotedTable, parse, split_cells


def read_captions_tsv(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """No header: file name, short caption, ..., long caption last; quoted cells may hold line breaks.

    The first row of the first file tells how many columns there are.
    """
    table = QuotedTable(spark, path, "\t", split_bytes)
    first = table.heads().orderBy("file").first()
    cells = split_cells(first["record"], "\t") if first else []
    if len(cells) < 2:
        raise ValueError(f"the captions in {path} have {len(cells)} column, not a file name and a caption")
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(len(cells))]
    rows = table.cells(T.StructType(fields), header=False)
    name, short, long = fields[0].name, fields[1].name, fields[-1].name
    return rows.select(
        file_stem(F.col(name)).alias("stem"), F.col(name).alias("file_name"),
        F.col(short).alias("short_caption"), F.col(long).alias("long_caption"),
    )


def score_schema(names: Sequence[str] = SCORES + SYNTHETIC) -> T.StructType:
    return T.StructType(
        [T.StructField("key", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in sorted(names)]]
    )


def read_scores_csv(spark: SparkSession, path: str, names: Sequence[str] = SCORES + SYNTHETIC, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Typed columns; an empty cell is NULL. Each file's header names its columns, in any order.

    Files with one header are parsed together, and the groups united by column name. Quoted cells may
    hold line breaks, also in a header.
    """
    table = QuotedTable(spark, path, ",", split_bytes)
    headers = [r["record"] for r in table.heads().select("record").distinct().orderBy("record").collect()]  # one per kind of header
    rows = table.records().where(~F.col("first"))
    if len(headers) > 1:
        rows = rows.join(table.heads().withColumnRenamed("record", "header"), "file")
    types = {n: T.DoubleType() for n in names}
    out = None
    for header in headers:
        fields = [T.StructField(c.strip(), types.get(c.strip(), T.StringType())) for c in split_cells(header, ",")]
        part = parse(rows.where(F.col("header") == header) if len(headers) > 1 else rows, T.StructType(fields), ",")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "key string")


def write_scores_csv(scores: DataFrame, path: str, key: str = "key") -> None:
    """Rows sorted by key, score columns sorted by name; a range sort, not one task."""
    names = sorted(c for c in scores.columns if c != key)
    scores.select(key, *names).orderBy(key).write.mode("overwrite").csv(path, header=True)


def write_scores(scores: DataFrame, path: str) -> None:
    """Parquet by shard; rows are rebalanced so that a large shard is split over several files."""
    scores.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_metadata_csv(spark: SparkSession, path: str, scores: Sequence[str] = SCORES, columns: Sequence[str] = ("key", "caption"), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Validation rows: keys stay text (leading zeros), every coherence is 1.0."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = QuotedTable(spark, path, ",", split_bytes).cells(schema, header=True)
    return rows.withColumns({f"{s}_coherence": F.lit(1.0) for s in scores})


def read_prompts_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')


def prompts_tsv_to_jsonl(spark: SparkSession, tsv: str, out: str) -> None:
    prompts_json(read_prompts_tsv(spark, tsv)).write.mode("overwrite").text(out)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines are ignored."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DESCRIPTOR).json(path, multiLine=True)


def read_shard_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard number, url, nsamples) of a `wids-index.json`."""
    docs = spark.read.schema(DESCRIPTOR).json(path, multiLine=True)
    return docs.select(F.posexplode("shardlist").alias("shard_idx", "s")).select(
        F.col("shard_idx").cast("long").alias("shard_idx"), "s.url", "s.nsamples"
    )


def _strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind; trim() knows only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: how many tasks list folders; Spark's own value is one task a folder up to 10,000
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _files(spark: SparkSession, root: str) -> DataFrame:
    """All files below `root`, listed once and by as many tasks as there are slots, four times over."""
    conf = spark.conf
    before = conf.get(_LISTING, None)
    try:
        conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    finally:
        if before is None:
            conf.unset(_LISTING)
        else:
            conf.set(_LISTING, before)


def _listing(files: DataFrame) -> DataFrame:
    """Images of `files` (`_files`) by path only; their bytes are not read."""
    files = files.select("path", _location().alias("place"))
    return files.select(
        "path",
        F.regexp_extract("place", r"^(.*)/samples/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", r"/samples/([^/]+)$", 1).alias("name"),
    ).where(F.col("folder") != "")


def _location() -> Column:
    """Where a row's file lies, in the one spelling that all readers give."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def _metadata(files: DataFrame) -> DataFrame:
    """(folder, text) of the metadata.jsonl of every prompt folder; the files hold one object. Other files are not opened."""
    texts = files.where((F.col("_metadata.file_name") == "metadata.jsonl") & (F.col("length") > 0))
    return texts.select(F.regexp_replace(_location(), "/metadata.jsonl$", "").alias("folder"), F.col("content").cast("string").alias("text"))


def discover_images(spark: SparkSession, root: str) -> DataFrame:
    """(filename, prompt): images of every prompt folder with a non-empty first metadata line."""
    files = _files(spark, root)
    first = _strip(F.element_at(F.split("text", "\n"), 1))
    prompts = _metadata(files).select("folder", first.alias("line")).where(F.col("line") != "")
    prompts = prompts.select("folder", F.get_json_object("line", "$.prompt").alias("prompt"))
    images = _listing(files).where(F.lower("name").rlike(r"\.(png|jpg|jpeg|webp)$"))
    return images.join(prompts, "folder").select(F.col("path").alias("filename"), "prompt")


def discover_images_strict(spark: SparkSession, root: str) -> DataFrame:
    """(filename, metadata): numbered folders only, files that start like `0001.png`."""
    files = _files(spark, root)
    specs = _metadata(files).select("folder", _strip(F.col("text")).alias("metadata"))
    images = _listing(files).where(
        F.col("folder").rlike(r"/\d+$") & F.col("name").rlike(r"^\d+\.png")
    )
    return images.join(specs, "folder").select(F.col("path").alias("filename"), "metadata")
