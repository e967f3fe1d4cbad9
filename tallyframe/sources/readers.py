"""Readers of stored records. Schemas are explicit; nothing is inferred on ingest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import CheckFailed, check_unique, enforce
from ..schemas import CASE_DDL, FRAME_DDL, RESULT_DDL, SOURCE_DDL
from ..session import materialize
from .writers import _exists


def _column_struct(ddl: str) -> str:
    """A column list such as ``a int, b string`` as a struct type."""
    return f"struct<{ddl}>"


def read_cases(spark: SparkSession, path: str | Sequence[str], ddl: str = CASE_DDL, lines: bool = False, check: bool = True) -> DataFrame:
    """Cases stored as an array of objects, as ``{"cases": [...]}``, or (``lines``) one object per line.

    A JSON document is read by one task; data sets of any size should use lines. Duplicate ids and empty input are refused.
    """
    schema = f"{ddl}, cases array<{_column_struct(ddl)}>"
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    columns = [c for c in raw.columns if c != "cases"]
    direct = raw.filter(F.col("cases").isNull()).select(*columns)
    wrapped = raw.filter(F.col("cases").isNotNull()).select(F.explode("cases").alias("c")).select("c.*")
    cases = direct.unionByName(wrapped)
    if check:
        if not cases.limit(1).count():
            raise CheckFailed("no cases in the input")
        enforce(check_unique(cases, ["case_id"]), "duplicate cases")
    return cases


def read_results(spark: SparkSession, paths: str | Sequence[str], ddl: str = RESULT_DDL) -> DataFrame:
    """Result rows from JSON lines of many files; blank lines are skipped, malformed ones fail the job."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(paths)


def read_episodes(spark: SparkSession, path: str | Sequence[str], result: str, trace: str, key: str = "arm") -> DataFrame:
    """Episode tables of (case_id, arm or policy, result JSON, trace JSON) with both columns parsed.

    ``result`` and ``trace`` are struct types; a reader that needs no trace passes none of its columns on, and the
    column is not read.
    """
    raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    options = {"mode": "FAILFAST"}
    return raw.select(
        "case_id", key, F.from_json("result", result, options).alias("result"), F.from_json("trace", trace, options).alias("trace")
    )


def read_shards(spark: SparkSession, root: str, ddl: str = RESULT_DDL, pattern: str = "shard-*") -> DataFrame:
    """Rows of all shard folders below ``root`` with the shard number and source file as provenance."""
    rows = spark.read.schema(ddl).option("mode", "FAILFAST").json(f"{root}/{pattern}")
    file = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(file, r"shard-(\d+)", 1).cast("int").alias("shard"), file.alias("source_file"))


SHARD_ENTRY = "struct<directory:string,manifest_sha256:string>"


def read_indexed_shards(spark: SparkSession, root: str, ddl: str = RESULT_DDL, files: str = "part-*") -> DataFrame:
    """Rows of the shard folders that ``shard_index.json`` lists, with folder and file as provenance.

    Refused are an index that differs from the ``aggregation.shards`` of ``manifest.json``, a folder that is no direct child
    of the root, and a shard whose ``manifest.json`` is missing or has another SHA-256 than listed. Only listed folders are
    read; without an index the root's own files are the rows. The list of shards is metadata and passes the driver.
    """
    rows = spark.read.schema(ddl).option("mode", "FAILFAST").option("pathGlobFilter", files)
    file = F.col("_metadata.file_path")

    def with_source(df: DataFrame) -> DataFrame:
        return df.select("*", F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("directory"), file.alias("source_file"))

    if not _exists(spark, f"{root}/shard_index.json"):
        return with_source(rows.json(root))

    def listed(name: str, path: str) -> str | None:
        text = spark.read.text(f"{root}/{name}", wholetext=True)
        return text.select(F.to_json(F.try_variant_get(F.parse_json("value"), path, "variant"))).first()[0]

    index = listed("shard_index.json", "$.shards")
    if index is None or index != listed("manifest.json", "$.aggregation.shards"):
        raise CheckFailed("shard index differs from the manifest")
    entries = spark.range(1).select(F.explode(F.from_json(F.lit(index), f"array<{SHARD_ENTRY}>")).alias("e")).select("e.*")
    direct = F.coalesce(~F.col("directory").contains("/") & ~F.col("directory").isin("", ".", ".."), F.lit(False))
    enforce(entries.filter(~direct), "shard folder is no direct child")
    enforce(check_unique(entries, ["directory"]), "shard listed twice")
    names = [r.directory for r in entries.collect()]
    if not names:
        return with_source(rows.json(root)).limit(0)
    here = [f"{root}/{n}/manifest.json" for n in names if _exists(spark, f"{root}/{n}/manifest.json")]
    if len(here) < len(names):
        raise CheckFailed(f"{len(names) - len(here)} listed shards have no manifest")
    found = spark.read.format("binaryFile").load(here).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("directory"), F.sha2("content", 256).alias("found_sha256")
    )
    changed = entries.join(found, "directory", "left").filter(~F.col("manifest_sha256").eqNullSafe(F.col("found_sha256")))
    enforce(changed, "listed shard manifest changed")
    return with_source(rows.json([f"{root}/{n}" for n in names]))


def read_source_csv(spark: SparkSession, path: str, ddl: str = SOURCE_DDL) -> DataFrame:
    """CSV listing of images with a header."""
    return spark.read.schema(ddl).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_frames(spark: SparkSession, path: str, ddl: str = FRAME_DDL, lines: bool = False) -> DataFrame:
    """Frame annotations, usually gzip JSON; Spark picks the codec from the file name."""
    return spark.read.schema(ddl).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


# Files from this many bytes on are read in pieces: a row that holds a file takes several times its size in a task, and 2 GB at most.
PIECES = 32 * 2**20
# The setting of file names' endings that need no codec, as Hadoop and as its client for Spark call it.
PASSED_ENDING = ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension")
# A byte order mark at the head of a file, which the text reader leaves out.
MARK = b"\xef\xbb\xbf"


def _line_digests(batches: Iterator) -> Iterator:
    """SHA-256 of files from their lines, which come in order; a task holds one batch of lines."""
    import pyarrow as pa

    file = None
    for batch in batches:
        ids, sizes, lines = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        start = 0
        while start < len(ids):
            end = len(ids) if ids[-1] == ids[start] else next(i for i in range(start, len(ids)) if ids[i] != ids[start])
            if ids[start] != file:
                if file is not None:
                    yield pa.RecordBatch.from_pydict({"id": [file], "sha256": [_closed(plain, marked, size - done)]})
                file, size, done = ids[start], sizes[start].as_py(), -1
                plain, marked = hashlib.sha256(), hashlib.sha256(MARK)
            piece = b"\n".join([*([b""] if done >= 0 else []), *lines.slice(start, end - start).to_pylist()])
            plain.update(piece)
            marked.update(piece)
            done, start = max(done, 0) + len(piece), end
    if file is not None:
        yield pa.RecordBatch.from_pydict({"id": [file], "sha256": [_closed(plain, marked, size - done)]})


def _closed(plain, marked, left: int) -> str:
    """The digest of a file of whose bytes so many did not come as lines: a last line feed and a mark at its head."""
    if left not in (0, 1, len(MARK), len(MARK) + 1):
        raise ValueError(f"a file was not read whole: {left} bytes differ")
    digest = marked if left >= len(MARK) else plain
    digest.update(b"\n" * (left % len(MARK)))
    return digest.hexdigest()


def hash_large(files: DataFrame) -> DataFrame:
    """``id`` (of the path) and SHA-256 of files of any size, from Spark's listing of them as binary files.

    A digest runs through a file in order, so one task reads it, line by line. Spark's text reader would split files and unpack
    those with the ending of a codec; a codec that changes nothing, set for the files' endings, keeps them whole and as they are.
    Files without an ending are split, and their lines sorted. A line, the bytes up to a line feed, has to fit a row (2 GB).
    """
    spark = files.sparkSession
    endings: dict[str, list[str]] = {}
    for (path,) in files.select("path").collect():
        _, dot, ending = path.rsplit("/", 1)[1].rpartition(".")
        # The reader takes patterns.
        endings.setdefault(dot + ending if dot else "", []).append(re.sub(r"([\\*?\[\]{}])", r"\\\1", path))
    id_, size, start = F.xxhash64("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_block_start")
    split = F.raise_error(F.lit("a file was split")).cast("long")
    out = spark.createDataFrame([], "id bigint, sha256 string")
    for ending, paths in endings.items():
        reader = spark.read.option("lineSep", "\n")
        if ending:
            reader = reader.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
            for key in PASSED_ENDING:
                reader = reader.option(key, ending)
        at = F.when(F.col("_metadata.file_block_length") == size, start).otherwise(split) if ending else start
        lines = reader.text(paths).select(id_.alias("id"), size.alias("size"), F.col("value").cast("binary").alias("line"), at.alias("start"))
        if not ending:
            lines = lines.withColumn("place", F.monotonically_increasing_id()).repartition("id").sortWithinPartitions("id", "start", "place")
        out = out.unionByName(lines.mapInArrow(_line_digests, out.schema))
    return out


def hash_assets(spark: SparkSession, path: str | Sequence[str], root: str, glob: str | None = None, pieces: int = PIECES) -> DataFrame:
    """Path relative to ``root``, byte length and SHA-256 of every file; a path outside the root is an error.

    Files from ``pieces`` bytes on are not held whole, see ``hash_large``. Spark lists no empty files.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    prefix = root.rstrip("/") + "/"
    full = F.regexp_replace("path", r"^file:/+", "/")
    inside = full.startswith(prefix)
    relative = F.when(inside, F.substring(full, F.lit(len(prefix) + 1), F.length(full))).otherwise(
        F.raise_error(F.concat(F.lit("asset outside the root: "), full)).cast("string")
    )

    def found(df: DataFrame, digest: Column) -> DataFrame:
        return df.select(relative.alias("path"), F.col("length").alias("bytes"), digest.alias("sha256"))

    size = F.col("_metadata.file_size")
    large = files.where(size >= pieces)
    whole = found(files.where(size < pieces), F.sha2("content", 256))
    if large.select("path").isEmpty():
        return whole
    digest = F.coalesce("sha256", F.raise_error(F.concat(F.lit("not read: "), "path")))
    named = large.withColumn("id", F.xxhash64("_metadata.file_path")).select("path", "length", "id")
    return whole.unionByName(found(named.join(hash_large(large), "id", "left"), digest))


def merge_shards(shards: Sequence[DataFrame], keys: Sequence[str], grid: DataFrame, order: Sequence[str], check: bool = True) -> DataFrame:
    """Disjoint complete shards of one model as one ordered table.

    The checks and the order's ranges read the rows several times, so they are written once.
    """
    from ..operators.checks import check_complete

    merged = shards[0]
    for shard in shards[1:]:
        merged = merged.unionByName(shard)
    merged = materialize(merged, "merged")
    if check:
        enforce(check_unique(merged, keys), "overlapping shards")
        enforce(check_complete(merged, grid, keys), "incomplete shards")
    return merged.orderBy(*order)
