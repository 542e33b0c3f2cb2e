"""Manifests: content ids, verification of stored partitions, completeness checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.exprs import reasons
from tickloom.plans.lineage import stage

# fixed values: partition path layout and the source each kind comes from
PATH_PATTERN = (
    r"^raw/kind=(book_deltas|book_states|trades)/source=([^/]+)/product=([^/]+)/"
    r"date=(\d{4}-\d{2}-\d{2})/hour=(\d{2})/part-([0-9a-f]{64})\.parquet$"
)
KINDS = ("book_deltas", "book_states", "trades")


#: Bytes of a file that a task holds while it hashes; file systems that tasks can open by themselves.
CHUNK_BYTES, OPEN_SCHEMES = 8 << 20, ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            system, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while piece := stream.read(CHUNK_BYTES):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "bytes", "sha256"])


def file_digests(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Size and SHA-256 of every file below `root`.

    The listing reads no content; files are dealt out singly and each is hashed in chunks of CHUNK_BYTES, so a file of any
    size takes little memory. Spark lists no empty files. In a store that only Spark's readers can open a file is one row of at most 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    scheme = target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme not in OPEN_SCHEMES:
        return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    address = F.when(F.col("path").startswith("file:/") & ~F.col("path").startswith("file:///"), F.concat(F.lit("file://"), F.substring("path", 6, 1 << 20)))
    listed = files.select(F.coalesce(address, "path").alias("path"), F.col("length").alias("bytes"))
    return listed.repartition(F.xxhash64("path")).mapInArrow(_hash_files, "path string, bytes bigint, sha256 string")


#: Children of a node of the digest tree, and leaves that its lowest nodes hold on average.
FAN, LEAVES = 16, 64


def merkle_levels(df: DataFrame, columns: Sequence[str] | None = None, depth: int | None = None) -> DataFrame:
    """Digest tree of a frame's content, whatever the order and dealing of its rows: (level, prefix, digest).

    A leaf is a distinct row's SHA-256 with its count, so copies combine before the shuffle. A node of the lowest level is
    the digest of the sorted leaves that share the first `depth` hex digits; a node above, of its children in order. The depth
    follows the number of distinct rows, so no node gathers more than a few leaves. Level 0 is the root; an empty frame has
    the digest of nothing.
    """
    names = sorted(columns or df.columns)
    leaves = stage(df.groupBy(F.sha2(F.to_json(F.struct(*names)), 256).alias("h")).agg(F.count(F.lit(1)).alias("n")))
    if depth is None:
        depth = max(1, math.ceil(math.log(max(leaves.count(), 1) / LEAVES, FAN)))
    text = F.concat("h", F.lit(":"), F.col("n").cast("string"))
    joined = lambda parts: F.sha2(F.array_join(parts, ","), 256).alias("digest")
    level = stage(leaves.groupBy(F.substring("h", 1, depth).alias("prefix")).agg(joined(F.array_sort(F.collect_list(text)))))
    out = level.select(F.lit(depth).alias("level"), "prefix", "digest")
    for d in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        keys = [F.substring("prefix", 1, d).alias("up")] if d else []
        level = level.groupBy(*keys).agg(joined(F.transform(children, lambda c: c["digest"])))
        level = level.select(F.col("up") if d else F.lit(""), "digest").toDF("prefix", "digest")
        out = out.unionByName(level.select(F.lit(d).alias("level"), "prefix", "digest"))
    return out


def merkle_root(df: DataFrame, columns: Sequence[str] | None = None, depth: int | None = None) -> DataFrame:
    """One row with the root's `digest`."""
    return merkle_levels(df, columns, depth).where("level = 0").select("digest")


def differing_rows(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, depth: int = 4) -> DataFrame:
    """Lowest nodes at which two frames differ, as prefixes of row hashes: what has to be compared row by row."""
    one = merkle_levels(left, columns, depth).where(F.col("level") == depth).select("prefix", F.col("digest").alias("l"))
    other = merkle_levels(right, columns, depth).where(F.col("level") == depth).select("prefix", F.col("digest").alias("r"))
    return one.join(other, "prefix", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("prefix")


def canonical_id(row: DataFrame, exclude: Sequence[str] = ("created_at",)) -> DataFrame:
    """Add `manifest_id`: SHA-256 of the row as JSON with sorted keys and no null fields."""
    fields = sorted(c for c in row.columns if c not in exclude)
    return row.withColumn("manifest_id", F.sha2(F.to_json(F.struct(*fields)), 256))


def dataset_manifest(
    df: DataFrame, target: str, ts: str, columns: Sequence[str], files: DataFrame | None = None
) -> DataFrame:
    """One row describing a corpus, with its content id."""
    per_instant = df.groupBy(ts).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("bigint")).alias("pos"),
        F.count(target).alias("known"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns],
    )
    row = per_instant.agg(
        F.sum("n").alias("rows"),
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.try_divide(F.sum("pos"), F.sum("known")).alias("prevalence"),
        F.sum(F.col("n") - 1).alias("duplicate_timestamps"),
        F.struct(*[F.sum(f"nulls_{c}").alias(c) for c in sorted(columns)]).alias("null_counts"),
    )
    if files is not None:
        row = with_listing(row, "partitions", files, ("path", "sha256"))
    return canonical_id(row)


def with_listing(row: DataFrame, name: str, entries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A listing of any length as its number of entries and the root of its digest tree."""
    root = stage(merkle_root(entries, columns))
    count = entries.agg(F.count(F.lit(1))).scalar()
    return row.withColumns({f"n_{name}": count, f"{name}_root": root.select("digest").scalar()})


def raw_manifest(
    partitions: DataFrame, qualified_seconds: Column | int, days: int, duplicates: DataFrame | None = None,
    incidents: DataFrame | None = None, excluded: DataFrame | None = None, completions: DataFrame | None = None,
) -> DataFrame:
    """Identity of the raw data of some days, one row: rows and partitions per kind, seconds covered and missing, and for each
    listing its number of entries and digest.

    `partitions` has kind and rows, and remote_path and sha256 for the digest; `duplicates` (kind, duplicates); `incidents` and
    `excluded` any columns; `completions` (product_id, source_date, day_start_epoch, day_end_epoch) of days whose trade pages
    are complete: epochs that do not match their UTC date are an error, as the evidence is part of the identity.
    """
    seconds = F.lit(qualified_seconds) if isinstance(qualified_seconds, int) else qualified_seconds
    per_kind = partitions.groupBy("kind").agg(F.count(F.lit(1)).alias("partitions"), F.sum("rows").alias("rows"))
    row = per_kind.agg(
        F.array_sort(F.collect_list(F.struct("kind", "partitions", "rows"))).alias("kinds")
    ).withColumns({"coverage_seconds": seconds, "missing_seconds": F.lit(days * 86_400) - seconds})
    if "sha256" in partitions.columns:
        row = with_listing(row, "partitions", partitions, ("kind", "remote_path", "rows", "sha256"))
    if duplicates is not None:
        counted = duplicates.groupBy("kind").agg(F.sum("duplicates").alias("duplicates"))
        listed = counted.agg(F.array_sort(F.collect_list(F.struct("kind", "duplicates"))).alias("d")).scalar()
        row = row.withColumn("duplicate_counts", listed)
    if incidents is not None:
        row = with_listing(row, "sequence_incidents", incidents, incidents.columns)
    if excluded is not None:
        row = with_listing(row, "excluded_intervals", excluded, excluded.columns)
    if completions is not None:
        day = F.unix_seconds(F.col("source_date").cast("date").cast("timestamp"))
        right = (F.col("day_start_epoch") == day) & (F.col("day_end_epoch") == day + 86_400) & (F.length("product_id") > 0)
        proven = completions.select(
            "product_id", F.col("source_date").cast("string").alias("source_date"),
            F.when(F.coalesce(right, F.lit(False)), F.col("day_start_epoch"))
            .otherwise(F.raise_error("completion epochs do not match their UTC date").cast("bigint")).alias("day_start_epoch"),
            "day_end_epoch",
        )
        row = with_listing(row, "trade_day_completions", proven, proven.columns)
    return canonical_id(row)


def verify_entries(
    entries: DataFrame, product: str, sources: dict[str, str], stored: DataFrame | None = None, stored_as: str = "remote_path"
) -> DataFrame:
    """Manifest entries with the reasons they cannot be trusted.

    Entries carry kind, remote_path, sha256 and verified_receipt; `stored` holds
    (remote_path, sha256) of the bytes that were found, by the entries' column `stored_as`.
    """
    part = lambda i: F.regexp_extract("remote_path", PATH_PATTERN, i)
    pairs = [x for kind, source in sources.items() for x in (F.lit(kind), F.lit(source))]
    expected_source = F.try_element_at(F.create_map(*pairs), F.col("kind"))
    receipt = F.col("verified_receipt")
    receipt_ok = (
        (receipt["success"] == F.lit(True)) & (receipt["remote_path"] == F.col("remote_path"))
        & (receipt["sha256"] == F.col("sha256"))
    )
    rows = entries
    missing = differs = F.lit(False)
    if stored is not None:
        found = stored.select(F.col("remote_path").alias("__path"), F.col("sha256").alias("__found"))
        rows = entries.join(found, F.col(stored_as) == F.col("__path"), "left").drop("__path")
        missing, differs = F.col("__found").isNull(), F.col("__found") != F.col("sha256")
    matched = F.coalesce(F.col("remote_path").rlike(PATH_PATTERN), F.lit(False))
    checked = rows.withColumn(
        "problems",
        reasons(
            ("path_malformed", ~matched | (matched & (part(3) != product))),
            ("kind_mismatch", matched & (part(1) != F.col("kind"))),
            ("source_mismatch", matched & ~part(2).eqNullSafe(expected_source)),
            ("hour_out_of_range", matched & (F.try_to_number(part(5), F.lit("99")) > 23)),
            ("digest_mismatch", matched & (part(6) != F.col("sha256"))),
            ("receipt_disagrees", ~F.coalesce(receipt_ok, F.lit(False))),
            ("file_missing", missing),
            ("checksum_mismatch", differs),
        ),
    )
    return checked.drop("__found")


def sidecar_problems(declared: DataFrame, rows: DataFrame, day_start: Column, day_end: Column) -> DataFrame:
    """Tables whose rows disagree with their declaration or leave the UTC day.

    `declared` has (table, declared_rows); `rows` has (table, at).
    """
    actual = rows.groupBy("table").agg(
        F.count(F.lit(1)).alias("actual_rows"),
        F.count_if(F.col("at").isNull() | (F.col("at") < day_start) | (F.col("at") >= day_end)).alias("outside"),
    )
    joined = declared.join(actual, "table", "full_outer")
    checked = joined.withColumn(
        "problems",
        reasons(
            ("undeclared_table", F.col("declared_rows").isNull()),
            ("row_count_mismatch", F.coalesce("actual_rows", F.lit(0)) != F.col("declared_rows")),
            ("outside_day", F.col("outside") > 0),
        ),
    )
    return checked.where(F.size("problems") > 0)


def reconcile_receipts(artifacts: DataFrame, receipts: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Artifacts of a day against their receipts: every kind and hour once, digests equal.

    Both frames have kind, hour and sha256; receipts also carry revision.
    """
    spark = artifacts.sparkSession
    grid = spark.range(24).select(
        F.col("id").cast("int").alias("hour"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    )
    have = artifacts.groupBy("kind", "hour").agg(
        F.count(F.lit(1)).alias("artifacts"), F.min("sha256").alias("artifact_sha256")
    )
    got = receipts.groupBy("kind", "hour").agg(
        F.count(F.lit(1)).alias("receipts"), F.min("sha256").alias("receipt_sha256"), F.min("revision").alias("revision")
    )
    joined = grid.withColumn("expected", F.lit(True)).join(have, ["kind", "hour"], "full_outer").join(
        got, ["kind", "hour"], "full_outer"
    )
    checked = joined.withColumn(
        "problems",
        reasons(
            ("unexpected_partition", F.col("expected").isNull()),
            ("artifact_missing", F.col("artifacts").isNull()),
            ("receipt_missing", F.col("receipts").isNull()),
            ("duplicate", (F.col("artifacts") > 1) | (F.col("receipts") > 1)),
            ("digest_mismatch", F.col("artifact_sha256") != F.col("receipt_sha256")),
            ("revision_malformed", ~F.col("revision").rlike("^[0-9a-f]{40}$")),
        ),
    )
    return checked.where(F.size("problems") > 0).select("kind", "hour", "problems")


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only one side has, tagged; empty when the inventories agree."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("only_in", F.lit("right"))
    )
