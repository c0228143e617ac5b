"""Receipts: digests of files and row sets, verification, contract checks, privacy scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ramplake.sources.files import digests, listed

# Path parts and text that must not be published, and the text suffixes that are scanned.
FORBIDDEN_PARTS = ("raw", "private", "scada", "turbine", "coordinates", "operational_status", "whereTurbins.csv")
FORBIDDEN_TEXT = r"(?i)(api[_ -]?key|authorization:|bearer\s+[A-Za-z0-9._-]{12,})"
TEXT_SUFFIXES = (".md", ".json", ".txt", ".yml", ".yaml", ".cff")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, bytes, sha256 of every file under a folder; a file is read once, as a stream."""
    found = digests(listed(spark, path, pattern))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "sha256")


def verify_digests(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows that are missing or differ; an empty result means verified."""
    return manifest.join(found.select("name", "sha256"), ["name", "sha256"], "left_anti")


def row_digest(df: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Order-free digest of the set of training rows per key, mergeable across tasks."""
    h = F.xxhash64(identity)
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("digest"))


def md5_row_digest(df: DataFrame, keys: list[str], identity: Column) -> DataFrame:
    """The same with portable hashing: the exclusive or of the first 60 bits of each row's md5."""
    h = F.conv(F.substring(F.md5(identity.cast("string")), 1, 15), 16, 10).cast("long")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("digest"))


def privacy_hits(df: DataFrame, name: Column, text: Column) -> DataFrame:
    """Rows whose path has a forbidden part, or whose text matches."""
    parts = F.split(F.lower(name), "/")
    path_hit = F.arrays_overlap(parts, F.array(*[F.lit(p.lower()) for p in FORBIDDEN_PARTS]))
    text_hit = text.rlike(FORBIDDEN_TEXT)
    return df.withColumns({"path_hit": F.coalesce(path_hit, F.lit(False)), "text_hit": F.coalesce(text_hit, F.lit(False))})


def privacy_scan(spark: SparkSession, path: str) -> DataFrame:
    """The same over the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    textual = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", "\\."), -1))).isin(*TEXT_SUFFIXES)
    text = F.when(textual, F.decode("content", "UTF-8"))
    return privacy_hits(files, F.col("path"), text).filter("path_hit OR text_hit").select("path", "path_hit", "text_hit")


def contract_violations(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """One pass that counts the rows breaking each rule (a null counts as broken), and repeated keys."""
    out = df.agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    if unique:
        again = df.groupBy(*unique).agg(F.count("*").alias("_n")).filter("_n > 1").agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
        out = out.withColumn("repeated_keys", again)
    return out


def assert_contract(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> None:
    row = contract_violations(df, rules, unique).first().asDict()
    broken = {k: v for k, v in row.items() if k != "rows" and v}
    if broken:
        raise ValueError(f"contract broken: {broken}")
