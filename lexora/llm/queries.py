"""Named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexora.llm import secrets, sharding
from lexora.llm.ann import nearest
from lexora.llm.bpe import encode_documents
from lexora.llm.fingerprint import fingerprint_edits
from lexora.llm.licenses import scan_licenses
from lexora.llm.near_dedup import near_duplicates
from lexora.llm.packing import pack_documents
from lexora.llm.quality import quality
from lexora.llm.warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents at 0.85."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of documents, with corpus-wide ownership."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).drop("key", "found")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every hundredth embedding."""
    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families stated in documents."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents and the text they decode to, as digests."""
    return encode_documents(_table(spark, sf_dir, "documents"), digest=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts."""
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt into shards of at most 1 MiB of text."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to dictionary-compressed archives and read back."""
    return archive_pages(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_quality": op3_quality,
        "op4_hash_forest": op4_hash_forest,
        "op5_license_scan": op5_license_scan,
        "op6_bpe": op6_bpe,
        "op7_packing": op7_packing,
        "op8_fingerprint": op8_fingerprint,
        "op9_sharding": op9_sharding,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.ORACLE,
        "op9_sharding": sharding.ORACLE,
    }
