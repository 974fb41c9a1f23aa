"""The token vault: encrypted values by scope, with listing, reading, purging and time to live.

Tables are plain data: entries (provider, conversation_id, token, type, value binary, created_at).  Values are
AES-256-GCM with a random nonce in front.  Keys come as arguments and are never written.  `store` keeps entries in files
that can be written and swept at once.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.plans.policy import expired

SCOPE = ("provider", "conversation_id")


def load_key(path: str) -> bytes:
    """A 32-byte key, made on first use and readable by its owner alone."""
    if not os.path.exists(path):
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(fd, "wb") as f:
            f.write(os.urandom(32))
    with open(path, "rb") as f:
        key = f.read()
    if len(key) != 32 or os.stat(path).st_mode & 0o077:
        raise ValueError(f"{path}: not a private 32-byte key")
    return key


def seal(value: Column, key: bytes) -> Column:
    return F.aes_encrypt(value.cast("binary"), F.lit(bytearray(key)), F.lit("GCM"))


def unseal(value: Column, key: bytes) -> Column:
    """Null where it does not decrypt."""
    return F.try_aes_decrypt(value, F.lit(bytearray(key)), F.lit("GCM")).cast("string")


def entries(mapping: DataFrame, key: bytes, created: Column) -> DataFrame:
    """Encrypted entries of a mapping (provider, conversation_id, token, type, value); providers with a slash are refused."""
    good = mapping.where(~F.col("provider").contains("/"))
    return good.select(*SCOPE, "token", "type", seal(F.col("value"), key).alias("value"), created.alias("created_at"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after a write: a scope's token has its newest value."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct("type", "value", "created_at"), F.struct("_new", "created_at")).alias("_e")
    return both.groupBy(*SCOPE, "token").agg(newest).select(*SCOPE, "token", "_e.*")


def metadata(writes: DataFrame) -> DataFrame:
    """Per scope: pii_count (writes, repeated ones too), pii_types, created_at, updated_at."""
    return writes.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("pii_count"), F.sort_array(F.collect_set("type")).alias("pii_types"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def active(meta: DataFrame, now: Column, ttl_hours: int) -> DataFrame:
    return meta.where(~expired(F.col("created_at"), now, ttl_hours))


def conversation(store: DataFrame, meta: DataFrame, key: bytes, provider: str, conversation_id: str, now: Column, ttl_hours: int) -> DataFrame:
    """token, type, value of one scope; nothing if the conversation is unknown or has expired as a whole, and no entries that do not decrypt."""
    own = lambda df: df.where((F.col("provider") == provider) & (F.col("conversation_id") == conversation_id))
    known = own(active(meta, now, ttl_hours)).select(*SCOPE)
    return own(store).join(known, list(SCOPE), "left_semi").select("token", "type", unseal(F.col("value"), key).alias("value")).where("value IS NOT NULL")


def purge(store: DataFrame, meta: DataFrame, now: Column, ttl_hours: int) -> DataFrame:
    """Entries, or metadata, of conversations that have not expired."""
    gone = meta.where(expired(F.col("created_at"), now, ttl_hours)).select(*SCOPE)
    return store.join(gone, list(SCOPE), "left_anti")


def purge_all(store: DataFrame) -> DataFrame:
    """An empty store of the same shape, which takes new entries."""
    return store.limit(0)


def delete(store: DataFrame, provider: str, conversation_id: str) -> DataFrame:
    """Entries, or metadata, of all other conversations."""
    return store.where(~((F.col("provider") == provider) & (F.col("conversation_id") == conversation_id)))


def merge_metadata(old: DataFrame, writes: DataFrame) -> DataFrame:
    """Metadata after more writes: counts add up, types are joined, created_at stays, updated_at moves on; labels and status stay."""
    fresh = metadata(writes).withColumn("label", F.lit(None).cast("string")).withColumn("status", F.lit(None).cast("string"))
    both = with_labels(old).unionByName(fresh)
    return both.groupBy(*SCOPE).agg(
        F.sum("pii_count").alias("pii_count"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("pii_types")))).alias("pii_types"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max("label").alias("label"), F.max("status").alias("status"),
    )


def with_labels(meta: DataFrame) -> DataFrame:
    """Metadata with the columns label and status, null where it had none."""
    for name in ("label", "status"):
        if name not in meta.columns:
            meta = meta.withColumn(name, F.lit(None).cast("string"))
    return meta


def update_metadata(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata replaced whole for the scopes in changes (all columns of meta); new scopes are added."""
    changes = with_labels(changes)
    return with_labels(meta).join(changes.select(*SCOPE), list(SCOPE), "left_anti").unionByName(changes)


def put(store: DataFrame, meta: DataFrame, mapping: DataFrame, key: bytes, created: Column) -> tuple[DataFrame, DataFrame]:
    """(store, metadata) after writing a mapping: both follow from the same sealed entries."""
    new = entries(mapping, key, created)
    return upsert(store, new), merge_metadata(meta, new)


def write(store: DataFrame, path: str) -> None:
    """Partitioned by provider; a write replaces the partitions it holds."""
    store.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider").parquet(path)
