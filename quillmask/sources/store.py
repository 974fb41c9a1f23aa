"""Vault entries in files, with commits: batches, sweeps and compactions that run at once lose nothing.

A store is a folder.  Entries lie in `data/folder=<name of its own>/provider=.../bucket=...`, written once and never changed.  What is in
the store is said by the newest file of `commits/`, a list of such folders and the last batch of each stream.  A commit writes the
next list under a name of its own and renames it to the next number; if that number is taken, it starts again
from the list that was there first.  Readers see the list they began with.

An entry keeps the time of its newest and of its first write and the number of writes, so a conversation's metadata (counts, types, times)
follow from a compacted store as from all its writes, and rewriting a token does not make its conversation younger.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.plans.policy import expired
from quillmask.sources import vault
from quillmask.sources.vault import SCOPE

SCHEMA = "conversation_id string, token string, type string, value binary, created_at timestamp, first_at timestamp, writes long, seq long, folder string, provider string, bucket int"
#: conversations are dealt into so many folders by hash, of which a look-up reads one
BUCKETS = 64
#: folders beyond which batches are merged; files that were taken out are kept for readers so many minutes, those of writers that failed a day
MOST, GRACE, ABANDONED = 100, 10.0, 24 * 60

_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)  # commits of one driver wait for each other


def bucket(conversation_id: Column) -> Column:
    return F.pmod(F.xxhash64(conversation_id), F.lit(BUCKETS)).cast("int")


class Store:
    """A store in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs

    # ---- files and lists -----------------------------------------------------------------------------------------------
    def _at(self, *names: str):
        return self._jvm.Path("/".join((self.path, *names)))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list:
        files, folder = self._files(), self._at(name)
        return list(files.listStatus(folder)) if files.exists(folder) else []

    def commits(self) -> tuple[int, dict]:
        """(number, list) of the newest commit; (0, an empty list) of a new store."""
        numbers = [int(f.getPath().getName()) for f in self._list("commits") if f.getPath().getName().isdigit()]
        if not numbers:
            return 0, {"folders": [], "batches": {}, "dropped": {}}
        stream = self._files().open(self._at("commits", f"{max(numbers):012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Puts change(list) in the place of the newest list, however many others commit; nothing happens where it gives None."""
        with _LOCKS[self.path]:
            while True:
                number, now = self.commits()
                new = change(json.loads(json.dumps(now)))
                if new is None:
                    return False
                files, own = self._files(), self._at("commits", f".{uuid.uuid4().hex}")
                out = files.create(own, False)
                out.write(json.dumps(new).encode())
                out.close()
                last = self._at("commits", f"{number + 1:012d}")
                if not files.exists(last) and self._renamed(own, last):
                    return True
                files.delete(own, False)

    def _renamed(self, own, last) -> bool:
        """Renames, unless the name is taken."""
        context = self._jvm.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(own, last, never)
        except Exception as e:  # FileAlreadyExistsException: someone else was first
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def _written(self, rows: DataFrame) -> str:
        name = f"folder={uuid.uuid4().hex}"
        rows.withColumn("bucket", bucket(F.col("conversation_id"))).write.partitionBy("provider", "bucket").parquet(f"{self.path}/data/{name}")
        return name

    # ---- what it does ----------------------------------------------------------------------------------------------------
    def rows(self, folders: list[str] | None = None) -> DataFrame:
        """Stored rows of the newest list, or of these folders, as they were written."""
        folders = self.commits()[1]["folders"] if folders is None else folders
        reader = self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/data")
        return reader.parquet(*(f"{self.path}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], SCHEMA)

    def read(self, folders: list[str] | None = None) -> DataFrame:
        """Entries with a token's newest value (of equal times the one that was added last), its first write and number of writes."""
        return _merged(self.rows(folders))

    def metadata(self) -> DataFrame:
        """As vault.metadata says it of all writes that were not removed."""
        return _metadata(self.read())

    def conversation(self, key: bytes, provider: str, conversation_id: str, now: Column, ttl_hours: int) -> DataFrame:
        """token, type, value of one scope; nothing if it has expired.  One bucket of one provider is read."""
        own = self.rows().where((F.col("provider") == provider) & (F.col("bucket") == bucket(F.lit(conversation_id))) & (F.col("conversation_id") == conversation_id))
        entries = _merged(own)
        return vault.conversation(entries, _metadata(entries), key, provider, conversation_id, now, ttl_hours)

    def add(self, entries: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Adds entries (as vault.entries gives them).  A batch of a stream that was added before adds nothing again."""
        if stream is not None and self.commits()[1]["batches"].get(stream, -1) >= batch:
            return False
        at = F.col("created_at").cast("timestamp")
        new = entries.select(*SCOPE, "token", "type", "value", at.alias("created_at"), at.alias("first_at"), F.lit(1).cast("long").alias("writes"), F.lit(time.time_ns()).alias("seq"))
        name = self._written(_merged(new))

        def change(now: dict) -> dict | None:
            if stream is not None:
                if now["batches"].get(stream, -1) >= batch:
                    return None
                now["batches"][stream] = batch
            now["folders"].append(name)
            return now

        added = self._commit(change)
        if not added:
            self._files().delete(self._at("data", name), True)
        if len(self.commits()[1]["folders"]) > MOST:
            self.compact()
        return added

    def _rewrite(self, keep: Callable[[DataFrame], DataFrame], folders: list[str] | None = None) -> None:
        """Writes what is to be kept of some folders as one that takes their place; folders that come meanwhile stay as they are."""
        while True:
            old = self.commits()[1]["folders"] if folders is None else folders
            if not old:
                return
            name = self._written(keep(self.read(old)))

            def change(now: dict) -> dict | None:
                if not set(old) <= set(now["folders"]):
                    return None  # another rewriting was first: what was read is no longer what is there
                now["folders"] = [name, *(f for f in now["folders"] if f not in old)]
                now["dropped"] |= dict.fromkeys(old, int(time.time() * 1000))
                return now

            if self._commit(change):
                return
            self._files().delete(self._at("data", name), True)
            if folders is not None:
                return

    def compact(self) -> None:
        """Merges all folders but the first, which holds what was merged before, and that one too once the others have grown to its size."""
        folders = self.commits()[1]["folders"]
        size = lambda f: self._files().getContentSummary(self._at("data", f)).getLength()
        later = folders[1:]
        whole = len(later) > 1 and sum(map(size, later)) >= size(folders[0])
        if len(later) > 1 or whole:
            self._rewrite(lambda df: df, folders if whole else later)
        self.vacuum()

    def sweep(self, now: Column, ttl_hours: int, grace: float = GRACE) -> int:
        """Removes conversations that have expired, tokens and all; returns how many went.  A time to live of 0 keeps all."""
        gone = 0

        def keep(entries: DataFrame) -> DataFrame:
            nonlocal gone
            late = _metadata(entries).where(expired(F.col("created_at"), now, ttl_hours)).select(*SCOPE)
            gone = late.count()
            return entries.join(late, list(SCOPE), "left_anti")

        if ttl_hours > 0:
            self._rewrite(keep)
            self.vacuum(grace)
        return gone

    def remove(self, provider: str, conversation_id: str, grace: float = GRACE) -> None:
        """Removes one conversation."""
        self._rewrite(lambda df: vault.delete(df, provider, conversation_id))
        self.vacuum(grace)

    def vacuum(self, grace: float = GRACE) -> int:
        """Deletes folders that were taken out of the list more than grace (minutes) ago, older lists, and what writers that failed left a day ago."""
        number, now = self.commits()
        clock = time.time() * 1000
        gone = [f for f, at in now["dropped"].items() if at <= clock - grace * 60_000]
        known = {*now["folders"], *now["dropped"]}
        stray = [f for f in self._list("data") if f.getPath().getName() not in known and f.getModificationTime() <= clock - ABANDONED * 60_000]
        old = [f for f in self._list("commits") if f.getPath().getName().isdigit() and int(f.getPath().getName()) < number and f.getModificationTime() <= clock - grace * 60_000]
        for path in [*(self._at("data", f) for f in gone), *(f.getPath() for f in stray + old)]:
            self._files().delete(path, True)

        def change(list_: dict) -> dict | None:
            list_["dropped"] = {f: at for f, at in list_["dropped"].items() if f not in gone}
            return list_ if gone else None

        self._commit(change)
        return len(gone) + len(stray)


def _merged(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("type", "value", "created_at", "seq"), F.struct("created_at", "seq")).alias("_e")
    grouped = rows.groupBy(*SCOPE, "token").agg(newest, F.min("first_at").alias("first_at"), F.sum("writes").alias("writes"))
    return grouped.select(*SCOPE, "token", "_e.*", "first_at", "writes")


def _metadata(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*SCOPE).agg(F.sum("writes").alias("pii_count"), F.sort_array(F.collect_set("type")).alias("pii_types"), F.min("first_at").alias("created_at"), F.max("created_at").alias("updated_at"))
