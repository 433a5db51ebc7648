"""Exactly one copy of each message that was delivered at least once.

Identifiers are dictionary-encoded exactly: an identifier belongs to the shard its hash
names and gets a dense code inside that shard. What was delivered is one bit a code, kept
as bitmaps of 32,768 bits a row, compressed in Parquet. A batch's identifiers are encoded, new
ones at the end of their shard, and one arrival of each unseen bit is selected; then the new bits
are united with the old ones in a new version of the state, which counts only from the moment its
version file appears (a rename). That file names the folder of the version and the batch it came
from, so a try that died is left behind unread and a batch that is repeated finds what it selected.

A version writes what is new: the codes of its new identifiers and the bitmaps those fall in. The
state is the codes of all versions and of each bitmap the newest. ``reshard`` writes one version
with all of it, under another number of shards, after which older codes and bitmaps are dropped.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barterflow.functions.ids import number_key
from barterflow.shared import delete_at_end, fresh_path

#: Shards of a new dictionary, at least; more where the session shuffles into more partitions. A shard is numbered inside one task.
SHARDS = 256

DICTIONARY, BITMAPS, FIRSTS = "dictionary", "bitmaps", "firsts"


def first_arrivals(rows: DataFrame, key: Column, order: list[Column], payload: list[Column]) -> DataFrame:
    """One row a key: the payload of the arrival that is first by ``order`` (nulls last).

    Map tasks aggregate before the shuffle, so a key with a third of all rows crosses it once a task.
    Rows whose key is null are left out. Of arrivals equal in ``order`` the smallest payload is taken.
    """
    rank = [x for c in order for x in (c.isNull(), c)]
    picked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rank)], F.struct(*payload).alias("p"))
    keyed = rows.select(key.alias("__key"), picked.alias("__a")).where("__key IS NOT NULL")
    return keyed.groupBy("__key").agg(F.min("__a").alias("__a")).select("__key", "__a.p.*")


def bit_is_set(bits: Column, position: Column) -> Column:
    """Whether a bitmap of Spark's bitmap functions has the bit at ``position`` (0 to 32,767)."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


class SeenState:
    """Dictionary and bitmaps in a folder, by version. ``shards`` counts for a new state only; an old one keeps its own until ``reshard``."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        old = self.version()
        if old:
            self.shards = self._committed(old)["shards"]
        else:
            self.shards = shards or max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _fs(self) -> tuple[JavaObject, JavaObject]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The newest committed version; 0 before the first commit."""
        fs, path = self._fs()
        root = path(f"{self.path}/commits")
        if not fs.exists(root):
            return 0
        return max([int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()], default=0)

    def _committed(self, version: int) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/commits/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def version_of(self, stream: str, number: int) -> int | None:
        """The version that batch ``number`` of a stream was committed as; None if it wasn't."""
        if not self.version():
            return None
        commits = self.spark.read.schema("version int, stream string, batch bigint").json(f"{self.path}/commits")
        return commits.where((F.col("stream") == stream) & (F.col("batch") == number)).agg(F.max("version").alias("v")).first().v

    def _commit(self, version: int, **more: str | int | list[str] | None) -> None:
        fs, path = self._fs()
        draft, final = path(f"{self.path}/drafts/{version}-{uuid.uuid4().hex}"), path(f"{self.path}/commits/{version}")
        fs.mkdirs(path(f"{self.path}/commits"))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "shards": self.shards} | more).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} was committed by another writer; ingest the batch again")

    def _at(self, version: int) -> str:
        return f"{self.path}/{self._committed(version)['at']}"

    def table(self, what: str, version: int) -> DataFrame:
        """One version's part of a table."""
        return self.spark.read.parquet(f"{self._at(version)}/{what}")

    def _parts(self, version: int) -> list[str]:
        """The folders of the versions whose codes and bitmaps make up the state of ``version``, in order."""
        return [f"{self.path}/{folder}" for folder in self._committed(version)["parts"]]

    def dictionary(self, version: int) -> DataFrame:
        """shard, key, code of every identifier seen up to a version."""
        return self.spark.read.parquet(*[f"{at}/{DICTIONARY}" for at in self._parts(version)])

    def bitmaps(self, version: int) -> DataFrame:
        """shard, bucket, bits up to a version: of each bitmap the newest."""
        every = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{at}/{BITMAPS}").withColumn("v", F.lit(v)) for v, at in enumerate(self._parts(version))])
        return every.groupBy("shard", "bucket").agg(F.max_by("bits", "v").alias("bits"))

    def selected(self, version: int, row_id: str) -> DataFrame:
        """Row ids of the arrivals selected for a committed version."""
        return self.table(FIRSTS, version).select(F.col("row_id").alias(row_id))

    def ingest(self, batch: DataFrame, id_col: str, order: list[str], row_id: str) -> DataFrame:
        """Row ids of the arrivals selected from ``batch``; afterwards their identifiers are seen.

        Null and blank identifiers are never selected. ``order`` picks the arrival of an
        identifier, nulls last, then the smallest ``row_id``.
        """
        return self.selected(self.add(batch, id_col, order, row_id), row_id)

    def add(self, batch: DataFrame, id_col: str, order: list[str], row_id: str, stream: str | None = None, number: int | None = None) -> int:
        """As ``ingest``; returns the version committed, for ``version_of`` and ``selected``."""
        old, new = self.version(), self.version() + 1
        key = number_key(id_col)
        firsts = first_arrivals(batch, key, [F.col(c) for c in [*order, row_id]], [F.col(row_id).alias("row_id")])
        firsts = firsts.select(F.pmod(F.xxhash64("__key"), F.lit(self.shards)).cast("int").alias("shard"), F.col("__key").alias("key"), "row_id")
        folder = f"v{new}-{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        by_shard = Window.partitionBy("shard")
        if old:
            known = self.dictionary(old)
            firsts = firsts.join(known, ["shard", "key"], "left")
            top = known.groupBy("shard").agg(F.max("code").alias("top"))
            fresh = firsts.where("code IS NULL").join(top, "shard", "left").withColumn("code", F.coalesce("top", F.lit(0)) + F.row_number().over(by_shard.orderBy("key"))).withColumn("fresh", F.lit(True))
            firsts = firsts.where("code IS NOT NULL").withColumn("fresh", F.lit(False)).unionByName(fresh.drop("top"))
        else:
            firsts = firsts.withColumn("code", F.row_number().over(by_shard.orderBy("key")).cast("bigint")).withColumn("fresh", F.lit(True))
        firsts = firsts.withColumn("bucket", F.bitmap_bucket_number("code")).withColumn("bit", F.bitmap_bit_position("code"))
        if old:
            firsts = firsts.join(self.bitmaps(old), ["shard", "bucket"], "left").where(~bit_is_set(F.col("bits"), F.col("bit"))).drop("bits")
        firsts.select("shard", "bucket", "bit", "key", "code", "fresh", "row_id").write.option("compression", "zstd").parquet(f"{at}/{FIRSTS}")
        selected = self.spark.read.parquet(f"{at}/{FIRSTS}")
        added = selected.groupBy("shard", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        if old:
            before = self.bitmaps(old).join(added.select("shard", "bucket"), ["shard", "bucket"], "left_semi")
            added = added.unionByName(before).groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        self._write(at, selected.where("fresh").select("shard", "key", "code"), added)
        self._commit(new, at=folder, stream=stream, batch=number, parts=[*(self._committed(old)["parts"] if old else []), folder])
        return new

    def _write(self, at: str, codes: DataFrame, bits: DataFrame) -> None:
        bits.write.option("compression", "zstd").parquet(f"{at}/{BITMAPS}")
        codes.write.option("compression", "zstd").parquet(f"{at}/{DICTIONARY}")

    def reshard(self, shards: int) -> int:
        """The whole state as one new version under ``shards`` shards; the codes and bitmaps of older versions are removed, what they selected stays. Returns the version.

        Identifiers get new codes; those whose bit isn't set stay unseen.
        """
        old, new = self.version(), self.version() + 1
        if not old:
            self.shards = shards
            return 0
        at = f"{self.path}/v{new}-{uuid.uuid4().hex}"
        known = self.dictionary(old).withColumn("bucket", F.bitmap_bucket_number("code")).withColumn("bit", F.bitmap_bit_position("code"))
        known = known.join(self.bitmaps(old), ["shard", "bucket"], "left").select("key", bit_is_set(F.col("bits"), F.col("bit")).alias("seen"))
        known = known.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        known.withColumn("code", F.row_number().over(Window.partitionBy("shard").orderBy("key")).cast("bigint")).write.option("compression", "zstd").parquet(f"{at}/coded")
        coded = self.spark.read.parquet(f"{at}/coded")
        seen = coded.where("seen").groupBy("shard", F.bitmap_bucket_number("code").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
        self._write(at, coded.select("shard", "key", "code"), seen)
        parts, self.shards = self._parts(old), shards
        folder = at.rpartition("/")[2]
        self._commit(new, at=folder, stream=None, batch=None, parts=[folder])
        fs, path = self._fs()
        for p in (*[f"{x}/{what}" for x in parts for what in (DICTIONARY, BITMAPS)], f"{at}/coded"):
            fs.delete(path(p), True)
        return new


def surplus_copies(rows: DataFrame, id_col: str, order: list[str], row_id: str, state: SeenState | None = None, batches: list[DataFrame] | None = None) -> DataFrame:
    """Row ids of every arrival that is a surplus copy: its identifier was seen in the state, or another arrival of it was selected.

    Rows whose identifier is null or blank are no copies. ``row_id`` must be unique; the
    anti-join is on it, so a hot identifier is no hot key there. ``batches``: the rows in parts
    that follow each other by ``order``, ingested one after another; without them, in one.
    """
    if state is None:
        state = SeenState(rows.sparkSession, fresh_path(rows.sparkSession, "seen"))
        delete_at_end(rows.sparkSession, state.path)
    kept = reduce(DataFrame.unionByName, [state.ingest(b, id_col, order, row_id) for b in batches or [rows]])
    candidates = rows.where(number_key(id_col).isNotNull()).select(row_id)
    return candidates.join(kept, row_id, "left_anti")
