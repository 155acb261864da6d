"""A persisted ordered key-value table: base files, an append-only write log and a manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from keystrand.errors import Conflict, InvalidArgument, NotSupported
from keystrand.functions.keys import MAX_KEY, MIN_KEY, is_reserved
from keystrand.operators import fsck, layout, lookup, merge

#: Bits of a stored sequence number below the number of its batch.
SEQ_BITS = 40


@dataclass(frozen=True)
class StoreOptions:
    """Options that change results; ``validate`` raises ``InvalidArgument``."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    records_per_page_goal: int = 44
    records_per_page_epsilon: float = 5
    fill_pct: int = 50
    reorg_length: int = 5
    key_step: int = 1

    def validate(self) -> None:
        bad = [
            (self.records_per_page_goal < 1, "records_per_page_goal"),
            (self.records_per_page_epsilon < 0, "records_per_page_epsilon"),
            (not 1 <= self.fill_pct <= 100, "fill_pct"),
            (self.reorg_length < 2, "reorg_length"),
            (self.key_step == 0, "key_step"),
        ]
        names = [name for wrong, name in bad if wrong]
        if names:
            raise InvalidArgument(f"out of range: {', '.join(names)}")


class KVStore:
    """``key long, value`` rows under one path.

    ``base-N-*`` holds rows sorted within key ranges; ``log/batch-N-*`` one appended batch each, in
    folders of names that no other writer takes.  Every change ends with a new manifest version, which
    names them and is moved into place only if no other writer took that version; so readers see whole
    batches only, and the loser of a race changes nothing.  All reads and writes go through Spark, so any
    store that Spark reaches will do.  Readers keep the manifest they opened; ``refresh`` takes the newest.

    Keys are longs from 1, or byte strings (a binary ``key`` at the load) in byte order, all but null.
    """

    MANIFEST = "version long, base string, batches array<string>, next_batch long, streamed long"

    def __init__(self, spark: SparkSession, path: str, options: StoreOptions):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.manifest: dict = {"version": 0, "base": "", "batches": [], "next_batch": 1, "streamed": -1}

    # --- opening -----------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: StoreOptions | None = None) -> KVStore:
        """Opens or creates; options are judged first, then existence."""
        store = cls(spark, path, options or StoreOptions())
        store.options.validate()
        exists = bool(store._names("manifest"))
        if exists and store.options.error_if_exists:
            raise InvalidArgument(f"{path} exists")
        if not exists and not store.options.create_if_missing:
            raise InvalidArgument(f"{path} does not exist")
        if exists:
            store.refresh()
        return store

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self, at):
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        fs = self._files(at)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, name: str) -> None:
        at = self._at(name)
        self._files(at).delete(at, True)

    def refresh(self) -> None:
        newest = max((n for n in self._names("manifest") if n.startswith("v-")), default=None)
        if newest:
            row = self.spark.read.json(f"{self.path}/manifest/{newest}", schema=self.MANIFEST).first()
            self.manifest = row.asDict() | {"batches": list(row["batches"] or [])}

    def _commit(self, **change) -> None:
        """Publishes the next manifest version; ``Conflict`` if another writer has published it."""
        new = self.manifest | change | {"version": self.manifest["version"] + 1}
        staged = self._at(f"manifest/.staged-{uuid.uuid4().hex}")
        fs, jvm = self._files(staged), self.spark.sparkContext._jvm
        out = fs.create(staged, False)
        out.write(json.dumps(new).encode())
        out.close()
        final = self._at(f"manifest/v-{new['version']:012d}")
        try:
            # a rename that never replaces
            none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(staged, final, none)
        except Py4JJavaError as e:
            fs.delete(staged, True)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {new['version']} was published by another writer; refresh and try again") from None
            raise
        self.manifest = new

    @property
    def loaded(self) -> bool:
        return bool(self.manifest["base"])

    # --- loading -----------------------------------------------------------------------------

    def bulk_load(self, rows: DataFrame, order: str | None = None) -> None:
        """Loads ``key, value`` into an empty store.

        A store that holds data: ``NotSupported``.  No rows, reserved or repeated keys, or keys that
        do not ascend along the column ``order`` where one is named: ``InvalidArgument``.
        """
        if self.loaded or self.manifest["next_batch"] > 1:
            raise NotSupported("the store holds data")
        found = fsck.load_violations(rows.select(F.col(order or "key").alias("pos"), "key")).first()
        if not found["n"] or found["reserved"] or found["duplicate_keys"] or (order and found["unordered"]):
            raise InvalidArgument(f"rows to load: {found.asDict()}")
        kind = "binary" if isinstance(rows.schema["key"].dataType, (BinaryType, StringType)) else "long"
        self._write_base(rows.select(F.col("key").cast(kind).alias("key"), "value"))

    def _write_base(self, view: DataFrame, **change) -> None:
        name = f"base-{self.manifest['version'] + 1:012d}-{uuid.uuid4().hex}"
        view.repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").parquet(f"{self.path}/{name}")
        self._commit(base=name, **change)

    # --- writing -----------------------------------------------------------------------------

    def write(self, batch: DataFrame, streamed: int | None = None) -> None:
        """Appends ``op ('W' or 'D'), key, value`` and, for repeated keys, ``seq`` (below 2^40).

        Unloaded: ``NotSupported``.  Reserved keys, unknown ops, and repeated keys without ``seq``:
        ``InvalidArgument``.  ``streamed`` numbers a micro-batch; one that was applied is skipped.  The
        batch is evaluated once: what was written is what is checked, before it is published.
        """
        if not self.loaded:
            raise NotSupported("not loaded")
        if streamed is not None and streamed <= self.manifest["streamed"]:
            return
        ordered = "seq" in batch.columns
        seq = F.col("seq").cast("long") if ordered else F.lit(0).cast("long")
        types = self._schema()
        n = self.manifest["next_batch"]
        rows = batch.select((F.lit(n << SEQ_BITS) + seq).alias("seq"), "op", F.col("key").cast(types["key"].dataType).alias("key"), F.col("value").cast(types["value"].dataType).alias("value"))
        name = f"batch-{n:012d}-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.path}/log/{name}")
        staged = self.spark.read.schema(rows.schema).parquet(f"{self.path}/log/{name}")
        own = F.col("seq") - (n << SEQ_BITS)
        checks = [F.count(F.when(is_reserved(F.col("key"), types["key"].dataType), 1)), F.count(F.when(~F.col("op").isin(merge.PUT, merge.DELETE) | F.col("op").isNull(), 1)), F.count(F.when(own.isNull() | (own < 0) | (own >= 1 << SEQ_BITS), 1))]
        reserved, unknown, outside = staged.agg(*checks).first()
        repeated = not staged.groupBy("key", "seq").count().where("count > 1").isEmpty()
        try:
            if reserved or unknown or outside or repeated:
                raise InvalidArgument(f"{reserved} reserved keys, {unknown} unknown ops, {outside} bad seq, repeated keys: {repeated}")
            self._commit(batches=[*self.manifest["batches"], name], next_batch=n + 1, **({} if streamed is None else {"streamed": streamed}))
        except (InvalidArgument, Conflict):
            self._delete(f"log/{name}")
            raise

    def _schema(self) -> StructType:
        return self.spark.read.parquet(f"{self.path}/{self.manifest['base']}").schema

    def put(self, rows: DataFrame) -> None:
        self.write(rows.withColumn("op", F.lit(merge.PUT)))

    def delete(self, keys: DataFrame) -> None:
        """Absent keys are no error."""
        self.write(keys.select("key", F.lit(merge.DELETE).alias("op"), F.lit(None).alias("value")))

    def read_modify_write(self, keys: DataFrame, change) -> None:
        self.write(merge.read_modify_write(self.view(), keys.select("key", F.lit(0).alias("seq")), change))

    # --- reading -----------------------------------------------------------------------------

    def log(self) -> DataFrame:
        """``seq, op, key, value`` of the batches that are not in the base yet."""
        own = self._schema()
        schema = StructType.fromDDL("seq long, op string").add(own["key"]).add(own["value"])
        paths = [f"{self.path}/log/{name}" for name in self.manifest["batches"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def view(self) -> DataFrame:
        """Base and log as one; the newest write of a key wins."""
        if not self.loaded:
            return self.spark.createDataFrame([], "key long, value binary")
        base = self.spark.read.parquet(f"{self.path}/{self.manifest['base']}")
        return merge.merge_view(base, self.log()) if self.manifest["batches"] else base

    def get(self, key: int | bytes):
        """The value, or None if there is none, the key is reserved or the store not loaded."""
        row = lookup.get(self.view(), key).first()
        return None if row is None else row["value"]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return lookup.multi_get(self.view(), keys)

    def scan(self, start: int | bytes, limit: int) -> DataFrame:
        """Unloaded stores give no rows, whatever the start; then reserved starts are refused."""
        return lookup.range_scan(self.view(), start, limit) if self.loaded else self.view()

    def pages(self) -> DataFrame:
        return layout.pages_fixed_pack(self.view(), self.options.records_per_page_goal)

    # --- compaction --------------------------------------------------------------------------

    def flush(self) -> None:
        """Rewrites the base with the log applied; older log batches are discarded from the view."""
        if self.loaded and self.manifest["batches"]:
            self._write_base(self.view(), batches=[])

    def flatten(self, start: int | bytes, end: int | bytes) -> None:
        """Compacts a key range; the files of a base are whole, so all of the log goes in."""
        if not self.loaded:
            raise NotSupported("not loaded")
        if start > end or (isinstance(start, int) and (start < MIN_KEY or start >= MAX_KEY or end < MIN_KEY)):
            raise InvalidArgument(f"range {start}..{end}")
        self.flush()

    def vacuum(self) -> list[str]:
        """Removes bases, log batches and manifests that the newest manifest does not name."""
        self.refresh()
        m = self.manifest
        old = [n for n in self._names("") if n.startswith("base-") and n != m["base"] and n < m["base"]]
        # a batch of a number not yet taken may be one that another writer is about to publish
        old += [f"log/{n}" for n in self._names("log") if n not in m["batches"] and n < f"batch-{m['next_batch']:012d}"]
        old += [f"manifest/{n}" for n in self._names("manifest") if n.startswith("v-") and n < f"v-{m['version']:012d}"]
        for name in old:
            self._delete(name)
        return old
