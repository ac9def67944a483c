"""Parquet tables under one root folder, with done-markers and version pointers.

Every path goes through Hadoop's FileSystem, so the same code works on a
local disk, HDFS or an object store named in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


# Of tables with a row per order line: smaller files than the default's. Small tables keep the
# default, since their size on disk bounds a broadcast (``functions.joins.PARQUET_EXPANSION``).
LARGE_CODEC = "zstd"


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths and the Hadoop file system ---------------------------------
    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _fs_path(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, *parts: str) -> bool:
        fs, p = self._fs_path(self.path(*parts))
        return bool(fs.exists(p))

    def write_text(self, text: str, *parts: str) -> None:
        """Write a small file atomically: temp file, then a rename over the old one."""
        target = self.path(*parts)
        fs, p = self._fs_path(target)
        fs.mkdirs(p.getParent())
        tmp = self._fs_path(target + f".{uuid.uuid4().hex}.tmp")[1]
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(tmp), fs.makeQualified(p), options)

    def read_text(self, *parts: str) -> str | None:
        fs, p = self._fs_path(self.path(*parts))
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            jvm = self.spark._jvm
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def folders(self, *parts: str) -> list[str]:
        """Names of the folders under a path (none where it is absent)."""
        fs, p = self._fs_path(self.path(*parts))
        if not fs.exists(p):
            return []
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory())

    def delete(self, *parts: str) -> None:
        fs, p = self._fs_path(self.path(*parts))
        fs.delete(p, True)

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        """Put the folder ``source`` in the place of ``target``, where there may be none."""
        fs, p = self._fs_path(self.path(*source))
        place = self._fs_path(self.path(*target))[1]
        fs.delete(place, True)
        if not fs.rename(p, place):
            raise OSError(f"{p} was not moved to {place}")

    # -- tables -------------------------------------------------------------
    def write(self, df: DataFrame, *parts: str, partition_by: list[str] | None = None,
              codec: str | None = None) -> DataFrame:
        """Write ``df`` as parquet (replacing what is there) and read it back. ``codec``:
        ``LARGE_CODEC`` for tables with a row per order line, default the session's.

        Reading back cuts the lineage: later plans start from the files, a
        lost executor costs a re-read, not a recomputation.
        """
        target = self.path(*parts)
        writer = df.write.mode("overwrite")
        if codec:
            writer = writer.option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(target)
        return self.spark.read.parquet(target)

    def read(self, *parts: str) -> DataFrame:
        return self.spark.read.parquet(self.path(*parts))

    # -- bucketed tables: co-located joins without a shuffle ------------------
    def table_name(self, *parts: str) -> str:
        digest = hashlib.sha1(self.path(*parts).encode()).hexdigest()[:16]
        return f"shopfloor_{parts[-1].lower()}_{digest}"

    def write_bucketed(self, df: DataFrame, key: str, buckets: int, *parts: str,
                       partitioned: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
        """Parquet in ``buckets`` files hashed and sorted on ``key`` (hashed on ``within`` and
        sorted on it and ``key``, if it is given), registered
        as a catalogue table so joins on ``key`` between tables of the same
        bucket count need no exchange. One file per bucket: the rows are
        hash-partitioned on ``key`` first (the same hash bucketing uses),
        unless the caller passes rows already partitioned that way."""
        name = self.table_name(*parts)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        hashed = list(within) or [key]
        rows = df if partitioned else df.repartition(buckets, *hashed)
        (rows.write.mode("overwrite").option("compression", LARGE_CODEC)
         .bucketBy(buckets, *hashed).sortBy(*within, key).option("path", self.path(*parts))
         .saveAsTable(name))
        return self.spark.table(name)

    def open_bucketed(self, key: str, buckets: int, *parts: str) -> DataFrame:
        """The bucketed table at ``parts``, registered again in this session
        (the catalogue may be in-memory) with its bucket spec."""
        name = self.table_name(*parts)
        if not self.spark.catalog.tableExists(name):
            schema = self.read(*parts).schema
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet "
                           f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS "
                           f"LOCATION '{self.path(*parts)}'")
        return self.spark.table(name)

    def drop_bucketed(self, *parts: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table_name(*parts)}")
        self.delete(*parts)

    def mark_done(self, *parts: str) -> None:
        self.write_text("done", *parts, "_DONE")

    def is_done(self, *parts: str) -> bool:
        return self.exists(*parts, "_DONE")

    # -- versions: write a new copy, then move one pointer --------------------
    def new_version(self, name: str) -> str:
        return f"v-{uuid.uuid4().hex[:12]}"

    def publish(self, name: str, version: str) -> None:
        self.write_text(version, name, "CURRENT")

    def current_version(self, name: str) -> str | None:
        text = self.read_text(name, "CURRENT")
        return text.strip() if text else None

    def scratch(self, prefix: str) -> str:
        """A fresh path for intermediate output, never reused."""
        return self.path("scratch", f"{prefix}-{uuid.uuid4().hex[:12]}")
