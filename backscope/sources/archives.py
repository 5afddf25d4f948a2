"""Sidecars, custom archives and table exports."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIDECAR = "version string, timestamp timestamp, database string, database_type string, host string, backup_file string, size_bytes bigint, sha256 string, compression string, backup_type string, base_backup string, duration double, extra_info map<string,string>"


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """The *.meta.json files of a folder, one row each; files that aren't such JSON are left out."""
    raw = spark.read.option("mode", "DROPMALFORMED").option("multiLine", True).option("pathGlobFilter", "*.meta.json").schema(SIDECAR).json(folder)
    return raw.where("backup_file is not null or database is not null")


def cluster_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each database of the cluster files of a folder."""
    schema = f"timestamp timestamp, cluster_name string, databases array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in SIDECAR.split(', ')))}>>"
    raw = spark.read.option("mode", "DROPMALFORMED").option("multiLine", True).option("pathGlobFilter", "*.meta.json").schema(schema).json(folder)
    return raw.where("databases is not null").select("cluster_name", F.explode("databases").alias("d")).select("cluster_name", "d.*")


MAGIC, END = b"BSAR0001", b"BSARTOC1"


def pack(entries: Sequence[tuple[dict, bytes]]) -> bytes:
    """An archive: magic, compressed blocks, the table of contents as JSON, its place, end mark."""
    out, toc = [MAGIC], []
    at = len(MAGIC)
    for about, data in entries:
        block = zlib.compress(data, 6)
        toc.append({**about, "offset": at, "stored": len(block), "length": len(data), "crc": zlib.crc32(data)})
        out.append(block)
        at += len(block)
    text = json.dumps(toc).encode()
    return b"".join([*out, text, struct.pack("<QQ", at, len(text)), END])


def contents(data: bytes) -> list[dict]:
    """An archive's table of contents."""
    if data[: len(MAGIC)] != MAGIC or data[-len(END) :] != END:
        raise ValueError("no archive, or cut off")
    at, size = struct.unpack("<QQ", data[-len(END) - 16 : -len(END)])
    return json.loads(data[at : at + size])


def block(data: bytes, entry: dict) -> bytes:
    """An entry's data; a wrong checksum is an error."""
    out = zlib.decompress(data[entry["offset"] : entry["offset"] + entry["stored"]])
    if zlib.crc32(out) != entry["crc"]:
        raise ValueError(f"entry {entry.get('tag')} is damaged")
    return out


ENTRIES = "path string, dump_id bigint, tag string, section int, length bigint, data binary"


def _entries(batches: Iterator[pa.RecordBatch], with_data: bool) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(path, e.get("dump_id"), e.get("tag"), e.get("section"), e["length"], block(data, e) if with_data else None) for e in contents(data)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in ENTRIES.split(", ")])


def read_archives(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The entries of all archives under a path, in the store that Spark reads."""
    from functools import partial

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(partial(_entries, with_data=with_data), ENTRIES)


def _round_trip(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            part = batch.slice(first, most)
            rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
            archive = pack([({"dump_id": i, "tag": g, "section": 2}, d or b"") for i, g, d in rows])
            back = [(e["dump_id"], e["tag"], block(archive, e)) for e in contents(archive)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*back, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["blob_id", "grp", "data"])


def round_trip(blobs: DataFrame, most: int = 200) -> DataFrame:
    """blob_id, grp, data: packed into archives of at most that many entries, and read back from their bytes."""
    from functools import partial

    return blobs.select("blob_id", "grp", "data").mapInArrow(partial(_round_trip, most=most), "blob_id long, grp string, data binary")


class ArchiveSource(DataSource):
    """`spark.read.format("bsar").load(path)`: entries of one archive, a partition for each, from a path that Python opens."""

    @classmethod
    def name(cls) -> str:
        return "bsar"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options["path"])


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _open(self):
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file:///{self.path.removeprefix('file:').lstrip('/')}")
        return fs.open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        with self._open() as f:
            size = f.size()
            f.seek(size - len(END) - 16)
            tail = f.read()
            if tail[-len(END) :] != END:
                raise ValueError("no archive, or cut off")
            at, n = struct.unpack("<QQ", tail[:16])
            f.seek(at)
            toc = json.loads(f.read(n))
        return [InputPartition(e) for e in toc]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        e = partition.value
        with self._open() as f:
            f.seek(e["offset"])
            data = zlib.decompress(f.read(e["stored"]))
        if zlib.crc32(data) != e["crc"]:
            raise ValueError(f"entry {e.get('tag')} is damaged")
        yield self.path, e.get("dump_id"), e.get("tag"), e.get("section"), e["length"], data


def export_tables(spark: SparkSession, tables: dict[str, DataFrame], folder: str, sizes: dict[str, int] | None = None, workers: int = 4) -> list[str]:
    """Write tables as Parquet, the largest first, a few at once; each is parted by Spark."""
    from concurrent.futures import ThreadPoolExecutor

    order = sorted(tables, key=lambda n: (-(sizes or {}).get(n, 0), n))
    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(lambda n: tables[n].write.mode("overwrite").parquet(f"{folder}/{n}"), order))
    return order


def read_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A database's table through JDBC, in ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties or {})


PACKS = "pack long, objects long, bytes long, data binary, toc array<struct<id: bigint, offset: bigint, length: bigint>>"


def pack_objects(blobs: DataFrame, pack_bytes: int = 16 << 20) -> DataFrame:
    """Large objects in packs of about that many bytes, by running total in order of id within ranges; each pack has its table."""
    from pyspark.sql import Window

    size = F.octet_length("data").cast("long")
    part = F.spark_partition_id()
    ranged = blobs.select("blob_id", "data", size.alias("size")).repartitionByRange("blob_id").withColumn("part", part)
    total = F.sum("size").over(Window.partitionBy("part").orderBy("blob_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("n", F.floor(F.coalesce(total, F.lit(0)) / pack_bytes))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("blob_id").to_pylist(), table.column("data").to_pylist(), strict=True), key=lambda r: r[0])
        at, toc = 0, []
        for i, data in rows:
            toc.append({"id": i, "offset": at, "length": len(data or b"")})
            at += len(data or b"")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])))
        row = (key[0].as_py() << 32 | key[1].as_py(), len(rows), at, b"".join(d or b"" for _, d in rows), toc)
        return pa.table({x: pa.array([c], t) for x, c, t in zip(("pack", "objects", "bytes", "data", "toc"), row, kinds, strict=True)})

    return placed.groupBy("part", "n").applyInArrow(run, PACKS)
