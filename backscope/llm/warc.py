"""WARC archives: a deterministic sharded writer, and a reader.

Records are parted into ranges of their id by histograms of bytes over ids, refined where they are heavy (no sampling, so that
reruns agree), sorted inside each range, written as one gzip member each, and rolled to a new file at a compressed size. Headers and digests are
made anew from the payload. A file is written under a temporary name and moved to its final name when it is whole; the
list of files is itself a table that appears by one rename at the end. Only files in that list are read.

Of records with equal payloads of at least `least` bytes, the one with the smallest id is a response and the others revisit
it; where that id itself repeats, its first row in the order of the sort is the response. Smaller payloads, and rows whose
id is null, are all responses. A null payload counts as empty. A null or unfit target becomes urn:page:<id>. An empty table
gives an empty list of files. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

#: Bytes of payload for a shard, compressed bytes at which a file is closed, and cells of a histogram at most.
SHARD_BYTES, ROLL_BYTES, CELLS = 64 << 20, 16 << 20, 8192
#: Records are regenerated, so their date is a parameter and not the clock.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "shard long, name string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload binary, block_ok boolean, file string"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that executors can open, and the path in it."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("/") else f"file:/{uri.removeprefix('file:').lstrip('/')}")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def target_of(url: str | None, page: int | None) -> str:
    if not url:
        return f"urn:page:{'none' if page is None else page}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, its headers made from the payload. refers_to: the id of the response that it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest if refers_to is None else digest + '/revisit')}", f"WARC-Date: {date}", f"WARC-Target-URI: {target_of(url, page)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Id: {refers_to}"]
    if page is not None:
        head.append(f"X-Record-Id: {page}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def digest_of(stream: pa.NativeFile) -> str:
    out = hashlib.sha256()
    while part := stream.read(1 << 20):
        out.update(part)
    return out.hexdigest()


class Roll:
    """The files of one shard, one after another."""

    def __init__(self, folder: str, shard: int, most: int) -> None:
        self.fs, self.folder = opened(folder)
        self.shard, self.most, self.number, self.out = shard, most, 0, None
        self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)

    def add(self, page: int | None, data: bytes) -> tuple | None:
        """Write a record; gives the row of the file that it closes, if it does."""
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}-{self.name}"
            self.out, self.size, self.records, self.sum, self.first = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256(), page
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sum.update(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, page
        return self.close() if self.size >= self.most else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self.fs.get_file_info(final).type != pafs.FileType.NotFound:
            # another attempt's, which may be listed already, stays if it has the same bytes
            with self.fs.open_input_stream(final, compression=None) as stream:
                same = self.sum.hexdigest() == digest_of(stream)
            if same:
                self.fs.delete_file(self.temporary)
            else:  # left by a run that never listed its files
                self.fs.move(self.temporary, final)
        else:
            self.fs.move(self.temporary, final)
        self.out, self.number = None, self.number + 1
        return self.shard, self.name, self.records, self.size, self.sum.hexdigest(), self.first, self.last


def _write(batches: Iterator[pa.RecordBatch], folder: str, most: int, date: str) -> Iterator[pa.RecordBatch]:
    """Rows by shard and id; those without a payload say which response the row after them revisits."""
    roll, rows, told, seen = None, [], None, None
    for batch in batches:
        for shard, page, digest, payload, url, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if roll is None or roll.shard != shard:
                rows.append(roll and roll.close())
                roll = Roll(folder, shard, most)
            if payload is None:
                told = (page, digest, refers_to)
                continue
            refers = told[2] if told and told[:2] == (page, digest) and page is not None else None
            if refers == page and seen != (page, digest):
                refers = None
            seen = (page, digest)
            rows.append(roll.add(page, record(page, url, payload, digest, refers, date)))
    rows.append(roll and roll.close())
    rows = [r for r in rows if r]
    if rows:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["shard", "name", "records", "bytes", "sha256", "first_id", "last_id"])


def shards(sizes: DataFrame, shard_bytes: int, cells: int = CELLS) -> list[int]:
    """The first ids of shards, but the first shard's, from (id, payload_bytes).

    Cells of equal width over all ids are summed; one that holds more than a quarter of a shard is cut into narrower cells in
    the next round, until it is a single id or light. So outlying ids don't put all others into one cell, and at most
    `cells` sums, or some for each shard that is written, reach the driver.
    """
    sizes = sizes.where("id is not null").select("id", (F.col("payload_bytes") + 400).alias("bytes"))
    low, high, total = sizes.agg(F.min("id"), F.max("id"), F.sum("bytes")).first()
    if low is None or total <= shard_bytes:
        return []
    heavy, light = [(low, high - low + 1, total)], []
    while heavy:
        # start, width and cells of each heavy range, which lie apart
        cut = [(start, -(-width // min(width, cells, 16 * -(-n // shard_bytes) + 16))) for start, width, n in heavy]
        starts, widths, spans = np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.uint64), np.array([width - 1 for _, width, _ in heavy], np.uint64)

        @F.pandas_udf("long")
        def cell(ids: pd.Series) -> pd.Series:
            """The first id of a cell; null outside of all heavy ranges. Differences of ids need all 64 bits."""
            x = ids.to_numpy(np.int64)
            k = np.maximum(np.searchsorted(starts, x, "right") - 1, 0)
            first = starts[k].view(np.uint64)
            off = x.view(np.uint64) - first
            return pd.Series(pd.arrays.IntegerArray((first + off // widths[k] * widths[k]).view(np.int64), (x < starts[k]) | (off > spans[k])))

        found = sizes.select(cell("id").alias("cell"), "bytes").where("cell is not null").groupBy("cell").agg(F.sum("bytes")).collect()
        heavy = []
        for start, n in found:
            j = int(np.searchsorted(starts, start, "right")) - 1
            width = min(int(widths[j]), int(starts[j]) + int(spans[j]) + 1 - start)
            (heavy if 4 * n > shard_bytes and width > 1 else light).append((start, width, n))
        heavy.sort()
    out, filled = [], 0
    for start, _, n in sorted(light):
        if filled and filled + n > shard_bytes:
            out.append(start)
            filled = 0
        filled += n
    return out


def write(df: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for each row under the folder (a URI that driver and executors share); gives the table of files.

    The payloads are shuffled once, to their range. Which row revisits which is found from digests alone: the smallest id
    for each digest is summed before the shuffle and written, so that the join which finds the others can split one that
    very many rows share.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(f"{folder}/_files")):
        raise FileExistsError(f"{folder} has a list of files already")
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(F.encode(F.col(f"`{payload}`").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.select("id", F.sha2("payload", 256).alias("digest"), "payload", "url")
    facts = keep(rows.select("id", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-facts")
    large = facts.where(F.col("payload_bytes") >= least).where("id is not null")
    firsts = keep(large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-firsts")
    # the smallest id itself comes along: it may stand in several rows
    revisits = large.select("id", "digest").join(firsts, "digest").select("id", "digest", F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("string").alias("url"), "refers_to").distinct()
    firsts_of = np.array(shards(facts, shard_bytes), np.int64)
    # rows without id, in no order but that of their digests, have shards of their own
    nameless = facts.where("id is null").agg(F.coalesce(F.sum(F.col("payload_bytes") + 400), F.lit(0))).first()[0]
    named, more = len(firsts_of) + 1, -(-nameless // shard_bytes)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts_of, ids.to_numpy(), "right").astype(np.int32))

    apart = (F.lit(named) + F.conv(F.substring("digest", 1, 12), 16, 10).cast("long") * more / F.lit(float(1 << 48))).cast("int")
    shard = F.when(F.col("id").isNull(), apart).otherwise(range_of(F.coalesce("id", F.lit(0)))).alias("shard")
    all_rows = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
    # a task for each shard
    dealt = all_rows.select(shard, "id", "digest", "payload", "url", "refers_to").repartitionById(named + more, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", "id", "digest", F.col("payload").isNotNull(), "url")
    temporary = f"{folder}/_files-{uuid.uuid4().hex}"
    dealt.mapInArrow(partial(_write, folder=folder, most=roll_bytes, date=date), FILES).write.parquet(temporary)
    if not fs.rename(path(temporary), path(f"{folder}/_files")):
        raise OSError(f"the list of files can't be put in {folder}")
    fs.delete(path(f"{folder}/_temporary"), True)
    return files(spark, folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{folder}/_files")


def members(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    rest, part, unpack = b"", [], zlib.decompressobj(31)
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            if part:
                raise ValueError("the file ends within a record")
            return
        part.append(unpack.decompress(rest))
        rest = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(part)
            part, unpack = [], zlib.decompressobj(31)


def headers_of(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), rest


def parsed(data: bytes) -> tuple:
    """What a record says, its digests reckoned from the bytes."""
    head, rest = headers_of(data)
    block = rest[: int(head["Content-Length"])]
    http, payload = headers_of(block)
    told = head["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = head["WARC-Type"] == "revisit"
    ok = head["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}" and rest[len(block) :] == b"\r\n\r\n"
    digest = told if revisit else hashlib.sha256(payload).hexdigest()
    page, refers = head.get("X-Record-Id"), head.get("X-Refers-To-Id")
    return page and int(page), int(http["Content-Length"]) if revisit else len(payload), digest, head["WARC-Type"], refers and int(refers), head["WARC-Target-URI"], None if revisit else payload, ok and digest == told


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, path = opened(folder)
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows, size = [], 0
            with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for data in members(stream):
                    row = parsed(data)
                    rows.append((*row[:6], row[6] if payloads else None, row[7], name))
                    size += len(data) if payloads else 200
                    if size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all files in the list: id, size and digest of the full payload (for a revisit, as its headers tell), type, the id it refers to, target, payload (none for revisits), whether digests hold, and the file."""
    listed = files(spark, folder).select("name")
    return listed.repartition(max(1, listed.count())).mapInArrow(partial(_read, folder=folder, payloads=payloads), RECORDS)
