"""Binary objects: size statistics, types by magic bytes and entropy, advice on compression, duplicates."""

from __future__ import annotations

import gzip
import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import written

KIB, MIB = 1 << 10, 1 << 20

#: Signatures in order, as hexadecimal digits from the start (or from byte 4, or with a form at byte 8), type, and name.
SIGNATURES = (
    ("FFD8FF", 0, "", "compressed", "jpeg"),
    ("89504E470D0A1A0A", 0, "", "compressed", "png"),
    ("474946383761", 0, "", "compressed", "gif"),
    ("474946383961", 0, "", "compressed", "gif"),
    ("52494646", 0, "57454250", "compressed", "webp"),
    ("424D", 0, "", "binary", "unknown"),
    ("49492A00", 0, "", "binary", "unknown"),
    ("4D4D002A", 0, "", "binary", "unknown"),
    ("25504446", 0, "", "compressed", "pdf"),
    ("504B0304", 0, "", "compressed", "zip"),
    ("D0CF11E0A1B11AE1", 0, "", "binary", "unknown"),
    ("1F8B", 0, "", "compressed", "gzip"),
    ("425A68", 0, "", "compressed", "bzip2"),
    ("28B52FFD", 0, "", "compressed", "zstd"),
    ("FD377A585A00", 0, "", "compressed", "xz"),
    ("04224D18", 0, "", "compressed", "unknown"),
    ("526172211A07", 0, "", "compressed", "unknown"),
    ("377ABCAF271C", 0, "", "compressed", "unknown"),
    ("66747970", 4, "", "compressed", "mp4"),
    ("494433", 0, "", "compressed", "mp3"),
    ("FFFB", 0, "", "compressed", "unknown"),
    ("FFF3", 0, "", "compressed", "unknown"),
    ("FFF2", 0, "", "compressed", "unknown"),
    ("4F676753", 0, "", "compressed", "ogg"),
    ("664C6143", 0, "", "compressed", "flac"),
    ("52494646", 0, "41564920", "compressed", "unknown"),
    ("1A45DFA3", 0, "", "compressed", "unknown"),
    ("7B", 0, "", "text", "json"),
    ("5B", 0, "", "text", "unknown"),
    ("3C3F786D6C", 0, "", "text", "xml"),
    ("3C68746D6C", 0, "", "text", "unknown"),
    ("3C21444F4354595045", 0, "", "text", "unknown"),
    ("3C21646F6374797065", 0, "", "text", "unknown"),
    ("3C737667", 0, "", "text", "unknown"),
    ("2D2D2D0A", 0, "", "text", "unknown"),
    ("2D2D2D0D0A", 0, "", "text", "unknown"),
    ("2D2D0A2D2D20506F737467726553514C", 0, "", "database", "unknown"),
    ("2D2D0D0A2D2D20506F737467726553514C", 0, "", "database", "unknown"),
    ("2D2D204D7953514C2064756D70", 0, "", "database", "unknown"),
    ("2D2D204D6172696144422064756D70", 0, "", "database", "unknown"),
    ("5047444D50", 0, "", "compressed", "pg_custom"),
    ("7373682D", 0, "", "text", "unknown"),
    ("2D2D2D2D2D424547494E", 0, "", "text", "unknown"),
)


def _holds(head: Column, signature: tuple) -> Column:
    magic, at, form, *_ = signature
    hit = F.substring(head, 2 * at + 1, len(magic)) == magic
    return hit & (F.substring(head, 17, 8) == form) if form else hit


def head_of(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 20))


def entropy_of(data: Column) -> Column:
    """Shannon entropy of the first 4096 bytes in bits, 0 to 8."""

    @F.pandas_udf("double")
    def entropy(values: pd.Series) -> pd.Series:
        def one(v: bytes | None) -> float:
            if not v:
                return 0.0
            n = np.bincount(np.frombuffer(v[:4096], np.uint8), minlength=256)
            p = n[n > 0] / n.sum()
            return float(-(p * np.log2(p)).sum()) + 0.0

        return values.map(one)

    return entropy(data)


def byte_profile(data: Column) -> Column:
    """Of a whole value: share of text bytes (printable, tab, line ends, or above 127 in valid UTF-8), and chi-square against equal bytes."""

    @F.pandas_udf("text_share double, chi_square double")
    def profile(values: pd.Series) -> pd.DataFrame:
        def one(v: bytes | None) -> tuple[float, float]:
            if not v:
                return 0.0, 0.0
            x = np.frombuffer(v, np.uint8)
            n = np.bincount(x, minlength=256)
            try:
                v.decode()
                high = int(n[128:].sum())
            except UnicodeDecodeError:
                high = 0
            expected = len(x) / 256
            return float(n[32:127].sum() + n[[9, 10, 13]].sum() + high) / len(x), float(((n - expected) ** 2 / expected).sum())

        return pd.DataFrame([one(v) for v in values], columns=["text_share", "chi_square"])

    return profile(data)


def looks(profile: Column) -> Column:
    """Text over a share of 0.85; random under a chi-square of 300; else binary."""
    return F.when(profile["text_share"] > 0.85, "text").when(profile["chi_square"] < 300, "random").otherwise("binary")


#: A second list of formats in order: name, endings, first bytes in hexadecimal digits, whether they are worth compressing.
NAMES = (
    ("JPEG", (".jpg", ".jpeg"), "FFD8FF", False),
    ("PNG", (".png",), "89504E47", False),
    ("GIF", (".gif",), "47494638", False),
    ("WebP", (".webp",), "52494646", False),
    ("GZIP", (".gz", ".gzip"), "1F8B", False),
    ("ZIP", (".zip",), "504B0304", False),
    ("ZSTD", (".zst", ".zstd"), "28B52FFD", False),
    ("XZ", (".xz",), "FD377A585A", False),
    ("BZIP2", (".bz2",), "425A68", False),
    ("7Z", (".7z",), "377ABCAF271C", False),
    ("RAR", (".rar",), "52617221", False),
    ("MP4", (".mp4", ".m4v"), "000000", False),
    ("MP3", (".mp3",), "FFFB", False),
    ("OGG", (".ogg", ".oga", ".ogv"), "4F676753", False),
    ("PDF", (".pdf",), "25504446", False),
    ("DOCX/Office", (".docx", ".xlsx", ".pptx"), "504B0304", False),
    ("BMP", (".bmp",), "424D", True),
    ("TIFF", (".tif", ".tiff"), "49492A00", True),
    ("XML", (".xml",), "3C3F786D6C", True),
    ("JSON", (".json",), "7B", True),
)
#: What remains, by look.
LOOKS = {"text": ("TEXT", True), "random": ("RANDOM/ENCRYPTED", False), "binary": ("UNKNOWN_BINARY", True)}


def named_format(data: Column, look: Column) -> Column:
    """(name, compressible) by the second list, the first match winning; by look where none matches."""
    head = head_of(data)

    def told(name: str, good: bool) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(good).alias("compressible"))

    first, *rest = NAMES
    rules = reduce(lambda w, s: w.when(head.startswith(s[2]), told(s[0], s[3])), rest, F.when(head.startswith(first[2]), told(first[0], first[3])))
    return reduce(lambda w, k: w.when(look == k, told(*LOOKS[k])), LOOKS, rules)


def type_of(data: Column, entropy: Column) -> Column:
    """By signature, then by entropy: over 7.5 compressed, under 4.5 text, else binary. Under 16 bytes unknown."""
    head = head_of(data)
    rules = reduce(lambda w, s: w.when(_holds(head, s), s[3]), SIGNATURES, F.when(F.coalesce(F.octet_length(data), F.lit(0)) < 16, "unknown"))
    return rules.when(entropy > 7.5, "compressed").when(entropy < 4.5, "text").otherwise("binary")


#: Shorter prefixes that name a format.
NAMED = tuple((*s[:3], s[4]) for s in SIGNATURES if s[4] != "unknown" and s[4] not in ("png", "gif")) + (("89504E47", 0, "", "png"), ("47494638", 0, "", "gif"))


def format_of(data: Column) -> Column:
    head = head_of(data)
    return reduce(lambda w, s: w.when(_holds(head, (*s[:3],)), s[3]), NAMED, F.when(F.coalesce(F.octet_length(data), F.lit(0)) < 4, "unknown")).otherwise("unknown")


def level_of(kind: Column) -> Column:
    return F.when(kind == "compressed", 0).when(kind.isin("text", "database"), 9).when(kind == "binary", 3).otherwise(6)


def size_stats(blobs: DataFrame, by: list[str]) -> DataFrame:
    """Rows, values, bytes, mean, largest, smallest, under 100 KB, from 1 MB."""
    size = F.octet_length("data").cast("long")
    return blobs.groupBy(*by).agg(F.count("*").alias("n"), F.count("data").alias("values"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.round(F.avg(size), 6).alias("mean"), F.max(size).alias("largest"), F.min(size).alias("smallest"), F.count_if(size < 100 * KIB).alias("small"), F.count_if(size >= MIB).alias("large"))


def strategy(stats: DataFrame, oid: Column) -> Column:
    n, mib = F.col("values"), MIB
    streamed = (F.col("large") > 0) & ((F.col("large") / n > 0.5) | (F.col("bytes") > 500 * mib))
    return F.when(n == 0, "standard").when(oid, "large_object").when((F.col("small") > 0) & (F.col("small") / n > 0.7), "bundle").when(streamed | (F.col("bytes") > 100 * mib), "parallel_stream").otherwise("standard")


def histogram(blobs: DataFrame) -> DataFrame:
    """Types and formats: rows, bytes, and bytes that needn't be compressed."""
    size = F.octet_length("data").cast("long")
    typed = blobs.select(size.alias("size"), type_of(F.col("data"), entropy_of(F.col("data"))).alias("type"), format_of(F.col("data")).alias("format"))
    g = typed.groupBy("type", "format").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return g.withColumn("skipped_bytes", F.when(F.col("type") == "compressed", F.col("bytes")).otherwise(0))


def registry_stats(blobs: DataFrame) -> DataFrame:
    """Values checked, unique ones, duplicates, and bytes that duplicates need not take."""
    size = F.octet_length("data").cast("long")
    g = blobs.select(F.sha2("data", 256).alias("h"), size.alias("size")).groupBy("h").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return g.agg(F.sum("n").alias("checked"), F.count("*").alias("unique"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved"))


class Bloom:
    """A Bloom filter: bits and hash functions from the number of values and the false positive rate, FNV-1a hashed twice."""

    def __init__(self, n: int, rate: float) -> None:
        bits = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
        self.m = max(8, -(-bits // 8) * 8)
        self.k = min(30, max(1, math.ceil(self.m / max(1, n) * math.log(2))))
        self.bits = bytearray(self.m // 8)

    def places(self, value: bytes) -> list[int]:
        a = _fnv(value)
        b = _fnv(value + b"\x01") | 1
        return [(a + i * b) % self.m for i in range(self.k)]

    def add(self, value: bytes) -> None:
        for p in self.places(value):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, value: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(value))


def _fnv(value: bytes) -> int:
    h = 0xCBF29CE484222325  # fixed values of FNV-1a
    for byte in value:
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    return h


def _digest_places(digests: np.ndarray, m: int, k: int) -> np.ndarray:
    """Bloom.places of many digests (a row of bytes each) at once: a row of k places for each."""
    h = np.full(len(digests), 0xCBF29CE484222325, np.uint64)
    prime = np.uint64(0x100000001B3)
    for byte in digests.T:
        h = (h ^ byte) * prime
    step = ((h ^ np.uint64(1)) * prime | np.uint64(1)) % np.uint64(m)
    return ((h % np.uint64(m))[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) % np.uint64(m)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def bloom_of(digests: DataFrame, rate: float = 0.01, most_bits: int = 1 << 26) -> Bloom | None:
    """The filter over a column of digests (binary, of one length, nulls left out), made in parts: words of bits, at most most_bits / 64 of them, reach the driver. None where it would take more bits."""
    digests = digests.toDF("digest").where("digest is not null")
    out = Bloom(max(1, digests.count()), rate)
    if out.m > most_bits:
        return None
    m, k = out.m, out.k

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(-(-m // 64) * 64, np.uint8)
        for batch in batches:
            if len(batch):
                bits[_digest_places(_matrix(batch["digest"]), m, k).ravel()] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        hit = np.flatnonzero(words)
        yield pd.DataFrame({"word": hit, "bits": words[hit]})

    whole = np.zeros(-(-m // 64), "<i8")
    for word, bits in digests.mapInPandas(part, "word long, bits long").groupBy("word").agg(F.bit_or("bits")).collect():
        whole[word] = bits
    out.bits = bytearray(whole.tobytes()[: m // 8])
    return out


def may_be_known(digest: Column, known: Bloom) -> Column:
    """Whether each digest may be in the filter: no known one fails, a null one does."""
    m, k, packed = known.m, known.k, bytes(known.bits)

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), bool)
        there = values.notna().to_numpy()
        if there.any():
            at = _digest_places(_matrix(values[there]), m, k)
            out[there] = (np.frombuffer(packed, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1)
        return pd.Series(out)

    return test(digest)


def might_contain(column: Column, known: Bloom) -> Column:
    """Whether each value's SHA-256 may be in the filter."""
    return may_be_known(F.unhex(F.sha2(column, 256)), known)


def repeated(blobs: DataFrame, rate: float = 0.01) -> DataFrame:
    """blob_id, repeated: whether another value has the same content (null content never). Only values that the filter of repeated digests lets through meet the exact set; without a filter all do."""
    digest = F.unhex(F.sha2("data", 256))
    known = written(blobs.where("data is not null").groupBy(digest.alias("digest")).agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated")
    bloom = bloom_of(known, rate)
    rows = blobs.select("blob_id", digest.alias("digest"))
    maybe = F.lit(True) if bloom is None else may_be_known(F.col("digest"), bloom)
    rows = written(rows.withColumn("maybe", maybe), "maybe")
    sure = rows.where("maybe").join(known.withColumn("found", F.lit(True)), "digest", "left").select("blob_id", F.coalesce("found", F.lit(False)).alias("repeated"))
    return rows.where("not maybe").select("blob_id", F.lit(False).alias("repeated")).unionByName(sure)


def gzip_size(data: Column, level: int = 6) -> Column:
    @F.pandas_udf("long")
    def size(values: pd.Series) -> pd.Series:
        return values.map(lambda v: len(gzip.compress(v or b"", level, mtime=0)))

    return size(data)


def column_analysis(blobs: DataFrame, by: list[str]) -> DataFrame:
    """Of each column: bytes, compressed bytes, incompressible bytes, ratio and advice."""
    size = F.octet_length("data").cast("long")
    typed = blobs.select(*by, size.alias("size"), gzip_size(F.col("data")).alias("packed"), type_of(F.col("data"), entropy_of(F.col("data"))).alias("type"))
    g = typed.groupBy(*by).agg(F.sum("size").alias("total_size"), F.sum("packed").alias("packed_size"), F.sum(F.when(F.col("type") == "compressed", F.col("size")).otherwise(0)).alias("incompressible"))
    g = g.withColumn("ratio", F.when(F.col("packed_size") > 0, F.col("total_size") / F.col("packed_size")).otherwise(1.0))
    return g.withColumn("advice", column_advice(F.col("total_size"), F.col("incompressible"), F.col("ratio")))


def column_advice(total: Column, incompressible: Column, ratio: Column) -> Column:
    share = 100.0 * incompressible / total
    return F.when(total == 0, "unknown").when((share > 80) | (ratio < 1.1), "skip").when(share > 50, "low_level").when(share > 20, "partial").otherwise("compress")


def database_advice(columns: DataFrame, level: int = 6) -> DataFrame:
    """columns: name, total_size, incompressible, advice. One row: totals, the largest column, the advice and its level."""
    g = columns.agg(F.count("*").alias("columns"), F.sum("total_size").alias("total_size"), F.sum("incompressible").alias("incompressible"), F.sum(F.when(F.col("advice") == "skip", F.col("total_size")).otherwise(0)).alias("skipped"), F.count_if(F.col("advice") == "skip").alias("skips"), F.max(F.struct("total_size", "name"))["name"].alias("largest"))
    share = F.when(F.col("total_size") > 0, 100.0 * F.col("incompressible") / F.col("total_size")).otherwise(0.0)
    advice = F.when((F.col("total_size") > 0) & (F.col("skipped") / F.col("total_size") > 0.6), "skip").when(F.col("skips") > F.floor(F.col("columns") / 2), "low_level").when(share > 70, "skip").when(share > 40, "low_level").when(share > 20, "partial").otherwise("compress")
    g = g.withColumn("incompressible_pct", F.round(share, 6)).withColumn("advice", advice)
    return g.withColumn("level", F.when(F.col("advice") == "skip", 0).when(F.col("advice") == "low_level", 1).when(F.col("advice") == "partial", 4).otherwise(level)).withColumn("potential_savings", F.when(F.col("advice") == "skip", F.col("incompressible")).otherwise(0))


#: MB a second by level.
SPEED = {0: 10000.0, 1: 500.0, 2: 350.0, 3: 250.0, 4: 180.0, 5: 140.0, 6: 100.0, 7: 70.0, 8: 40.0, 9: 20.0}


def throughput(level: Column, incompressible_share: Column) -> Column:
    """MB a second, three times as many for the share that can't be compressed."""
    base = reduce(lambda w, k: w.when(level == k, SPEED[k]), range(1, 10), F.when(level == 0, SPEED[0])).otherwise(100.0)
    return base * (1 - incompressible_share) + base * 3 * incompressible_share


def time_estimate(size: Column, level: Column, incompressible_share: Column) -> Column:
    """Seconds to read at 200 MB a second and to compress."""
    mb = size / float(MIB)
    return mb / 200.0 + F.when(level > 0, mb / throughput(level, incompressible_share)).otherwise(0.0)


def decisions(blobs: DataFrame, streams: int) -> DataFrame:
    """The whole path of a value: type, level, duplicate of which row, stream."""
    typed = blobs.select("blob_id", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("hash"), type_of(F.col("data"), entropy_of(F.col("data"))).alias("type"))
    firsts = typed.groupBy("hash").agg(F.min("blob_id").alias("first_id"))
    out = typed.join(firsts, "hash")
    duplicate = F.col("blob_id") != F.col("first_id")
    return out.select("blob_id", "type", level_of(F.col("type")).alias("level"), F.when(duplicate, F.col("first_id")).alias("duplicate_of"), F.when(~duplicate, F.pmod("blob_id", F.lit(streams)).cast("int")).alias("stream"))
