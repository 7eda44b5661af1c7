"""Deterministic sharded WARC archives: written in order of page, rolled by compressed size, committed by a manifest."""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, partitions

#: Payloads below this are always written in full.
LEAST = 1000
#: Payload bytes of a shard, compressed bytes after which a file is closed, and most cells that size shards.
SHARD_BYTES, FILE_BYTES, CELLS = 16 << 20, 32 << 20, 4096
#: Parts that a cell with too many bytes is cut into, and about how many shards there are at most.
SPLIT, MOST_SHARDS = 64, 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: First half of every record id; the other half is the page's number.
SPACE = 0x61736B77656C
NAMED, UNNAMED = 1, 2


def record_id(page_id: int | None, digest: bytes, copy: int = 0) -> str:
    """A version-8 UUID that holds the page's number, or a digest where there is none."""
    number = (int(page_id) if page_id is not None else int.from_bytes(digest[:8], "big") + copy) & (2**64 - 1)
    flag = (NAMED if page_id is not None else UNNAMED) << 8
    value = SPACE << 80 | 8 << 76 | (flag | number >> 62) << 64 | 2 << 62 | number & (2**62 - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(name: str) -> int | None:
    """The page's number in a record id."""
    value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    flag = value >> 64 & 0xFFF
    if flag >> 8 != NAMED:
        return None
    number = (flag & 3) << 62 | value & (2**62 - 1)
    return number - 2**64 if number >> 63 else number


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    lines = [*headers, ("WARC-Block-Digest", labelled(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, copy: int = 0) -> bytes:
    """A response with the payload, or a revisit of page ``refers`` without it."""
    digest = hashlib.sha1(payload).digest()
    headers = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", labelled(digest)),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers is not None:
        headers += [("WARC-Refers-To", record_id(refers, b"")), ("WARC-Profile", PROFILE)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http + (payload if refers is None else b""))


def file_system(folder: str):
    """The file system of a folder's address and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Roll:
    """The open file of a shard: written under a temporary name, renamed when complete."""

    def __init__(self, folder: str, shard: int, number: int):
        self.fs, base = file_system(folder)
        self.name = f"{shard:08d}-{number:05d}.warc.gz"
        self.done, self.part = f"{base}/{self.name}", f"{base}/tmp/{uuid.uuid4().hex}-{self.name}"
        self.fs.create_dir(f"{base}/tmp", recursive=True)
        self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.part), 0, 0, hashlib.sha256()
        info = f"software: askwell\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {shard}\r\n".encode()
        name = record_id(None, hashlib.sha1(self.name.encode()).digest())
        heads = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Filename", self.name)]
        self.add(record([*heads, ("Content-Type", "application/warc-fields")], info))

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size, self.records = self.size + len(data), self.records + 1

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.part, self.done)
        return self.name, self.size, self.records, self.sum.hexdigest()


def cell_of(column: str, starts: list[int]) -> Bucketizer:
    """The number of the last of ``starts`` that isn't above a number; numbers below the first are in its cell."""
    cuts = sorted({float(s) for s in starts[1:]}) or [sys.float_info.max]  # at least one is asked for
    return Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=column, outputCol="__cell")


def shard_starts(rows: DataFrame, shard_bytes: int) -> list[int]:
    """The first page number of every shard; they follow from the bytes per page number alone.

    Equal cells of page numbers are counted, and those with more bytes than a
    shard are cut and counted again, so that numbers may lie close together or
    far apart. Neighbouring cells then fill shards in order.
    """
    named = rows.filter("page_id is not null").select("page_id", F.col("page_id").cast("double").alias("__at"), "bytes")
    low, high, total = named.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if low is None:
        return [0]
    limit = max(shard_bytes, total // MOST_SHARDS)
    width = (high - low) // CELLS + 1
    cells = {start: width for start in range(low, high + 1, width)}
    while True:
        starts = sorted(cells)
        found = cell_of("__at", starts).transform(named).groupBy("__cell").agg(F.sum("bytes").alias("n")).collect()
        size = {int(r["__cell"]): r["n"] for r in found}
        distinct = [s for i, s in enumerate(starts) if not i or i == 1 or float(s) > float(starts[i - 1])]
        heavy = [s for i, s in enumerate(distinct) if size.get(i, 0) > limit and cells[s] > 1]
        if not heavy:
            break
        for start in heavy:
            whole = cells.pop(start)
            part = -(-whole // SPLIT)
            cells.update({s: min(part, start + whole - s) for s in range(start, start + whole, part)})
    out, filled = [low], 0
    for i, start in enumerate(distinct):
        if filled and filled + size.get(i, 0) > limit:
            out.append(start)
            filled = 0
        filled += size.get(i, 0)
    return out


def with_shard(rows: DataFrame, starts: list[int]) -> DataFrame:
    """``rows`` with ``shard``, which grows with the page's number; pages without one go to any, before the others."""
    at = rows.withColumn("__at", F.coalesce(F.col("page_id").cast("double"), F.lit(0.0)))
    any_ = F.pmod(F.xxhash64("sha"), F.lit(len(starts))).cast("int")
    shard = F.when(F.col("page_id").isNull(), any_).otherwise(F.col("__cell").cast("int"))
    return cell_of("__at", starts).transform(at).withColumn("shard", shard).drop("__at", "__cell")


def write_archive(
    pages: DataFrame, folder: str, least: int = LEAST, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the manifest of complete files.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    largest page_id is a response, the others are revisits of it. Null html is
    an empty payload; a null url has no target header; rows without a page_id
    are written first in their shard, and revisit a numbered page if one is
    equal; repeated rows of the responding page are responses all. Other columns
    are ignored. An empty table gives an empty manifest.

    A task writes under temporary names and renames complete files, whose bytes
    depend on the rows alone, so a second attempt replaces a file by its equal.
    Only files in the manifest, which Spark commits as a whole, count.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    known = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    slim = kept(known.select("page_id", "sha", F.octet_length("payload").alias("bytes")))
    starts = shard_starts(slim, shard_bytes)
    keepers = (
        slim.filter(F.col("bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("refers"), F.count("*").alias("n"))
        .filter("n > 1 and refers is not null").drop("n")
    )
    again = slim.join(keepers, "sha").filter("page_id is null or page_id <> refers").distinct()
    decisions = with_shard(again, starts).select(
        "shard", "page_id", F.lit(0).alias("tag"), "sha", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), "refers",
    )
    bodies = with_shard(known, starts).select("shard", "page_id", F.lit(1).alias("tag"), "sha", "url", "payload", F.lit(None).cast("long").alias("refers"))
    order = ["shard", "page_id", "tag", "sha", "url"]
    rows = decisions.unionByName(bodies).repartitionById(len(starts), "shard").sortWithinPartitions(*order)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, open_shard, number, page, refers, copy = None, None, 0, None, {}, 0
        for batch in batches:
            files = []
            for row in batch.itertuples(index=False):
                page_id = None if pd.isna(row.page_id) else int(row.page_id)
                if row.shard != open_shard or roll.size >= file_bytes:
                    if roll is not None:
                        files.append(roll.close())
                    number = number + 1 if row.shard == open_shard else 0
                    if row.shard != open_shard:
                        refers, page = {}, (row.shard, page_id)
                    roll, open_shard = Roll(folder, int(row.shard), number), row.shard
                if (row.shard, page_id) != page:
                    refers, page = {}, (row.shard, page_id)
                if row.tag == 0:
                    refers[row.sha] = int(row.refers)
                else:
                    copy += 1
                    roll.add(page_record(page_id, row.url, bytes(row.payload), refers.get(row.sha), copy))
            if files:
                yield pd.DataFrame(files, columns=["name", "bytes", "records", "sha256"])
        if roll is not None:
            yield pd.DataFrame([roll.close()], columns=["name", "bytes", "records", "sha256"])

    manifest = f"{folder}/manifest"
    rows.mapInPandas(write, "name string, bytes long, records long, sha256 string").write.parquet(manifest)
    system, base = file_system(folder)
    if system.get_file_info(f"{base}/tmp").type.name == "Directory":
        system.delete_dir(f"{base}/tmp")
    return spark.read.parquet(manifest)


#: Compressed bytes given to the unpacker at once.
FED = 1 << 15


def members(data: bytes) -> Iterator[bytes]:
    """The records of an archive file, each unpacked from where the last one ended."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            part = view[at : at + FED]
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict | None:
    """A page's record: type, ids, digest and payload; None for other records."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if labelled(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
    return {
        "page_id": page_of(headers["WARC-Record-ID"]),
        "url": headers.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest.hex(),
        "record_type": kind,
        "refers_to": page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None,
    }


FIELDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of the files in a folder's manifest, each checked against its digests."""
    manifest = spark.read.parquet(f"{folder}/manifest")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, digest in zip(batch["name"], batch["sha256"]):
                system, base = file_system(folder)
                with system.open_input_stream(f"{base}/{name}") as stream:
                    data = stream.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} isn't the file in the manifest")
                found = [r for r in map(parse, members(data)) if r is not None]
                if not payloads:
                    for r in found:
                        r["payload"] = None
                for i in range(0, len(found), 2000):
                    out = pd.DataFrame(found[i : i + 2000])
                    for c in ("page_id", "refers_to"):
                        out[c] = out[c].astype("Int64")
                    yield out

    return manifest.repartition(partitions(spark), "name").mapInPandas(read, FIELDS)
