"""Deterministic sharded WARC writer and reader.

Pages are range-partitioned by id into shards of about ``shard_bytes``, sorted, and written as one gzip member per
record. A file is closed when its compressed size reaches ``roll_bytes``; its name is the shard and its number in
the shard, so files depend on the pages alone. Tasks write under temporary names of their own; only files named
in the results of tasks that succeeded are renamed, and the manifest, written last, is what readers go by. A lost
executor or a repeated task leaves at most temporary files, which the commit removes.

Of records with equal payloads the one with the largest id holds the payload and the others are revisits of it.
Headers and digests are made anew from the payload.

Defined cases: a null html is an empty payload; a null url becomes ``urn:x-page:<id>``; a null id is smaller than
all others, and rows with the same id and payload are not revisits of each other. No pages make no files.

Files are opened through ``pyarrow.fs``, by the scheme of the target folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.batches import arrow_schema
from specimen_spark.operators.keyed import attach
from specimen_spark.session import cut_lineage

MANIFEST = "temporary string, name string, shard int, records bigint, bytes bigint, sha1 string"
RECORDS = "file string, page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
URN = "urn:x-page:"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLES_PER_SHARD = 200


def file_system(target: str):
    """File system and path of a folder given as URI or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes, content_type: str) -> bytes:
    """One gzip member; without a time stamp, so that equal pages make equal files."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
             ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    headers = [
        ("WARC-Record-ID", f"<{URN}{page_id}>"),
        ("WARC-Target-URI", f"{URN}{page_id}" if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))))),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers, http + payload, "application/http; msgtype=response")
    headers += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return record("revisit", headers, http, "application/http; msgtype=response")


class ShardFiles:
    """The open file of a writing task; ``closed`` has a manifest row for each finished one."""

    def __init__(self, target: str, roll_bytes: int):
        self.fs, self.folder = file_system(target)
        self.roll, self.attempt = roll_bytes, uuid.uuid4().hex
        self.out, self.shard, self.number, self.closed = None, None, 0, []

    def write(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out and self.size >= self.roll:
            self.close()
        if self.out is None:
            self.name = f"part-{shard:06d}-{self.number:06d}.warc.gz"
            self.temporary = f"_tmp/{self.attempt}-{self.name}"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.size, self.records, self.digest, self.number = 0, -1, hashlib.sha1(), self.number + 1
            info = f"software: page archive writer\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self.append(record("warcinfo", [("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Filename", self.name)], info, "application/warc-fields"))
        self.append(data)

    def append(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.closed.append((self.temporary, self.name, self.shard, self.records, self.size, self.digest.hexdigest()))
            self.out = None


def shard_bounds(pages: DataFrame, shard_bytes: int) -> np.ndarray:
    """Ids that part the shards, from those ids whose hash falls in a share that holds some hundred per shard."""
    size = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes")).first()
    shards = max(1, -(-int(size["bytes"] or 0) // shard_bytes))
    step = max(1, size["n"] // (shards * SAMPLES_PER_SHARD))
    if shards == 1:
        return np.empty(0, np.int64)
    sample = pages.where("page_id IS NOT NULL").where(F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0).select("page_id").distinct()
    ids = np.sort(np.array([r[0] for r in sample.collect()], np.int64))
    return np.unique(ids[np.arange(1, shards) * len(ids) // shards]) if len(ids) else ids


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page with a larger id has too; narrow rows only."""
    narrow = pages.select("page_id", F.sha1("payload").alias("digest"))
    holders = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = attach(narrow, holders, ["digest"], "inner")
    return same.where("refers_to IS NOT NULL AND (page_id IS NULL OR page_id < refers_to)").distinct()


def write_archives(pages: DataFrame, target: str, shard_bytes: int = 256 << 20, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write pages (page_id, url, html) below ``target``, a fresh folder; returns the stored manifest."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    bounds = shard_bounds(pages, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        shards = np.zeros(len(ids), np.int32)
        shards[known] = np.searchsorted(bounds, ids[known].astype("int64"), side="right")
        return pd.Series(shards)

    # What a page refers to travels as a row of its own that sorts before the page, so the payload is shuffled once.
    nothing = F.lit(None)
    rows = revisits(pages).select("page_id", F.lit(0).alias("kind"), nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "digest", "refers_to")
    rows = rows.union(pages.select("page_id", F.lit(1).alias("kind"), "url", "payload", nothing.cast("string"), nothing.cast("bigint")))
    n_shards = len(bounds) + 1
    ordered = (rows.withColumn("shard", shard_of("page_id")).repartition(n_shards, "shard")
               .sortWithinPartitions("shard", "page_id", "kind", "url", "payload"))
    out = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, refers, last = ShardFiles(target, roll_bytes), {}, object()
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                page_id, kind, url, payload, digest, refers_to, shard = row
                if page_id != last:
                    refers, last = {}, page_id
                if kind == 0:
                    refers[digest] = refers_to
                else:
                    other = refers.get(hashlib.sha1(payload).hexdigest()) if refers else None
                    files.write(shard, page_record(page_id, url, payload, other))
        files.close()
        if files.closed:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*files.closed), out)], schema=out)

    fs, folder = file_system(target)
    fs.create_dir(f"{folder}/_tmp", recursive=True)
    manifest = cut_lineage(ordered.mapInArrow(write, MANIFEST))
    return commit(spark, manifest, target)


def commit(spark: SparkSession, manifest: DataFrame, target: str) -> DataFrame:
    """Rename the files of the manifest and store it; can be run again after a failure."""
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(target)
        for batch in batches:
            for temporary, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist()):
                if fs.get_file_info(f"{folder}/{name}").type.name == "NotFound":
                    fs.move(f"{folder}/{temporary}", f"{folder}/{name}")
            yield batch

    manifest.mapInArrow(rename, MANIFEST).drop("temporary").write.mode("overwrite").parquet(f"{target}/manifest")
    fs, folder = file_system(target)
    fs.delete_dir(f"{folder}/_tmp")
    return spark.read.parquet(f"{target}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    left = stream.read(chunk)
    while left:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not left:
                raise EOFError("the last gzip member is cut off")
            parts.append(unpack.decompress(left))
            left = unpack.unused_data if unpack.eof else stream.read(chunk)
        yield b"".join(parts)
        left = left or stream.read(chunk)


def page_number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def parse(member: bytes, with_payload: bool):
    """The page of a record, or None for records of other kinds; digests are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or kind == "response" and (base32_sha1(payload) != digest or len(payload) != length):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not fit its digests")
    return (page_number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, page_number(fields.get("WARC-Refers-To")),
            digest, length, payload if with_payload and kind == "response" else None)


def read_archives(spark: SparkSession, target: str, with_payload: bool = True) -> DataFrame:
    """The page records of the files in the manifest; a file is read as a stream, record by record."""
    out = arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(target)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for batch in batches:
            for name in batch["name"].to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for member in members(stream):
                        if (page := parse(member, with_payload)) is not None:
                            rows.append((name, *page))
                            size += len(page[-1] or b"") + 200
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    names = spark.read.parquet(f"{target}/manifest").select("name")
    return names.repartition(max(1, min(names.count(), 10_000)), "name").mapInArrow(read, RECORDS)
