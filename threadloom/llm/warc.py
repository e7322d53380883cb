"""Deterministic sharded WARC archives.

Records are cut into shards at key boundaries that depend only on the data,
sorted inside each shard, and streamed into gzip members, one a record. A file
is closed when its compressed size passes the roll size. Headers, ids and
digests are made anew from the payload. Tasks write under names of their own
attempt and report a manifest row for each file; the manifest is written first,
then its files get their final names. A lost or repeated task leaves files
that no manifest names, and renaming twice does no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
LEAST = 1000
BUCKETS = 1 << 12
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:record")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, tmp string, records bigint, bytes bigint, sha1 string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def range_cuts(df: DataFrame, key: str, weight: Column, most: int, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds (inclusive) of key ranges that hold about ``most`` of ``weight`` each.

    The keys are counted in equal-width buckets; a bucket that holds more than
    ``most`` is counted again in finer ones, down to single keys. The driver sees
    bucket sums only. The bounds depend on nothing but the rows.
    """
    rows = df.select(F.col(key).cast("bigint").alias("k"), weight.cast("bigint").alias("w")).where("k is not null")
    span = rows.agg(F.min("k"), F.max("k")).first()
    if span[0] is None:
        return []
    cuts, full, todo = [], 0, [(int(span[0]), int(span[1]))]

    def sums(lo: int, hi: int) -> list[tuple[int, int, int]]:
        width = max(1, -(-(hi - lo + 1) // buckets))
        b = F.floor((F.col("k") - F.lit(lo)) / F.lit(width)).cast("bigint")
        got = rows.where((F.col("k") >= lo) & (F.col("k") <= hi)).groupBy(b.alias("b")).agg(F.sum("w").alias("w")).orderBy("b").collect()
        return [(lo + r["b"] * width, min(hi, lo + (r["b"] + 1) * width - 1), r["w"]) for r in got]

    stack = list(reversed(sums(*todo[0])))
    while stack:
        lo, hi, w = stack.pop()
        if w > most and hi > lo:
            stack += reversed(sums(lo, hi))
            continue
        full += w
        if full >= most:
            cuts.append(hi)
            full = 0
    return cuts


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit of the response of page ``refers``."""
    sha = hashlib.sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha.hexdigest())}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{b32encode(sha.digest()).decode()}", f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, sha.hexdigest())}", f"X-Refers-To-Page-Id: {refers}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """The files of one task, written under names of this attempt."""

    def __init__(self, root: str, attempt: str, roll: int):
        self.fs, self.path = _fs(f"{root}/_tmp")
        self.root, self.attempt, self.roll = root, attempt, roll
        self.fs.create_dir(self.path, recursive=True)
        self.shard, self.seq, self.out, self.done = -1, 0, None, []

    def put(self, shard: int, raw: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.tmp = f"_tmp/{self.name}.{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}.{self.attempt}", compression=None)
            self.size, self.count, self.sha = 0, 0, hashlib.sha1()
        z = zlib.compressobj(5, zlib.DEFLATED, 31)  # the gzip header that zlib writes holds no time
        packed = z.compress(raw) + z.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.count += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.tmp, self.count, self.size, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def write_warc(
    df: DataFrame, root: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST,
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = "2020-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record a row below the folder ``root`` and return the manifest (file, records, bytes, sha1).

    Of rows with equal payloads of at least ``least`` bytes those with the
    largest id are responses and the others revisit it; all other rows are
    responses. A null payload is empty; a null url has no target header; a null
    id goes to the first shard and revisits an equal payload that has an id.
    Repeated rows are written each. The files depend only on the rows and
    parameters. Other columns are ignored. An empty table writes no file.
    """
    spark = df.sparkSession
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).cast("bigint").alias("pid"), F.col(url).cast("string").alias("url"), body.alias("body"))
    cuts = range_cuts(rows, "pid", F.length("body") + 512, shard_bytes)
    keyed = rows.select("pid", F.sha1("body").alias("sha"), F.length("body").alias("n")).where(F.col("n") >= least)
    shared = keyed.groupBy("sha").agg(F.max("pid").alias("top"), F.count("*").alias("c")).where("c > 1 and top is not null").select("sha", "top")
    # Only rows with a shared payload have a note; few keys may be many rows, so they are dealt over salts.
    from threadloom.llm.shared import attach

    notes = attach(keyed, shared, "sha", F.col("pid"), 16).where("top is not null and (pid is null or pid < top)")
    shard = _shard_of(F.col("pid"), cuts)
    # A row's note travels to the same sorted partition just ahead of it, so the payloads move once.
    both = rows.select("pid", F.lit(1).alias("ord"), "url", "body", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("bigint").alias("top")).unionByName(
        notes.select("pid", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), "sha", "top").distinct()
    ).withColumn("shard", shard)
    by = ["shard", F.col("pid").asc_nulls_first(), "ord", F.col("url").asc_nulls_first(), F.col("body")]
    dealt = both.repartitionByRange(len(cuts) + 1, "shard").sortWithinPartitions(*by)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at, known = _Files(root, uuid.uuid4().hex, roll_bytes), object(), {}
        for part in batches:
            for pid, order, link, data, sha, top, sh in zip(*[part[c] for c in ("pid", "ord", "url", "body", "sha", "top", "shard")], strict=True):
                pid = None if pd.isna(pid) else int(pid)
                if pid != at:
                    at, known = pid, {}
                if order == 0:
                    known[sha] = int(top)
                    continue
                data = bytes(data)
                refers = known.get(hashlib.sha1(data).hexdigest()) if known else None
                files.put(int(sh), record(pid, link, data, refers, date))
        files.close()
        yield pd.DataFrame(files.done, columns=["file", "tmp", "records", "bytes", "sha1"])

    manifest = f"{root}/_manifest"
    dealt.mapInPandas(write, MANIFEST).write.mode("errorifexists").parquet(manifest)
    listed = spark.read.schema(MANIFEST).parquet(manifest)

    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(root)
        for part in batches:
            for name, tmp in zip(part["file"], part["tmp"], strict=True):
                if fs.get_file_info(f"{base}/{tmp}").type.name == "File":
                    fs.move(f"{base}/{tmp}", f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type.name != "File":
                    raise FileNotFoundError(f"{root}/{name}")
            yield part.drop(columns=["tmp"])

    out = "file string, records bigint, bytes bigint, sha1 string"
    listed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(publish, out).write.mode("overwrite").parquet(f"{root}/_committed")
    from threadloom.llm.shared import delete_path

    delete_path(spark, f"{root}/_tmp")
    return spark.read.schema(out).parquet(f"{root}/_committed")


def _shard_of(pid: Column, cuts: list[int]) -> Column:
    """Index of the key range; a search in a constant array, so the plan stays one expression for any number of cuts."""
    if not cuts:
        return F.lit(0)
    bounds = F.lit(cuts)
    lo, n = F.lit(0), len(cuts)
    step = 1 << (n.bit_length() - 1)
    while step:
        ahead = lo + F.lit(step)
        lo = F.when((ahead <= n) & (F.get(bounds, ahead - 1) < pid), ahead).otherwise(lo)
        step >>= 1
    return F.coalesce(lo, F.lit(0))


def records_of(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, read in chunks; only one record is held."""
    z, got, more = zlib.decompressobj(31), bytearray(), stream.read(chunk)
    while more:
        got += z.decompress(more)
        if z.eof:
            more = z.unused_data
            z = zlib.decompressobj(31)
            head, _, rest = bytes(got).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            got = bytearray()
            more = more or stream.read(chunk)
        else:
            more = stream.read(chunk)
    if got:
        raise ValueError("archive ends inside a record")


def read_warc(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """The records of the committed files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, block_bytes, payload (of responses).

    A response's payload is checked against its digest; a revisit has the length
    and digest that its headers state.
    """
    listed = spark.read.schema("file string, records bigint, bytes bigint, sha1 string").parquet(f"{root}/_committed")
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from base64 import b32decode

        fs, base = _fs(root)
        for part in batches:
            for name in part["file"]:
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for h, block in records_of(stream):
                        http, _, body = block.partition(b"\r\n\r\n")
                        digest = b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        response = h["WARC-Type"] == "response"
                        if response and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{name}: payload and digest of {h['WARC-Record-ID']} differ")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        rows.append((int(h["X-Page-Id"]) if "X-Page-Id" in h else None, h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None, body if response and with_payload else None))
                        held += len(body)
                        if held > 16 << 20 or len(rows) >= 4096:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    return listed.select("file").repartition(spark.sparkContext.defaultParallelism).mapInPandas(parse, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
