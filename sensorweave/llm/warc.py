"""Deterministic sharded WARC writer and reader.

Records are sorted by key over ranges of keys with about equal bytes, one writing task a
range; ranges come from sums over all records, not from a sample. A task rolls a new
file when the current one has reached `roll_bytes` compressed, writes every record as its own
gzip member (no time stamp in it) with regenerated length, block and payload digests, and gives
files temporary names. What the tasks report is collected as one row a file, ordered and
renamed to final names, and listed in a manifest that is itself renamed into place: a folder
without a manifest was not committed. A task that runs again writes files of its own, so lost
executors and speculation leave at most unlisted files, which the commit removes.

Records with equal payloads: the one with the largest key is a response, the others are
revisits of it without payload (from `least_bytes` payload bytes on; below, all are responses).

Keys are integers of any size a long has (others are refused). Null html is an empty payload; null keys sort first and are never referred to by number (an all-null
group has its first record as response); repeated rows with one key and payload count as one
copy more: one of them is the response, the rest revisits. An empty table commits an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, hot_join, integral, shared_folder, sweep

ROLL_BYTES = 64 << 20
#: Payload bytes of a shard (one task's share) at most.
SHARD_BYTES = 1 << 30
#: Bits of a key that tell its cell at least, and bits by which heavy cells are cut.
CELL_BITS, MORE_BITS = 12, 6
LEVEL = 4
#: Date of every record: output depends on the records alone.
DATE = "2020-01-01T00:00:00Z"


class Store:
    """Files of a folder by uri: file: and plain paths by the local file system, others by Arrow's."""

    def __init__(self, uri: str):
        self.uri = uri
        if uri.startswith("file:") or "://" not in uri:
            self.fs, self.root = None, "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def path(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def make(self) -> None:
        os.makedirs(self.root, exist_ok=True) if self.fs is None else self.fs.create_dir(self.root, recursive=True)

    def write(self, name: str):
        return open(self.path(name), "wb") if self.fs is None else self.fs.open_output_stream(self.path(name))

    def read(self, name: str):
        return open(self.path(name), "rb") if self.fs is None else self.fs.open_input_stream(self.path(name))

    def move(self, a: str, b: str) -> None:
        os.replace(self.path(a), self.path(b)) if self.fs is None else self.fs.move(self.path(a), self.path(b))

    def names(self) -> list[str]:
        if self.fs is None:
            return os.listdir(self.root)
        from pyarrow import fs

        return [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.root))]

    def remove(self, name: str) -> None:
        os.remove(self.path(name)) if self.fs is None else self.fs.delete_file(self.path(name))


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(key, uri: str, payload: bytes, refers_to, first: bool, sort_key: str) -> bytes:
    """One record, headers made anew. A revisit has no payload but its digest and length; first: no earlier copy is referred to."""
    digest, block = sha1(payload), payload if first else b""
    name = uuid.UUID(bytes=hashlib.sha256(f"{sort_key}|{digest}|{first}".encode()).digest()[:16], version=5)
    head = [
        ("WARC-Type", "response" if first else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in uri if c >= " ") or "about:blank"), ("Content-Type", "text/html; charset=utf-8"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if key is None else key),
        ("X-Payload-Length", len(payload)),
    ]
    if not first:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", "" if refers_to is None else refers_to)]
    head.append(("Content-Length", len(block)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _plan(pages: DataFrame, page_id: str, html: str, least_bytes: int) -> DataFrame:
    """Key and digest of the records that are revisits of another key, and that key: small rows, summed before they move."""
    own = pages.select(F.col(page_id).alias("k"), F.coalesce(html, F.lit("")).alias("h"))
    own = own.select("k", F.sha1(F.encode("h", "utf-8")).alias("d"), F.octet_length("h").alias("n"))
    top = own.where(F.col("n") >= least_bytes).groupBy("d").agg(F.max("k").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    top = cut(top)
    return hot_join(own.select("k", "d"), top.select("d", "top"), ["d"], top, "copies").select("k", "d", "top")


def _shards(sizes: DataFrame, shards: int) -> tuple[Column, int]:
    """The shard of a key `k` with digest `d`, and how many there are: consecutive keys of about equal bytes together.

    A cell is the range of keys with the same leading bits. Cells heavier than a shard are cut by their next bits until they
    are not or are one key, so a few far-off keys spoil nothing, and any long is a key. Cells come from sums over all records;
    no sample is taken. Null keys go by digest to shards of their own, before the others.
    """
    lo, hi, total, null = sizes.agg(F.min("k"), F.max("k"), F.sum("n"), F.sum(F.when(F.col("k").isNull(), F.col("n")))).first()
    most = -(-(total or 1) // shards)
    nulls = -(-(null or 0) // most)
    of_null = F.floor(F.conv(F.substring("d", 1, 6), 16, 10).cast("long") * max(1, nulls) / (1 << 24)).cast("int")
    if lo is None:
        return of_null, max(1, nulls)
    signed, plain = (lambda x: x - (x >> 63 << 64)), (lambda x: x & (1 << 64) - 1)
    code, bits = F.col("k").bitwiseXOR(F.lit(-1 << 63)), plain(lo ^ hi).bit_length()  # unsigned codes in the order of keys
    step = min(16, max(CELL_BITS, shards.bit_length() + 4))
    shifts, table, leaves = [max(0, bits - step)], [0] * (1 << step), []
    heavy = {signed(plain(lo ^ (-1 << 63)) >> bits): 0} if bits < 64 else {0: 0}
    while heavy:
        shift, above = shifts[-1], bits if len(shifts) == 1 else shifts[-2]
        cut_by = lambda s: F.shiftrightunsigned(code, s) if s < 64 else F.lit(0).cast("long")
        own = sizes.where(F.col("k").isNotNull() & cut_by(above).isin(list(heavy)))
        mask, more = (1 << (above - shift)) - 1, {}
        for r in own.groupBy(cut_by(shift).alias("c")).agg(F.sum("n").alias("n")).toLocalIterator():
            c = plain(r.c)
            at = heavy[signed(c >> (above - shift))] + (c & mask)
            if r.n > most and shift:
                more[signed(c)], table[at] = len(table), -len(table)
                table += [0] * (1 << MORE_BITS)
            else:
                leaves.append((c << shift, r.n, at))
        heavy = more
        if heavy:
            shifts.append(max(0, shift - MORE_BITS))
    shard, now = nulls, 0
    for _, n, at in sorted(leaves):
        if now and now + n > most:
            shard, now = shard + 1, 0
        now += n
        table[at] = shard
    cells = F.lit(table)
    place = F.element_at(cells, (cut_by(shifts[0]).bitwiseAND(F.lit((1 << (bits - shifts[0])) - 1)) + 1).cast("int"))
    if len(shifts) > 1:
        within = F.array(*(F.struct(F.lit(s).alias("s"), F.lit((1 << (a - s)) - 1).alias("m")) for a, s in zip(shifts, shifts[1:], strict=False)))
        place = F.aggregate(within, place, lambda t, x: F.when(t < 0, F.element_at(cells, (F.call_function("shiftrightunsigned", code, x["s"]).bitwiseAND(x["m"]) - t + 1).cast("int"))).otherwise(t))
    return F.when(F.col("k").isNull(), of_null).otherwise(place), shard + 1


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = 0, parts: int | None = None) -> list[dict]:
    """Write and commit; the manifest's entries, one a file, in order of keys."""
    ship(pages.sparkSession)
    store = Store(folder)
    store.make()
    body = pages.select(
        F.col(page_id).cast("long").alias("k"), F.sha1(F.encode(F.coalesce(html, F.lit("")), "utf-8")).alias("d"), F.lit(1).alias("part"),
        F.lit(None).cast("long").alias("top"), F.col(url).cast("string").alias("u"), F.col(html).alias("h"),
    )
    plan = _plan(pages, page_id, html, least_bytes).select(F.col("k").cast("long").alias("k"), "d", F.lit(0).alias("part"), F.col("top").cast("long").alias("top"), F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("h"))
    integral(pages, page_id)
    sizes = pages.select(F.col(page_id).cast("long").alias("k"), (F.coalesce(F.octet_length(html), F.lit(0)) + 300).cast("long").alias("n"))
    n = parts or max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.agg(F.sum("n")).first()[0] or 0) // SHARD_BYTES))
    place, n = _shards(sizes, n)
    rows = body.union(plan).withColumn("s", place).repartitionById(n, "s").sortWithinPartitions("s", "k", "d", "part", "u").drop("s")

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, attempt = Store(folder), uuid.uuid4().hex
        out, made, last, top, seen, shared, copies = None, [], None, None, False, False, 0
        for b in batches:
            for k, d, part, t, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, d) != last:
                    last, top, seen, shared, copies = (k, d), None, False, False, 0
                if part == 0:  # comes before the records of its key and digest
                    top, shared = t, True
                    continue
                payload = (h or "").encode()
                first = not shared or (k == top and not seen)
                seen = True
                if out is None or made[-1]["bytes"] >= roll_bytes:
                    if out:
                        out.close()
                    made.append({"temp": f".tmp-{attempt}-{len(made)}", "first": k, "digest": d, "bytes": 0, "records": 0})
                    out = store.write(made[-1]["temp"])
                    made[-1]["bytes"] += out.write(head := member(_info())) or len(head)
                data = member(record(k, u or "", payload, top, first, f"{k}|{copies}|{u}"))
                copies += 1
                out.write(data)
                made[-1]["bytes"] += len(data)
                made[-1]["records"] += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("temp", pa.string()), ("first", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    files = rows.mapInArrow(run, "temp string, first long, digest string, bytes long, records long").toLocalIterator()
    return commit(store, sorted((r.asDict() for r in files), key=lambda r: (r["first"] is not None, r["first"] or 0, r["digest"])))


def _info() -> bytes:
    text = b"format: WARC File Format 1.1\r\n"
    return b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-5000-8000-000000000000>\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: " + str(len(text)).encode() + b"\r\n\r\n" + text + b"\r\n\r\n"


def commit(store: Store, files: list[dict]) -> list[dict]:
    """Final names by order, the manifest last; then what no manifest lists is removed."""
    entries = []
    for i, f in enumerate(files):
        name = f"part-{i:06d}.warc.gz"
        store.move(f["temp"], name)
        entries.append({"name": name, "records": f["records"], "bytes": f["bytes"], "first": f["first"]})
    with store.write(".tmp-manifest") as out:
        out.write("".join(json.dumps(e, sort_keys=True) + "\n" for e in entries).encode())
    store.move(".tmp-manifest", "manifest.jsonl")
    for name in store.names():
        if name.startswith(".tmp-"):
            store.remove(name)
    return entries


def manifest(folder: str) -> list[dict]:
    with Store(folder).read("manifest.jsonl") as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a gzipped archive, read member by member."""
    raw, z, held = b"", zlib.decompressobj(31), []
    while data := raw or stream.read(1 << 16):
        held.append(z.decompress(data))
        raw = b""
        if z.eof:
            raw, z = z.unused_data, zlib.decompressobj(31)
            text, held = b"".join(held), []
            head, _, rest = text.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of a committed folder: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html (null for revisits, or without payloads).

    Digests of blocks are checked; a wrong one fails the task.
    """
    ship(spark)
    names = [e["name"] for e in manifest(folder)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, cols = Store(folder), [[] for _ in range(7)]
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])
        held = 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.read(name) as f:
                    for head, block in records(f):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        if head["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
                            raise ValueError(f"{name}: wrong digest in {head['WARC-Record-ID']}")
                        first = head["WARC-Type"] == "response"
                        to = head.get("X-Refers-To-Page-Id", "")
                        row = (int(head["X-Page-Id"]) if head["X-Page-Id"] else None, len(block) if first else int(head["X-Payload-Length"]), sha1(block) if first else head["WARC-Payload-Digest"][5:], head["WARC-Type"], int(to) if to else None, head["WARC-Target-URI"], block.decode() if first and payloads else None)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                        held += len(block) + 200
                        if held >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
                            cols, held = [[] for _ in range(7)], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
    if not names:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names)).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write to a new folder below the shared one, read back what is committed there, and remove the folder."""
    folder = posixpath.join(shared_folder(spark), f"warc-{uuid.uuid4().hex}")
    write(pages, folder, **options)
    out = cut(read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    sweep(spark, folder)
    return out
