"""Web archives with a two-level capture index (operator 9).

Writing: every page becomes one gzip member of a WARC file. Records with equal payloads of at least
``REVISIT_BYTES`` bytes share one ``response`` (the largest page_id); the others are ``revisit`` records
without payload that name it. Tasks write their own files into the shared folder under a fresh name and
report them in their output rows, so files of lost or repeated attempts are never referred to.

Index: captures are sorted by reversed-host key over range partitions; each partition is a shard file of
compressed blocks of ``BLOCK`` captures. A shard's sparse directory has the first key and byte range of
each block; the top level has one row per shard (its last key and file).

Reading: keys are sent to their shards by binary search over the top level, a task loads the
directories of its shards only, finds the blocks by binary search, reads those byte ranges and searches
the captures inside; captures are then read by byte range from the archives and parsed.

Null html is an empty payload; null page_ids are written like others (a null id is never a group's
response unless all are null); a null url has the empty key; rows that repeat (page_id, html) are records
of their own; an empty table writes nothing and returns no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, prepare
from riskloom.llm.textvec import to_bytes
from riskloom.session import ensure_checkpoint_dir

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
BLOCK = 256
NEAR_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, file string, offset long, length int, record_type string, refers_to long"


def filesystem(uri: str):
    """The store of a URI and the path in it; the same call works on the driver and in tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def archive_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def surt(url) -> str:
    """Reversed-host key: labels from the top-level domain down, then port, path and query."""
    text = "" if not isinstance(url, str) else url.strip()
    try:
        part = urlsplit(text)
        host, port = (part.hostname or ""), part.port
    except ValueError:
        return text.lower()
    if not host:
        return text.lower()
    labels = host.split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    tail = (part.path or "/") + (f"?{part.query}" if part.query else "") + (f"#{part.fragment}" if part.fragment else "")
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + tail


def record(url, page_id, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record as a gzip member."""
    name = "" if page_id is None else int(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{name}')}>",
            f"WARC-Date: {DATE}", "WARC-Target-URI: " + json.dumps("" if not isinstance(url, str) else url)[1:-1],
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {name}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {int(refers_to)}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to: who answers and who revisits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # counted on digests alone: combined in the task, so a payload with many copies is a few rows
    groups = rows.filter(F.octet_length("html") >= revisit_bytes).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest")).groupBy(
        "digest").agg(F.max("page_id").alias("answer"), F.count("*").alias("n")).filter("n > 1").select("digest", "answer")
    keyed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    revisit = F.col("answer").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("answer"))
    return keyed.join(groups, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("answer")).alias("refers_to"))


def write(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; returns the captures (durable): key, page_id, file, offset, length, type, refers_to."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for pdf in batches:
                rows = []
                for p, u, h, d, k, r in pdf[["page_id", "url", "html", "digest", "record_type", "refers_to"]].itertuples(index=False, name=None):
                    p, r = (None if x is None or x != x else int(x) for x in (p, r))
                    member = record(u, p, to_bytes(h), d, k, r)
                    if out is None or at + len(member) > file_bytes and at:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    rows.append((surt(u), p, name, at, len(member), k, r))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length", "record_type", "refers_to"]).astype(
                    {"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return cut(records(pages, revisit_bytes).mapInPandas(run, CAPTURE))


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sorted shards of compressed blocks; returns the top level (durable): first_key, last_key, file, directory bytes."""
    fields = [x.split()[0] for x in CAPTURE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name, at, waiting, directory, last = f"{uuid.uuid4().hex}.cdx", 0, [], [], ""
        out = None

        def close_block():
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(json.dumps(x) for x in waiting).encode(), 1)
            out.write(data)
            directory.append((waiting[0][0], at, len(data)))
            at += len(data)
            waiting.clear()

        for pdf in batches:
            for x in pdf[fields].astype(object).where(pdf[fields].notna(), None).itertuples(index=False, name=None):
                waiting.append([int(v) if isinstance(v, float) else v for v in x])
                last = x[0]
                if len(waiting) == block:
                    close_block()
        if waiting:
            close_block()
        if directory:
            table = json.dumps(directory).encode()
            out.write(table)
            out.close()
            yield pd.DataFrame({"first_key": [directory[0][0]], "last_key": [last], "file": [name], "offset": [at], "length": [len(table)]})

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # file and offset split a key with very many captures over several shards
    ordered = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return cut(ordered.mapInPandas(run, "first_key string, last_key string, file string, offset long, length long"))


def lookup(urls: DataFrame, top: DataFrame, folder: str) -> DataFrame:
    """Captures of the distinct keys of ``urls`` (column url) through the two levels."""
    spark = urls.sparkSession
    # one row per shard: as many as partitions, not as captures
    shards = [tuple(r) for r in top.orderBy("first_key", "last_key", "file").collect()]
    firsts, lasts = [s[0] for s in shards], [s[1] for s in shards]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [surt(u) for u in pdf["url"].tolist()]
            pairs = [(k, i) for k in keys for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pd.DataFrame(pairs, columns=["key", "shard"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for pdf in batches:
            for shard, part in pdf.groupby("shard"):
                _, _, name, at, size = shards[int(shard)]
                with store.open_input_file(f"{root}/{name}") as f:
                    directory = json.loads(f.read_at(size, at))
                    starts = [d[0] for d in directory]
                    wanted = sorted(set(part["key"]))
                    held, block = -1, []
                    found: list = []
                    for k in wanted:
                        # a key may begin in the block before the first one that starts with it
                        i = max(0, bisect_left(starts, k) - 1)
                        while i < len(starts) and starts[i] <= k:
                            if i != held:
                                block = [json.loads(x) for x in zlib.decompress(f.read_at(directory[i][2], directory[i][1])).split(b"\n")]
                                held = i
                            keys = [x[0] for x in block]
                            found += block[bisect_left(keys, k):bisect_right(keys, k)]
                            i += 1
                        if len(found) > 4096:
                            yield _captures(found)
                            found = []
                    if found:
                        yield _captures(found)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = urls.select(F.col("url").cast("string").alias("url")).mapInPandas(route, "key string, shard int").distinct()
    return routed.repartition(n, "shard").sortWithinPartitions("shard", "key").mapInPandas(search, CAPTURE)


def _captures(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in CAPTURE.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read(captures: DataFrame, folder: str) -> DataFrame:
    """Parsed records of the captures, by byte ranges (neighbouring ranges of a file in one request)."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for pdf in batches:
            rows = []
            for name, part in pdf.sort_values(["file", "offset"]).groupby("file"):
                with store.open_input_file(f"{root}/{name}") as f:
                    lo, data = 0, b""
                    for at, size, end in zip(part["offset"], part["length"], part["offset"] + part["length"]):
                        if not (lo <= at and end <= lo + len(data)):
                            near = part["offset"] + part["length"]
                            upto = int(near[(part["offset"] >= at) & (near <= max(end, at + NEAR_BYTES))].max())
                            lo, data = int(at), f.read_at(upto - int(at), int(at))
                        head, payload = parse(data[at - lo:end - lo])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged record in {name} at {at}")
                        page, refers = head["X-Page-Id"], head.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, json.loads('"' + head["WARC-Target-URI"] + '"'), payload,
                                     int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(refers) if refers else None))
            yield pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype(
                {"page_id": "Int64", "refers_to": "Int64"})

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = captures.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInPandas(run, schema)


def archive(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, block: int = BLOCK,
            folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Write archives and index; returns (captures, top level of the index, folder)."""
    prepare(pages.sparkSession)
    folder = folder or archive_folder(pages.sparkSession, "warc")
    captures = write(pages, folder, revisit_bytes, file_bytes)
    return captures, build_index(captures, folder, block), folder
