"""Web archives with a two-level capture index.

An archive is a folder::

    NNNNNN-A-R.warc.gz   WARC 1.1 records, each a gzip member of its own
    index-NNNNNN-A.cdxz  captures sorted by key in compressed blocks, then the block directory
    manifest.json        the index files in order, with their first and last keys

A capture's key is its address with the host's labels reversed (``com,example)/path``),
so that the captures of a site lie side by side. The directory is sparse, one line a
block. A search binary-searches the manifest for index files and their directories for
blocks, reads only those blocks, and then only the byte ranges of the records found.
Writers name files by task attempt and every index entry names its file, so what a lost
or repeated attempt leaves is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumera.llm.common import join_counted, numbered, parts_for, read_table, scratch, small, stored

#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 100
#: Bytes after which a task begins another archive file.
FILE_BYTES = 1 << 30
#: Captures of an index block, and of an index file.
BLOCK, SHARD = 1_000, 500_000
#: Bytes read at once, and bytes between two records that are read along.
READ, GAP = 4 << 20, 64 << 10
#: Bytes of an archive file whose records one task reads.
SPLIT = 64 << 20
TAIL = "<QQ8s"
MAGIC = b"CDXZ0001"
# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, row_no long, record_type string, file string, offset long, length long"
RECORD = "page_id string, url string, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string"


def url_key(url: str | None) -> str:
    """The sort key of an address: host labels reversed, then port, path and query.

    Scheme, user, fragment and the default port don't count, nor does the case of the
    host. Spaces, controls and what isn't ASCII are percent-encoded. Null and empty are "".
    """
    rest = quote((url or "").strip(), safe="%/:?#[]@!$&'()*+,;=~-._")
    scheme, mark, tail = rest.partition("://")
    scheme = scheme.lower() if mark else ""
    tail = (tail if mark else rest).partition("#")[0]
    cut = min((i for i in (tail.find("/"), tail.find("?")) if i >= 0), default=len(tail))
    host, path = tail[:cut].rpartition("@")[2].lower(), tail[cut:]
    if not host and not path:
        return ""
    host, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    port = "" if port == {"http": "80", "https": "443"}.get(scheme) else port
    labels = host.rstrip(".").split(".")
    if not labels[-1].isdigit():
        labels.reverse()
    return ",".join(labels) + (f":{port}" if port else "") + ")" + (path or "/")


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record; line ends in a value are percent-encoded."""
    lines = [VERSION, b"WARC-Type: " + kind.encode()]
    lines += [f"{name}: {value}".replace("\r", "%0D").replace("\n", "%0A").encode() for name, value in fields if value is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name and the block of one uncompressed record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.strip().lower().decode(): value.strip().decode() for name, _, value in (line.partition(b":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:size]


def _urn(row: int) -> str:
    """The record id of a row, the same at every attempt."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'capture %d' % row).digest()[:16], version=5)}>"


class ArchiveWriter:
    """Archive files of one task; says where each record lies."""

    def __init__(self, folder: str, date: str, level: int, most: int) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.date, self.level, self.most, self.files, self.out, self.at = date, level, most, 0, None, 0
        context = TaskContext.get()
        self.stem = f"{context.partitionId():06d}-{context.taskAttemptId()}"

    def _write(self, record: bytes) -> tuple[str, int, int]:
        packer = zlib.compressobj(self.level, wbits=31)
        data = packer.compress(record) + packer.flush()
        self.out.write(data)
        place = (self.name, self.at, len(data))
        self.at += len(data)
        return place

    def add(self, page_id: str | None, url: str | None, row: int, payload: bytes, refers_row: int | None, digest: str | None) -> tuple[str, int, int]:
        """Write a response, or a revisit if ``refers_row`` is given; file, offset and length."""
        if self.out is None or self.at >= self.most:
            self.close()
            self.name, self.at = f"{self.stem}-{self.files:03d}.warc.gz", 0
            self.files += 1
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self._write(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        known = digest or hashlib.sha256(payload).hexdigest()
        fields = [("WARC-Record-ID", _urn(row)), ("WARC-Date", self.date), ("WARC-Target-URI", url or None), ("WARC-Payload-Digest", f"sha256:{known}"), ("Page-Id", page_id)]
        fields += [("Content-Type", "application/http;msgtype=response")]
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        if refers_row is not None:
            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_row)), ("WARC-Truncated", "length")]
            return self._write(_record("revisit", fields, http + b"\r\n"))
        return self._write(_record("response", fields, http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload))

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def equal_payloads(rows: DataFrame, row: str, id_col: str, html: Column, least: int) -> DataFrame:
    """(row, refers_row, digest) of each row whose payload an earlier one has, by page id, then row."""
    payload = F.coalesce(html, F.lit(""))
    narrow = rows.select(F.col(row).alias("row_no"), F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least)
    narrow = stored(narrow, "digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row_no")).alias("first")
    groups = narrow.groupBy("digest", "size").agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = stored(groups.select("digest", "size", F.col("first.row_no").alias("refers_row"), "copies"), "equal")
    return join_counted(narrow, groups, ["digest", "size"], "copies").where("row_no <> refers_row").select(F.col("row_no").alias(row), "refers_row", "digest")


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", least: int = REVISIT_BYTES, level: int = 6, file_bytes: int = FILE_BYTES, shard: int = SHARD) -> dict:
    """Write one record a row, and the index.

    Of rows with equal payloads of ``least`` bytes or more, that of the smallest id is a
    response and the others are revisits of it, without payload; null ids come last,
    equal ids in the order of the rows, so of repeated rows one is a response. Null
    payloads are empty; null and empty addresses have no target and share the key "".
    Other columns are ignored. An empty table gives an archive without files.

    Payloads are moved between tasks only if the table of revisits is too large to be
    broadcast. Returns the manifest.
    """
    spark = pages.sparkSession
    rows, row = numbered(pages)
    again = equal_payloads(rows, row, id_col, F.col(html_col), least)
    again = stored(again, "revisits")
    whole = rows.select(row, F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    whole = whole.join(again, row, "left")
    whole = whole.select("page_id", "url", row, "refers_row", "digest", F.when(F.col("refers_row").isNull(), F.col("html")).cast("binary").alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, date, level, file_bytes)
        for batch in small(batches, 200):
            found = []
            for page_id, url, number, refers, digest, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = writer.add(page_id, url, number, html or b"", refers, digest)
                found.append((url_key(url), number, "response" if refers is None else "revisit", *place))
            yield _batch(found)
        writer.close()

    entries = stored(whole.mapInArrow(write, ENTRY), "captures")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    n = parts_for(entries.count(), shard, spark)
    ordered = entries.repartitionByRange(n, "key", "row_no").sortWithinPartitions("key", "row_no")
    made = ordered.mapInArrow(_index_writer(folder), "name string, first string, last string, captures long, blocks long").collect()
    index = [r.asDict() for r in sorted(made, key=lambda r: r.name)]
    manifest = {"version": 1, "captures": sum(r["captures"] for r in index), "index": index}
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["key", "row_no", "record_type", "file", "offset", "length"])


def _index_writer(folder: str):  # noqa: ANN202
    """Writes the sorted captures of a task as one index file; memory is bounded by a block and its directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"index-{context.partitionId():06d}-{context.taskAttemptId()}.cdxz"
        out, at, total, held, directory, last = None, 0, 0, [], [], ""

        def flush() -> int:
            data = gzip.compress(b"".join(held), 6, mtime=0)
            out.write(data)
            directory[-1] += [at, len(data)]
            held.clear()
            return len(data)

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}")
                if not held:
                    directory.append([line[0]])
                held.append(json.dumps(line).encode() + b"\n")
                total, last = total + 1, line[0]
                if len(held) == BLOCK:
                    at += flush()
        if out is None:
            return
        if held:
            at += flush()
        data = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
        out.write(data + struct.pack(TAIL, at, len(data), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict({"name": [name], "first": [directory[0][0]], "last": [last], "captures": [total], "blocks": [len(directory)]})

    return run


class CaptureIndex:
    """One index file: its sparse directory in memory, its blocks read as they are asked for."""

    def __init__(self, handle) -> None:  # noqa: ANN001
        self.f = handle
        size = handle.size()
        at, n, magic = struct.unpack(TAIL, handle.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC:
            raise ValueError("not an index file, or cut short")
        self.directory = json.loads(gzip.decompress(handle.read_at(n, at)))
        self.first = [d[0] for d in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def block(self, i: int) -> list[list]:
        if self.held[0] != i:
            _, at, n = self.directory[i]
            self.held = (i, [json.loads(line) for line in gzip.decompress(self.f.read_at(n, at)).splitlines()])
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """The captures of a key: a key may begin in the block before the first that begins with it."""
        for i in range(max(0, bisect_left(self.first, key) - 1), bisect_right(self.first, key)):
            lines = self.block(i)
            a = bisect_left(lines, key, key=lambda e: e[0])
            b = bisect_right(lines, key, key=lambda e: e[0])
            yield from lines[a:b]


def read_manifest(folder: str) -> dict:
    """The manifest of an archive."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def find_captures(urls: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """Index entries of all captures of the addresses: key, row_no, record_type, file, offset, length.

    Each capture comes once, however often its address is asked for. Null addresses find
    the captures without one; addresses without captures find nothing. Other columns
    are ignored.
    """
    index = read_manifest(folder)["index"]
    first, last = [r["first"] for r in index], [r["last"] for r in index]
    names = [r["name"] for r in index]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key in {url_key(u) for u in batch.column(0).to_pylist()}:
                # The files that may hold the key are those from the first that ends at it or later to the last that begins at it or before.
                found += [(key, i) for i in range(bisect_left(last, key), bisect_right(first, key))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([i for _, i in found], pa.int32())], names=["key", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        now, held, handle = -1, None, None
        for batch in batches:
            found = []
            for key, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if handle is not None:
                        handle.close()
                    handle = store.open_input_file(f"{root}/{names[shard]}")
                    now, held = shard, CaptureIndex(handle)
                for entry in held.find(key):
                    found.append(tuple(entry))
                    if len(found) >= 10_000:
                        yield _batch(found)
                        found = []
            yield _batch(found)

    asked = urls.select(F.col(url_col).alias("url")).mapInArrow(place, "key string, shard int").distinct()
    dealt = asked.repartition(max(1, len(index)), "shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(search, ENTRY)


def read_captures(entries: DataFrame, folder: str) -> DataFrame:
    """The records of index entries, by range reads: page_id, url, record_id, record_type, refers_to_id, payload_bytes, payload_digest.

    The payload of a response is hashed and must agree with its header; of a revisit
    payload_bytes is null, and payload_digest what the header says. Entries are dealt
    by stretches of files, and neighbouring records are read at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        now, handle = None, None
        for batch in batches:
            places = list(zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True))
            i, found = 0, []
            while i < len(places):
                file, begin, _ = places[i]
                j = i + 1
                while j < len(places) and places[j][0] == file and places[j][1] <= places[j - 1][1] + places[j - 1][2] + GAP and places[j][1] + places[j][2] <= begin + READ:
                    j += 1
                if file != now:
                    if handle is not None:
                        handle.close()
                    now, handle = file, store.open_input_file(f"{root}/{file}")
                data = handle.read_at(places[j - 1][1] + places[j - 1][2] - begin, begin)
                for _, offset, length in places[i:j]:
                    found.append(_row(data[offset - begin : offset - begin + length]))
                i = j
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            kinds = [pa.string()] * 5 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])

    stretch = F.floor(F.col("offset") / SPLIT).alias("stretch")
    dealt = entries.select("file", stretch, "offset", "length").repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD)


def _row(member: bytes) -> tuple:
    fields, block = parse_record(zlib.decompress(member, 31))
    known = fields["warc-payload-digest"].removeprefix("sha256:")
    size = None
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != known:
            raise ValueError(f"the payload of {fields['warc-record-id']} isn't what its header says")
    return fields.get("page-id"), fields.get("warc-target-uri"), fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), size, known


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the payload size, digest and page of what a revisit refers to: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    ``records`` is stored. A revisit whose response isn't among them, or has another
    digest, has a null size and null refers_to.
    """
    plain = ["page_id", "url", "record_type", "payload_bytes", "payload_digest"]
    responses = records.where("record_type <> 'revisit'").select(*plain, F.lit(None).cast("string").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'")
    asked = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n_revisits"))
    known = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"))
    targets = stored(known.join(asked, "refers_to_id", "right"), "targets")
    both = join_counted(revisits, targets, ["refers_to_id"], "n_revisits")
    same = F.col("digest") == F.col("payload_digest")
    found = both.select("page_id", "url", "record_type", F.when(same, F.col("size")).alias("payload_bytes"), "payload_digest", F.when(same, F.col("refers_to")).alias("refers_to"))
    return responses.unionByName(found)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive and read back by the addresses of all pages."""
    pages, folder = read_table(spark, sf_dir, "pages"), scratch(spark, "archive")
    write_archive(pages, folder)
    entries = find_captures(pages, folder)
    records = resolve_revisits(stored(read_captures(entries, folder), "records"))
    as_id = lambda c: F.col(c).cast(pages.schema["page_id"].dataType).alias(c)
    return records.select(as_id("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to"))


OP11_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
