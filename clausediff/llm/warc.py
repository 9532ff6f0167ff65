"""WARC archives and a globally ordered capture index.

Pages are written as WARC 1.1 records, a gzip member each, into files in the shared folder;
equal payloads of some size are stored once, as the response with the largest id, and the
others revisit it. The archives are read back file by file, each reader giving sorted runs
of captures, cut at common range boundaries. A range's runs then meet in one task as blocks, which
Spark sorts by their first keys, and a loser tree merges them by URL key and timestamp while it holds
about a block of each run, so that the ranges in turn hold all capture histories in order. Files that a lost or repeated task leaves are never read: only the
manifest rows of tasks that ended well name files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm.common import BROADCAST_ROWS, shared_dir, small_or_not, stored

#: Payloads shorter than this are always stored.
REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS = 50_000, 1024, 200_000
#: Tasks that read archives back; beyond so many archives a task reads several.
MOST_READERS = 100_000
#: Keys that place the range boundaries: so many, or so many a range, and at most. Only the balance depends on them.
BOUNDARY_SAMPLE, RANGE_SAMPLE, MOST_SAMPLE = 4096, 16, 1 << 20
#: Capture time of page 0 where the pages have none; page n follows n seconds later.
FIRST_CAPTURE = 1_704_067_200
#: Most revisit decisions that are broadcast: a row of them, with its digest, is about six times an id.
AGAIN_ROWS = BROADCAST_ROWS // 6
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = pa.schema(
    [("sort_key", pa.binary()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("url_key", pa.string()), ("captured_at", pa.string()), ("archive", pa.string()), ("record_offset", pa.int64())]
)


def url_key(url: str | None) -> str:
    """The URL with its host's labels turned round, lower-cased, without scheme, port and fragment."""
    m = re.match(r"(?s)^[^:/?#]*://(?:[^@/?#]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    if not m:
        return url or ""
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def sort_key(url: str | None, stamp: str, page_id: int | None) -> bytes:
    return f"{url_key(url)}\0{stamp}".encode("utf-8", "replace") + (0 if page_id is None else page_id + (1 << 63)).to_bytes(8, "big")


def _stamp(page_id: int | None) -> datetime:
    return datetime.fromtimestamp(FIRST_CAPTURE + (page_id or 0) % 1_000_000_000, UTC)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, with the payload's length, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_stamp(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; returns the manifest: archive, records, bytes."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    narrow = stored(p.select("page_id", "digest", "n").where(F.col("n") >= min_bytes), "payloads")
    same = narrow.groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    again = stored(narrow.join(same, ["digest", "n"]).where("page_id <> first").select("page_id", "digest", "n", F.col("first").alias("refers_to")).distinct(), "revisits")
    folder = shared_dir(pages.sparkSession, "warc")

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, k, n, size, done = None, 0, 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    path = f"{root}/capture-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
                    out, n, size = fs.open_output_stream(path, compression=None), 0, 0
                raw = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                packer = zlib.compressobj(4, wbits=31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path.rsplit("/", 1)[1], n, size))
                    out, k = None, k + 1
        if out is not None:
            out.close()
            done.append((path.rsplit("/", 1)[1], n, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            ["archive", "records", "bytes"],
        )

    rows = p.join(small_or_not(again, AGAIN_ROWS), ["page_id", "digest", "n"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    return stored(rows.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def _members(data: memoryview):
    """(offset, content) of the gzip members of an archive."""
    at = 0
    while at < len(data):
        start, d, parts = at, zlib.decompressobj(31), []
        while not d.eof and at < len(data):
            parts.append(d.decompress(data[at : at + 16384]))
            at += min(16384, len(data) - at)
        if not d.eof:
            raise ValueError("an archive ends inside a record")
        at -= len(d.unused_data)
        yield start, b"".join(parts)


def _number(urn: str | None) -> int | None:
    n = urn[len("<urn:x-page:") : -1] if urn else ""
    return int(n) if n else None


def captures(archive: str):
    """A tuple of CAPTURE's columns for each record of an archive, digests checked."""
    fs, path = pafs.FileSystem.from_uri(archive)
    with fs.open_input_stream(path, compression=None) as f:
        data = memoryview(f.read())
    for offset, raw in _members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
        kind = fields["WARC-Type"]
        if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{archive}, record at {offset}: the payload isn't what its header says")
        stamp = re.sub(r"\D", "", fields["WARC-Date"])
        page_id, url = _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI")
        yield (sort_key(url, stamp, page_id), page_id, n, digest, kind, _number(fields.get("WARC-Refers-To")), url_key(url), stamp, archive.rsplit("/", 1)[1], offset)


class LoserTree:
    """Merges sorted lists: inner nodes hold the losers of their matches, so the next row
    costs one match on each level above the list that it came from."""

    def __init__(self, runs: list[list[tuple]], at: list[int] | None = None):
        self.runs, self.at = runs, at or [0] * len(runs)
        self.k = len(runs)
        self.loser = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether list a's head comes before b's; a list that is used up comes last."""
        x, y = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        if not (x and y):
            return x or (not y and a < b)
        p, q = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return p[0] < q[0] or p[0] == q[0] and a < b

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0:  # while building: wait here for the opponent
                self.loser[node] = winner
                return
            if self._less(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        return self.until()

    def until(self, key: bytes | None = None):
        """The rows that are left, or those before a key."""
        while self.k:
            w = self.loser[0]
            if self.at[w] == len(self.runs[w]) or key is not None and self.runs[w][self.at[w]][0] >= key:
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._replay(w)


class BlockMerge:
    """External merge of sorted runs whose blocks come in the order of their first keys.

    All rows before a new block's first key are in the blocks that came before it, so they can go
    out when it comes. A run's next block comes only when its last one is used up, or down to rows
    of that very key: what is held is about one block of each run that has rows around the key."""

    def __init__(self):
        self.tree, self.most = LoserTree([]), 0

    def add(self, rows: list[tuple]):
        """Takes in a block; gives the rows before its first."""
        yield from self.tree.until(rows[0][0])
        left = [(r, at) for r, at in zip(self.tree.runs, self.tree.at) if at < len(r)] + [(rows, 0)]
        self.most = max(self.most, len(left))
        self.tree = LoserTree([r for r, _ in left], [at for _, at in left])

    def rest(self):
        yield from self.tree.until()
        self.tree = LoserTree([])


def merged_index(manifest: DataFrame, boundaries: list[bytes]) -> DataFrame:
    """All captures of the manifest's archives; (range_id, place) is their global order by
    URL key, timestamp and id."""
    spark = manifest.sparkSession
    edges = spark.sparkContext.broadcast(boundaries)

    def runs(batches):
        task, run = TaskContext.get().partitionId() << 32, 0

        def blocks(rows):
            nonlocal run
            rows.sort(key=lambda r: r[0])
            out, at = [], 0
            while at < len(rows):
                r = bisect_right(edges.value, rows[at][0])
                to = at + 1
                while to < len(rows) and to - at < BLOCK_ROWS and (r == len(edges.value) or rows[to][0] < edges.value[r]):
                    to += 1
                table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:to], strict=True), CAPTURE.types, strict=True)], schema=CAPTURE)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, CAPTURE) as w:
                    w.write_batch(table)
                out.append((r, rows[at][0], task + run, at, sink.getvalue().to_pybytes()))
                at = to
            run += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range_id", "first", "run", "seq", "block"])

        rows = []
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for capture in captures(archive):
                    rows.append(capture)
                    if len(rows) == RUN_ROWS:
                        yield blocks(rows)
                        rows = []
        if rows:
            yield blocks(rows)

    files = min(max(1, manifest.count()), MOST_READERS)  # a number, or the few rows would be put together into one task
    found = manifest.select("archive").repartition(files, "archive").mapInArrow(runs, "range_id long, first binary, run long, seq long, block binary")
    dealt = found.repartition(len(boundaries) + 1, "range_id").sortWithinPartitions("range_id", "first", "run", "seq").select("range_id", "block")

    def merge(batches):
        now, merging, place, held = None, BlockMerge(), 0, []

        def out(least: int):
            """Rows held for output as a batch, once there are `least`."""
            nonlocal held, place
            if len(held) < least:
                return
            columns = [pa.array(c, t) for c, t in list(zip(zip(*held, strict=True), CAPTURE.types, strict=True))[1:]]
            places = pa.array(range(place, place + len(held)), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([now] * len(held), pa.int64()), places], [*CAPTURE.names[1:], "range_id", "place"])
            place, held = place + len(held), []

        for batch in batches:
            for r, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != now:
                    for row in merging.rest():
                        held.append(row)
                        yield from out(BLOCK_ROWS)
                    yield from out(1)
                    now, place = r, 0
                table = pa.ipc.open_stream(block.as_buffer()).read_all()
                for row in merging.add(list(zip(*(c.to_pylist() for c in table.columns), strict=True))):
                    held.append(row)
                    yield from out(BLOCK_ROWS)
        for row in merging.rest():
            held.append(row)
            yield from out(BLOCK_ROWS)
        yield from out(1)

    types = {"int64": "long", "string": "string"}
    columns = ", ".join(f"{f.name} {types[str(f.type)]}" for f in CAPTURE if f.name != "sort_key")
    return dealt.mapInArrow(merge, columns + ", range_id long, place long")


def archived(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, reads them back and returns the merged
    index: CAPTURE's columns without the key, with range_id and place.

    A null html is an empty payload, a null URL has no target and an empty key. Repeated
    rows give a record each. An empty table writes no archive and returns no rows."""
    manifest = write_archives(pages, min_bytes)
    total = manifest.agg(F.sum("records")).first()[0] or 0
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(parts, total // 1000), total // RANGE_ROWS)
    sample = min(MOST_SAMPLE, max(BOUNDARY_SAMPLE, RANGE_SAMPLE * ranges))
    some = F.pmod(F.xxhash64("page_id", "url"), F.lit(max(1, total // sample))) == 0
    sample = pages.select("url", "page_id").where(some).distinct().limit(2 * sample).collect()
    keys = sorted({sort_key(r.url, f"{_stamp(r.page_id):%Y%m%d%H%M%S}", r.page_id) for r in sample})
    ranges = min(ranges, len(keys) or 1)
    return merged_index(manifest, sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}))


#: The index in SQL, without where its records lie (archive, record_offset, range_id, place).
ORACLE = rf"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
q as (select page_id, url, octet_length(encode(html)) as payload_bytes, sha1(encode(html)) as payload_digest, max(page_id) over (partition by html) as last,
    regexp_extract(coalesce(url, ''), '(?s)^[^:/?#]*://(?:[^@/?#]*@)?([^/?#:]*)(?::\d*)?([^#]*)', ['host', 'rest']) as m,
    regexp_matches(coalesce(url, ''), '(?s)^[^:/?#]*://') as absolute from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when payload_bytes >= {REVISIT_BYTES} and page_id <> last then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= {REVISIT_BYTES} and page_id <> last then last end as refers_to,
    case when absolute then array_to_string(list_reverse(string_split(lower(m.host), '.')), ',') || ')' || coalesce(nullif(m.rest, ''), '/') else coalesce(url, '') end as url_key,
    strftime(make_timestamp(({FIRST_CAPTURE} + page_id % 1000000000) * 1000000), '%Y%m%d%H%M%S') as captured_at
from q
"""
