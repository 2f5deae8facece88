"""WARC archives with payload deduplication, and capture histories by external index merge.

Each page becomes a record in a gzipped WARC file (one gzip member a record, one file a task). Of records with equal
payloads of at least ``MIN_REVISIT`` bytes that with the largest page_id is the response, the others are revisits of
it. The files are read back one task each; every response's payload is checked against its digest, and the captures are
sorted by URL key, timestamp and page_id into runs. Runs are merged by k-way loser trees: a sample of their keys, of at
most about ``KEYS``, cuts the key space into ranges, each range is one task's merge, and the ranges in order are the
globally ordered histories. Where there are more than ``FAN_IN`` runs, groups of them are merged into longer runs first,
by range as well, so that no level has fewer tasks than the last. The driver knows a name for each file and run.

Defined cases: null html is an empty payload and a null url an empty one; a null page_id never beats another, and where
all are null, or several share the largest, each of these is a response; an empty table gives an empty history; extra
columns are ignored. Timestamps: pages have none, so a capture's is ``EPOCH`` plus page_id seconds.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.kernel import map_arrow, shared_folder, written

MIN_REVISIT, FAN_IN, BATCH, SAMPLES, KEYS, RUN_ROWS, LEVEL = 1000, 128, 2048, 64, 100_000, 200_000, 4
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
CAPTURE = pa.schema([
    ("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("at", pa.int64()),
])
DDL = "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long"


def url_key(url: str) -> str:
    """Sort-friendly key: reversed host, then path and sorted query; scheme, www, default port and fragment go."""
    m = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/?#]*)([^?#]*)\??([^#]*)", url.strip())
    host = re.sub(r":(80|443)$", "", m[2].rpartition("@")[2].lower())
    host = host.removeprefix("www.")
    query = "&".join(sorted(m[4].split("&"))) if m[4] else ""
    return ",".join(reversed(host.split("."))) + ")" + (m[3].rstrip("/") or "/") + ("?" + query if query else "")


def timestamp(page_id: int | None) -> str:
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y%m%d%H%M%S")


def record(page: dict) -> bytes:
    """One WARC record, as a gzip member."""
    payload, revisit = (page["html"] or "").encode(), page["refers_to"] is not None
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{page["digest"]}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    t = timestamp(page["page_id"])
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page['page_id'])}",
        f"WARC-Date: {t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z", "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", page["url"] or ""),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(page["digest"])).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page["page_id"] is not None:
        head.append(f"X-Page-Id: {page['page_id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(page['refers_to'])}", f"X-Refers-To-Page: {page['refers_to']}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file, read once from front to back."""
    data, offset = b"", 0
    while True:
        z, parts = zlib.decompressobj(31), []
        size = 0
        while not z.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    if size:
                        raise ValueError("the archive ends inside a record")
                    return
            size += len(data)
            parts.append(z.decompress(data))
            data = z.unused_data
        size -= len(data)
        yield offset, b"".join(parts)
        offset += size


def capture(content: bytes, file: str, at: int) -> tuple:
    """The index entry of a record; a response's payload must match its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{file}: the record at {at} doesn't hold its payload")
    number = lambda f: int(fields[f]) if f in fields else None
    ts = re.sub(r"[^0-9]", "", fields["WARC-Date"])
    return url_key(fields.get("WARC-Target-URI", "")), ts, number("X-Page-Id"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page"), file, at


def sort_key(c: tuple) -> tuple:
    return c[0], c[1], c[2] is None, c[2] or 0, c[7], c[8]


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next winner takes log2(k) comparisons."""

    def __init__(self, sources: list[Iterator[tuple]]) -> None:
        self.sources, self.k = sources, len(sources)
        self.head = [self._next(i) for i in range(self.k)]
        self.node = [-1] * max(1, self.k)
        winners = {self.k + i: i for i in range(self.k)}
        for n in range(self.k - 1, 0, -1):
            a, b = winners[2 * n], winners[2 * n + 1]
            winners[n], self.node[n] = (a, b) if self._less(a, b) else (b, a)
        self.node[0] = winners.get(1, 0)

    def _next(self, i: int) -> tuple | None:
        row = next(self.sources[i], None)
        return None if row is None else (sort_key(row), i, row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (best := self.head[w := self.node[0]]) is not None:
            yield best[2]
            self.head[w] = self._next(w)
            n = (w + self.k) // 2
            while n:
                if self._less(self.node[n], w):
                    self.node[n], w = w, self.node[n]
                n //= 2
            self.node[0] = w


def write_run(uri: str, rows: Iterator[tuple]) -> tuple[int, list[list[str]]]:
    """Write sorted captures; the rows written and about ``SAMPLES`` evenly spaced keys of them."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0])
    count, keys, step = 0, [], 1
    with fs.open_output_stream(path, compression=None) as out, pa.ipc.new_file(out, CAPTURE, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        part: list[tuple] = []
        for row in rows:
            if count % step == 0:
                keys.append([row[0], row[1]])
                if len(keys) > 2 * SAMPLES:
                    keys, step = keys[::2], 2 * step
            count += 1
            part.append(row)
            if len(part) == BATCH:
                w.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), CAPTURE)], schema=CAPTURE))
                part = []
        if part:
            w.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), CAPTURE)], schema=CAPTURE))
    return count, keys


def read_run(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """A run's captures with low <= (URL key, timestamp) < high, a batch in memory at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        r = pa.ipc.open_file(f)
        first = lambda i: (lambda b: (b["url_key"][0].as_py(), b["ts"][0].as_py()))(r.get_batch(i))
        start = 0 if low is None else max(0, bisect.bisect_left(range(r.num_record_batches), low, key=first) - 1)
        for i in range(start, r.num_record_batches):
            for row in zip(*[c.to_pylist() for c in r.get_batch(i).columns]):
                if low is not None and row[:2] < low:
                    continue
                if high is not None and row[:2] >= high:
                    return
                yield row


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html with digest and refers_to (null for responses)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    p = p.withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    long = p.where(F.octet_length("html") >= MIN_REVISIT)
    best = long.groupBy(F.col("digest").alias("d2")).agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null").drop("n")
    # only payloads that may be revisits meet by digest; the others, many of them alike, are spread
    key = F.when(F.octet_length("html") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    out = p.withColumn("key", key).join(best.hint("shuffle_hash"), F.col("key") == F.col("d2"), "left")
    refers = F.when((F.octet_length("html") >= MIN_REVISIT) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best"))), F.col("best"))
    return out.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Write the archives; the files of the attempts that counted. A lost attempt's file is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/warc/{uuid.uuid4().hex}.warc.gz"
        out = None
        for batch in batches:
            for page in batch.to_pylist():
                if out is None:
                    fs, path = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(path.rpartition("/")[0])
                    out = fs.open_output_stream(path, compression=None)
                out.write(record(page))
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([uri])], names=["file"])

    return [r.file for r in written(record_types(pages).mapInArrow(run, "file string"), "files").collect()]


def tasks(pages: DataFrame, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of work, a task each."""
    spark = pages.sparkSession
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), ddl)


Run = list[tuple[str, tuple | None, tuple | None]]  # its files in order, each with the keys it begins at and ends before


def sorted_runs(pages: DataFrame, files: list[str], folder: str) -> tuple[list[Run], list[tuple]]:
    """The runs, and a sample of their keys in order."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            runs, keys = [], []
            for file in batch.column("file").to_pylist():
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_stream(path, compression=None) as stream:
                    part: list[tuple] = []
                    for at, content in members(stream):
                        part.append(capture(content, file.rpartition("/")[2], at))
                        if len(part) == RUN_ROWS:
                            runs.append(f"{folder}/runs/{uuid.uuid4().hex}")
                            keys.append(write_run(runs[-1], iter(sorted(part, key=sort_key)))[1])
                            part = []
                    if part:
                        runs.append(f"{folder}/runs/{uuid.uuid4().hex}")
                        keys.append(write_run(runs[-1], iter(sorted(part, key=sort_key)))[1])
            return {"run": runs, "keys": keys}

        return step

    table = written(map_arrow(tasks(pages, [(f,) for f in files], "file string"), "run string, keys array<array<string>>", make), "runs")
    total = table.agg(F.sum(F.size("keys"))).first()[0] or 0
    lot = F.pmod(F.xxhash64("k", "run"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, KEYS / max(1, total))) + 1
    keys = table.select("run", F.explode("keys").alias("k")).where(lot).select("k").collect()
    return [[(r.run, None, None)] for r in table.select("run").collect()], sorted(tuple(r.k) for r in keys)


def cuts_of(keys: list[tuple], ranges: int) -> list[tuple]:
    ranges = min(len(keys), max(1, ranges))
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)})


def read_part(run: Run, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    for uri, begin, end in run:
        if (end is None or low is None or low < end) and (begin is None or high is None or begin < high):
            yield from read_run(uri, low, high)


def merged_runs(pages: DataFrame, runs: list[Run], keys: list[tuple], folder: str) -> list[Run]:
    """Groups of ``FAN_IN`` runs merged into one each, a task for each group and range, until one tree can hold all."""
    spark = pages.sparkSession
    while len(runs) > FAN_IN:
        groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]
        cuts = cuts_of(keys, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // len(groups)))
        bounds = list(zip([None, *cuts], [*cuts, None]))
        sent = spark.sparkContext.broadcast(groups)  # names of runs

        def make(sent=sent, bounds=bounds):
            def step(batch: pa.RecordBatch) -> dict:
                g, n, out = batch.column("g").to_pylist(), batch.column("n").to_pylist(), []
                for i, k in zip(g, n):
                    out.append(f"{folder}/runs/{uuid.uuid4().hex}")
                    write_run(out[-1], iter(LoserTree([read_part(r, *bounds[k]) for r in sent.value[i]])))
                return {"g": g, "n": n, "run": out}

            return step

        work = [(i, k) for i in range(len(groups)) for k in range(len(bounds))]
        made = {(r.g, r.n): r.run for r in written(map_arrow(tasks(pages, work, "g int, n int"), "g int, n int, run string", make), "runs").collect()}
        runs = [[(made[i, k], *bounds[k]) for k in range(len(bounds))] for i in range(len(groups))]
        sent.destroy()
    return runs


def archive(pages: DataFrame) -> DataFrame:
    """Write, read back and merge: a row per page, with its position in the globally ordered capture histories."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    runs, keys = sorted_runs(pages, write_archives(pages, folder), folder)
    runs = merged_runs(pages, runs, keys, folder)
    cuts = cuts_of(keys, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            rows, pos = [], []
            for n in batch.column("n").to_pylist():
                low, high = (cuts[n - 1] if n else None), (cuts[n] if n < len(cuts) else None)
                for i, row in enumerate(LoserTree([read_part(r, low, high) for r in runs])):
                    rows.append(row)
                    pos.append((n << 33) + i)
            return dict(zip(CAPTURE.names, map(list, zip(*rows)))) | {"position": pos} if rows else None

        return step

    work = tasks(pages, [(n,) for n in range(len(cuts) + 1)] if runs else [], "n long")
    return map_arrow(work, DDL + ", position long", make).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "position")


SQL = r"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as b, sha1(coalesce(html, '')) as d from pages),
m as (select d, max(page_id) as top from p where b >= 1000 group by d),
r as (select p.*, case when b >= 1000 and (page_id < top or page_id is null) then top end as refers_to from p left join m using (d))
select page_id, b as payload_bytes, d as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from r
"""
