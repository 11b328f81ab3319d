"""WARC archives: writing, reading back, and the index of captures merged from locally sorted runs by a loser tree."""

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registrum.llm._shared import bounded, fresh_path, lean, removed, scratch, staged

VERSION, END = "WARC/1.1", "\r\n\r\n"
MIN_BYTES = 100
#: Most bytes of a payload, and records in an archive of such payloads: some 64 MB, since reading an archive back takes a task the
#: memory of one. Longer payloads have an archive each.
SIZES = ((1 << 14, 4_000), (1 << 20, 60), (1 << 24, 4))
#: Captures that one task merges.
RANGE = 100_000
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, archive string, place long"


def url_key(url: Column) -> Column:
    """Host labels from the top down, then path and query: tion,example,www)/path?query; no scheme, port or fragment. A null url
    has an empty key."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^.*@|:\d+$|^www\.", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(bare, r"[/?].*$", 0)))


def plan_records(pages: DataFrame, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, captured, payload_bytes, payload_digest, refers_to: null for responses; for pages whose payload of at
    least `min_bytes` bytes is that of a page with a smaller id, that page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    long = rows.where(F.col("payload_bytes") >= min_bytes)
    firsts = long.groupBy("payload_digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "least")
    # short payloads, all empty pages among them, are never looked up
    met = long.join(bounded(staged(firsts, "payloads")), "payload_digest", "left")
    again = F.col("least").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("least")))
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    every = met.select(*names, F.when(again, F.col("least")).alias("refers_to")).unionByName(rows.where(F.col("payload_bytes") < min_bytes).select(*names, F.lit(None).cast("long").alias("refers_to")))
    captured = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return every.select("page_id", "url", "html", captured.alias("captured"), "payload_bytes", "payload_digest", "refers_to")


def record_text(p: DataFrame) -> Column:
    """A record without the line ends that follow it. A revisit has the HTTP header of the full payload and no payload."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    kind = F.when(p["refers_to"].isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    url = F.regexp_replace(p["url"], r"[\r\n\t ]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), p["payload_bytes"].cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.when(p["refers_to"].isNull(), p["html"]).otherwise(F.lit("")))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), p["page_id"].cast("string"), F.lit(">"))),
        line("WARC-Date", p["captured"]),
        line("WARC-Target-URI", url),
        line("X-URL-Key", F.regexp_replace(url_key(p["url"]), r"[\r\n\t ]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), p["payload_digest"])),
        line("WARC-Profile", F.when(p["refers_to"].isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), p["refers_to"].cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body)


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES, sizes: tuple[tuple[int, int], ...] = SIZES) -> str:
    """Archives under path, gzip-compressed, each of payloads of one class of sizes (most bytes, records in an archive), so that their
    number bounds its bytes. Spark's text writer puts a record's two line ends behind it, so archives reach any store that Spark writes
    to, by its commit protocol."""
    plan = plan_records(pages, min_bytes=min_bytes)
    low = -1
    for high, records in (*sizes, (2**63 - 1, 1)):
        some = plan.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
        if low < 0 or not some.isEmpty():
            some.select(record_text(some).alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).option("compression", "gzip").text(path)
        low = high
    return path


def records_of(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header and block of every record of an archive. Blocks are taken by their length, never by what they look like."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        body = stop + 4
        end = body + int(head["Content-Length"])
        if content[end : end + 4] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, head, content[body:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def _row(place: int, head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (said, digest):
        raise ValueError(f"the payload at byte {place} is not what its header says")
    return {"page_id": _page(head.get("WARC-Record-ID")), "payload_bytes": said, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": _page(head.get("WARC-Refers-To")), "url_key": head.get("X-URL-Key", ""), "captured": head["WARC-Date"], "place": place}


_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("archive", pa.string()), ("place", pa.int64())])


def order_key(row: dict) -> tuple:
    """URL key, time, page (null first), and then where the record is, so that no two records tie."""
    return row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0, row["archive"], row["place"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive's captures as one sorted run."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = [_row(*r) | {"archive": path.rpartition("/")[2]} for r in records_of(zlib.decompress(content.as_py(), 47))]
            yield pa.RecordBatch.from_pylist(sorted(rows, key=order_key), schema=_SCHEMA)


class LoserTree:
    """Merges k sorted runs: inner nodes keep the loser of each match, so the next record takes one match a level."""

    def __init__(self, runs: list[Iterable], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [key(h) if h is not None else None for h in self.heads]
        self.tree = [-1] * self.k
        self.winner = self._play(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.tree[node] = lost
        return won

    def __iter__(self):
        while self.k and self.keys[self.winner] is not None:
            won = self.winner
            yield self.heads[won]
            self.heads[won] = next(self.runs[won], None)
            self.keys[won] = self.key(self.heads[won]) if self.heads[won] is not None else None
            node = (won + self.k) // 2
            while node:
                if self._beats(self.tree[node], won):
                    self.tree[node], won = won, self.tree[node]
                node //= 2
            self.winner = won


def _keys(table: pa.Table, at: int, end: int) -> Iterator[tuple[tuple, int]]:
    """(order key, row) of rows at to end, read a few at a time."""
    for start in range(at, end, 256):
        rows = table.slice(start, min(256, end - start)).to_pylist()
        yield from ((order_key(r), start + k) for k, r in enumerate(rows))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range of URL keys, which come run by run, as one sorted sequence. The range is held as columns; of each run the merge
    holds a few rows."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    archive = table.column("archive").combine_chunks()
    edges = [0, *(k + 1 for k in np.flatnonzero(pc.not_equal(archive[1:], archive[:-1]).to_numpy(zero_copy_only=False)).tolist()), len(archive)]
    runs = [_keys(table, a, b) for a, b in zip(edges, edges[1:], strict=False)]
    order, done = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        told = table.take(pa.array(order)).append_column("place_in_range", pa.array(range(done, done + len(order)), pa.int64()))
        yield from told.combine_chunks().to_batches()

    for _, row in LoserTree(runs, lambda x: x[0]):
        order.append(row)
        if len(order) == 4096:
            yield from rows()
            done, order = done + len(order), []
    if order:
        yield from rows()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under path, a sorted run for each archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lean(_runs), RECORD)


def merge_index(runs: DataFrame) -> DataFrame:
    """All captures by URL key and time, with position from 0 in the whole history: ranges follow each other, each range's slices of the
    runs are merged by a loser tree, and what lies before a range is added to the places in it. Ranges are cut by time and page too, so
    that a URL captured very often is no single task, and there are as many as hold RANGE captures each, on average."""
    with scratch(runs.sparkSession) as keep:
        held = staged(runs, "captures")
        n = max(1, held.count() // RANGE + 1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        order = ["url_key", "captured", "page_id", "archive", "place"]
        sliced = held.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("archive", *order)
        merged = keep(staged(sliced.mapInArrow(lean(_merged), RECORD + ", part int, place_in_range long"), "history"))
    # a row for each range
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return merged.join(F.broadcast(offsets), "part").withColumn("position", F.col("before") + F.col("place_in_range")).drop("part", "before", "place_in_range")


def archive_pages(pages: DataFrame, path: str | None = None, *, min_bytes: int = MIN_BYTES, sizes: tuple[tuple[int, int], ...] = SIZES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html), reads the archives back and returns their merged index:
    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, archive, place, position.

    A null html is an empty payload, a null url has an empty key, a null page_id stays null and is a revisit where an equal payload
    of `min_bytes` bytes has an id; rows that share the least id are all responses. Without a clock in the table, a capture's
    time is a fixed moment plus page_id seconds. An empty table gives an empty index. Other columns are ignored. Archives that no path
    was given for are removed once they have been read back.
    """
    spark = pages.sparkSession
    place = write_archives(pages, path or fresh_path(spark, "warc"), min_bytes=min_bytes, sizes=sizes)
    index = merge_index(read_archives(spark, place))
    if path is None:
        removed(spark, place)
    return index
