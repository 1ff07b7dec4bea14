"""WARC archives: write with deduplicated payloads, read back, merge capture indexes.

Writing.  A page is one WARC/1.1 record.  Records with equal payloads of at least
`min_revisit_bytes` bytes are one `response` (the smallest id) and `revisit`
records that refer to it and hold the HTTP header alone.  Spark's text writer
writes the archives: a record is a line, and the separator is the four bytes that
end a WARC record, so task retries and lost executors are its commit protocol's
business and any file system that Spark writes will do.  Each archive is gzipped
as one stream, sorted by URL key and time.

Reading.  Archives are read whole as binary files, inflated as a stream and
parsed by Content-Length; payload digests are computed anew and must agree with
the headers.

Merging.  Each archive yields a run of captures in order of (URL key, time, id).
The runs are dealt out by ranges of that key, and every task merges its runs with
a loser tree, which gives globally ordered capture histories: tasks in order, and
rows in order within each.  A URL with very many captures spans several ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import shared

_END = "\r\n\r\n"
_CAPTURES = "id bigint, url string, captured string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the last to the first, then path and query; no scheme, user, port or fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """Rows (id, url, captured, html) with `digest` and `refers_to`: the smallest id of an equal payload, null for that id itself.

    Payloads travel once, by id; what is grouped by digest has ids alone, is
    combined before the shuffle, and only digests that repeat go on.
    """
    rows = pages.withColumn("digest", F.sha2(F.col("html"), 256))
    narrow = rows.filter(F.octet_length("html") >= min_revisit_bytes).select("id", "digest").filter(F.col("id").isNotNull())
    first = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).filter("last > refers_to").drop("last")
    later = narrow.join(first, "digest").filter("id > refers_to").distinct()
    return rows.join(later, ["id", "digest"], "left")


def _record(r: DataFrame) -> Column:
    """The whole record without the bytes that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("html").cast("string")), F.lit("\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    uri = F.regexp_replace(F.col("url"), r"[\r\n]", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.col("captured")), F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def write_warc(pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", captured: Column | None = None, min_revisit_bytes: int = 100, records_per_archive: int = 20_000) -> None:
    """Writes a record for each row, in gzipped archives.

    captured: the time as a WARC date string; without it, seconds since 2024 by
    id.  Null html is an empty payload; null URLs have no WARC-Target-URI; rows
    without an id are responses; rows that repeat the smallest id of a payload are
    responses, other repeated rows revisits.  Other columns are left out.
    """
    if captured is None:
        captured = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col(id_column), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("url"), captured.alias("captured"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    ordered = with_revisits(rows, min_revisit_bytes).withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", "captured", "id")
    ordered.select(_record(ordered).alias("value")).write.options(lineSep=_END, compression="gzip", maxRecordsPerFile=records_per_archive).text(path)


def _inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    gz, at = zlib.decompressobj(31), 0
    while at < len(content):
        yield gz.decompress(content[at : at + step])
        at += step
        while gz.eof and (gz.unused_data or at < len(content)):  # archives may have a member for each record
            rest, gz = gz.unused_data, zlib.decompressobj(31)
            yield gz.decompress(rest or content[at : at + step])
            at += 0 if rest else step
    yield gz.flush()


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive; holds a record at a time."""
    have = bytearray()
    source = _inflated(content)

    def fill(n: int) -> None:
        while len(have) < n:
            have.extend(next(source))

    while True:
        while (end := have.find(b"\r\n\r\n")) < 0:
            more = next(source, None)
            if more is None:
                if have.strip():
                    raise ValueError("an archive ends within a record")
                return
            have.extend(more)
        head = have[:end].decode().split("\r\n")
        if not head[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record: {head[0][:40]}")
        headers = dict(x.split(": ", 1) for x in head[1:])
        size = int(headers["Content-Length"])
        fill(end + 4 + size + 4)
        yield headers, bytes(have[end + 4 : end + 4 + size])
        del have[: end + 4 + size + 4]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of all archives, in the order of the archive."""

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CAPTURES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for h, block in _records(content.as_buffer().to_pybytes()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size, digest = int(head.rpartition(b"Content-Length: ")[2]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{name}: the payload of {h['WARC-Record-ID']} doesn't have its digest")
                    rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Date"], size, digest, h["WARC-Type"], number(h.get("WARC-Refers-To")), name.as_py()))
                    if len(rows) >= 4096:
                        yield emit()
                        rows = []
        if rows:
            yield emit()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _CAPTURES)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path of log2(k) matches."""

    _OVER = (1,)  # after any key; keys are wrapped as (0, key)

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.head = [self._next(i) for i in range(len(runs))] or [self._OVER]
        self.loser = [-1] * self.k
        self.winner = self._play(1)

    def _next(self, i: int) -> tuple:
        row = next(self.runs[i], None)
        return self._OVER if row is None else (0, row)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if (self.head[b], b) < (self.head[a], a):
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while (top := self.head[self.winner]) is not self._OVER:
            yield top[1]
            at = self.winner
            self.head[at] = self._next(at)
            node = (at + self.k) // 2
            while node:
                other = self.loser[node]
                if (self.head[other], other) < (self.head[at], at):
                    self.loser[node], at = at, other
                node //= 2
            self.winner = at


def merge_captures(index: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """Captures in global order of (url_key, captured, id), merged from the archives' runs.

    Ranges of keys are cut so that a task holds about `most_rows` narrow rows, however
    many there are in all; ids tell captures of one hot key apart, so it is cut, too.
    An archive's captures within a range are a run, sorted by itself.
    """
    ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // most_rows))
    keyed = index.withColumn("url_key", url_key(F.col("url"))).repartitionByRange(ranges, "url_key", "captured", "id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = list(zip(*(rows[c].to_pylist() for c in ("url_key", "captured")), [-(2**63) if x is None else x for x in rows["id"].to_pylist()], strict=True))
        runs: dict[str, list[tuple]] = {}
        for i, archive in enumerate(rows["archive"].to_pylist()):
            runs.setdefault(archive, []).append((*keys[i], i))
        order = [k[-1] for k in LoserTree([iter(sorted(run)) for run in runs.values()])]
        for at in range(0, len(order), 8192):
            yield from rows.take(pa.array(order[at : at + 8192], pa.int64())).to_batches()

    return keyed.mapInArrow(merge, keyed.schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from the archives that were written.

    Null and empty pages are responses without bytes; equal pages of 100 bytes or more
    refer to the one with the smallest id; very large pages are one record; rows of
    one id are records of their own; an empty table has no rows.
    """
    path = shared.scratch(spark, "warc")
    write_warc(shared.load(spark, sf_dir, "pages"), path)
    index = shared.table(read_captures(spark, path), "captures")
    return merge_captures(index).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
