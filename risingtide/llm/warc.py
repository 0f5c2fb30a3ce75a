"""WARC archives of pages, and their capture index by an external merge.

Writing: every task sorts its captures by URL key and time (a run) and writes them as
WARC/1.1 records, files of a bounded size, in Spark's text format with the record end
as line end. Of pages with the same payload of at least 100 bytes the one with the
smallest id is a response; the others are revisits that refer to it, without payload.

Reading: files are parsed by Content-Length, so payloads may hold anything. Each file
is a sorted run of captures. Keys are cut into ranges; the task of a range merges the
parts of all runs that fall into it with a loser tree. Ranges follow each other, so the
index is in global order of URL key, time and id. Ranges are cut on all three, so the
captures of one URL may fill several of them.

Null payloads are empty. A null URL has no target line and an empty key. Repeated rows
each have their record; equal ids share the record id. Rows without id are revisits of
an equal page with one, else responses. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from risingtide.llm.tables import BROADCAST_IDS, Scratch

REVISIT_BYTES = 100
# Records of one archive file, and its bytes where records are long.
RECORDS = 4_000
FILE_BYTES = 128 << 20
# Captures that one merge task holds.
RANGE_ROWS = 200_000

_CAPTURE = ("page_id long, url string, captured string, record_type string, payload_digest string, "
            "payload_bytes long, refers_to long, run string, offset long, length long")


def url_key(url: str | Column) -> Column:
    """Host labels in reverse, then the path: pages of a site and its subdomains lie together."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.lower(F.regexp_replace(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?", ""))
    host, path = F.regexp_extract(rest, r"^([^/?#:]*)", 1), F.regexp_replace(rest, r"^[^/?#:]*(?::[0-9]+)?", "")
    return F.when(url != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)).otherwise("")


def default_time(page_id: str = "page_id") -> Column:
    """A capture time for tables without one: as many seconds after a fixed day as the id, modulo 10 ** 9."""
    return F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(coalesce({page_id}, 0), 1000000000))")


def write_archives(pages: DataFrame, path: str, scratch: Scratch, captured: Column | None = None) -> None:
    """One record per row of ``pages`` (page_id, url, html) below ``path``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "%0A").alias("url"),
        F.date_format(captured if captured is not None else default_time(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"),
    )
    same = scratch.keep(
        rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(
            F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), "same")
    longest = same.agg(F.max("bytes")).first()[0] or 1
    groups = scratch.keep(same.where("n > 1 and first is not null").select("digest", "first"), "groups")
    few = groups.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8
    known = rows.join(F.broadcast(groups) if few else groups, "digest", "left")
    # A null id is never the first of its group.
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "bytes", F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), "url")).otherwise(""),
        F.lit("\r\nWARC-Date: "), "captured", F.lit("\r\nWARC-Payload-Digest: sha256:"), "digest",
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            urn("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block), F.lit("\r\n\r\n"), block,
    )
    runs = known.sortWithinPartitions(url_key("url"), "captured", "page_id").select(record.alias("value"))
    runs.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, min(RECORDS, FILE_BYTES // longest))).text(path)


def parse_records(name: str, data: bytes) -> Iterator[tuple]:
    """The captures of one archive file, in its order."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block = data[head + 4: head + 4 + size]
        http_end = block.index(b"\r\n\r\n") + 4
        http = dict(line.split(": ", 1) for line in block[:http_end - 4].decode("utf-8").split("\r\n")[1:])
        named = fields["WARC-Record-ID"][len("<urn:page:"):-1]
        kind, digest, length = fields["WARC-Type"], fields["WARC-Payload-Digest"].split(":")[1], int(http["Content-Length"])
        if kind == "response":
            payload = block[http_end:]
            if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"record {named} of {name} does not match its digest")
        refers = fields.get("WARC-Refers-To")
        yield (None if named == "none" else int(named), fields.get("WARC-Target-URI"), fields["WARC-Date"], kind, digest,
               length, int(refers[len("<urn:page:"):-1]) if refers else None, name, at, head + 8 + size - at)
        at = head + 4 + size + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split(" ")[0] for part in _CAPTURE.split(", ")]
    types = [pa.int64() if part.endswith("long") else pa.string() for part in _CAPTURE.split(", ")]
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1)):
            rows = list(parse_records(name.as_py(), data.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def read_archives(spark, path: str, scratch: Scratch) -> DataFrame:
    """One row per record below ``path``: what it says, and where it lies."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return scratch.keep(files.mapInArrow(_read, _CAPTURE), "captures", batch_rows=1)


class LoserTree:
    """The k-way merge of sorted runs: each inner place holds the run that lost there."""

    def __init__(self, runs: list[list]):
        self.runs, self.heads = runs, [0] * len(runs)
        k = len(runs)
        self.tree = [-1] * max(k, 1)
        for run in range(k):
            self._play(run)

    def _before(self, a: int, b: int) -> bool:
        """Whether the next row of run ``a`` comes before that of run ``b``; a run that is used up never does."""
        left, right = self.heads[a] < len(self.runs[a]), self.heads[b] < len(self.runs[b])
        if not (left and right):
            return left
        return (self.runs[a][self.heads[a]], a) < (self.runs[b][self.heads[b]], b)

    def _play(self, run: int) -> None:
        place = (run + len(self.runs)) // 2
        while place > 0:
            other = self.tree[place]
            if other == -1:
                self.tree[place] = run
                return
            if self._before(other, run):
                self.tree[place], run = run, other
            place //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator:
        while self.runs:
            winner = self.tree[0]
            if self.heads[winner] >= len(self.runs[winner]):
                return
            yield self.runs[winner][self.heads[winner]]
            self.heads[winner] += 1
            self._play(winner)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys: the parts of all runs to one ordered part of the index."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    key, captured, page, run, offset = (table.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "run", "offset"))
    runs: dict[str, list] = {}
    for i, name in enumerate(run):
        runs.setdefault(name, []).append(i)
    parts = []
    for name in sorted(runs):
        # A run is in order as it was written; its rows may have travelled in any.
        places = sorted(runs[name], key=lambda i: offset[i])
        parts.append([(key[i], captured[i], page[i] is not None, page[i] or 0, i) for i in places])
    order = pa.array([entry[-1] for entry in LoserTree(parts)], pa.int64())
    yield from table.take(order).combine_chunks().to_batches()


def capture_index(captures: DataFrame, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``captures``, a stored table, in global order of URL key, time and id."""
    keyed = captures.withColumn("url_key", url_key("url"))
    ranges = max(1, -(-captures.count() // range_rows))
    dealt = keyed.repartitionByRange(ranges, "url_key", "captured", "page_id")
    return scratch.keep(dealt.mapInArrow(_merge, keyed.schema), "index")


def archived(pages: DataFrame) -> DataFrame:
    """Write, read back and index ``pages``: one row per page, as its record says."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_archives(pages, path, scratch)
    index = capture_index(read_archives(pages.sparkSession, path, scratch), scratch)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
