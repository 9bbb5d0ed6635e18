"""WARC archives and their merged capture index.

Writing: payloads are digested; of equal payloads of at least ``min_bytes`` the largest page_id is the response and the others
become revisit records that name it. Each task sorts its captures by URL key and time and writes them as one archive through
Spark's text writer: a record ends in CR LF CR LF, which is the writer's line separator, so the (gzipped) part files are WARC
files in any store Spark can write, committed by Spark.
Reading: the archives are parsed as streams, payload digests are checked, and every archive is a run sorted by (URL key, time).
Index: runs are cut at common range bounds and the pieces of each range merged by a loser tree, which gives capture
histories in global order.

Defined results: null html is an empty payload; null url an empty target; pages with null page_id are plain responses and
nothing refers to them; pages of one page_id and payload are both responses; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_limits, count_rows, lookup_join, stored_bytes

_END = "\r\n\r\n"
#: Index rows that one merge task should hold; it sets the number of ranges.
MERGE_ROWS = 200_000
#: Bytes of records, uncompressed, that an archive of records of average size should hold.
ARCHIVE_BYTES = 256 << 20


def url_key(url: Column) -> Column:
    """Host names from the top domain down, then path and query; no scheme, user, port or fragment."""
    url = F.coalesce(url, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?:[^/@?]*@)?([^/:?]*)", 1)), r"^www\.", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def captures(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, key, stamp, digest, n_bytes, refers_to) of each page; refers_to is null for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    number = F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10 * 365 * 86400)).cast("decimal(18,6)")
    stamp = F.date_format(F.expr("timestamp_ntz'2015-01-01 00:00:00'") + F.make_dt_interval(secs=number), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"), html.alias("html"))
    base = base.select("*", url_key(F.col("url")).alias("key"), stamp.alias("stamp"), F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    groups = base.where((F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    groups = Workspace(pages.sparkSession, "warc-groups").table(groups, "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = lookup_join(base, groups.select("digest", "top"), "digest", "left", sizes=groups.select("digest", "n"), total=total)
    return out.select(*base.columns, F.when((F.col("n_bytes") >= min_bytes) & (F.col("page_id") < F.col("top")), F.col("top")).alias("refers_to"))


def write_archives(found: DataFrame, path: str, records_per_file: int = 20_000, compression: str = "gzip") -> None:
    """Each partition of captures() as sorted archives."""
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(_END))
    again = F.col("refers_to").isNotNull()
    body = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    lines = [
        F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), uri(F.col("page_id"))), F.concat(F.lit("WARC-Date: "), F.col("stamp")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("refers_to")))), F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n_bytes"))).cast("string")),
    ]
    ordered = found.sortWithinPartitions("key", "stamp", "page_id")
    record = ordered.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), body).alias("value"))
    record.write.mode("overwrite").option("lineSep", _END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset in the uncompressed archive) of each record of a stream."""
    buf, at = bytearray(), 0
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while True:
        end = buf.find(b"\r\n\r\n")
        while end < 0:
            seen = len(buf)
            if not fill(seen + 1):
                if buf.strip():
                    raise ValueError("a record's header is cut off")
                return
            end = buf.find(b"\r\n\r\n", max(0, seen - 3))
        first, *rest = bytes(buf[:end]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        headers = dict(x.split(": ", 1) for x in rest)
        size = int(headers["Content-Length"])
        if not fill(end + 4 + size + 4) or bytes(buf[end + 4 + size : end + 8 + size]) != b"\r\n\r\n":
            raise ValueError("a record's block is cut off")
        yield headers, bytes(buf[end + 4 : end + 4 + size]), at
        at += end + 8 + size
        del buf[: end + 8 + size]


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed bytes, gzip members one after another, or the bytes themselves."""
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(content), step):
            yield content[i : i + step]
        return
    while content:
        d = zlib.decompressobj(31)
        while not d.eof:
            out = d.decompress(content, step)
            content = d.unconsumed_tail
            if not out and not content and not d.eof:
                raise ValueError("a gzip member is cut off")
            yield out
        content = d.unused_data


_RUN = "run string, seq long, page_id long, url string, key string, stamp string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(spark, path: str) -> DataFrame:
    """One row for each record, archive by archive, in the archives' order. Raises if a payload has another digest than stated."""
    arrow_limits(spark)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                for seq, (h, block, _) in enumerate(records(inflate(content))):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"{name}: payload of record {seq} has digest {digest}, not {stated}")
                    else:
                        size, digest = int(head.rpartition(b"Content-Length: ")[2]), stated
                    rows.append((name, seq, _page(h["WARC-Record-ID"]), h["WARC-Target-URI"], None, h["WARC-Date"], size, digest, h["WARC-Type"], _page(h.get("WARC-Refers-To"))))
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _RUN.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _RUN).withColumn("key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: each step replays one path of the tournament, log2(k) comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = [r for r in runs if r], []
        self.at = [0] * len(self.runs)
        self.k = max(1, len(self.runs))
        self.losers = [-1] * self.k
        for r in range(len(self.runs)):
            self._replay(r)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; a run at its end goes last."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while True:
            w = self.losers[0]
            if self.at[w] >= len(self.runs[w]):
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._replay(w)


def merge_index(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of runs in global order of (key, stamp, page_id); runs is written already, so that its ranges can be sampled."""
    spark = runs.sparkSession
    arrow_limits(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), count_rows(runs) // MERGE_ROWS + 1)
    names = [c for c in runs.columns if c not in ("run", "seq")]
    order = [names.index(c) for c in ("key", "stamp", "page_id")]
    schema = runs.select(*names).schema
    types = [runs.schema[c].dataType for c in names]

    def merge(batches):
        pieces: dict[str, list[tuple]] = {}
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for run, _, *row in zip(*columns):
                sort_key = tuple((row[i] is not None, row[i]) if row[i] is not None else (False, 0) for i in order)
                pieces.setdefault(run, []).append((sort_key, len(pieces.get(run, ())), row))
        out: list[list] = []
        for _, _, row in LoserTree([pieces[r] for r in sorted(pieces)]):
            out.append(row)
            if len(out) >= 5000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(rows: list[list]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(x, kinds[t.simpleString()]) for x, t in zip(zip(*rows), types)], names=names)

    ranged = runs.select("run", "seq", *names).repartitionByRange(n, "key", "stamp", "page_id")
    return ranged.sortWithinPartitions("run", "seq").mapInArrow(merge, schema)


def archive_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Writes the archives (to path, or a folder in shared storage), reads them back and returns the merged capture index."""
    ws = Workspace(pages.sparkSession, "warc")
    path = path or ws.path("archives")
    mean = 4 * stored_bytes(pages.select("html")) // max(1, count_rows(pages))  # pages are stored at a fourth of their size at least
    most = min(mean, 8 << 20) + 600  # of a table whose size is not known the estimate may be far too large
    write_archives(captures(pages, min_bytes), path, records_per_file=min(20_000, ARCHIVE_BYTES // most))
    return merge_index(ws.table(read_archives(pages.sparkSession, path), "runs"))
