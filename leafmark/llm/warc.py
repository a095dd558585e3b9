"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import cut, join_checked, shared_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
READ = "path string, kind string, start long, end long, reason string, record_id string, record_type string, target_uri string, refers_to string, header_digest string, payload_digest string, payload_bytes long, payload binary"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:leafmark:page:{'null' if page_id is None else page_id}>"


def page_of(column):
    """The page_id of a record id column."""
    return F.regexp_extract(column, r"^<urn:leafmark:page:(-?\d+)>$", 1).try_cast("long")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One uncompressed record: an HTTP response, or a revisit that has the response's header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() if refers_to is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []),
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, to: str | None = None, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write a record for each (page_id, url, html) row, gzip member by member; return the manifest (path, records, bytes).

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of at least `min_bytes` bytes, that with
    the largest page_id is a response and the others revisit it; of rows that repeat that page_id, which are brought
    together, that with the largest url (of equal ones an arbitrary one) is the response. If all their ids are null, all
    are responses. Null urls leave out the target. An empty table gives an empty manifest. Extra
    columns are ignored.

    Every task writes a file of its own into `to` (default: the shared folder), under a name of that attempt; only
    files of attempts that succeeded are in the manifest, so lost executors leave unlisted files and no torn ones.
    Payloads aren't shuffled unless the table of repeated digests is too large to broadcast.
    """
    spark = pages.sparkSession
    to = to or shared_path(spark, "warc")
    need = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    per_id = need.where(F.octet_length("html") >= min_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    again = cut(
        per_id.groupBy("digest").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", F.col("n").alias("rows"))).alias("best"))
        .where("n > 1 and best.page_id is not null").select("digest", F.col("best.page_id").alias("best"), F.col("best.rows").alias("rows"))
    )
    joined = join_checked(need, again, ["digest"], "left")
    own = F.coalesce(F.col("best") == F.col("page_id"), F.lit(False))
    marked = joined.withColumn("refers", F.when(F.col("best").isNull() | own | (F.octet_length("html") < min_bytes), F.lit(None)).otherwise(F.col("best")))
    if not again.where("rows > 1").isEmpty():
        repeated = own & F.coalesce(F.col("rows") > 1, F.lit(False))
        nth = F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("url")))
        marked = marked.where(~repeated).unionByName(marked.where(repeated).withColumn("refers", F.when(nth > 1, F.col("best"))))
    marked = marked.select("page_id", "url", "digest", "refers", F.when(F.col("refers").isNull(), F.col("html")).alias("html"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = pafs.FileSystem.from_uri(to)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n, size = None, 0, 0
        for f in batches:
            for page, url, digest, refers, html in zip(f["page_id"], f["url"], f["digest"], f["refers"], f["html"], strict=True):
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)  # members are compressed one by one already
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                raw = make_record(page, url if isinstance(url, str) else None, payload, base64.b32encode(digest).decode(), None if refers is None else record_id(refers))
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(raw) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{to}/{name}"], "records": [n], "bytes": [size]})

    return cut(marked.mapInPandas(write, "path string, records long, bytes long"))


class _Source:
    """A window on a file that moves forward: holds what lies between the reading position and what was asked for.

    Bytes that were forgotten are read again from a file that can be sought; those of others are never forgotten.
    """

    def __init__(self, file, chunk: int = 1 << 20):
        self.file, self.chunk, self.data, self.base, self.ended = file, chunk, bytearray(), 0, False
        self.seeks = file.seekable()

    def fill(self, to: int) -> bool:
        """Have bytes up to offset `to`, if the file has them."""
        while self.base + len(self.data) < to and not self.ended:
            more = self.file.read(max(self.chunk, to - self.base - len(self.data)))
            self.ended = not more
            self.data += more
        return self.base + len(self.data) >= to

    def forget(self, to: int) -> None:
        if self.seeks and to > self.base:
            del self.data[: to - self.base]
            self.base = to

    def get(self, a: int, b: int) -> bytes:
        if a < self.base:
            self.file.seek(a)
            self.data, self.base, self.ended = bytearray(), a, False
        self.fill(b)
        return bytes(self.data[a - self.base : b - self.base])

    def end(self) -> int:
        return self.base + len(self.data)

    def find(self, patterns: tuple[bytes, ...], at: int) -> int:
        """The first offset from `at` on where one of the patterns stands; the file's end if there is none."""
        self.get(at, at + 1)
        while True:
            self.fill(at + self.chunk)
            found = [x for x in (self.data.find(p, at - self.base) for p in patterns) if x >= 0]
            if found:
                return self.base + min(found)
            if self.ended:
                return self.end()
            at = max(at, self.end() - max(map(len, patterns)))
            self.forget(at)


class _Inflating:
    """The first `size` bytes that the gzip member at `at` inflates to, as a file."""

    def __init__(self, src: _Source, at: int, size: int):
        self.src, self.start, self.size = src, at, size
        self.seek(0)

    def seekable(self) -> bool:
        return True

    def seek(self, to: int) -> None:
        self.z, self.at, self.given, self.rest = zlib.decompressobj(31), self.start, 0, b""
        while self.given < to and self.read(min(1 << 20, to - self.given)):
            pass

    def read(self, n: int) -> bytes:
        out, n = [], min(n, self.size - self.given)
        while n > 0:
            if not self.rest:
                self.rest = self.src.get(self.at, self.at + (1 << 16))
                self.at += len(self.rest)
                self.src.forget(self.at)
            piece, self.rest = self.rest, b""
            got, self.z = _inflated(self.z, piece, n)
            self.rest = self.z.unconsumed_tail
            if not got and (self.z.eof or not piece):
                break
            out.append(got)
            n, self.given = n - len(got), self.given + len(got)
        return b"".join(out)


def _inflated(z, piece: bytes, most: int) -> tuple:
    """What a piece inflates to, and the inflater after it; up to its first bad byte if it has one, found by halves, since a failed call gives nothing."""
    before = z.copy()
    try:
        return z.decompress(piece, most), z
    except zlib.error:
        good, bad = 0, len(piece)
        while bad - good > 1:
            try:
                before.copy().decompress(piece[: (middle := (good + bad) // 2)])
                good = middle
            except zlib.error:
                bad = middle
        return before.decompress(piece[:good], most), before


class _Bad(Exception):
    pass


def _fields(head: bytes) -> dict[str, str]:
    if not head.startswith(VERSION):
        raise _Bad("no version line")
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise _Bad("header line without colon")
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise _Bad("no content length")
    return fields


def _record(src: _Source, at: int, most: int) -> tuple[int, dict[str, str], bytes | None, str | None, int]:
    """End, fields, payload, its digest and length of the record at `at`, all checks passed.

    A block of more than `most` bytes is read piece by piece for its digests, and its payload is None. A revisit has
    no payload, and the digest that it states.
    """
    size = 1 << 12
    while (head := (raw := src.get(at, at + size)).find(b"\r\n\r\n")) < 0:
        if not raw.startswith(VERSION[: len(raw)]):
            raise _Bad("no version line")
        if len(raw) < size or size > most:
            raise _Bad("header not ended")
        size *= 4
    fields = _fields(raw[:head])
    begin, n = at + head + 4, int(fields["content-length"])
    http = fields.get("content-type", "").startswith("application/http")
    if n <= most:
        block = src.get(begin, begin + n)
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        length, of_block, of_payload, read = len(payload), digest32(block), digest32(payload), len(block)
    else:
        payload, block_sha, payload_sha, length, read = None, hashlib.sha1(), hashlib.sha1(), 0, 0
        opening = b"" if http else None  # what stands before the payload, as far as read
        while read < n and (piece := src.get(begin + read, begin + min(n, read + (1 << 20)))):
            block_sha.update(piece)
            read += len(piece)
            if opening is not None:
                opening += piece
                if (cut_at := opening.find(b"\r\n\r\n")) < 0:
                    continue
                piece, opening = opening[cut_at + 4 :], None
            payload_sha.update(piece)
            length += len(piece)
            src.forget(begin + read)
        of_block, of_payload = (base64.b32encode(x.digest()).decode() for x in (block_sha, payload_sha))
    if read < n or src.get(begin + n, begin + n + 4) != b"\r\n\r\n":
        raise _Bad("block shorter or longer than its content length")
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != of_block:
        raise _Bad("block digest differs")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if fields.get("warc-type") == "revisit":
        return begin + n + 4, fields, b"", stated, 0
    if stated is not None and stated != of_payload:
        raise _Bad("payload digest differs")
    return begin + n + 4, fields, payload, of_payload, length


#: A member that inflates to no more is inflated once and held; of a larger one the records are read in a second pass.
HELD = 1 << 23


def _member(src: _Source, at: int) -> tuple[bytes | None, int, int, str]:
    """What the gzip member at `at` inflates to (None: more than HELD), how many bytes, where it ends (or reading stopped), and what is wrong with it, if anything."""
    z, out, size, start = zlib.decompressobj(31), [], 0, b""
    while not z.eof:
        piece = src.get(at, at + (1 << 16))
        if not piece:
            return (b"".join(out) if out is not None else None), size, at, "gzip member not ended"
        before = z.copy()
        try:
            got, wrong = z.decompress(piece), ""
        except zlib.error as e:
            got, wrong = _inflated(before, piece, 0)[0], f"gzip: {str(e)[:60]}"
        size += len(got)
        start = (start + got)[:7] if len(start) < 7 else start
        out = None if out is None or size > HELD else [*out, got]
        if not start.startswith(VERSION[: len(start)]):
            return b"", 0, at, "gzip member without a version line"
        if wrong:
            return (b"".join(out) if out is not None else None), size, at, wrong
        at += len(piece) - len(z.unused_data)
        if size > HELD:
            src.forget(at)
    return (b"".join(out) if out is not None else None), size, at, ""


def _within(src: _Source, sound: bool, most: int) -> Iterator[tuple]:
    """Records of an inflated member, as they end, and the stretches between: (fields, payload, digest, length) or (begin, end, reason).

    In a member that is damaged only records that state a block digest which holds are taken.
    """
    at, bad, why = 0, None, ""
    while src.get(at, at + 1):
        try:
            end, fields, payload, digest, length = _record(src, at, most)
            if not sound and not fields.get("warc-block-digest", "").startswith("sha1:"):
                raise _Bad("no block digest in a damaged member")
        except _Bad as e:
            if bad is None:
                bad, why = at, str(e)
            at = src.find((VERSION,), at + 1)
            continue
        if bad is not None:
            yield bad, at, why
            bad = None
        yield fields, payload, digest, length
        at = end
        src.forget(at)
    if bad is not None:
        yield bad, at, why


def salvage(file, most: int = 1 << 30) -> Iterator[tuple]:
    """('record', start, end, fields, payload, digest, length) and ('gap', start, end, reason) of a file, in order, covering it.

    A record is whole only if its gzip member inflates (or its plain form is all there), its header parses, its block
    has the stated length and its digests hold. Otherwise the bytes from there to the next offset at which a gzip
    magic or a version line starts a whole record are one gap. A member may hold several records: they have its start
    and end, and so has a gap for each stretch in it that is no whole record, which tells its place in the inflated
    bytes. Of a member that fails, whole records before the damage whose digests hold are given, with an empty range at
    its start, and it is a gap all the same.

    Members and files may have any size: records are read one at a time, and no more is held than a record and a member
    of up to HELD bytes (of a file that can't be sought, also the compressed bytes of a member). Of a record of more
    than `most` bytes the payload isn't held: it is None, its digests are checked all the same, and its digest and
    length are given. A header of more than `most` bytes is a gap.
    """
    src, at, bad, why = _Source(file), 0, None, ""
    while src.get(at, at + 1):
        src.forget(at)
        first, found, end, wrong = src.get(at, at + 7), iter(()), at, ""
        if first.startswith(GZIP):
            raw, size, end, wrong = _member(src, at)
            found = _within(_Source(_Inflating(src, at, size) if raw is None else io.BytesIO(raw)), not wrong, most)
            early = []  # gaps before the first record
            for x in found if not wrong else ():
                early.append(x)
                if isinstance(x[0], dict):
                    break
            if not wrong and not any(isinstance(x[0], dict) for x in early):
                wrong = early[0][2] if early else "empty gzip member"
            found = chain(early, found)
        elif first.startswith(VERSION):
            try:
                end, *record = _record(src, at, most)
                found = iter([tuple(record)])
            except _Bad as e:
                wrong = str(e)
        else:
            wrong = "neither a gzip member nor a version line"
        if wrong:
            if bad is None:
                bad, why = at, wrong
            for x in found:
                if isinstance(x[0], dict):
                    yield "record", at, at, *x
            at = src.find((GZIP, VERSION), at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        for x in found:
            if isinstance(x[0], dict):
                yield "record", at, end, *x
            else:
                yield "gap", at, end, f"inflated {x[0]}-{x[1]}: {x[2]}"
        at = end
    if bad is not None:
        yield "gap", bad, at, why


def read_archives(manifest: DataFrame, payload: bool = True, max_record_bytes: int = 1 << 30) -> DataFrame:
    """Every record and every quarantined gap of the files in manifest's `path` column (kind: record or gap).

    Files are streamed, each in one task, one record at a time (see salvage(): of a record of more than
    `max_record_bytes` the payload is null, its digest and length are given). After a failed check the reader goes on at the
    next valid gzip member or version line; the bytes between are a gap row with its reason. An unreadable file is one
    gap row from 0 to 0. Empty files and manifests give no rows; null paths are skipped; a path listed twice is read twice.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for f in batches:
            for path in f["path"]:
                if not isinstance(path, str):
                    continue
                try:
                    fs, at = pafs.FileSystem.from_uri(path)
                    with fs.open_input_file(at) as file:
                        for x in salvage(file, max_record_bytes):
                            if x[0] == "gap":
                                rows.append((path, *x, *[None] * 8))
                            else:
                                _, a, b, h, data, digest, length = x
                                rows.append((path, "record", a, b, None, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, digest, length if h.get("warc-type") != "revisit" else None, data if payload else None))
                                size += len(data or b"") if payload else 200
                            if size > 8 << 20:
                                yield _rows(rows)
                                rows, size = [], 0
                except (OSError, FileNotFoundError) as e:
                    rows.append((path, "gap", 0, 0, f"unreadable: {str(e)[:80]}", *[None] * 8))
        if rows:
            yield _rows(rows)

    return manifest.select("path").mapInPandas(run, READ)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])
    f["payload_bytes"] = f["payload_bytes"].astype("Int64")
    return f
