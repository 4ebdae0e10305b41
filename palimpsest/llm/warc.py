"""WARC archives: a writer with identical-payload revisits, and a salvage reader.

Writer: a record is one gzip member. Spark's text sink writes the members as they are, with an empty member (a fixed one, which
inflates to nothing) as its line end, so archives go wherever Spark can write, and a lost task is simply written again.

Reader: it walks an archive member by member, or record by record where it isn't compressed. Each must pass its checks: gzip's
own sums, a version line, header syntax, a length that ends in two line ends, and the digests the header names. Where one fails, the reader
looks for the next byte at which a member or version line begins a record that passes, goes on there, and logs the bytes between.
Within a damaged stretch of an archive that isn't compressed, a record that a payload embeds is one that passes, and is given as such.
The same search runs on a member's inflated bytes, as they come, so a failed record costs only itself. Of a member that doesn't inflate to
its end, what came before counts, but not the record that inflating stops in or at; after an error in it, only records with a block digest do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.storage import written

#: gzip of nothing, without a time: a fixed value of the format
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300000000000000 0000".replace(" ", ""))
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive, and the most that a record may inflate to: Spark and Arrow have no larger values.
ARCHIVE_BYTES = 64 << 20
RECORD_BYTES = (1 << 31) - 1
#: Bytes of a member that are inflated at once, first and at most.
FIRST_PIECE, PIECE = 1 << 13, 1 << 20

RECORD_FIELDS = (
    "archive string, offset bigint, length bigint, gap string, record_type string, record_id string, uri string, "
    "payload_digest string, refers_to string, payload_bytes bigint, payload binary"
)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str | None, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One gzip member. A revisit holds the response's HTTP head without its body; control characters in the URI are escaped."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{_sha1(block)}",
    ]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class Damaged(Exception):
    """A failed check. resume: no version line that begins before that place can begin a record, as it would run into the same fault."""

    def __init__(self, what: str, resume: int = 0) -> None:
        super().__init__(what)
        self.resume = resume


class Short(Damaged):
    """More bytes could still make the record whole."""


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record that begins at `at`; Damaged if a check fails."""
    if not _VERSION.match(data, at):
        raise (Damaged if len(data) - at >= 10 else Short)("no version line")
    header: dict[str, str] = {}
    begin = data.find(b"\r\n", at) + 2
    while True:  # line by line, as the end of the header may be far behind the first line that can't belong to one
        stop = data.find(b"\r\n", begin)
        if stop < 0:
            raise Short("header without end", len(data))
        if stop == begin:
            break
        name, colon, value = data[begin:stop].partition(b":")
        if not colon or not name.strip():
            raise Damaged("header syntax", begin)
        header[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        begin = stop + 2
    size = header.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise Damaged("no length", stop if not size else 0)
    begin, end = stop + 2, stop + 2 + int(size)
    if end + 4 > len(data):
        raise Short("length does not end the record")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not end the record")
    block = data[begin:end]
    digest = header.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != _sha1(block):
        raise Damaged("block digest")
    return header, block, end + 4


class _Member:
    """The inflated bytes of the member at `at`, bit by bit. Once done: size, end (of its bytes in data) and error, if any.

    Pieces of the archive begin small and grow, as an archive of many small members would else be copied over and over.
    """

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.inflater, self.piece = data, at, zlib.decompressobj(31), FIRST_PIECE
        self.end, self.size, self.done, self.error = at, 0, False, ""

    def more(self, want: int) -> bytes:
        out: list[bytes] = []
        got = 0
        while got < want and not self.done:
            feed = self.inflater.unconsumed_tail
            if not feed:
                feed = self.data[self.end : self.end + self.piece]
                self.end += len(feed)
                self.piece = min(4 * self.piece, PIECE)
            try:
                part = self.inflater.decompress(feed, want - got)
            except zlib.error:
                self.done, self.error, part = True, "gzip member", self._until_error(self.size + got)
            if self.inflater.eof and not self.error:
                self.done = True
                self.end -= len(self.inflater.unused_data)
            elif not feed and not part:
                self.done, self.error = True, "gzip member without end"
            out.append(part)
            got += len(part)
        self.size += got
        return b"".join(out)

    def _until_error(self, known: int) -> bytes:
        """The inflated bytes after the first `known` ones, up to the error: the member is inflated anew, byte by byte where it fails."""
        inflater, out, at = zlib.decompressobj(31), [], self.at
        step = FIRST_PIECE
        while at < len(self.data):
            before = inflater.copy() if step > 1 else inflater
            try:
                out.append(inflater.decompress(self.data[at : at + step]))
            except zlib.error:
                if step == 1:
                    break
                inflater, step = before, 1
                continue
            at += step
        self.end = at
        return b"".join(out)[known:]


def _inside(member: _Member, buf: bytes, most: int) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(begin, end, None, header, block) of records and (begin, end, reason, {}, b"") of gaps in the member's inflated bytes, buf first."""
    base = place = 0
    gap, reason = -1, ""
    while place < len(buf) or not member.done:
        if place >= len(buf):
            base, buf, place = base + len(buf), member.more(PIECE), 0
            continue
        try:
            header, block, end = _parse(buf, place)
            if end - place > most:
                raise Damaged("record too long")
        except Damaged as e:
            held = len(buf) - place
            if isinstance(e, Short) and not member.done and held < most:
                base, buf, place = base + place, buf[place:] + member.more(max(held, PIECE)), 0
                continue
            if gap < 0:
                gap, reason = base + place, str(e)
            # What is short of an end may get one with more bytes.
            m = _VERSION.search(buf, max(place + 1, e.resume if member.done or not isinstance(e, Short) else 0))
            if m:
                place = m.start()
            elif member.done:
                place = len(buf)
            else:  # a version line may begin in the last bytes
                keep = max(place + 1, len(buf) - 9)
                base, buf, place = base + keep, buf[keep:] + member.more(PIECE), 0
            continue
        if gap >= 0:
            yield gap, base + place, reason, {}, b""
            gap = -1
        yield base + place, base + end, None, header, block
        place = end
    if gap >= 0:
        yield gap, base + len(buf), reason, {}, b""


def _records_at(data: bytes, at: int, most: int) -> tuple[Iterator[tuple[str | None, dict[str, str], bytes]], int, str]:
    """Records and inner gaps of the member, or the plain record, that begins at `at`, where it ends, and why it does too soon."""
    if not data.startswith(_MAGIC, at):
        header, block, end = _parse(data, at)
        return iter([(None, header, block)]), end, ""
    member = whole = _Member(data, at)
    first = member.more(PIECE)
    if not member.done:  # its end must be known before its records are given
        whole = _Member(data, at)
        while not whole.done:
            whole.more(PIECE)

    def found() -> Iterator[tuple[str | None, dict[str, str], bytes]]:
        for begin, end, why, header, block in _inside(member, first, most):
            proved = whole.error != "gzip member" or header.get("warc-block-digest", "").startswith("sha1:")
            if why is None and whole.error and (end >= whole.size or not proved):
                why = whole.error
            yield (None, header, block) if why is None else (f"{why}, inflated bytes {begin}-{end} of the member at {at}", {}, b"")

    return found(), whole.end, whole.error


def salvage(data: bytes, most: int = RECORD_BYTES) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, length, None, header, block) of each record, and (offset, length, reason, {}, b"") of each gap, in order.

    Gaps inside a member have the member's offset and length, and the range of inflated bytes in their reason.
    """
    at, gap, reason = 0, -1, ""
    resume = 0  # version lines before it fail, members may not
    taken = 0  # end of what broken members gave; before it only members are looked for
    while at < len(data):
        given, failed, waiting = False, "", []
        try:
            found, end, error = _records_at(data, at, most)
            for why, header, block in found:
                row = (at, end - at, why, header, block)
                if why is not None and not given:
                    waiting.append(row)
                    continue
                if not given:
                    if gap >= 0:
                        yield gap, at - gap, reason, {}, b""
                        gap = -1
                    yield from waiting
                    given = True
                yield row
            if not given:
                failed = error or (waiting[0][2].partition(", inflated")[0] if waiting else "")
        except Damaged as e:
            failed, error, end, resume = str(e), "", at, max(resume, e.resume)
        if not failed and not error:  # an empty member alone doesn't prove that the reader is in step again
            at = end
            continue
        if given:
            taken, gap, reason = end, end, error
        elif gap < 0:
            gap, reason = max(at, taken), failed
        m = re.compile(re.escape(_MAGIC)).search(data, at + 1, taken) or _START.search(data, max(at + 1, taken))
        while m and m.start() < resume and m[0] != _MAGIC:
            m = _START.search(data, m.start() + 1)
        at = m.start() if m else len(data)
        if given and at <= gap:
            gap = -1
    if 0 <= gap < len(data):
        yield gap, len(data) - gap, reason, {}, b""


def _body(block: bytes) -> tuple[bytes, int | None]:
    """What follows the HTTP head, and the length that the head states."""
    head, found, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", head) if found else None
    return (body if found else block), (int(m[1]) if m else None)


def _urn(value: str | None) -> str | None:
    m = re.fullmatch(r"<(?:urn:page:)?(.*)>", value or "")
    return (m[1] or None) if m else value


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Writes a record per row to gzip archives of about archive_bytes of payload under path.

    Of rows with equal payloads (UTF-8; null is empty) of at least min_revisit_bytes, those with the smallest id are responses, all
    others revisits of it; null ids count as larger than all others, and rows that share the smallest id are all responses.
    Smaller payloads are always responses. Null URLs have no target. Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    read = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    keyed = read.withColumn("_digest", F.unhex(F.sha1("_payload")))
    shared = keyed.where(F.length("_payload") >= min_revisit_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Only payloads seen more than once; written, so that both sides of the join are tables whose hot digests AQE can split.
    repeats = written(shared.where("_n > 1").select("_digest", "_first"))
    joined = keyed.join(repeats, "_digest", "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_id")), F.col("_first"))
    mean = read.agg(F.avg(F.length("_payload"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True)
                text = lambda x: None if x is None else str(x)
                out = [record(text(i), url, body, text(r), date) for i, url, body, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = joined.select("_id", "_url", "_payload", refers.alias("_refers")).mapInArrow(run, "member binary")
    (
        members.select(F.col("member").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", max(1, int(archive_bytes / max(1.0, mean))))
        .text(path)
    )


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, most: int = RECORD_BYTES) -> DataFrame:
    """A row for each record and each quarantined gap of the archives under path.

    Records: archive, offset, length (bytes of its member), record_type, record_id and refers_to (without brackets), uri,
    payload_digest, payload_bytes (of the full payload, also for revisits) and payload (null for revisits). Gaps: archive, offset, length
    and gap, the reason of the first failed check; all else null. Empty archives give no rows. A record that inflates to more than
    `most` bytes is quarantined. An archive is held by one task, so archives should be of bounded size, as write_warc's are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
        kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in RECORD_FIELDS.split(", ")]
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for offset, length, gap, header, block in salvage(content.as_py() or b"", most):
                    row: tuple = (archive.as_py(), offset, length, gap)
                    if gap is None:
                        body, stated = _body(block)
                        kind, digest = header.get("warc-type"), header.get("warc-payload-digest", "")
                        whole = kind != "revisit"
                        named = digest[5:] if digest.startswith("sha1:") else (_sha1(body) if whole else None)
                        if whole and named != _sha1(body):
                            row = (archive.as_py(), offset, length, "payload digest", *[None] * 7)
                        else:
                            row += (kind, _urn(header.get("warc-record-id")), header.get("warc-target-uri"), named, _urn(header.get("warc-refers-to")))
                            row += (len(body) if whole else stated, body if whole and with_payload else None)
                            held += len(body)
                    else:
                        row += (None,) * 7
                    rows.append(row)
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = spark.read.format("binaryFile").load(path).where("length > 0")
    return found.select("path", "content").mapInArrow(run, RECORD_FIELDS)
