"""Legacy ARC archives to WARC files, and back from WARC files to records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import small_batches, tidy

#: Fields of a record's header line by format version; the URL comes first and the declared length last.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Payloads of at least so many bytes are revisits where an earlier record has the same.
LEAST_PAYLOAD = 0
#: Most records of one archive, ARC or WARC, and bytes with which it ends even before; a file is read by one task, which
#: holds it whole. A larger record is an archive of its own.
RECORDS_PER_FILE = 500
BYTES_PER_FILE = 16 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"
_LAST = (1 << 63) - 1

ARC_RECORD = (
    "archive string, offset long, version int, url string, ip string, date string, mime string, status int, "
    "id long, block binary, head_bytes long, payload_bytes long, payload_digest string, error string"
)
WARC_RECORD = (
    "record_id string, record_type string, date string, url string, payload_digest string, refers_to string, "
    "id long, payload_bytes long, error string"
)


def digest(payload: bytes) -> str:
    """SHA-1 in base 32, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_archive(name: str, records: list[tuple[str, str, str, str, bytes]], version: int = 1) -> bytes:
    """An ARC file of ``(url, ip, date, mime, block)`` records, headed by its ``filedesc`` record."""
    blank = ("200", "-", "-", "0", name) if version == 2 else ()
    body = f"{version} 0 -\n{' '.join(FIELDS[version])}\n\n".encode()
    out = []
    for url, ip, date, mime, block in [(f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", body), *records]:
        out += [" ".join((url, ip, date, mime, *blank, str(len(block)))).encode(), b"\n", block, b"\n"]
    return b"".join(out)


def archive_pages(pages: DataFrame, **columns) -> DataFrame:
    """``(archive, content)``: pages as ARC archives of a few hundred records, each an HTTP response with its page's id.

    White space in a URL is percent-encoded, a null or empty URL is ``-``, a null html an empty payload. ``columns``
    may name ``page_id``, ``url`` and ``html``, and the format ``version``.
    """
    return _page_rows(pages, **columns).mapInPandas(_builder(**columns), "archive string, content binary")


def _page_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", version: int = 1) -> DataFrame:
    return pages.select(F.col(page_id).cast("string").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))


def _cut(blocks: Iterator[bytes], size=len) -> Iterator[list]:
    """``blocks`` in runs of at most ``RECORDS_PER_FILE``, each of at most ``BYTES_PER_FILE`` or of one block."""
    run, held = [], 0
    for block in blocks:
        if run and (len(run) == RECORDS_PER_FILE or held + size(block) > BYTES_PER_FILE):
            yield run
            run, held = [], 0
        run.append(block)
        held += size(block)
    if run:
        yield run


def _builder(version: int = 1, **columns):
    def record(i, u, h) -> tuple[str, str, str, str, bytes]:
        payload = (h or "").encode("utf-8", "surrogatepass")
        own = "" if i is None or i != i else f"{ID_HEADER}: {int(i)}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n".encode()
        clean = "".join(f"%{ord(c):02X}" if c <= " " else c for c in u or "-")
        return clean, "127.0.0.1", "20240101000000", "text/html", head + payload

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        records = (record(*x) for b in batches for x in zip(b["id"], b["url"], b["html"], strict=True))
        for k, run in enumerate(_cut(records, lambda r: len(r[-1]))):
            name = f"pages-{part:06}-{k:06}.arc"
            yield pd.DataFrame({"archive": [name], "content": [arc_archive(name, run, version)]})

    return build


def _http(block: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the HTTP head, 0 where there is none, and its fields by lower-cased name."""
    if not block.startswith(b"HTTP/"):
        return 0, {}
    ends = [(block.find(mark), len(mark)) for mark in (b"\r\n\r\n", b"\n\n")]
    at = min(((p + n, p) for p, n in ends if p >= 0), default=None)
    if at is None:
        return len(block), {}
    fields = {}
    for line in block[: at[1]].decode("latin-1").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return at[0], fields


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text else None
    except ValueError:
        return None


def arc_records(archive: str, content: bytes) -> Iterator[tuple]:
    """The records of one ARC file, gzipped or not, as ``ARC_RECORD`` rows.

    The first record is the version block: the first word of its body is the format version, which decides how many
    fields a header line has (a URL may hold spaces, so fields are counted from the right). A record is as long as its
    header declares. A line that is no header, or a length beyond the end of the file, gives one row with ``error`` and
    ends the file, since the place of the next record is then unknown.
    """
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError) as e:
            yield (archive, 0, None, *[None] * 6, b"", 0, 0, None, f"not readable as gzip: {e}")
            return
    at, version = 0, None
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        start, stop = at, content.find(b"\n", at)
        line = content[at : stop if stop >= 0 else len(content)].decode("utf-8", "replace").strip("\r")
        names = FIELDS[version or (2 if len(line.split(" ")) >= len(FIELDS[2]) else 1)]
        values = line.rsplit(" ", len(names) - 1)
        length = _number(values[-1])
        bad = stop < 0 or len(values) < len(names) or length is None or length < 0
        if bad or stop + 1 + length > len(content):
            why = "header line not understood" if bad else f"{length} bytes declared, {len(content) - stop - 1} left"
            yield (archive, start, version, *[None] * 6, b"", 0, 0, None, f"{why}: {line[:200]}")
            return
        block = content[stop + 1 : stop + 1 + length]
        at = stop + 1 + length
        field = dict(zip(names, values, strict=True))
        if version is None:
            version = 2 if block.split(b" ", 1)[0].strip() == b"2" else 1
        head, http = _http(block)
        payload = block[head:]
        status = _number(field.get("status")) or _number(block[9:12].decode("latin-1") if head else None)
        yield (
            archive, start, version, field["url"], field["ip"], field["date"], field["mime"], status,
            _number(http.get(ID_HEADER.lower())), block, head, len(payload), digest(payload), None,
        )


def page_records(pages: DataFrame, **columns) -> DataFrame:
    """The records of ``archive_pages(pages)``, built and read in one pass of one Python worker per task."""
    small_batches(pages.sparkSession)
    build, parse = _builder(**columns), _reader()
    return _page_rows(pages, **columns).mapInPandas(tidy(lambda batches: parse(build(batches))), ARC_RECORD)


def read_arc(archives: DataFrame) -> DataFrame:
    """Records of ``archives(archive, content)``, such as ``binaryFile`` reads them; one file is one task's work."""
    return archives.select("archive", "content").mapInPandas(_reader(), ARC_RECORD)


def _reader():
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ARC_RECORD.split(", ")]
        for batch in batches:
            for name, content in zip(batch["archive"], batch["content"], strict=True):
                frame = pd.DataFrame(list(arc_records(name, content or b"")), columns=names, dtype=object)
                yield frame.astype({"version": "Int32", "status": "Int32", "id": "Int64"})

    return parse


def warc_date(date: str | None) -> str:
    """``YYYYMMDD[hh[mm[ss]]]`` as ``YYYY-MM-DDThh:mm:ssZ``; what is no such date becomes the first second of 1970."""
    d = date or ""
    if not (d.isascii() and d.isdigit() and 8 <= len(d) <= 14):
        return "1970-01-01T00:00:00Z"
    d = d.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(archive: str, offset: int, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {offset} {url}')}>"


def to_warc(records: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """WARC archives of the readable ARC records, one row ``value`` each (its bytes without the last line end).

    Identifiers are made from archive, offset and URL, so reruns agree. ``filedesc`` becomes ``warcinfo``, HTTP
    responses ``response`` (block with HTTP head), anything else ``resource``. Of responses with equal payloads of at
    least ``least_payload`` bytes, the one with the smallest id (then archive and offset; no id comes last) stays
    a response and the others become ``revisit`` records that name it and carry the HTTP head alone.

    Digests are grouped without blocks. Which record repeats which is then known by archive and offset, and with these
    it is joined to the blocks, so a payload that very many records have is no task's own.
    """
    sound = records.filter(F.col("error").isNull())
    place = F.struct(F.coalesce("id", F.lit(_LAST)).alias("id"), "archive", "offset", "url", "date")
    payloads = written(
        sound.filter((F.col("head_bytes") > 0) & (F.col("payload_bytes") >= least_payload)).select(
            "payload_digest", place.alias("place")
        ),
        "payloads",
    )
    first = written(
        payloads.groupBy("payload_digest")
        .agg(F.min("place").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(F.col("payload_digest").alias("digest"), "first"),
        "first-payloads",
    )
    repeats = written(
        payloads.join(first, F.col("payload_digest") == F.col("digest"))
        .filter(F.struct("place.archive", "place.offset") != F.struct("first.archive", "first.offset"))
        .select(
            F.col("place.archive").alias("own_archive"),
            F.col("place.offset").alias("own_offset"),
            F.col("first.archive").alias("first_archive"),
            F.col("first.offset").alias("first_offset"),
            F.col("first.url").alias("first_url"),
            F.col("first.date").alias("first_date"),
        ),
        "repeats",
    )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = (_warc_record(r) for batch in batches for r in batch.itertuples(index=False))
        for run in _cut(made):
            yield pd.DataFrame({"value": [b"".join(run)[:-1]]})

    own = (F.col("archive") == F.col("own_archive")) & (F.col("offset") == F.col("own_offset"))
    joined = sound.join(repeats, own, "left").drop("own_archive", "own_offset", "error")
    return joined.mapInPandas(tidy(build), "value binary").select(F.col("value").cast("string").alias("value"))


def _warc_record(r) -> bytes:
    block, more = r.block, []
    kind, mime = "resource", r.mime or "application/octet-stream"
    if (r.url or "").startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
        block = f"software: trustgrain\r\nformat: WARC File Format 1.1\r\ndescription: ARC {r.version} {r.archive}\r\n".encode()
    elif r.head_bytes:
        kind, mime = "response", "application/http; msgtype=response"
        if isinstance(r.first_archive, str):
            kind, block = "revisit", r.block[: int(r.head_bytes)]
            more = [
                ("WARC-Profile", REVISIT),
                ("WARC-Refers-To", record_id(r.first_archive, int(r.first_offset), r.first_url)),
                ("WARC-Refers-To-Target-URI", r.first_url),
                ("WARC-Refers-To-Date", warc_date(r.first_date)),
            ]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(r.archive, int(r.offset), r.url)),
        ("WARC-Date", warc_date(r.date)),
        *([] if kind == "warcinfo" else [("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip)]),
        *([] if kind == "warcinfo" else [("WARC-Payload-Digest", f"sha1:{r.payload_digest}")]),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *more,
        ("Content-Type", mime),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def write_warc(values: DataFrame, path: str, archives_per_file: int = 1) -> None:
    """Write the archives of ``to_warc`` as WARC files; Spark's writer adds the last line end of each.

    A file is gzipped as a whole, as Spark's writer does, so its records are read in order and not by their offset.
    """
    values.write.option("compression", "gzip").option("maxRecordsPerFile", archives_per_file).text(path)


def warc_records(content: bytes) -> Iterator[tuple]:
    """The records of one WARC file, gzipped or not, as ``WARC_RECORD`` rows; lengths are as declared.

    The digest of a response's payload is computed anew, and a difference from the declared one is an ``error``. After
    a header that is not understood, the rest of the file is one row with an ``error``.
    """
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError) as e:
            yield (*[None] * 8, f"not readable as gzip: {e}")
            return
    at = 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = content.find(b"\r\n\r\n", at)
        lines = content[at : max(stop, at)].decode("utf-8", "surrogatepass").split("\r\n")
        field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = _number(field.get("content-length"))
        if not lines[0].startswith("WARC/") or length is None or stop + 4 + length > len(content):
            yield (*[None] * 8, f"no record at byte {at}")
            return
        block = content[stop + 4 : stop + 4 + length]
        at = stop + 4 + length
        kind = field.get("warc-type")
        declared = (field.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        head, http = _http(block)
        payload = None if kind == "revisit" else block[head:]
        wrong = payload is not None and declared and digest(payload) != declared
        yield (
            field.get("warc-record-id"), kind, field.get("warc-date"), field.get("warc-target-uri"), declared,
            field.get("warc-refers-to"), _number(http.get(ID_HEADER.lower())),
            None if payload is None else len(payload), "payload digest differs" if wrong else None,
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files in a folder. Revisits have no payload of their own; see ``resolve_revisits``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WARC_RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                frame = pd.DataFrame(list(warc_records(content)), columns=names, dtype=object)
                yield frame.astype({"id": "Int64", "payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(tidy(parse), WARC_RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``payload_bytes`` of revisits taken from the response they refer to, and its id as
    ``refers_to_id``. Only revisits are joined; the records, which have no payloads, are written once."""
    records = written(records, "warc-records")
    rest = [c for c in records.columns if c != "payload_bytes"]
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("response"), F.col("id").alias("refers_to_id"), F.col("payload_bytes").alias("of_response")
    )
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    resolved = records.filter(revisit).join(responses, F.col("refers_to") == F.col("response"), "left")
    others = records.filter(~revisit).select(*rest, "payload_bytes", F.lit(None).cast("long").alias("refers_to_id"))
    return others.union(resolved.select(*rest, F.coalesce("payload_bytes", "of_response").alias("payload_bytes"), "refers_to_id"))
