"""WARC archives: captured as one gzip stream a file, normalised to a member a record with an offset index, and read by it."""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.tables import in_batches
from variorum.session import scratch_folder, stage

#: Bytes of records, before compression, after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
#: Bytes that are read at once.
CHUNK = 1 << 20
LEVEL = 6
#: Rows that are handed on at once.
BLOCK_ROWS = 4096
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: Date of captures whose table has none.
DATE = "1970-01-01T00:00:00Z"
#: A revisit of a record with an equal payload (a fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURED = "archive string, ordinal long, page_id long, record_id string, payload_key string"
NORMALISED = "archive string, index string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# ---- records -------------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def head(fields: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + "".join(f"{name}: {held}\r\n" for name, held in fields).encode() + b"\r\n"


def response(record_id: str, url: str | None, payload: bytes, date: str = DATE) -> bytes:
    """A whole record, its end included. What may not stand in a header line of an address is percent-encoded."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload)
    ) + END
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        safe = "".join(map(chr, range(0x21, 0x7F)))
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe=safe)))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + len(payload))),
    ]
    return head(fields) + http + payload + END


def revisit(fields: list[tuple[str, str]], block: bytes, refers_to: str) -> bytes:
    """The same capture without its payload, which the record `refers_to` has."""
    http = block[: block.index(END) + len(END)]
    kept = [(name, held) for name, held in fields if name not in ("WARC-Type", "Content-Length")]
    kept = [
        ("WARC-Type", "revisit"), *kept, ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE),
        ("Content-Length", str(len(http))),
    ]
    return head(kept) + http + END


def id_of(page_id: int | None, archive: str, ordinal: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{archive}:{ordinal}"


def page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


class Stream:
    """Bytes of a gzip file, of one member or many, inflated as they are asked for."""

    def __init__(self, file) -> None:
        self.file, self.held, self.inflate, self.over = file, bytearray(), zlib.decompressobj(31), False

    def more(self) -> bool:
        while not self.over:
            data = self.inflate.unused_data if self.inflate.eof else self.file.read(CHUNK)
            if not data and self.inflate.eof:
                data = self.file.read(CHUNK)
            if not data:
                self.over = True
                if not self.inflate.eof:
                    raise EOFError("archive ends inside a gzip member")
                break
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            if found := self.inflate.decompress(data):
                self.held += found
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to `mark`, which is taken too; None at the end of the file."""
        looked = 0
        while (at := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise EOFError("archive ends inside a record")
                return None
        found = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise EOFError("archive ends inside a record")
        found = bytes(self.held[:n])
        del self.held[:n]
        return found


def records(file) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header fields, block) of each record of a gzipped archive; one record is held at a time."""
    stream = Stream(file)
    while (lines := stream.until(END)) is not None:
        first, *rest = lines.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        fields = [(name, held.strip()) for name, _, held in (line.partition(":") for line in rest)]
        block = stream.take(int(dict(fields)["Content-Length"]))
        stream.take(len(END))
        yield fields, block


# ---- archives ------------------------------------------------------------------------------------------


def opened(path: str, write: bool = False):
    """A file in the shared folder: a local one, or one of a store that Arrow knows."""
    system, place = fs.FileSystem.from_uri(path)
    if not write:
        return system.open_input_file(place)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place, compression=None)  # not by the name


def capture(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a response record for each row, into archives that are one gzip stream each; CAPTURED tells what stands where.

    A null html is an empty payload, a null url leaves the address out. Stage the result: it writes as it is
    read. A task that is run again writes files of new names, and only those of the attempt that was
    committed are named in it.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    )

    def make():
        now: dict = {}

        def close() -> None:
            if now:
                now["file"].write(now["gzip"].flush())
                now["file"].close()
                now.clear()

        def work(batch: pa.RecordBatch | None) -> Iterator[list]:
            if batch is None:
                close()
                return
            out = []
            for page, url, html in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
                if not now:
                    name = uuid.uuid4().hex
                    path = f"{folder}/{name}.warc.gz"
                    now.update(
                        name=name, path=path, file=opened(path, True), size=0, n=0,
                        gzip=zlib.compressobj(LEVEL, zlib.DEFLATED, 31),
                    )
                payload = html.as_py()
                record_id = id_of(page.as_py(), now["name"], now["n"])
                whole = response(record_id, url.as_py(), payload)
                now["file"].write(now["gzip"].compress(whole))
                out.append((now["path"], now["n"], page.as_py(), record_id, hashlib.sha256(payload).hexdigest()))
                now["n"] += 1
                now["size"] += len(whole)
                if now["size"] >= archive_bytes:
                    close()
            yield list(map(list, zip(*out)))

        return work

    return in_batches(rows, CAPTURED, make, last=True)


def repeats(captured: DataFrame) -> DataFrame:
    """archive, ordinal, refers_to (a record id) of each record whose payload another one keeps.

    Of equal payloads the record with the largest page_id keeps it, a null one being the smallest; of records
    under one id exactly one does. Groups are reduced before the shuffle, so a common payload is one row by then.
    """
    keeper = F.max(F.struct("page_id", "archive", "ordinal", "record_id")).alias("keeper")
    groups = captured.groupBy("payload_key").agg(keeper, F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return (
        captured.join(groups, "payload_key")
        .filter("record_id <> keeper.record_id")
        .select("archive", "ordinal", F.col("keeper.record_id").alias("refers_to"))
    )


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Inflate each archive once and write its records again, a gzip member each, with an index beside; NORMALISED.

    `archives` has the column archive, and may have `repeats`, an array of (ordinal, refers_to): these records
    become revisits. Archives of one stream or of many are read alike. The index has a line for each
    record: offset, length, type, record id. Stage the result, see `capture`.
    """
    if "repeats" not in archives.columns:
        archives = archives.withColumn("repeats", F.lit(None).cast("array<struct<ordinal:long,refers_to:string>>"))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for archive, listed in zip(batch.column(0).to_pylist(), batch.column(1)):
                known = {r["ordinal"]: r["refers_to"] for r in listed.as_py() or ()}
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                offset = n = 0
                with opened(archive) as source, opened(path, True) as out, opened(f"{path}.idx", True) as index:
                    for n, (fields, block) in enumerate(records(source), 1):
                        named = dict(fields)
                        kind, refers_to = named["WARC-Type"], known.get(n - 1)
                        if refers_to is not None:
                            kind, whole = "revisit", revisit(fields, block, refers_to)
                        else:
                            whole = head(fields) + block + END
                        gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gzip.compress(whole) + gzip.flush()
                        out.write(member)
                        index.write(f"{offset}\t{len(member)}\t{kind}\t{named['WARC-Record-ID']}\n".encode())
                        offset += len(member)
                yield [[path], [f"{path}.idx"], [n]]

        return work

    return in_batches(archives.select("archive", "repeats"), NORMALISED, make)


def index_lines(path: str) -> Iterator[tuple[int, int, str, str]]:
    """(offset, length, type, record id) of each record in a sidecar index."""
    held = b""
    with opened(path) as file:
        while data := file.read(CHUNK):
            *lines, held = (held + data).split(b"\n")
            for line in lines:
                offset, length, kind, record_id = line.decode().split("\t")
                yield int(offset), int(length), kind, record_id


def read_member(file, offset: int, length: int) -> tuple[list[tuple[str, str]], bytes]:
    """One record of a normalised archive, by its place."""
    file.seek(offset)
    whole = zlib.decompress(file.read(length), 31)
    lines, _, rest = whole.partition(END)
    fields = [(n, held.strip()) for n, _, held in (line.partition(":") for line in lines.decode().split("\r\n")[1:])]
    return fields, rest[: int(dict(fields)["Content-Length"])]


def read_records(normalised: DataFrame) -> DataFrame:
    """RECORDS of normalised archives, each read at its place in the index.

    Length and digest are those of the whole payload: of a response they are worked out from what is read
    and held against its header, of a revisit they stand in its header.
    """

    def make():
        def one(file, offset: int, length: int) -> tuple:
            fields, block = read_member(file, offset, length)
            named = dict(fields)
            http, _, payload = block.partition(END)
            stated = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
            digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
            refers_to = named.get("WARC-Refers-To")
            if refers_to is None and (base32_sha1(payload), len(payload)) != (digest, stated):
                raise ValueError(f"payload of {named['WARC-Record-ID']} is not what its header says")
            page = page_of(named["WARC-Record-ID"].strip("<>"))
            of = page_of(refers_to.strip("<>")) if refers_to else None
            return page, stated, digest, named["WARC-Type"], of

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                with opened(archive) as file:
                    for offset, length, *_ in index_lines(index):
                        out.append(one(file, offset, length))
                        if len(out) == BLOCK_ROWS:
                            yield list(map(list, zip(*out)))
                            out = []
                if out:
                    yield list(map(list, zip(*out)))

        return work

    return in_batches(apart(normalised.select("archive", "index")), RECORDS, make)


def apart(archives: DataFrame) -> DataFrame:
    """Dealt out in as many partitions as there are archives: each is a task's work, however short its row."""
    return archives.repartition(max(1, archives.count()))


def archived(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """NORMALISED archives of a table of pages, in the shared folder.

    A record a row. Of rows with equal payloads, empty ones among them, the one with the largest page_id is a
    response and all others are revisits of it; a null id is the smallest, and of repeated rows one is the
    response. A null html is empty, a null url is left out, other columns don't matter; no rows give no
    archives. A record is held whole, an archive never. Payloads are not shuffled: only ids and hashes are.
    """
    folder = scratch_folder(pages.sparkSession, "archives")
    captured = stage(capture(pages, f"{folder}/captured", id_col, url_col, html_col, archive_bytes), "captured")
    # An archive's records are few, by its size, so a list of them is too.
    listed = repeats(captured).groupBy("archive").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("repeats"))
    every = captured.groupBy("archive").agg(F.count(F.lit(1)).alias("records"))
    given = stage(every.join(listed, "archive", "left").select("archive", "repeats"), "archive-repeats")
    return stage(normalise(apart(given), f"{folder}/normalised"), "normalised")
