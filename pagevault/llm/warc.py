"""Web archives: WARC records in ZIP packages, written by Spark tasks into the shared folder and read back by ranges.

A package is a ZIP file with two stored members: archive/data.warc.gz, one gzip member per record, and indexes/index.cdxj, one line per record
with its place. Of pages with equal payloads the one with the largest id is kept as a response, the others become revisits of
it. Reading takes two steps: tasks parse the directories and indexes of packages into ranges, then the ranges are dealt out anew and
read, each with one request. So a package is never extracted, and one large package is read by many tasks.

Every attempt of a task writes files of its own; the list of packages comes from the attempts that Spark commits, so lost executors and
repeated tasks leave nothing that is read twice. Packages close at a size, so neither they nor their indexes grow with the data.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm.frames import shared_folder, with_uid, written
from pagevault.llm.zipfiles import Archive, BadArchive, opened

LEAST = 1000  # bytes of a payload that may be revisited
PACKAGE = 128 << 20  # bytes of records after which a package is closed
RANGE = 4 << 20  # bytes of a read
HEAVY = 4096  # a class of equal payloads with more than this part of all rows is joined by broadcast; there are at most so many
DATE = "2024-01-01T00:00:00Z"
ROWS = 200  # records of an Arrow batch
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC standard
_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# --- records ---------------------------------------------------------------------------------------------------------


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, ident: str, date: str, block: bytes, headers: dict[str, str]) -> bytes:
    """One WARC record, as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {_line(v)}" for k, v in headers.items()] + [f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(ident: str, url: str | None, payload: bytes, n_bytes: int, sha1: str, date: str, refers: str | None, refers_url: str | None) -> bytes:
    """A response with its payload, or a revisit, which has the response's HTTP headers only."""
    headers = {} if url is None else {"WARC-Target-URI": url}
    headers["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    if refers is not None:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{refers}>", "WARC-Refers-To-Date": date}
        headers |= {} if refers_url is None else {"WARC-Refers-To-Target-URI": refers_url}
    headers["Content-Type"] = "application/http; msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return record("response" if refers is None else "revisit", ident, date, http + (payload if refers is None else b""), headers)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields, names in lower case."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a plain or gzipped record."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise BadArchive("not a WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    if len(rest) < size:
        raise BadArchive(f"record {fields.get('warc-record-id')} ends early")
    return fields, rest[:size]


def _sha1(value: str) -> str:
    """Lower-case hex of a digest field, which is base 32 as written here, or hex."""
    text = value.partition(":")[2] or value
    return base64.b32decode(text).hex() if len(text) == 32 else text.lower()


# --- writing ---------------------------------------------------------------------------------------------------------


def _packages(folder: str, date: str, limit: int):
    """Rows of a task -> its packages, in order; one result row per closed package."""

    class Package:
        def __init__(self, number: int):
            ctx = TaskContext.get()
            self.path = f"{folder}/pages-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{number:05d}.zip"
            files, path = opened(self.path)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            self.stream = files.open_output_stream(path)
            self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
            self.member = self.zip.open(_DATA, "w", force_zip64=True)
            self.at, self.records, self.index = 0, 0, io.BytesIO()
            self.put(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, b"format: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"}), None)

        def put(self, raw: bytes, ident: str | None) -> None:
            if ident is not None:
                line = {"id": ident, "filename": _DATA, "offset": self.at, "length": len(raw)}
                self.index.write(f"{ident} {json.dumps(line)}\n".encode())
                self.records += 1
            self.member.write(raw)
            self.at += len(raw)

        def close(self) -> pa.RecordBatch:
            self.member.close()
            self.zip.writestr(_INDEX, self.index.getbuffer())
            self.zip.close()
            self.stream.close()
            return pa.RecordBatch.from_pydict({"path": [self.path], "n_records": pa.array([self.records], pa.int64()), "n_bytes": pa.array([self.at], pa.int64())})

    def run(batches):
        package, number = None, 0
        for batch in batches:
            columns = [batch[c] for c in ("ident", "url", "html", "n_bytes", "sha1", "refers", "refers_url")]
            for i in range(batch.num_rows):
                ident, url, html, n_bytes, sha1, refers, refers_url = (c[i].as_py() for c in columns)
                package = package or Package(number)
                payload = b"" if html is None else html.encode()
                package.put(page_record(ident, url, payload, n_bytes, sha1, date, refers, refers_url), ident)
                if package.at >= limit:
                    yield package.close()
                    package, number = None, number + 1
        if package:
            yield package.close()

    return run


def _revisits(rows: DataFrame, least: int) -> DataFrame:
    """_uid, refers and refers_url of rows whose payload another row with a larger _uid has too.

    Classes of equal payloads meet their rows by a shuffle on the payload's hash, but for those that hold more than one in HEAVY rows: at most
    HEAVY such classes exist, so they are broadcast, and no task gets a hot class.
    """
    narrow = written(rows.filter(F.col("n_bytes") >= least).select("_uid", "ident", "url", F.sha2(F.col("html").cast("binary"), 256).alias("same")))
    classes = narrow.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_uid", "ident", "url")).alias("last")).filter("n > 1")
    classes = written(classes.select("same", "n", F.col("last._uid").alias("last"), F.col("last.ident").alias("refers"), F.col("last.url").alias("refers_url")))
    is_heavy = F.col("n") * HEAVY > F.lit(narrow.count())
    heavy = F.broadcast(classes.filter(is_heavy).drop("n"))
    rows = narrow.select("_uid", "same")
    hot = rows.join(heavy, "same")
    cold = rows.join(heavy.select("same"), "same", "left_anti").join(classes.filter(~is_heavy).drop("n"), "same")
    return hot.unionByName(cold).filter(F.col("_uid") < F.col("last")).select("_uid", "refers", "refers_url")


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, least: int = LEAST,
    date: str = DATE, package: int = PACKAGE,
) -> DataFrame:
    """Write one record per row into packages below `folder` (by default a new one in the shared folder); path, n_records, n_bytes of each package.

    Payloads are the HTML in UTF-8, null as empty. Rows with equal payloads of at least `least` bytes: the one with the largest id is a response,
    the others revisit it. Ids may be null or repeated: such rows are ordered by id (null first) and HTML, and of equal rows any one
    is the largest. Null URLs leave the field out; line ends in a URL are written as %0D and %0A. An empty table writes no package.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    rows, same = with_uid(pages, id_col, html_col, url_col)
    ident = F.concat(F.lit("urn:page:"), F.url_encode(F.coalesce(F.col(f"_in_{id_col}").cast("string"), F.lit(""))))
    html = F.coalesce(F.col("_text"), F.lit(""))
    rows = rows.select(
        "_uid",
        (ident if same else F.concat(ident, F.lit(":"), F.col("_uid").cast("string"))).alias("ident"),
        F.col(f"_in_{url_col}").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("n_bytes"),
    )
    revisits = written(_revisits(rows, least))
    # the narrow side is hashed, so that pages are not sorted
    marked = rows.join(revisits.hint("shuffle_hash"), "_uid", "left")
    marked = marked.select("ident", "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "n_bytes", F.sha1(F.col("html").cast("binary")).alias("sha1"), "refers", "refers_url")
    return written(marked.mapInArrow(_packages(folder, date, package), "path string, n_records long, n_bytes long"))


# --- reading ---------------------------------------------------------------------------------------------------------


def _walk(archive: Archive, start: int, size: int, zipped: bool):
    """(offset, length) of the records of a member without an index, read from front to end."""
    at, end = 0, size
    while at < end:
        if zipped:
            unpacker, n = zlib.decompressobj(31), 0
            while not unpacker.eof:
                part = archive.read(start + at + n, min(RANGE, end - at - n))
                if not part:
                    raise BadArchive("a gzip member ends early")
                while part and not unpacker.eof:
                    unpacker.decompress(part, RANGE)
                    rest = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
                    n += len(part) - len(rest)
                    part = b"" if unpacker.eof else rest
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                more = archive.read(start + at + len(head), min(4096, end - at - len(head)))
                if not more:
                    raise BadArchive("a record's head ends early")
                head += more
            head = head[: head.index(b"\r\n\r\n")]
            n = len(head) + 4 + int(_fields(head)["content-length"]) + 4
        yield at, n
        at += n


def _entries(archive: Archive):
    """(absolute offset, length) of each record of a package: from its indexes, else by walking through the member."""
    members = {m.name: m for m in archive.members()}
    data = {n: archive.data_start(m) for n, m in members.items() if n.startswith("archive/") and re.search(r"\.warc(\.gz)?$", n)}
    indexed = set()
    for name, member in members.items():
        if not (name.startswith("indexes/") and name.endswith(".cdxj")):
            continue
        at, left, rest = archive.data_start(member), member.size, b""
        while left or rest:
            take = min(left, 1 << 20)
            lines = (rest + archive.read(at, take)).split(b"\n")
            at, left = at + take, left - take
            rest = lines.pop() if left else b""
            for line in filter(None, lines):
                entry = json.loads(line[line.index(b"{") :])
                file = entry["filename"] if entry["filename"] in data else f"archive/{entry['filename']}"
                if file not in data:
                    raise BadArchive(f"an index names {entry['filename']}, which is not there")
                indexed.add(file)
                yield data[file] + int(entry["offset"]), int(entry["length"])
    for name, start in data.items():
        if name not in indexed:
            for at, n in _walk(archive, start, members[name].size, name.endswith(".gz")):
                yield start + at, n


def _ranges(batches):
    """Packages -> ranges of neighbouring records, each of up to RANGE bytes or one record."""
    for batch in batches:
        for path in batch["path"].to_pylist():
            files, inner = opened(path)
            with files.open_input_file(inner) as file:
                begin, lengths, out = 0, [], []
                for at, n in _entries(Archive(file)):
                    if lengths and (at != begin + sum_ or sum_ + n > RANGE):
                        out.append((path, begin, lengths))
                        lengths = []
                    if not lengths:
                        begin, sum_ = at, 0
                    lengths.append(n)
                    sum_ += n
                    if len(out) == ROWS:
                        yield _range_batch(out)
                        out = []
                if lengths:
                    out.append((path, begin, lengths))
                if out:
                    yield _range_batch(out)


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "start", "lengths"])


_RECORD = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
)
_RECORD_DDL = "record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _page_row(raw: bytes, payloads: bool) -> tuple | None:
    fields, block = parsed(raw)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        raise BadArchive(f"record {fields['warc-record-id']} has no HTTP headers")
    digest = _sha1(fields["warc-payload-digest"])
    if kind == "response":
        n = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise BadArchive(f"the payload of {fields['warc-record-id']} has another digest")
    else:
        n = int(_fields(head)["content-length"])
    refers = fields.get("warc-refers-to")
    kept = payload if payloads and kind == "response" else None
    return fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), n, digest, refers and refers.strip("<>"), kept


def _reader(payloads: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, inner = opened(row["path"])
                with files.open_input_file(inner) as file:
                    data = memoryview(Archive(file).read(row["start"], sum(row["lengths"])))
                at, out = 0, []
                for n in row["lengths"]:
                    found = _page_row(bytes(data[at : at + n]), payloads)
                    at += n
                    if found:
                        out.append(found)
                    if len(out) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RECORD, strict=True)], schema=_RECORD)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RECORD, strict=True)], schema=_RECORD)

    return run


def read_archives(archives: DataFrame, path_col: str = "path", payloads: bool = True) -> DataFrame:
    """The page records of the packages at `path`: record_id, record_type, url, date, payload_bytes, payload_digest, refers_to, payload.

    payload_bytes and payload_digest are those of the full payload, also for revisits, whose payload is null (`resolved` finds it). Packages of
    others are read as well, if their members are stored: with an index, or record by record without one. A damaged package or a
    payload with another digest raises BadArchive. No packages give no rows.
    """
    spark = archives.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = archives.select(F.col(path_col).alias("path")).repartition(parts, "path")
    ranges = paths.mapInArrow(_ranges, "path string, start long, lengths array<long>")
    return ranges.repartition(parts, "path", "start").mapInArrow(_reader(payloads), _RECORD_DDL)


def resolved(records: DataFrame) -> DataFrame:
    """All records with their payload: revisits get that of the response they refer to."""
    first = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'").drop("payload")
    found = again.join(first.select(F.col("record_id").alias("refers_to"), "payload"), "refers_to", "left")
    return first.unionByName(found.select(first.columns))


def page_id(record_id: str, kind: str = "long"):
    """The page's id from the record's."""
    text = F.url_decode(F.split(F.col(record_id), ":").getItem(2))
    return F.when(text != "", text).cast(kind)


def page_records(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write the pages and read them back: the id, payload_bytes, payload_digest, record_type and refers_to (an id) of each."""
    kind = dict(pages.dtypes)[id_col]
    records = read_archives(write_archives(pages, id_col, url_col, html_col, least=least), payloads=False)
    return records.select(
        page_id("record_id", kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", page_id("refers_to", kind).alias("refers_to")
    )


SQL = f"""
WITH payloads AS (SELECT page_id, COALESCE(html, '') AS p, strlen(COALESCE(html, ''))::BIGINT AS n FROM pages),
kept AS (SELECT p, max(page_id) AS last FROM payloads WHERE n >= {LEAST} GROUP BY p)
SELECT a.page_id, a.n AS payload_bytes, sha1(a.p) AS payload_digest, CASE WHEN k.last > a.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.last > a.page_id THEN k.last END AS refers_to
FROM payloads a LEFT JOIN kept k ON a.p = k.p AND a.n >= {LEAST}
"""
