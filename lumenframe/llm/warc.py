"""WARC archives as a chunked record table.

A payload never has to be one value: it travels as rows ``(record_id, chunk_no, data)``, each
carrying the number of bytes and the digest of the payload up to and including that chunk. The
row marked ``last`` thus knows the whole payload's length and digest without anyone holding it.

* ``chunk_payloads`` cuts payloads into chunk rows, ``mark_revisits`` finds equal payloads.
* ``write_archives`` streams chunk rows into gzip-per-record WARC/1.1 files, one file per task,
  under a name of its own attempt, renamed when complete. A lost task is run again and its file
  replaced by an equal one.
* ``read_archives`` streams files back into chunk rows, one task per file.

Files live in a folder that all executors reach: a file system that pyarrow opens by URI.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads are cut into chunks of so many bytes.
CHUNK_BYTES = 64 * 1024
#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 100
#: Rows of a batch are sent on when they hold so many bytes.
BATCH_BYTES = 4 << 20

CHUNK_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to_record string, chunk_no int, data binary, "
    "bytes_so_far long, digest_so_far string, last boolean, declared_digest string, file string"
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_name(id_column: Column) -> Column:
    """The record's URN, from which ``record_key`` reads the id back; an empty name for a null id."""
    return F.concat(F.lit("urn:record:"), F.coalesce(id_column.cast("string"), F.lit("")))


def record_key(name: Column, kind: str) -> Column:
    """The id in a record's URN; null for an empty name."""
    text = F.substring(name, len("urn:record:") + 1, 1 << 30)
    return F.when(text != "", text).cast(kind)


def mark_revisits(pages: DataFrame, id_column: str, payload: Column, uri: Column, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Columns ``record_id, target_uri, payload, payload_bytes, payload_digest, refers_to_record``.

    Of records with equal payloads of at least ``min_bytes`` bytes, those with the smallest id are
    responses (several, where rows repeat that id), the others refer to it. Null ids sort last; a group
    of null ids only is all responses. A null payload is empty.
    """
    rows = pages.select(
        F.col(id_column).alias("__id"), uri.cast("string").alias("target_uri"),
        F.coalesce(payload.cast("binary"), F.lit(b"").cast("binary")).alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # Equal payloads are few next to all: what is joined back holds only digests seen more than once.
    repeated = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first_id"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.join(repeated, "payload_digest", "left")
    later = F.col("first_id").isNotNull() & ~F.col("__id").eqNullSafe(F.col("first_id"))
    return joined.select(
        record_name(F.col("__id")).alias("record_id"), "target_uri", "payload", "payload_bytes", "payload_digest",
        F.when(later, record_name(F.col("first_id"))).alias("refers_to_record"),
    )


def chunk_payloads(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk, in order; an empty payload, or one that refers to another, has one empty chunk."""
    written = F.when(F.col("refers_to_record").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.greatest(F.ceil(written / chunk_bytes) - 1, F.lit(0)).cast("int")
    return records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).select(
        "record_id", "target_uri", "payload_digest", "refers_to_record", "chunk_no",
        written.alias("written_bytes"),
        F.when(F.col("refers_to_record").isNull(), F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})"))
        .otherwise(F.lit(b"")).alias("data"),
    )


def _head(record_id, uri, digest, refers, payload_bytes: int) -> bytes:
    """The WARC header of a record, with the HTTP header that starts its block."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{record_id}>",
             "WARC-Date: 2024-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + quote(uri, safe=":/?#[]@!$&'()*+,;=%~"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers:
        lines += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(_HTTP) + payload_bytes}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + _HTTP


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows, in the order of their partitions, to ``folder``; one row per file: ``file, records, bytes``.

    The rows of a record must follow one another in one partition, as ``chunk_payloads`` leaves them. A
    payload whose digest differs from the one announced is an error. The result is lazy: files are written
    when it is evaluated, and again, equal, when it is evaluated again.
    """

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft = f"{path}/.{name}-{context.taskAttemptId()}"
        out, records, size, digest, packer = None, 0, 0, None, None

        def put(data: bytes) -> None:
            nonlocal size
            if data:
                out.write(data)
                size += len(data)

        def end(announced) -> None:
            if digest is not None and digest.hexdigest() != announced:
                raise ValueError("payload and digest differ")
            put(packer.compress(b"\r\n\r\n") + packer.flush())

        announced = None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                record_id, uri, sha, refers, number, total, data = (c[i].as_py() for c in columns)
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(draft)
                if number == 0:
                    if packer is not None:
                        end(announced)
                    records += 1
                    announced, packer = sha, zlib.compressobj(6, zlib.DEFLATED, 31)
                    digest = None if refers else hashlib.sha256()
                    put(packer.compress(_head(record_id, uri, sha, refers, total)))
                if digest is not None:
                    digest.update(data)
                put(packer.compress(data))
        if out is None:
            return
        end(announced)
        out.close()
        store.move(draft, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"file": [f"{folder}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())}
        )

    return chunks.mapInArrow(write, "file string, records long, bytes long")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder as a table with column ``file``."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file)
    rows = [(f"{folder}/{n}",) for n in names if n.endswith((".warc", ".warc.gz")) and n[0] != "."]
    return spark.createDataFrame(rows, "file string")


def read_archives(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all records in the archives named in column ``file`` (see ``CHUNK_SCHEMA``).

    Compressed or plain. A record gives at least one row; ``bytes_so_far`` and ``digest_so_far`` (SHA-256,
    bare hex) cover the payload through that chunk. An HTTP header at the start of a response or
    revisit block is not payload. A file that ends inside a record is an error.
    """

    def rows_of(file):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_stream(path, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            yield from _records(stream, file, chunk_bytes)

    def read(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
        kinds = {"chunk_no": pa.int32(), "data": pa.binary(), "bytes_so_far": pa.int64(), "last": pa.bool_()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        held, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for row in rows_of(file):
                    held.append(row)
                    size += len(row[5]) + 300
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return files.select("file").mapInArrow(read, CHUNK_SCHEMA)


def _records(stream, file: str, chunk_bytes: int):
    """Chunk rows of the records of a binary stream, holding one chunk at a time."""
    while True:
        line = stream.readline() if hasattr(stream, "readline") else _line(stream)
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start in {file}")
        head = _headers(stream)
        left = int(head["content-length"])
        kind = head.get("warc-type", "").lower()
        if head.get("content-type", "").replace(" ", "").lower().startswith("application/http") and left:
            skipped = b""
            while not skipped.endswith(b"\r\n\r\n") and len(skipped) < left:
                skipped += _line(stream)
            left -= len(skipped)
        bare = lambda key: head[key].strip("<>") if key in head else None
        declared = head.get("warc-payload-digest")
        declared = declared.split(":", 1)[1].lower() if declared and declared.lower().startswith("sha256:") else None
        digest, number, done = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left)) if left else b""
            while left and len(data) < min(chunk_bytes, left):
                more = stream.read(min(chunk_bytes, left) - len(data))
                if not more:
                    raise ValueError(f"{file} ends inside a record")
                data += more
            left -= len(data)
            done += len(data)
            digest.update(data)
            yield (bare("warc-record-id"), kind, head.get("warc-target-uri"), bare("warc-refers-to"), number, data,
                   done, digest.hexdigest(), left == 0, declared, file)
            number += 1
            if not left:
                break


def _line(stream) -> bytes:
    return stream.readline()


def _headers(stream) -> dict[str, str]:
    """Named fields up to the blank line; names in lower case, a continued line joins the one before."""
    fields: dict[str, str] = {}
    name = ""
    while (line := _line(stream)).strip():
        if line[:1] in b" \t" and name:
            fields[name] += " " + line.strip().decode()
            continue
        name, _, value = line.decode().partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def summarize(chunks: DataFrame, id_type: str = "long", id_column: str = "page_id") -> DataFrame:
    """One row per record read: its id, payload length and digest, type, and the id it refers to.

    A response's figures are those its last chunk carries. A revisit has no payload of its own: the digest is the one
    it declares, the length that of the record it refers to (null when that record is not in the archives).
    """
    ends = chunks.where("last").select(
        "record_id", "record_type", "refers_to_record", "bytes_so_far", "digest_so_far", "declared_digest"
    )
    responses = ends.where("refers_to_record is null")
    lengths = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("bytes_so_far").alias("full_bytes"))
    found = responses.withColumn("full_bytes", F.col("bytes_so_far")).unionByName(
        # Sizes are estimated from the list of files, far too low: no broadcast on that ground.
        ends.where("refers_to_record is not null").join(lengths.hint("merge"), "refers_to_record", "left")
    )
    return found.select(
        record_key(F.col("record_id"), id_type).alias(id_column),
        F.col("full_bytes").alias("payload_bytes"),
        F.when(F.col("refers_to_record").isNull(), F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        record_key(F.col("refers_to_record"), id_type).alias("refers_to"),
    )
