"""WARC archives with a two-level capture index.

Writing: each task writes its pages as gzip members (one per record) into a WARC file in the shared
folder and yields an index row per record: reversed-host key, file, offset, length. A file's name
holds its task attempt, and index rows name the file, so a task that is run again leaves an unread
file behind and nothing else.

Payloads equal to that of another capture are not written again: of records with equal payloads of
at least ``least_bytes``, the one with the largest page id is the response, the others are revisit
records that refer to it.

Index: index rows are range-sorted by key; runs of ``block_rows`` become compressed blocks, and a
directory keeps each block's first and last key. Blocks hold more rows where there would else be more than
MOST_BLOCKS of them, so the directory has a bound whatever the corpus. A lookup binary-searches the directory
for the blocks of its key, is sent to these, binary-searches their lines, then reads ranges of the archive,
each file's in order of offset. Reading back looks up every url.

Defined cases: null html is an empty payload; null urls have the key of an empty url; repeated
rows are records of their own; equal payloads whose ids tie share the id that they refer to, and are
all responses; an empty table makes no archive and no rows; very long payloads are written and read whole, one at a
time; further columns, whatever their names, are ignored. The store must be one that pyarrow can open.
"""

from __future__ import annotations

import bisect
import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST_BYTES, BLOCK_ROWS = 1000, 2000
#: Blocks of an index, at most (but for one more per partition of its sort): rows of the directory that goes to tasks.
MOST_BLOCKS = 200_000
#: Searched keys of a block that one task looks up on average, at most; bytes of archive that a task reads.
KEYS_AT_ONCE, READ_BY_TASK = 20_000, 32_000_000
#: Gaps of fewer bytes between two records of a file are read along with them; bytes read at once.
GAP, READ_AT_ONCE = 65_536, 16_000_000
INDEX = "key string, page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def store(uri: str):
    """The file system and path behind a Hadoop path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def surt(url: Column) -> Column:
    """http://www.example.com:80/a?b -> com,example,www:80)/a?b"""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""))
    host, port = F.regexp_replace(authority, r":\d*$", ""), F.regexp_extract(authority, r"(:\d+)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))
    return F.replace(F.replace(key, F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A"))  # they separate an index's fields and lines


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record; the payload's whole length goes in a field of its own, as revisits hold none."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "text/html"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    body = b"" if refers_to is not None else payload or b""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parsed(member: bytes) -> tuple:
    """A gzip member's record, as in RECORD; its digest is checked against the payload."""
    import hashlib

    head, _, body = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = body[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return number("X-Page-ID"), fields["WARC-Target-URI"], number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-ID"), payload if kind == "response" else None


def captures(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, size, digest, refers_to (null: response)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("d256"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest", "d256").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # the groups that there are: payloads stay where they are read unless these are many
    groups = common.written(groups.where("n > 1").select(F.col("digest").alias("g1"), F.col("d256").alias("g2"), "keep_id"))
    rows = rows.join(common.sent_if_small(groups), F.expr("digest = g1 AND d256 = g2"), "left_outer")
    refers_to = F.when(~F.expr("page_id <=> keep_id"), F.col("keep_id"))
    rows = rows.withColumn("refers_to", refers_to)
    return rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def write_archives(captured: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes the archives below folder and returns the index rows, sorted by key within ranges."""
    rows = captured.select(surt(F.col("url")).alias("key"), "page_id", "url", "payload", "size", "digest", "refers_to")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out = name = None
        offset = 0
        for b in it:
            index = []
            for r in b.to_pylist():
                if out is None:
                    system, path = store(folder)
                    system.create_dir(path, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)  # members are compressed here
                member = gzip.compress(record(r["page_id"], r["url"], r["payload"], r["size"], r["digest"], r["refers_to"]), level, mtime=0)
                out.write(member)
                index.append((r["key"], r["page_id"], name, offset, len(member)))
                offset += len(member)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*index)) or [()] * 5, kinds)], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()  # before the task ends, so that its index rows never name an unfinished file

    return common.written(common.in_batches(rows, batches, INDEX))


def build_index(index: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(directory, blocks). directory: block, first_key, last_key, rows; blocks: block, content."""
    block_rows = max(block_rows, -(-index.count() // MOST_BLOCKS))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in it:
            held += zip(*(b.column(i).to_pylist() for i in range(5)))
            while len(held) >= block_rows:
                yield packed(held[:block_rows])
                held = held[block_rows:]
        if held:
            yield packed(held)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        content = zlib.compress("\n".join("\t".join("" if x is None else str(x) for x in r) for r in rows).encode())
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([len(rows)], pa.int64()), pa.array([content], pa.binary())], ["first_key", "last_key", "rows", "content"])

    sorted_rows = index.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    blocks = sorted_rows.select("key", "page_id", "file", "offset", "length").mapInArrow(batches, "first_key string, last_key string, rows long, content binary")
    blocks = common.written(blocks.withColumn("block", F.monotonically_increasing_id()))
    return blocks.select("block", "first_key", "last_key", "rows"), blocks.select("block", "content")


def lines_of(content: bytes) -> list[tuple]:
    rows = (line.split("\t") for line in zlib.decompress(content).decode().split("\n"))
    return [(key, int(page) if page else None, file, int(offset), int(length)) for key, page, file, offset, length in rows]


def ranged_reads(entries: DataFrame, folder: str) -> DataFrame:
    """entries (file, offset, length) -> the records at these places, see RECORD."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        at, source = None, None
        for b in it:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            i = 0
            while i < len(rows):
                # neighbours in a file are read in one go
                j, (file, first, length) = i + 1, rows[i]
                upto = first + length
                while j < len(rows) and rows[j][0] == file and 0 <= rows[j][1] - upto <= GAP and rows[j][1] + rows[j][2] - first <= READ_AT_ONCE:
                    upto = rows[j][1] + rows[j][2]
                    j += 1
                if at != file:
                    if source is not None:
                        source.close()
                    at, source = file, system.open_input_file(f"{path}/{file}")
                content = source.read_at(upto - first, first)
                found = [parsed(content[o - first : o - first + n]) for _, o, n in rows[i:j]]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
                i = j
        if source is not None:
            source.close()

    # a file's ranges lie in order; a file is split over tasks by stretches of offsets, so none waits for a large one.
    # Tasks are told by the bytes that they will read: the entries themselves are tiny
    stretch = F.floor(F.col("offset") / (4 * READ_AT_ONCE))
    total = entries.agg(F.sum("length")).first()[0] or 0
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BY_TASK))
    dealt = entries.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(common.tidy(batches), RECORD)


def search(keys: DataFrame, directory: DataFrame, blocks: DataFrame) -> DataFrame:
    """The index lines, as in INDEX, of distinct keys (column key), written: a binary search in the directory names the
    blocks that may hold a key, one in the block finds its lines."""
    rows = directory.orderBy("first_key", "last_key", "block").select("first_key", "last_key", "block").limit(2 * MOST_BLOCKS + 1).toArrow().to_pydict()
    first, last, number = rows["first_key"], rows["last_key"], rows["block"]
    if len(number) > 2 * MOST_BLOCKS:
        raise ValueError(f"an index of over {2 * MOST_BLOCKS} blocks: build it with more rows in a block")

    def find_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = []
            for key in b.column(0).to_pylist():
                i = bisect.bisect_left(last, key)  # both bounds ascend with the blocks
                while i < len(first) and first[i] <= key:
                    found.append((key, number[i]))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["key", "block"])

    asked = common.written(keys.select("key").mapInArrow(find_blocks, "key string, block long"))
    parts = asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.expr(f"int(ceil(n / {KEYS_AT_ONCE}))").alias("parts"))
    parts = F.broadcast(common.written(parts))  # a row per block at most
    asked = asked.join(parts, "block").select("key", "block", F.expr("int(pmod(xxhash64(key), parts))").alias("part"))
    there = blocks.join(parts, "block").select(F.col("block").alias("number"), F.explode(F.expr("sequence(0, parts - 1)")).alias("of"), "content")

    def search_block(some: pa.Table, block: pa.Table) -> pa.Table:
        lines = [line for content in block.column("content").to_pylist() for line in lines_of(content)]
        hits = []
        for key in some.column("key").to_pylist():
            i = bisect.bisect_left(lines, key, key=lambda line: line[0])
            while i < len(lines) and lines[i][0] == key:
                hits.append(lines[i])
                i += 1
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*hits)) or [()] * 5, kinds)], ["key", "page_id", "file", "offset", "length"])

    return common.written(asked.groupBy("block", "part").cogroup(there.groupBy("number", "of")).applyInArrow(search_block, INDEX))


def look_up(urls: DataFrame, directory: DataFrame, blocks: DataFrame, folder: str) -> DataFrame:
    """The records of the given urls (column url)."""
    return ranged_reads(search(urls.select(surt(F.col("url")).alias("key")).distinct(), directory, blocks), folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_dir(spark)
    pages = common.table(spark, sf_dir, "pages")
    directory, blocks = build_index(write_archives(captures(pages), folder))
    return look_up(pages, directory, blocks, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keep_id FROM p WHERE strlen(html) >= {LEAST_BYTES} GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN keep_id IS NULL OR keep_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep_id <> p.page_id THEN keep_id END AS refers_to
FROM p LEFT JOIN g USING (html)
"""
