"""WARC archives: written as Spark text parts, read back by boundary-chain verification.

Writing: pages are keyed by the SHA-1 of their payload; the smallest page_id of
equal payloads is the response, the others are revisits without payload, which name
the response's page and address.  Every record has an id of its own.  A part file is
records of header block, payload and the blank lines that end a record.

Reading: every split yields a candidate at each version line, be it a record or
bytes inside a payload, with the offset of its successor as its own header
tells.  Offsets inside a split are resolved in the task (a candidate's exit is
where its chain leaves the split); between splits, pointer jumping from the
start of each file keeps the candidates that are reached.  Magic inside a
payload is never reached.  A payload that holds magic spans several pieces; the
task joins those inside its split, and a second scan joins the few that cross.

Edge cases: null html is an empty payload; a null url is written as an empty
target; repeated rows with one page_id are records of their own, and those with the
smallest page_id of their payload all respond; a null page_id responds; an empty
table gives an empty result; columns other than page_id, url and html are ignored;
any payload bytes, also version lines, come back unchanged, however long.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import bits_of, perhaps
from ._cluster import fresh_path, prepare, stage, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Payloads smaller than this are never revisits.
LEAST_PAYLOAD = 0
#: Records in a part file at most.
FILE_RECORDS = 50_000


def with_roles(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, html with _digest (hex SHA-1), _bytes, and _refers and _address of the response (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_first")
    # only digests and addresses are grouped, and only pages whose payload may occur again are shuffled
    groups = stage(keyed.where(F.col("_bytes") >= least).groupBy("_digest").agg(first, F.count("*").alias("_n")).where("_n > 1").select("_digest", "_first"), "warc-groups")
    told = perhaps(keyed, "_digest", bits_of(groups, "_digest"))
    again = told.where("_maybe").join(groups.hint("merge"), "_digest", "left")
    revisit = (F.col("_bytes") >= least) & (F.col("page_id") != F.col("_first.page_id"))
    again = again.select(*keyed.columns, F.when(revisit, F.col("_first.page_id")).alias("_refers"), F.when(revisit, F.col("_first.url")).alias("_address"))
    return told.where("not _maybe").select(*keyed.columns).unionByName(again, allowMissingColumns=True)


def _hex_to_base32(digest: F.Column) -> F.Column:
    """Base-32 of 20 bytes given as 40 hex digits: four groups of 10 digits, 8 letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for k in range(4):
        n = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(letters), (F.shiftright(n, 5 * (7 - i)).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


def write_warc(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD) -> None:
    """Write a record per row under ``path``; Spark's committer makes each part appear whole or not at all."""
    rows = with_roles(pages, least)
    revisit = F.col("_refers").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit("")))
    clean = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]", " ")
    # a record's id is its own, also among repeated rows
    hexa = F.md5(F.concat_ws("|", F.col("page_id"), F.col("_digest"), F.col("url"), F.monotonically_increasing_id()))
    uuid = F.concat_ws("-", *(F.substring(hexa, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _hex_to_base32(F.col("_digest")))),
        line("X-Page-ID", clean(F.col("page_id"))),
        line("X-Payload-Length", F.col("_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To-Target-URI", clean(F.col("_address"))), line("WARC-Refers-To-Date", F.lit(DATE)), line("X-Refers-To-Page-ID", F.col("_refers").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(header, body).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELD = re.compile(rb"(?m)^([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r?$")
_CANDIDATE = "file string, block long, at long, next long, exit long, size long, page_id long, type string, refers long, told_bytes long, told_digest string, digest string"


class _Open:
    """A candidate whose payload is still being read."""

    __slots__ = ("row", "left", "sha")

    def __init__(self, row: dict, left: int):
        self.row, self.left, self.sha = row, left, hashlib.sha1()

    def feed(self, data: bytes) -> bool:
        take = data[: self.left]
        self.sha.update(take)
        self.left -= len(take)
        if self.left:
            return False
        self.row["digest"] = base64.b32encode(self.sha.digest()).decode()
        return True


def _number(x: bytes | None) -> int | None:
    return int(x) if x and re.fullmatch(rb"-?[0-9]{1,18}", x) else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between version lines, in split order -> candidates with split-relative offsets."""
    magic = MAGIC.encode()
    schema = pa.schema([(k, pa.string() if t == "string" else pa.int64()) for k, t in (x.split() for x in _CANDIDATE.split(", "))])
    here, at, rows, opened = None, 0, [], []

    def close() -> pa.RecordBatch:
        # a chain's exit: resolved from the last candidate to the first
        exits: dict[int, int] = {}
        for r in reversed(rows):
            n = r["next"]
            r["exit"] = exits.get(n, n) if n is not None and n < at else n
            exits[r["at"]] = r["exit"] if r["exit"] is not None else -1
        rows.append({"file": here[0], "block": here[1], "at": None, "next": at})  # the split's length
        out = pa.RecordBatch.from_pylist(rows, schema=schema)
        rows.clear()
        opened.clear()
        return out

    for batch in batches:
        files, blocks, values = batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value")
        for file, block, value in zip(files, blocks, values):
            piece = value.as_py()
            if here != (file, block):
                if here is not None:
                    yield close()
                here, at = (file, block), 0
                first = block == 0
            else:
                first = False
            # a piece ends where the next version line starts; the file's first piece precedes its first record
            if first:
                at += len(piece)
                continue
            start = at
            at += len(magic) + len(piece)
            opened[:] = [o for o in opened if not o.feed(magic) and not o.feed(piece)] if opened else []
            cut = piece.find(b"\r\n\r\n")
            fields = {k.lower(): v for k, v in _FIELD.findall(piece[:cut])} if cut >= 0 else {}
            length = _number(fields.get(b"content-length"))
            if length is None or length < 0:
                continue
            digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
            body = start + len(magic) + cut + 4
            row = {"file": file, "block": block, "at": start, "next": body + length + 4, "size": length, "page_id": _number(fields.get(b"x-page-id")), "type": fields.get(b"warc-type", b"").decode("latin-1"), "refers": _number(fields.get(b"x-refers-to-page-id")), "told_bytes": _number(fields.get(b"x-payload-length")), "told_digest": digest}
            rows.append(row)
            record = _Open(row, length)
            if not record.feed(piece[cut + 4 :]):
                opened.append(record)
    if here is not None:
        yield close()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: page_id, type, refers, size, told_bytes, told_digest, digest (of the stored payload)."""
    prepare(spark)
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    found = stage(pieces.mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split
    splits = stage(found.where("at is null").select("file", "block", F.coalesce(F.sum("next").over(order), F.lit(0)).alias("base"), F.col("next").alias("length")), "warc-splits")
    records = found.where("at is not null")
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    if most <= 1:
        # no chain leaves its split: the start of the file enters it
        entries = splits.select("file", "block", F.lit(0).cast("long").alias("entry"))
    else:
        entries = _jump(records, splits, most)
    good = records.join(_reached(records, entries), ["file", "block", "at"], "left_semi")
    rest = good.where("digest is null")
    if most > 1 and rest.limit(1).count():
        good = good.where("digest is not null").unionByName(_crossing(spark, path, rest, splits, found.columns))
    return good.select("page_id", "type", "refers", "size", "told_bytes", "told_digest", "digest")


def _jump(records: DataFrame, splits: DataFrame, most: int) -> DataFrame:
    """Pointer jumping over split exits: (file, block, entry) for every split a chain enters."""
    placed = records.join(splits, ["file", "block"]).select("file", (F.col("at") + F.col("base")).alias("node"), (F.col("exit") + F.col("base")).alias("to"))
    # only candidates at which some chain enters a split matter between splits
    targets = placed.select("file", F.col("to").alias("node")).unionByName(splits.select("file", F.lit(0).cast("long").alias("node")).distinct()).distinct()
    edges = stage(placed.join(targets, ["file", "node"], "left_semi"), "warc-edges")
    reached = splits.select("file", F.lit(0).cast("long").alias("node")).distinct()
    hops = 1
    while hops < most:
        onward = reached.join(edges, ["file", "node"]).select("file", F.col("to").alias("node"))
        reached = stage(reached.unionByName(onward).distinct(), "warc-reached")
        further = edges.select("file", F.col("node").alias("to"), F.col("to").alias("_to"))
        edges = stage(edges.join(further, ["file", "to"], "left").select("file", "node", F.coalesce("_to", "to").alias("to")), "warc-edges")
        hops *= 2
    within = (F.col("node") >= F.col("base")) & (F.col("node") < F.col("base") + F.col("length"))
    return reached.join(splits, "file").where(within).select("file", "block", (F.col("node") - F.col("base")).alias("entry"))


def _reached(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, block, at) on the chains that start at the entries; one group per split."""
    both = records.select("file", "block", "at", "next").unionByName(entries.select("file", "block", F.col("entry").alias("at"), F.lit(None).cast("long").alias("next")))

    def walk(key, t):
        at, following = t.column("at").to_pylist(), t.column("next").to_pylist()
        after = {a: n for a, n in zip(at, following) if n is not None}
        out = set()
        for a, n in zip(at, following):
            while n is None and a in after and a not in out:
                out.add(a)
                a = after[a]
        return pa.table({"file": pa.array([key[0].as_py()] * len(out), pa.string()), "block": pa.array([key[1].as_py()] * len(out), pa.int64()), "at": pa.array(sorted(out), pa.int64())})

    return both.groupBy("file", "block").applyInArrow(walk, "file string, block long, at long")


def _crossing(spark: SparkSession, path: str, rest: DataFrame, splits: DataFrame, columns: list[str]) -> DataFrame:
    """Digests of records whose payload holds magic and crosses splits, from a second scan joined by place."""
    magic = MAGIC.encode()
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            begin = []
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            data = []
            for file, block, value in zip(files, blocks, batch.column("value")):
                piece = value.as_py()
                if here != (file, block):
                    here, at = (file, block), 0
                    if block == 0:
                        begin.append(0)
                        data.append(piece)
                        at = len(piece)
                        continue
                begin.append(at)
                data.append(magic + piece)
                at += len(magic) + len(piece)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(begin, pa.int64()), pa.array(data, pa.binary())], names=["file", "block", "begin", "data"])

    pieces = raw.mapInArrow(place, "file string, block long, begin long, data binary").join(splits, ["file", "block"]).select("file", "block", (F.col("begin") + F.col("base")).alias("begin"), "data")
    wanted = rest.join(splits, ["file", "block"]).select(*(F.col(c) for c in columns), (F.col("next") + F.col("base") - 4 - F.col("size")).alias("from"), (F.col("next") + F.col("base") - 4).alias("to"))
    # a crossing record is sent to the splits it lies in, of which few records cross any one
    over = splits.select("file", F.col("block").alias("_split"), F.col("base").alias("_base"), "length")
    sent = wanted.join(over, "file").where((F.col("_base") < F.col("to")) & (F.col("_base") + F.col("length") > F.col("from"))).drop("_base", "length")
    pairs = sent.join(pieces.withColumnRenamed("block", "_split"), ["file", "_split"]).where((F.col("begin") < F.col("to")) & (F.col("begin") + F.octet_length("data") > F.col("from")))
    cut = F.expr("substring(data, cast(greatest(`from` - begin, 0) + 1 as int), cast(least(`to` - begin, octet_length(data)) - greatest(`from` - begin, 0) as int))")
    # the key is the record, so a group is one payload
    joined = pairs.withColumn("data", cut).groupBy("file", "block", "at").agg(F.sort_array(F.collect_list(F.struct("begin", "data"))).alias("cuts"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cuts in batch.column("cuts").to_pylist():
                sha = hashlib.sha1()
                for c in cuts:
                    sha.update(c["data"])
                out.append(base64.b32encode(sha.digest()).decode())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), batch.column("at"), pa.array(out)], names=["file", "block", "at", "digest"])

    digests = joined.mapInArrow(digest, "file string, block long, at long, digest string")
    return rest.drop("digest").join(digests, ["file", "block", "at"]).select(*columns)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path)
    response = F.col("type") == "response"
    return records.select(
        "page_id",
        F.when(response, F.col("size")).otherwise(F.col("told_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("told_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").alias("refers_to"),
    )


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p),
b AS (SELECT page_id, payload_bytes, f,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 10 * (i // 8) + 1, 10))::BIGINT >> (5 * (7 - i % 8))) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM b
"""
