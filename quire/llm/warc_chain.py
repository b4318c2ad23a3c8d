"""WARC: archives written by Spark, and read back by boundary-chain verification.

Writing: rows become WARC records in text files, one file for each task, under
a shared folder. Of rows with equal payloads the one with the largest id is a
response, the others are revisits of it without a payload block.

Reading: the files are cut at every record magic, so a payload that holds the
magic is cut too. Each task runs through its stretch of a file and emits for
each candidate its place and that of its successor, worked out from its
Content-Length; places are relative to the stretch's first record, and sums of
stretch lengths make them absolute. Candidates whose header does not parse have
no successor. Within a stretch each candidate's pointer is followed to the
first place outside it; pointer jumping over stretches (doubling, so as many
rounds as the logarithm of the stretches in a file) then marks what can be
reached from the file's start. Only reachable records are kept; a payload that
was cut is put together again from the stretches' parts up to its end.

Defined results: null html is an empty payload; a null id or url is left out of
the header and read as null (a null id is the smallest); rows with one id and
one payload are records of their own and all of one type; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, shared_path, stored

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
MIN_PAYLOAD = 0
_FIELDS = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$", re.M)


def _base32_sha1(payload: str) -> str:
    """SQL for the bare upper-case base32 SHA-1 of a binary column: 160 bits are 32 letters of five."""
    bits = f"sha1({payload})"
    letters = []
    for group in range(8):  # five hex digits are four letters
        number = f"cast(conv(substr({bits}, {5 * group + 1}, 5), 16, 10) as int)"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (shiftright({number}, {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return f"concat({', '.join(letters)})"


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses). Only
    digests that occur more than once are joined back, so one frequent payload
    is counted before the shuffle and its rows are split by the skewed join."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    keyed = rows.select("*", F.expr("sha1(cast(payload as binary))").alias("sha1"), F.expr("octet_length(payload)").cast("long").alias("payload_bytes"))
    # written first, so that its size is known before payloads would be shuffled to meet it
    twice = stored(
        keyed.where(F.col("payload_bytes") >= min_payload)
        .groupBy("sha1", "payload_bytes")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha1", "payload_bytes", "response"),
        "warc-repeated",
    )
    joined = keyed.join(twice, ["sha1", "payload_bytes"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select("page_id", "url", "payload", "payload_bytes", revisit.alias("revisit"), F.when(revisit, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """One text file of WARC records for each task, under `path`."""
    rows = classified(pages, **columns).withColumn("digest", F.expr(_base32_sha1("cast(payload as binary)")))
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), F.col(c).cast("string"), F.lit(">"))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    one_line = F.regexp_replace("url", r"[\r\n]", "")
    record = F.concat(
        F.lit(MAGIC),
        F.when(F.col("revisit"), F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        field("WARC-Record-ID", uri("page_id")),
        field("WARC-Target-URI", one_line),
        field("WARC-Refers-To", uri("refers_to")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("X-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(GAP),
        F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _parsed(segment: bytes) -> dict | None:
    """Fields of a candidate's header and the length of the header; None if it is none."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELDS.findall(segment[:end].replace(b"\r\n", b"\n"))}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    return {"fields": fields, "header": end + 4, "length": int(length)}


def _number(uri: bytes) -> int | None:
    m = re.fullmatch(rb"<urn:x-page:(-?\d+)>", uri)
    return int(m[1]) if m else None


CANDIDATES = (
    "file string, stretch long, place long, successor long, outside long, page_id long, record_type string, "
    "digest string, payload_bytes long, refers_to long, header long, length long, measured string, total long"
)
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _segments(batches):
    """(file, stretch, place, segment) of a task's rows in order, place None for
    what lies before a file's first magic; then (file, stretch, total, None)."""
    key, at = None, 0
    for batch in batches:
        for file, stretch, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, stretch) != key:
                if key:
                    yield *key, at, None
                key, at = (file, stretch), 0
                if stretch == 0:
                    at = len(segment)
                    yield file, stretch, None, segment
                    continue
            yield file, stretch, at, segment
            at += len(MAGIC) + len(segment)
    if key:
        yield *key, at, None


def _candidates(batches):
    """For each candidate its place, its successor's, and the first place
    outside the stretch that its pointers lead to; for each stretch its total."""
    schema, rows = _schema(CANDIDATES), []
    for file, stretch, at, segment in _segments(batches):
        if segment is None:
            outside: dict[int, int | None] = {}
            for row in reversed(rows):  # pointers lead forward
                to = row.get("successor")
                row["outside"] = outside[row["place"]] = to if to is None or to >= at else outside.get(to)
            rows.append({"file": file, "stretch": stretch, "total": at})
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
        elif at is not None:
            row = {"file": file, "stretch": stretch, "place": at}
            if found := _parsed(segment):
                fields, start, length = found["fields"], found["header"], found["length"]
                text = {k.decode(): v.decode(errors="replace") for k, v in fields.items()}
                stated = text.get("x-payload-length", "")
                response = text["warc-type"] == "response"
                row |= {
                    "successor": at + len(MAGIC) + start + length + len(GAP),
                    "page_id": _number(fields.get(b"warc-record-id", b"")),
                    "record_type": text["warc-type"],
                    "digest": text.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    "payload_bytes": length if response else int(stated) if stated.isdigit() else None,
                    "refers_to": _number(fields.get(b"warc-refers-to", b"")),
                    "header": start,
                    "length": length,
                }
                if response and start + length <= len(segment):
                    row["measured"] = _digest(segment[start : start + length])
            rows.append(row)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic, with the file and the place of the stretch."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("stretch"), F.col("value").cast("binary").alias("segment"))


def _reached(found: DataFrame, name: str) -> DataFrame:
    """(file, place) of stretch entries reached from each file's start, by
    pointer jumping over the places where pointers leave a stretch."""
    starts = found.where("place = 0").select("file", "place")
    landings = found.where("outside is not null").select("file", F.col("outside").alias("place")).distinct()
    nodes = landings.union(starts).distinct().join(found.select("file", "place", "outside"), ["file", "place"])
    jump = stored(nodes.select("file", "place", F.col("outside").alias("to")), f"{name}-jump")
    reached = stored(starts, f"{name}-reached")
    n = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "place"]).where("to is not null").select("file", F.col("to").alias("place"))
        grown = stored(reached.union(ahead).distinct(), f"{name}-reached")
        if (m := grown.count()) == n:
            return grown
        reached, n = grown, m
        second = jump.select("file", F.col("place").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(second, ["file", "to"]).select("file", "place", F.col("next").alias("to")), f"{name}-jump")


def _walked(rows):
    """Of one stretch's candidates those reached from its entries, and for the
    rest the reached one before them (none before the first)."""
    import pandas as pd

    rows = rows.sort_values("place", kind="stable")
    alive = {int(p) for p in rows.loc[rows["entry"].notna(), "place"]}
    owner, kept, owners = None, [], []
    for place, to in zip(rows["place"], rows["successor"], strict=True):
        hit = int(place) in alive
        if hit:
            owner = int(place)
            if not pd.isna(to):
                alive.add(int(to))
        kept.append(hit)
        owners.append(owner)
    return pd.DataFrame({"file": rows["file"], "place": rows["place"].astype("int64"), "reached": kept, "owner": pd.array(owners, dtype="Int64")})


def read_archives(spark: SparkSession, path: str, name: str = "warc") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok
    of every reachable record. payload_digest is that of the payload as read,
    for revisits that of the header; digest_ok says whether the header agrees."""
    scanned = _scanned(spark, path)
    rows = stored(map_arrow(scanned, _candidates, CANDIDATES), f"{name}-candidates")
    per_file = Window.partitionBy("file").orderBy("stretch")
    bases = rows.where("total is not null").select("file", "stretch", (F.sum("total").over(per_file) - F.col("total")).alias("base"))
    moved = [(F.col(c) + F.col("base")).alias(c) for c in ("place", "successor", "outside")]
    rest = [c for c in rows.columns if c not in ("place", "successor", "outside", "total")]
    found = stored(rows.where("total is null").join(bases, ["file", "stretch"]).select(*rest, "base", *moved), f"{name}-found")
    entries = _reached(found, name).withColumn("entry", F.lit(True))
    places = found.select("file", "stretch", "place", "successor").join(entries, ["file", "place"], "left")
    walked = stored(places.groupBy("file", "stretch").applyInPandas(_walked, "file string, place long, reached boolean, owner long"), f"{name}-walked")
    records = found.join(walked.where("reached"), ["file", "place"]).where("record_type is not null")
    cut = records.where("record_type = 'response' and measured is null")
    digest = F.when(F.col("record_type") == "response", F.coalesce("measured", "joined")).otherwise(F.col("digest"))
    if cut.isEmpty():
        records = records.withColumn("joined", F.lit(None).cast("string"))
    else:
        records = records.join(_joined(scanned, found, walked, cut), ["file", "place"], "left")
    return records.select(
        "page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"), digest.eqNullSafe(F.col("digest")).alias("digest_ok")
    )


def _joined(scanned: DataFrame, found: DataFrame, walked: DataFrame, cut: DataFrame) -> DataFrame:
    """(file, place, joined): digests of payloads that hold the magic. Their
    parts are the unreached candidates up to the record's end."""
    spans = cut.select("file", F.col("place").alias("begun"), F.col("successor").alias("end"), "header", "length")
    inside = walked.where("not reached and owner is not null").select("file", "place", F.col("owner").alias("begun"))
    # heads of stretches have no reached candidate before them in the stretch: they belong to the record that spans their place
    heads = walked.where("not reached and owner is null").join(spans, "file").where("begun < place and place < end").select("file", "place", "begun")
    own = spans.select("file", F.col("begun").alias("place"), "begun")
    parts = own.union(inside).union(heads).join(spans, ["file", "begun"]).where("place < end")
    wanted = parts.join(found.select("file", "place", "stretch", (F.col("place") - F.col("base")).alias("at")), ["file", "place"])

    def run(batches):
        schema = _schema("file string, stretch long, at long, segment binary")
        for file, stretch, at, segment in _segments(batches):
            if segment is not None and at is not None:
                yield pa.RecordBatch.from_pylist([{"file": file, "stretch": stretch, "at": at, "segment": segment}], schema)

    read = map_arrow(scanned, run, "file string, stretch long, at long, segment binary").join(wanted, ["file", "stretch", "at"])
    joined = read.groupBy("file", "begun", "header", "length").agg(F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("parts"))
    payload = F.expr(f"substring(aggregate(slice(parts, 2, size(parts)), parts[0].segment, (a, x) -> concat(a, cast('{MAGIC[:-2]}' || chr(13) || chr(10) as binary), x.segment)), cast(header as int) + 1, cast(length as int))")
    return joined.withColumn("payload", payload).select("file", F.col("begun").alias("place"), F.expr(_base32_sha1("payload")).alias("joined"))


def archived(pages: DataFrame, **columns) -> DataFrame:
    """`pages` written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, **columns)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h,
         max(page_id) OVER (PARTITION BY html) AS best
  FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""
