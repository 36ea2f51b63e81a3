"""Metadata of files: codes, brokers, report types, dates, recovered payloads, image sizes, signatures, migration."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plans.registry import query
from docloom.session import table

#: Patterns of names with codes, of codes alone, of dates written as digits, and of brokers. Fixed values.
NAMED_CODE = r"([一-鿿A-Za-z0-9*]{2,12})[（(]([0-9]{6})[)）]"
BARE_CODE = r"(?<![0-9])([0-9]{6})(?![0-9])"
DIGIT_DATE = r"(?<![0-9])20[0-9]{6}(?![0-9])"
BROKER = r"([一-鿿]{2,6}证券)"


def _first(*found: Column) -> Column:
    """The first that isn't empty; empty if none."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def report_fields(filename: Column, title: Column) -> Column:
    """struct<security_code, security_name, broker, report_type>; the file name comes before the title, unknown is empty."""
    scopes = [F.coalesce(c, F.lit("")) for c in (filename, title)]
    bare = [F.regexp_extract(F.regexp_replace(s, DIGIT_DATE, " "), BARE_CODE, 1) for s in scopes]
    code = _first(*[F.regexp_extract(s, NAMED_CODE, 2) for s in scopes], *bare)
    both = F.concat_ws(" ", *scopes)
    kind = F.when(F.contains(both, F.lit("宏观")), "宏观").when(F.contains(both, F.lit("行业")), "行业").when(code != "", "个股").otherwise("")
    return F.struct(
        code.alias("security_code"),
        _first(*[F.regexp_extract(s, NAMED_CODE, 1) for s in scopes]).alias("security_name"),
        _first(*[F.regexp_extract(s, BROKER, 1) for s in scopes]).alias("broker"),
        kind.alias("report_type"),
    )


def filled(known: Column, guessed: Column) -> Column:
    """Rules win; a model's guess fills what they left empty."""
    return _first(known, F.coalesce(guessed, F.lit("")))


def json_payload(reply: Column) -> Column:
    """The fields in the outermost braces of a reply, as a map; an inner ``metadata`` object is taken out. Null if none."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    inner = F.coalesce(F.get_json_object(body, "$.metadata"), body)
    return F.from_json(F.nullif(inner, F.lit("")), "map<string,string>")


def filename_date(name: Column) -> Column:
    """yyyy-mm-dd from eight digits, year-month-day, year-month or a year, in this order; null if none is valid."""
    year = r"(?<![0-9])((?:19|20)[0-9]{2})"
    forms = [
        (year + "([0-9]{2})([0-9]{2})(?![0-9])", 3),
        (year + r"[-_.年]([0-9]{1,2})[-_.月]([0-9]{1,2})(?![0-9])", 3),
        (year + r"[-_.年]([0-9]{1,2})(?![0-9])", 2),
        (year + "(?![0-9])", 1),
    ]

    def dated(pattern: str, groups: int) -> Column:
        y, *rest = [F.regexp_extract(name, pattern, k + 1) for k in range(groups)]
        m, d = [*rest, F.lit("1"), F.lit("1")][:2]
        valid = (y != "") & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
        return F.when(valid, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

    return F.coalesce(*[dated(*f) for f in forms])


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF or JPEG image; None for anything else or a broken header."""
    data = bytes(data or b"")
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return struct.unpack_from(">II", data, 16)
        if data.startswith((b"GIF87a", b"GIF89a")):
            return struct.unpack_from("<HH", data, 6)
        at = 2 if data.startswith(b"\xff\xd8") else len(data)
        while (at := data.find(b"\xff", at)) >= 0:
            kind = data[at + 1]
            if kind == 0xD9:
                return None
            if kind in (0x00, 0x01, 0xFF) or 0xD0 <= kind <= 0xD8:  # fill bytes and markers without a length
                at += 1 if kind == 0xFF else 2
                continue
            (length,) = struct.unpack_from(">H", data, at + 2)
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
                height, width = struct.unpack_from(">HH", data, at + 5)
                return width, height
            at += 2 + length
    except (struct.error, IndexError):
        pass
    return None


def with_image_size(images: DataFrame, content: str = "content") -> DataFrame:
    """Adds width and height, null where the header says nothing; only the column of bytes goes to Python."""

    @F.pandas_udf("width int, height int")
    def measured(data: pd.Series) -> pd.DataFrame:
        sizes = [image_size(x) or (None, None) for x in data]
        return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")

    return images.withColumn("_size", measured(content)).select(*images.columns, "_size.width", "_size.height")


def _pads(secret: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """The HMAC of a message in hexadecimal, from built-in functions: two rounds of SHA-256 over padded keys."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in _pads(secret))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def migrated(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The rows with exactly the wanted columns (name: SQL expression for those that are missing); others are dropped."""
    return rows.select(*[F.col(c) if c in rows.columns else F.expr(default).alias(c) for c, default in wanted.items()])


_NAME = """CASE doc_id % 5 WHEN 0 THEN concat('贵州茅台(600', lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), ')-中信证券-点评') WHEN 1 THEN '行业周报_20260815_海通证券'
 WHEN 2 THEN concat('深度 300', lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), ' 20260815') WHEN 3 THEN '宏观策略' ELSE 'note' END"""


@query(
    "report_fields",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '600' || lpad((doc_id % 1000)::VARCHAR, 3, '0') WHEN 2 THEN '300' || lpad((doc_id % 1000)::VARCHAR, 3, '0') ELSE '' END AS security_code,
 CASE doc_id % 5 WHEN 0 THEN '贵州茅台' ELSE '' END AS security_name, CASE doc_id % 5 WHEN 0 THEN '中信证券' WHEN 1 THEN '海通证券' ELSE '' END AS broker,
 CASE doc_id % 5 WHEN 0 THEN '个股' WHEN 1 THEN '行业' WHEN 2 THEN '个股' WHEN 3 THEN '宏观' ELSE '' END AS report_type FROM documents""",
)
def q_report_fields(spark, sf_dir):
    """Fields of made-up file names."""
    return table(spark, sf_dir, "documents").select("doc_id", report_fields(F.expr(_NAME), F.lit(None).cast("string")).alias("m")).select("doc_id", "m.*")


@query("json_payload", "SELECT doc_id, lang, source FROM documents")
def q_payload(spark, sf_dir):
    """Languages and sources, read back from noisy replies."""
    d = table(spark, sf_dir, "documents")
    reply = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.struct("lang", "source").alias("metadata"))), F.lit("\n``` done"))
    return d.select("doc_id", json_payload(reply).alias("m")).select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))


_DAY = ["CAST(2000 + o_orderkey % 25 AS STRING)", "lpad(CAST(1 + o_orderkey % 14 AS STRING), 2, '0')", "lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')"]
_FILE = f"concat('r', CAST(o_orderkey % 2 AS STRING), '_', CASE o_orderkey % 3 WHEN 0 THEN concat({_DAY[0]}, {_DAY[1]}, {_DAY[2]}) WHEN 1 THEN concat({_DAY[0]}, '-', {_DAY[1]}, '-', {_DAY[2]}) ELSE concat({_DAY[0]}, '.', {_DAY[1]}) END, '.pdf')"


@query(
    "filename_date",
    f"""SELECT o_orderkey, CASE WHEN m <= '12' THEN y || '-' || m || '-' || CASE WHEN k = 2 THEN '01' ELSE d END WHEN k <> 0 THEN y || '-01-01' END AS day
FROM (SELECT o_orderkey, o_orderkey % 3 AS k, {_DAY[0]} AS y, {_DAY[1]} AS m, {_DAY[2]} AS d FROM orders)""",
)
def q_filename_date(spark, sf_dir):
    """Dates of made-up file names, some with months that don't exist, of which only the year is good."""
    return table(spark, sf_dir, "orders").select("o_orderkey", filename_date(F.expr(_FILE)).alias("day"))


_INNER, _OUTER = (p.hex() for p in _pads(b"event secret"))


@query("event_signatures", f"SELECT event_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(props)))) AS signature FROM events")
def q_signatures(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hmac_sha256(F.col("props"), b"event secret").alias("signature"))


@query("schema_migration", "SELECT doc_id, source, source || '#' || doc_id AS parent_id, true AS is_current, '' AS version FROM documents")
def q_migration(spark, sf_dir):
    wanted = {"doc_id": "null", "source": "''", "parent_id": "concat(source, '#', doc_id)", "is_current": "true", "version": "''"}
    return migrated(table(spark, sf_dir, "documents"), wanted)
