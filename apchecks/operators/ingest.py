"""Rules for uploaded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes (hexadecimal) of the allowed types.
MAGIC = {
    "255044462D": "application/pdf",
    "89504E470D0A1A0A": "image/png",
    "FFD8FF": "image/jpeg",
    "49492A00": "image/tiff",
    "4D4D002A": "image/tiff",
}
MIN_TEXT_CHARS = 20


def detect_mime(content: Column) -> Column:
    """The type by the first bytes, never by the name; null for other types."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for start, mime in MAGIC.items():
        out = F.when(head.startswith(start), mime).otherwise(out)
    return out


def safe_name(name: Column, longest: int = 200) -> Column:
    base = F.substring_index(F.regexp_replace(name, r"\\", "/"), "/", -1)
    clean = F.regexp_replace(base, r"[\p{C}<>:\"|?*]", "")
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, longest), F.lit("")), F.lit("upload"))


def check_uploads(files: DataFrame, max_bytes: int, max_pages: int = 10) -> DataFrame:
    """Accept or reject ``files`` (file_id, name, content binary, pages int, text_chars), in a fixed order of tests."""
    size, mime = F.octet_length("content"), detect_mime(F.col("content"))
    code = (
        F.when(size <= 0, "EMPTY_FILE").when(size > max_bytes, "FILE_TOO_LARGE").when(mime.isNull(), "UNSUPPORTED_FILE_TYPE")
        .when(F.col("pages") <= 0, "UNREADABLE_FILE").when(F.col("pages") > max_pages, "TOO_MANY_PAGES")
    )
    quality = (
        F.when((mime == "application/pdf") & (F.col("text_chars") >= MIN_TEXT_CHARS), "clean").when(F.col("text_chars") == 0, "unknown")
        .when(mime == "application/pdf", "scanned").otherwise("photo")
    )
    return files.select(
        "file_id", safe_name(F.col("name")).alias("name"), size.cast("long").alias("size"), mime.alias("mime"), code.alias("rejected"),
        F.when(code.isNull(), quality).alias("doc_quality"), F.sha2("content", 256).alias("sha256"),
    )
