"""Permit reports: numbered text lines to solar permit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Line patterns of the county report.
HEADER = r"^([A-Z]{1,4}-\d{3,7})\s+.*?\b(\d{2}/\d{2}/\d{4})\s+(\d{3}-\d{3}-\d{2})\b"
FURNITURE = (r"C O U N T Y|BUILDING PERMITS ISSUED|Application No\s+Master No|^\s*Situs\s*$|OwnerName\s+OwnerAddress|"
             r"^\d{2}/\d{2}/\d{4}\s*-\s*\d{2}/\d{2}/\d{4}")
SOLAR = r"(?i)solar|photovolta|\bPV\b"
KILOWATT = r"(?i)(\d{1,4}(?:\.\d{1,2})?)\s*kw"
MOUNT = r"(?i)(ground[- ]?mount|roof[- ]?mount)"


def owning_header(lines: DataFrame, file: str, line_no: str, is_header: str, block: int = 10000) -> DataFrame:
    """Add ``head``: the number of the last header line at or before each line of a file.

    Lines are looked at in blocks, and a block without a header before a line takes the last header
    of the earlier blocks, so no file has to fit into one task.
    """
    d = lines.withColumn("_b", F.floor(F.col(line_no) / block))
    mark = F.when(F.col(is_header), F.col(line_no))
    own = F.max(mark).over(W.partitionBy(file, "_b").orderBy(line_no).rowsBetween(W.unboundedPreceding, 0))
    ends = d.groupBy(file, "_b").agg(F.max(mark).alias("_end"))
    # one row per block of a file
    before = F.max("_end").over(W.partitionBy(file).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    carry = ends.select(file, "_b", before.alias("_carry"))
    return d.withColumn("_own", own).join(carry, [file, "_b"]).withColumn("head", F.coalesce("_own", "_carry")).drop("_own", "_carry", "_b")


def parse_permits(lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """Solar permits from report lines; a record runs from its header to the next header."""
    kept = lines.filter(~F.col(text).rlike(FURNITURE)).withColumn(text, F.rtrim(text))
    kept = kept.withColumn("_h", F.col(text).rlike(HEADER))
    owned = owning_header(kept, file, line_no, "_h").filter("head IS NOT NULL")
    # one permit is a handful of lines
    body = owned.groupBy(file, "head").agg(F.array_sort(F.collect_list(F.struct(line_no, text))).alias("b"))
    body = body.withColumn("lines", F.transform("b", lambda r: r[text])).withColumn("blob", F.array_join("lines", " "))
    first = F.element_at("lines", 1)
    kw, mount = F.regexp_extract("blob", KILOWATT, 1), F.regexp_extract("blob", MOUNT, 1)
    year = F.regexp_extract(F.col(file), r"(20\d{2})", 1)
    return body.filter(F.col("blob").rlike(SOLAR)).select(
        F.when(year != "", year.cast("int")).alias("year"), F.regexp_extract(first, HEADER, 1).alias("app_no"),
        F.regexp_extract(first, HEADER, 2).alias("date_issued"), F.regexp_extract(first, HEADER, 3).alias("apn"),
        F.when(kw != "", kw.cast("double")).alias("kw"),
        F.when(mount != "", F.regexp_replace(F.lower(mount), " ", "-")).alias("mount"),
        F.trim(F.coalesce(F.try_element_at("lines", F.lit(2)), F.lit(""))).alias("situs_raw"),
        F.col("blob").alias("description"), F.col(file).alias("source_file"))


def issued_date(text):
    """MM/dd/yyyy text to a date; unreadable text is null."""
    return F.to_date(F.try_to_timestamp(text, F.lit("MM/dd/yyyy")))
