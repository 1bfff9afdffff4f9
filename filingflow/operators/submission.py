"""Submission bundles as rows: header fields, documents, content kinds and decoded payloads.

All but uuencoding is native; a bundle is one row of ``filing_id, submission``.
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Fixed value: the header keys that are kept and the names they get.
HEADER_FIELDS = {
    "ACCESSION NUMBER": "accession_number",
    "CONFORMED SUBMISSION TYPE": "submission_type",
    "PUBLIC DOCUMENT COUNT": "public_document_count",
    "CONFORMED PERIOD OF REPORT": "period_of_report",
    "FILED AS OF DATE": "filed_as_of_date",
    "COMPANY CONFORMED NAME": "company_name",
    "CENTRAL INDEX KEY": "cik",
    "STANDARD INDUSTRIAL CLASSIFICATION": "sic",
    "FISCAL YEAR END": "fiscal_year_end",
}

#: Fixed value: file extensions by kind.
HTML, IMAGE = (".htm", ".html", ".xhtml"), (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")
BINARY = (".zip", ".xlsx", ".xls", ".pdf", ".doc", ".docx")


def as_text(content: Column) -> Column:
    """Bytes as text: damaged UTF-8 as U+FFFD, every line break as one newline."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def header_fields(text: Column) -> Column:
    """The kept header fields as a map; of repeated keys the first stands, even if empty; no header gives an empty map."""
    body = F.regexp_extract(text, r"(?is)<SEC-HEADER[^>]*>(.*?)</SEC-HEADER>", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.upper(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.regexp_replace(F.regexp_extract(x, r"(?s)\A[^:]*:(.*)\z", 1), r"(?U)\A\s+|\s+\z", "").alias("v")))
    known = F.create_map(*[F.lit(x) for kv in HEADER_FIELDS.items() for x in kv])
    kept = F.filter(pairs, lambda p: F.array_contains(F.array(*map(F.lit, HEADER_FIELDS)), p["k"]))
    empty = F.array().cast("array<struct<k:string,v:string>>")
    first = F.aggregate(kept, empty, lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(F.element_at(known, p["k"]).alias("key"), p["v"].alias("value"))))


def document_field(block: Column, name: str) -> Column:
    """The first line-anchored value of a tag; an empty tag takes the next line's text, as white space may span lines."""
    return F.regexp_extract(block, rf"(?imdU)^\s*<{name}>\s*(.*?)\s*$", 1)


def text_body(block: Column) -> Column:
    return F.regexp_extract(block, r"(?isU)<TEXT>\s*(.*?)\s*</TEXT>", 1)


def content_kind(filename: Column, doc_type: Column) -> Column:
    """The kind by extension and type, in a fixed order of rules."""
    name = F.substring_index(filename, "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"(?s)[^.](\.[^.]+)\z", 1))
    kind = F.upper(doc_type)
    return (
        F.when(suffix.isin(*HTML), "html")
        .when(suffix.isin(*IMAGE) | (kind == "GRAPHIC"), "image")
        .when((suffix == ".xsd") | F.startswith(kind, F.lit("EX-101")), "xbrl")
        .when(suffix == ".xml", "xml")
        .when(suffix == ".txt", "text")
        .when(suffix.isin(*BINARY), "binary")
        .otherwise("unknown")
    )


def split_documents(submissions: DataFrame) -> DataFrame:
    """filing_id, doc_ordinal, sequence, doc_type, filename, description, text, content_kind, error per document.

    A document without a filename, or whose filename would leave its folder, has an error instead of failing the bundle.
    """
    blocks = submissions.select("filing_id", F.posexplode(F.regexp_extract_all("submission", F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))).alias("doc_ordinal", "block"))
    # tags stand in front of the body, as a rule; a tag that does not is looked for in the whole block
    head = F.regexp_extract("block", r"(?isd)\A(.*?<TEXT>[^\n]*)", 1)
    cut = blocks.withColumn("head", F.when(head == "", F.col("block")).otherwise(head))

    def field(tag: str) -> Column:
        return F.when(F.col("head").rlike(rf"(?imdU)^\s*<{tag}>"), document_field(F.col("head"), tag)).otherwise(document_field(F.col("block"), tag))

    out = cut.select(
        "filing_id", "doc_ordinal", F.trim(field("SEQUENCE")).try_cast("int").alias("sequence"),
        field("TYPE").alias("doc_type"), field("FILENAME").alias("filename"), field("DESCRIPTION").alias("description"), text_body(F.col("block")).alias("text"),
    )
    name = F.col("filename")
    error = F.when(name == "", "missing filename").when(name.rlike(r"[/\\]") | name.isin(".", ".."), "unsafe filename")
    return out.withColumn("content_kind", content_kind(name, F.col("doc_type"))).withColumn("error", error)


_BEGIN = re.compile(r"^begin\s+\d{3,4}\s+\S+", re.MULTILINE)


def _uudecode(text: str) -> bytes | None:
    """The bytes of the first uuencoded block, tolerating trailing garbage on its lines; None if it is none."""
    found = _BEGIN.search(text)
    if not found:
        return None
    out = []
    for line in text[found.end() :].split("\n")[1:]:
        if not line.strip():
            continue
        if line.strip() == "end":
            break
        try:
            raw = line.encode("ascii")
            try:
                out.append(binascii.a2b_uu(raw))
            except binascii.Error:
                size = (((raw[0] - 32) & 63) * 4 + 5) // 3
                out.append(binascii.a2b_uu(raw[:size]))
        except (UnicodeEncodeError, binascii.Error):
            return None
    return b"".join(out)


@F.pandas_udf(BinaryType())
def uudecode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: _uudecode(x) if isinstance(x, str) else None)


def strict_base64(text: Column) -> Column:
    """The bytes of strictly valid base64, white space aside, else null."""
    packed = F.regexp_replace(text, SPACE, "")
    return F.when((F.length(packed) % 4 == 0) & packed.rlike(r"^[A-Za-z0-9+/]*={0,2}\z"), F.try_to_binary(packed, F.lit("base64")))


SPACE = r"(?U)[\s\x1c-\x1f]+"


def decode_payloads(documents: DataFrame) -> DataFrame:
    """filing_id, doc_ordinal, payload, decode_status, size. Only texts with a begin line reach the Python function.

    Uuencoding is tried for every kind, base64 for images and other binaries; these fall back to their raw bytes. The size
    of a decoded payload is in bytes, that of a text in characters.
    """
    looks = F.col("text").rlike(r"(?m)^begin\s+\d{3,4}\s+\S+")
    with_uu = documents.withColumn("_uu", F.when(looks, uudecode(F.when(looks, F.col("text")))))
    binary = F.col("content_kind").isin("image", "binary")
    plain = F.col("text").cast("binary")
    b64 = F.when(binary, strict_base64(F.col("text")))
    out = with_uu.withColumn("_b64", b64)
    status = F.when(F.col("_uu").isNotNull(), "uuencode").when(F.col("_b64").isNotNull(), "base64").when(binary, "raw").otherwise("text")
    size = F.when(status == "text", F.char_length("text")).otherwise(F.octet_length(F.coalesce("_uu", "_b64", plain)))
    return out.select("filing_id", "doc_ordinal", F.coalesce("_uu", "_b64", plain).alias("payload"), status.alias("decode_status"), size.cast("long").alias("size"))


def manifests(submissions: DataFrame, documents: DataFrame, payloads: DataFrame) -> DataFrame:
    """filing_id, manifest: one JSON text per filing, its documents in order."""
    sized = documents.join(payloads.select("filing_id", "doc_ordinal", "decode_status", "size"), ["filing_id", "doc_ordinal"])
    item = F.struct("doc_ordinal", "sequence", F.col("doc_type").alias("type"), "filename", "description", "content_kind", "decode_status", "size")
    listed = sized.groupBy("filing_id").agg(F.sort_array(F.collect_list(item)).alias("documents"))
    head = submissions.select("filing_id", header_fields(F.col("submission")).alias("filing"))
    return head.join(listed, "filing_id", "left").select("filing_id", F.to_json(F.struct(F.col("filing_id").alias("source"), "filing", "documents")).alias("manifest"))
