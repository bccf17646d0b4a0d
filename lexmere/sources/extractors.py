"""Contents become texts by format: a registry of extractors, each one branch of the plan.

An extractor takes rows (id, filename, content) of its format and returns
(id, text_content, page_offsets, error_message) for each; the id is handed on as it is. Rows are routed once into a
table with a folder for each format, so a branch reads its own rows only, and
what its function costs is not paid by other formats. A row that its extractor
cannot read stays, with the error in its row; it stops no other row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.functions import scalars as S
from lexmere.functions.arrays import running_sums
from lexmere.session import stored

Extractor = Callable[[DataFrame], DataFrame]
#: Rows of formats that no extractor is registered for go to this one.
DEFAULT = "plain_text"
#: Extensions and mime types of formats whose name they are not.
EXTENSIONS = {"txt": "plain_text", "md": "plain_text", "text": "plain_text", "htm": "html"}
MIMES = {"application/pdf": "pdf", "text/html": "html", "application/json": "json"}


def format_of(filename: Column, mime: Column | None = None) -> Column:
    """The format key: by extension, which names its own format unless EXTENSIONS says another; without one by mime type; else DEFAULT."""
    ext = F.substring(S.extension(F.coalesce(filename, F.lit(""))), 2, 1 << 20)
    named = F.coalesce(*[F.when(ext == e, f) for e, f in EXTENSIONS.items()], F.when(ext != "", ext))
    if mime is None:
        return F.coalesce(named, F.lit(DEFAULT))
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return F.coalesce(named, *[F.when(kind == m, f) for m, f in MIMES.items()], F.lit(DEFAULT))


def _result(text: Column, error: Column, pages: Column | None = None) -> list[Column]:
    whole = F.array(F.lit(0), F.length(text))
    return ["id", text.alias("text_content"), F.when(text.isNotNull(), pages if pages is not None else whole).alias("page_offsets"), F.when(text.isNull(), error).alias("error_message")]


def _utf8() -> Column:
    return F.try_validate_utf8(F.col("content").cast("string"))


def plain_text(rows: DataFrame) -> DataFrame:
    """UTF-8 text, on one page or on those that form feeds part; page i from 1 on begins at the sum of earlier lengths plus i - 1."""
    d = rows.withColumn("t", _utf8()).withColumn("n", F.transform(F.split("t", chr(12)), F.length))
    ends = F.transform(running_sums(F.col("n")), lambda e, i: (e + i).cast("int"))
    pages = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size("n") - 1), F.array(F.length("t")))
    return d.select(*_result(F.col("t"), F.lit("the content is not valid UTF-8"), pages))


def html(rows: DataFrame) -> DataFrame:
    """The text of a page: scripts, styles, comments and tags go, five named entities are read, white space is one blank."""
    t = F.regexp_replace(F.col("t"), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"<[^<>]*+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    kept = F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))
    return rows.withColumn("t", _utf8()).withColumn("t", kept).select(*_result(F.col("t"), F.lit("the content is not valid UTF-8")))


def json_text(path: str = "$.text") -> Extractor:
    """The text at a path of a JSON document."""
    return lambda rows: rows.withColumn("t", F.get_json_object(_utf8(), path)).select(*_result(F.col("t"), F.lit(f"no JSON with a text at {path}")))


def per_blob(read: Callable[[bytes, str], tuple[str, list[int]]]) -> Extractor:
    """An extractor out of a function (content, filename) -> (text, page offsets), for formats that need a Python library. What it raises is that row's error."""

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, name, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    if content is None:
                        raise ValueError("no content")
                    text, pages = read(content, name or "")
                    error = None
                except Exception as e:  # noqa: BLE001  a row that cannot be read is kept with its error
                    text, pages, error = None, None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([key], b.column(0).type), pa.array([text], pa.string()), pa.array([pages], pa.list_(pa.int32())), pa.array([error], pa.string())], names=["id", "text_content", "page_offsets", "error_message"])

    return lambda rows: rows.select("id", "filename", "content").mapInArrow(extracted, f"id {rows.schema['id'].dataType.simpleString()}, text_content string, page_offsets array<int>, error_message string")


EXTRACTORS: dict[str, Extractor] = {"plain_text": plain_text, "html": html, "json": json_text()}


def extracted(rows: DataFrame, extractors: Mapping[str, Extractor] = EXTRACTORS, default: str = DEFAULT) -> DataFrame:
    """(id, filename, content, mime_type?) -> (id, doc_format, extractor, text_content, page_offsets, error_message), every row once.

    doc_format is what the row's name says, extractor the registered format
    that read it: `default` for formats that are not registered. Rows that
    could not be read have a null text and an error; null contents count as
    such; rows that an extractor leaves out come back with an error, and rows
    that repeat an id are read each for itself. Empty tables: empty result.
    Columns of other names are dropped before extractors see the rows.
    """
    if default not in extractors:
        raise ValueError(f"no extractor is registered for {default}")
    mime = F.col("mime_type") if "mime_type" in rows.columns else None
    found = format_of(F.col("filename"), mime)
    reader = F.when(found.isin(*extractors), found).otherwise(default)
    # extractors see a row's id, format and number as one value that they hand on
    key = F.struct(F.col("id").alias("id"), found.alias("doc_format"), F.monotonically_increasing_id().alias("row"))
    routed = stored(rows.select(key.alias("id"), "filename", "content", reader.alias("extractor")), by=["extractor"])
    out = None
    for name, extractor in extractors.items():
        own = routed.where(F.col("extractor") == name).select("id", "filename", "content")
        read = extractor(own).select("id", F.lit(name).alias("extractor"), "text_content", F.col("page_offsets").cast("array<int>"), "error_message")
        out = read if out is None else out.unionByName(read)
    out = stored(out)
    lost = routed.select("id", "extractor").join(out.select("id.row"), F.col("id.row") == F.col("row"), "left_anti")
    none = lost.select("id", "extractor", F.lit(None).cast("string").alias("text_content"), F.lit(None).cast("array<int>").alias("page_offsets"), F.lit("the extractor returned no row").alias("error_message"))
    error = F.when(F.col("text_content").isNull(), F.coalesce("error_message", F.lit("no text")))
    return out.unionByName(none).select("id.id", "id.doc_format", "extractor", "text_content", "page_offsets", error.alias("error_message"))
