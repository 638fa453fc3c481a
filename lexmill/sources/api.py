"""Documents from pages of a publication API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import parse_api_date

# Column, field of an item, type in JSON ("date" is text that holds an ISO date).
API_COLUMNS = [
    ("eo_number", "eoNumber", "string"),
    ("title", "title", "string"),
    ("name", "name", "string"),
    ("complex_name", "complexName", "string"),
    ("document_number", "number", "string"),
    ("document_date", "documentDate", "date"),
    ("publish_date", "publishDateShort", "date"),
    ("view_date", "viewDate", "string"),
    ("pages_count", "pagesCount", "int"),
    ("pdf_file_size", "pdfFileLength", "bigint"),
    ("has_svg", "hasSvg", "boolean"),
    ("zip_file_length", "zipFileLength", "bigint"),
    ("jd_reg_number", "jdRegNumber", "string"),
    ("jd_reg_date", "jdRegDate", "date"),
    ("signatory_authority_id", "signatoryAuthorityId", "string"),
    ("document_type_id", "documentTypeId", "string"),
]


def load_api_documents(pages: DataFrame, json_col: str, country_id: Column | int, block_id: Column | str | None, loaded_at: Column) -> DataFrame:
    """One row per item of every ``{"items": [...]}`` page, in the columns of the documents table.

    Fields that are missing are null, ``has_svg`` false; dates that are none are null. Pages that are
    null, no JSON or without items give no row. Repeated items stay: the merge on ``eo_number`` follows.
    """
    item = ",".join(f"{field}:{'string' if kind == 'date' else kind}" for _, field, kind in API_COLUMNS)
    column = lambda c: c if isinstance(c, Column) else F.lit(c)
    given = {"publication_block_id": column(block_id).cast("string"), "country_id": column(country_id), "created_at": loaded_at, "updated_at": loaded_at}
    items = pages.select(F.explode(F.from_json(json_col, f"items array<struct<{item}>>")["items"]).alias("_item"), *[c.alias(name) for name, c in given.items()])
    read = {name: parse_api_date(F.col(f"_item.{field}")) if kind == "date" else F.col(f"_item.{field}") for name, field, kind in API_COLUMNS}
    read["has_svg"] = F.coalesce(read["has_svg"], F.lit(False))
    return items.select(*[c.alias(name) for name, c in read.items()], *given)
