"""Raw pages and files: bytes to text by the charset that they declare or that their bytes show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Single-byte code pages and the bytes from which on they differ from ISO-8859-1.
CODE_PAGES = {"windows-1251": 0x80, "windows-1252": 0x80, "koi8-r": 0x80}
#: Other names of charsets; fixed values.
ALIASES = {"cp1251": "windows-1251", "win-1251": "windows-1251", "cp1252": "windows-1252", "latin1": "iso-8859-1", "latin-1": "iso-8859-1", "utf8": "utf-8", "us-ascii": "utf-8", "ascii": "utf-8", "koi8r": "koi8-r"}
#: Bytes at the beginning of which a declaration may stand.
_HEAD = 1024


def code_page_letters(name: str) -> tuple[str, str]:
    """The characters of ISO-8859-1 and those that the same bytes stand for in a code page; bytes it lacks are left out."""
    pairs = []
    for byte in range(CODE_PAGES[name], 256):
        try:
            pairs.append((chr(byte), bytes([byte]).decode(name)))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def declared_charset(content: Column) -> Column:
    """The charset that a byte order mark or the head of a page names, in lower case; null if none."""
    mark = F.hex(F.substring(content, 1, 3))
    head = F.decode(F.substring(content, 1, _HEAD), "ISO-8859-1")
    named = F.lower(F.regexp_extract(head, r"""(?i)(?:charset|encoding)\s*=\s*["']?\s*([\w.:-]+)""", 1))
    named = F.coalesce(*[F.when(named == alias, name) for alias, name in ALIASES.items()], named)
    return F.when(mark == "EFBBBF", "utf-8").when(mark.startswith("FFFE") | mark.startswith("FEFF"), "utf-16").when(named != "", named)


def charset_of(content: Column, declared: Column, fallback: str = "windows-1251") -> Column:
    """``declared`` if it is known and possible, else utf-8 if the bytes are valid UTF-8, else ``fallback``."""
    known = ["utf-8", "iso-8859-1", *CODE_PAGES]
    possible = declared.isin(known) | ((declared == "utf-16") & (F.octet_length(content) % 2 == 0))
    return F.when(possible, declared).when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise(fallback)


def decoded(content: Column, charset: Column) -> Column:
    """The text of the bytes; what is no character becomes U+FFFD in utf-8 and stays as it is in code pages."""
    latin = F.decode(content, "ISO-8859-1")
    text = F.when(charset == "utf-8", F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\ufeff", ""))
    for name in CODE_PAGES:
        text = text.when(charset == name, F.translate(latin, *code_page_letters(name)))
    return text.when(charset == "utf-16", F.decode(content, "UTF-16")).otherwise(latin)


def content_type(content: Column, name: Column) -> Column:
    """By the first bytes, else by the name's ending, else unknown bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    ending = F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))
    return (
        F.when(F.hex(F.substring(content, 1, 4)) == "25504446", "application/pdf")
        .when(head.rlike(r"^[^<]{0,8}\s*<(!doctype|html|head|body|meta|div|p)\b"), "text/html")
        .when(ending.isin("htm", "html"), "text/html")
        .when(ending == "txt", "text/plain")
        .when(ending == "json", "application/json")
        .otherwise("application/octet-stream")
    )


def raw_documents(pages: DataFrame, doc_id: Column, url: Column, content: str, metadata: Column) -> DataFrame:
    """(doc_id, url, content_type, charset, text, metadata) of rows with a binary column.

    ``metadata`` is a map of strings. Types other than text have a null charset and text; null bytes
    are an empty document. All is done in columns, in the pass that reads the bytes.
    """
    data = F.coalesce(F.col(content), F.lit(b""))
    kind = content_type(data, url)
    charset = F.when(kind.startswith("text/") | (kind == "application/json"), charset_of(data, declared_charset(data)))
    told = pages.select(doc_id.alias("doc_id"), url.alias("url"), kind.alias("content_type"), charset.alias("charset"), data.alias("_data"), metadata.alias("metadata"))
    return told.select("doc_id", "url", "content_type", "charset", F.when(F.col("charset").isNotNull(), decoded(F.col("_data"), F.col("charset"))).alias("text"), "metadata")


def load_raw_files(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """:func:`raw_documents` of the files below ``folder`` whose names match; the id is the file's name without its ending. Empty files are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.\w+)?$", 1)
    told = F.map_from_arrays(F.array(F.lit("length"), F.lit("modified")), F.array(F.col("length").cast("string"), F.col("modificationTime").cast("string")))
    return raw_documents(files, name, F.col("path"), "content", told)
