"""Amendments applied to articles, versions compared, texts cut into chunks and encoded."""

from __future__ import annotations

import collections
import difflib
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import content, html
from lexmill.functions.legal import replace_first
from lexmill.operators.paragraphs import judge_paragraphs
from lexmill.operators.versions import KEY

#: Places where a chunk may end, in the order in which they are tried; fixed values.
CHUNK_ENDS = (". ", "! ", "? ", "\n", ".\n", "!\n", "?\n")
#: Namespace of X.500 names, for chunk ids.
X500 = "6ba7b8149dad11d180b400c04fd430c8"


def replace_text(text: str, old: str, new: str, least: float = 0.8) -> str | None:
    """The first exact occurrence replaced, else the first run of as many words that is similar enough; None if there is none.

    A similar run leaves the words joined by one space. The similarity is at most twice the characters
    that run and ``old`` have in common, in any order, over their lengths together. That bound is kept
    up as the run moves on by a word, and only runs that it lets through are compared.
    """
    if old in text:
        return text.replace(old, new, 1)
    words, size = text.split(), len(old.split())
    wanted, held = collections.Counter(old), collections.Counter()
    spaces, common, length = min(wanted.pop(" ", 0), size - 1), 0, size - 1
    for last, word in enumerate(words if size else ()):
        for c in word:
            common += held[c] < wanted[c]
            held[c] += 1
        length += len(word)
        if last >= size:
            for c in words[last - size]:
                held[c] -= 1
                common -= held[c] < wanted[c]
            length -= len(words[last - size])
        first = last + 1 - size
        if first >= 0 and 2 * (common + spaces) >= least * (length + len(old)) * (1 - 1e-12):
            if difflib.SequenceMatcher(None, " ".join(words[first : last + 1]), old).ratio() >= least:
                return " ".join([*words[:first], new, *words[last + 1 :]])
    return None


def _folded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Snapshots of sorted rows (code, article, day, is_base, kind, old, new), one for each day that changes an article."""
    for key, changes in itertools.groupby(rows, key=lambda r: r[:2]):
        text, repealed, waiting = None, None, None
        for day, on_day in itertools.groupby(changes, key=lambda r: None if r[3] else r[2]):
            results = []
            for _, _, _, is_base, kind, old, new in on_day:
                if is_base:
                    text = new or ""
                    continue
                if kind == "addition":
                    text, repealed, done = new or "", None, True
                elif kind == "repeal":
                    done = text is not None
                    repealed = day if done else repealed
                else:
                    after = None if text is None else f"{text}\n{new or ''}" if old is None else replace_text(text, old, new or "")
                    done = after is not None
                    text = after if done else text
                results.append(done)
            if day is not None and text is not None:
                if waiting:
                    yield (*waiting, False)
                waiting = (*key, day, text, repealed, sum(results), len(results) - sum(results))
        if waiting:
            yield (*waiting, waiting[4] is None)


def consolidate(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshots of every amended article: (code_id, article_number, version_date, text, repealed_date,
    n_applied, n_failed, is_current, is_repealed, text_hash).

    ``base`` has (code_id, article_number, text), one row for each article, and ``changes`` (code_id,
    article_number, version_date, eo, old, new) and, if it likes, kind. An "addition" sets the article
    to ``new`` whether or not it is there, a "repeal" keeps the text and ends the article; both fail
    never but for the repeal of an unknown article. Anything else is a modification: a null ``old``
    adds a line, a null ``new`` removes. Changes are applied by date and eo, one snapshot for each
    date; those without a date are left out. The last snapshot is current unless it is repealed. An
    article that is not in ``base`` has no snapshot before its addition.

    The order inside an article is essential. A task reads its articles as one sorted stream and holds
    one text, not an article's changes.
    """
    kind = F.col("kind") if "kind" in changes.columns else F.lit(None).cast("string")
    texts = base.select(*KEY, F.lit(None).cast("date").alias("version_date"), F.lit(None).cast("long").alias("eo"), F.lit(True).alias("is_base"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("old"), F.col("text").alias("new"))
    steps = changes.filter("version_date is not null").select(*KEY, "version_date", F.col("eo").cast("long"), F.lit(False).alias("is_base"), kind.alias("kind"), "old", "new")
    # A base text without changes gives no snapshot and needs no special treatment.
    order = [*KEY, F.desc("is_base"), "version_date", "eo", "kind", "old", "new"]
    columns = ["code_id", "article_number", "version_date", "is_base", "kind", "old", "new"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (tuple(None if v is None or v != v else v for v in r) for b in batches for r in b[columns].itertuples(index=False, name=None))
        names = [*KEY, "version_date", "text", "repealed_date", "n_applied", "n_failed", "is_current"]
        snapshots = _folded(rows)
        while some := list(itertools.islice(snapshots, 1000)):
            yield pd.DataFrame(some, columns=names)

    schema = "code_id string, article_number string, version_date date, text string, repealed_date date, n_applied long, n_failed long, is_current boolean"
    stream = texts.unionByName(steps).repartition(*KEY).sortWithinPartitions(*order)
    return stream.mapInPandas(fold, schema).withColumns({"is_repealed": F.col("repealed_date").isNotNull(), "text_hash": F.md5("text")})


def compare_texts(old: str, new: str, least: int = 50) -> tuple[float, list[str]]:
    """Share of matching characters, and what was replaced, deleted or inserted, each cut at ``least`` characters."""
    if old == new:
        return 1.0, []
    matcher, edits = difflib.SequenceMatcher(None, old, new), []
    for tag, a, b, c, d in matcher.get_opcodes():
        gone, come = f"'{old[a:b][:least]}...'", f"'{new[c:d][:least]}...'"
        edits += {"replace": [f"Replaced: {gone} with {come}"], "delete": [f"Deleted: {gone}"], "insert": [f"Inserted: {come}"]}.get(tag, [])
    return matcher.ratio(), edits


def compare_versions(old: Column, new: Column) -> Column:
    """(changes_detected, changes, similarity) of two versions, each (article_number, text, is_repealed, repealed_date).

    Versions of different articles are not compared: their similarity is 0. A change of status is
    named before the edits. Null texts count as empty.
    """

    @F.pandas_udf("struct<similarity:double,edits:array<string>>")
    def edits(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare_texts(a or "", b or "") for a, b in zip(left, right)], columns=["similarity", "edits"])

    was, now = F.coalesce(old["is_repealed"], F.lit(False)), F.coalesce(new["is_repealed"], F.lit(False))
    note = F.when(now & ~was, F.concat(F.lit("Article repealed on "), F.coalesce(new["repealed_date"].cast("string"), F.lit("None")))).when(was & ~now, "Article reinstated")
    same = old["article_number"].eqNullSafe(new["article_number"])
    other = F.array(F.concat(F.lit("Different articles: "), F.coalesce(old["article_number"], F.lit("")), F.lit(" vs "), F.coalesce(new["article_number"], F.lit(""))))
    found = edits(F.when(same, old["text"]), F.when(same, new["text"]))
    changes = F.when(same, F.concat(F.when(note.isNotNull(), F.array(note)).otherwise(F.array().cast("array<string>")), found["edits"])).otherwise(other)
    return F.struct((F.size(changes) > 0).alias("changes_detected"), changes.alias("changes"), F.when(same, found["similarity"]).otherwise(0.0).alias("similarity"))


def similarity(old: Column | str, new: Column | str) -> Column:
    """Share of matching characters of two texts, 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left.fillna(""), right.fillna(""))], dtype="float64")

    return ratio(old, new)


def replaced(text: Column, old: str, new: str, least: float = 0.8) -> Column:
    """``replace_text`` as a column: null where nothing is found. Exact hits stay in the JVM."""

    @F.pandas_udf("string")
    def similar(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else replace_text(t, old, new, least) for t in texts], dtype=object)

    exact = text.contains(old)
    return F.when(exact, replace_first(text, old, new)).otherwise(similar(F.when(~exact, text)))


def version_diff(versions: DataFrame) -> DataFrame:
    """Each version beside the one before it: similarity, what changed, and the change of its status."""
    w = Window.partitionBy(*KEY).orderBy("version_date")
    version = F.struct("article_number", F.col("article_text").alias("text"), "is_repealed", F.when(F.col("is_repealed"), F.col("version_date")).alias("repealed_date"))
    both = versions.select(*KEY, "version_date", version.alias("_new")).withColumn("_old", F.lag("_new").over(w)).filter("_old is not null")
    status = F.when(F.col("_new.is_repealed") & ~F.col("_old.is_repealed"), "repealed").when(~F.col("_new.is_repealed") & F.col("_old.is_repealed"), "reinstated").otherwise("same")
    compared = both.withColumn("c", compare_versions(F.col("_old"), F.col("_new")))
    return compared.select(*KEY, "version_date", status.alias("status"), "c.similarity", "c.changes")


def cut_chunks(text: str, size: int = 512, overlap: int = 50) -> list[str]:
    """Overlapping chunks that end behind a sentence where they can, trimmed, empty ones left out.

    Of the marks of :data:`CHUNK_ENDS` the first kind that a window holds ends the chunk, at its last
    place. At the third step in a row of less than a quarter of ``size``, or that would not move on
    at all, the rest is cut into plain windows.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    if len(text) <= size:
        return [text] if text else []
    spans, start, stalls = [], 0, 0
    while start < len(text):
        end = start + size
        if end < len(text):
            found = next((e for e in CHUNK_ENDS if e in text[start:end]), None)
            end = text.rfind(found, start, end) + len(found) if found else end
        stalls = stalls + 1 if end - start < size // 4 or end - overlap <= start else 0
        if stalls == 3:
            # A window that reaches the end is the last one.
            last = max(0, -(-(len(text) - start - size) // (size - overlap)))
            spans += [(start + k * (size - overlap), start + k * (size - overlap) + size) for k in range(last + 1)]
            break
        spans.append((start, end))
        start = max(end - overlap, 0) if end < len(text) else end
    return [chunk for a, b in spans if (chunk := text[a:b].strip())]


def chunk_rows(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(document_id, chunk_index, chunk_text) of whole texts of any length; none for null and empty (see :func:`cut_chunks`)."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_chunks(t, size, overlap) for t in texts])

    return docs.filter(F.length("text") > 0).select(F.col("doc_id").alias("document_id"), F.posexplode(cut("text")).alias("chunk_index", "chunk_text"))


def embed(chunks: DataFrame, text_col: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 32, size: int | None = None, prompt: Column | None = None) -> DataFrame:
    """``chunks`` with an embedding of single floats; each distinct (prompt, text) is encoded once, ``batch`` at a time.

    ``encode`` gets the prompt, a column that may differ by row, and the text as one string. A blank
    or null text gets zeros and is not encoded, if ``size`` tells how many; without it is encoded as it is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = text if prompt is None else F.concat(F.coalesce(prompt, F.lit("")), text)
    blank = F.lit(False) if size is None else F.btrim(text, F.lit(" \t\n\r\f\v")) == ""
    keyed = chunks.withColumns({"_md5": F.when(~blank, F.md5(whole)), "_whole": whole})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = [v for i in range(0, len(part), batch) for v in encode(part["text"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({"_md5": part["_md5"], "embedding": vectors})

    distinct = keyed.filter("_md5 is not null").groupBy("_md5").agg(F.first("_whole").alias("text"))
    encoded = keyed.join(distinct.mapInPandas(run, "_md5 string, embedding array<float>"), "_md5", "left").drop("_md5", "_whole")
    return encoded if size is None else encoded.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), size)))


def assemble(lines: DataFrame, group: str, place: str, is_header: Column, text: str) -> DataFrame:
    """Lines under their header, joined by blank lines; headers without lines give nothing, nor lines before any header."""
    w = Window.partitionBy(group).orderBy(place)
    marked = lines.withColumn("_head", is_header).withColumn("article_no", F.sum(F.col("_head").cast("long")).over(w)).filter("article_no > 0 and not _head")
    body = F.array_sort(F.collect_list(F.struct(place, text)))
    return marked.groupBy(group, "article_no").agg(F.array_join(F.transform(body, lambda r: r[text]), "\n\n").alias("article_text"))


def accepted_numbers(numbers: Column) -> Column:
    """Of an article's paragraph numbers in order, those that follow each other (or stand in the tens of one that does)."""
    ten = lambda n, base: (n >= base * 10) & (n <= base * 10 + 9)
    start = F.struct(F.lit(1).cast("long").alias("expected"), F.array().cast("array<bigint>").alias("kept"))

    def step(state: Column, n: Column) -> Column:
        e = state["expected"]
        keep = (n <= e) | ten(n, e) | ((e > 1) & ten(n, e - 1))
        return F.struct((e + (n == e).cast("long")).alias("expected"), F.when(keep, F.array_append(state["kept"], n)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(numbers, start, step, lambda s: s["kept"])


#: Header of an article: number and title; fixed value.
ARTICLE_HEADER = r"^Статья\s+(\d+(?:[.\-]\d+)*)\.?\s*(.+)$"


def split_articles(pages: DataFrame, source: str, body_class: str | None = None) -> DataFrame:
    """Articles of pages (page_id, html): (page_id, article_no, article_number, article_title, article_text).

    Lines after a header belong to its article, but for controls of the page; for kremlin numbered
    paragraphs must also follow each other (see ``paragraphs.judge_paragraphs``). ``source`` is kremlin
    (the title is made again from the number), pravo, government (titles are whole lines; of equal
    numbers in a page government keeps the first) or constitution (headers are h3 only, numbers 1 to
    137, paragraphs of more than 5 characters, no stars). Pages without headers, null and empty pages
    give nothing, nor do headers without lines.
    """
    constitution = source == "constitution"
    lines = pages.select("page_id", F.explode(html.page_lines(F.col("html"), body_class)).alias("line")).select("page_id", "line.*")
    if constitution:
        lines = lines.withColumn("text", F.btrim(F.regexp_replace("text", r"\*", "")))
    number = F.regexp_extract("text", f"(?iUd){ARTICLE_HEADER}", 1)
    is_head = (number != "") & ((F.col("tag") == "h3") & number.try_cast("int").between(1, 137) if constitution else F.lit(True))
    in_order = source == "kremlin"
    keep = F.length("text") > 5 if constitution else F.lit(True) if in_order else content.content_validity(F.col("text"))["ok"]
    marked = lines.withColumn("_head", F.coalesce(is_head, F.lit(False))).filter(F.col("_head") | keep)
    w = Window.partitionBy("page_id").orderBy("pos")
    numbered = marked.withColumn("article_no", F.sum(F.col("_head").cast("long")).over(w)).filter("article_no > 0")
    if in_order:  # the window has brought a page's lines together
        numbered = judge_paragraphs(numbered, ["page_id", "article_no"], "pos", "text", dealt=True).filter("_head or kept")
    head = F.max(F.when(F.col("_head"), F.struct(number.alias("number"), F.regexp_extract("text", f"(?iUd){ARTICLE_HEADER}", 2).alias("title"), F.col("text").alias("line"))))
    body = F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("pos", "text"))))
    found = numbered.groupBy("page_id", "article_no").agg(head.alias("h"), F.array_join(F.transform(body, lambda r: r["text"]), "\n\n").alias("article_text")).filter("article_text <> ''")
    title = F.concat(F.lit("Статья "), F.col("h.number"), F.lit(". "), F.btrim("h.title")) if source == "kremlin" else F.col("h.line")
    out = found.select("page_id", "article_no", F.col("h.number").alias("article_number"), title.alias("article_title"), "article_text")
    if source != "government":
        return out
    return out.withColumn("_rk", F.row_number().over(Window.partitionBy("page_id", "article_number").orderBy("article_no"))).filter("_rk = 1").drop("_rk")
