"""Registered queries on ingest, reconciliation, amendments, chunks and streams, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import citations as cit
from lexmill.functions import content, html, rules
from lexmill.functions import legal as lg
from lexmill.functions import text as tx
from lexmill.operators import amendments, consolidation, courts, lookups, merge, numbering, paragraphs, search, snapshots, token_index, versions
from lexmill.plans.registry import _CITED, SQL_LETTERS, any_like_sql, changes_sql, letters_in_full, query, search_sql, shown_changes
from lexmill.sources.api import load_api_documents
from lexmill.sources.standin import table
from lexmill.sources.tables import fresh_folder, spread_out
from lexmill.streaming.streams import stream_changes, stream_upsert

_NATURAL = "CASE WHEN regexp_matches(article_number, '^[0-9]+$') THEN CAST(article_number AS INTEGER) ELSE 999999 END, article_number"


# Sources


@query("""SELECT eo_number, title, CASE WHEN id % 3 = 0 THEN NULL ELSE country END AS name, concat(title, ' / ', block) AS complex_name, concat(CAST(id % 100 AS VARCHAR), '-FZ') AS document_number,
 publish_date - 10 AS document_date, publish_date, concat('day ', CAST(id % 31 AS VARCHAR)) AS view_date, CAST(id % 20 AS INTEGER) AS pages_count, id * 1000 AS pdf_file_size, id % 3 = 0 AS has_svg,
 CASE WHEN id % 2 = 0 THEN id * 10 END AS zip_file_length, concat('JD', CAST(id AS VARCHAR)) AS jd_reg_number, CASE WHEN id % 4 <> 0 THEN publish_date END AS jd_reg_date, block AS signatory_authority_id,
 CAST(id % 6 AS VARCHAR) AS document_type_id, 'block-1' AS publication_block_id, 1 AS country_id, DATE '2024-01-01' AS created_at, DATE '2024-01-01' AS updated_at FROM docs""")
def a1_load_api_documents(s, d):
    i, text = F.col("id"), lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    made = {
        "eoNumber": F.col("eo_number"), "title": F.col("title"), "name": F.when(i % 3 != 0, F.col("country")), "complexName": F.concat_ws(" / ", "title", "block"),
        "number": F.concat(text(i % 100), F.lit("-FZ")), "documentDate": F.concat(text(F.date_sub("publish_date", 10)), F.lit("T00:00:00")), "publishDateShort": text("publish_date"),
        "viewDate": F.concat(F.lit("day "), text(i % 31)), "pagesCount": (i % 20).cast("int"), "pdfFileLength": i * 1000, "hasSvg": F.when(i % 3 == 0, True),
        "zipFileLength": F.when(i % 2 == 0, i * 10), "jdRegNumber": F.concat(F.lit("JD"), text("id")), "jdRegDate": F.when(i % 4 == 0, "none yet").otherwise(text("publish_date")),
        "signatoryAuthorityId": F.col("block"), "documentTypeId": text(i % 6), "unknownField": F.lit(1),
    }
    item = F.struct(*[c.alias(field) for field, c in made.items()])
    pages = table(s, d, "docs").groupBy(F.floor(i / 30).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json"))
    found = load_api_documents(pages, "json", 1, "block-1", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return found.withColumns({c: F.col(c).cast("date") for c in ("created_at", "updated_at")})


@query("""SELECT id, seq, name, code, description FROM (SELECT s_nationkey AS id, s_suppkey AS seq, s_name AS name, lower(s_name) AS code, CASE WHEN s_suppkey % 3 <> 0 THEN concat('supplier ', CAST(s_suppkey AS VARCHAR)) END AS description,
 row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 2 DESC, s_suppkey DESC) AS rk FROM supplier) x WHERE rk = 1""")
def a2_load_dimension(s, d):
    seq, description = F.col("s_suppkey"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string"))
    rows = table(s, d, "supplier").select(F.col("s_nationkey").alias("id"), seq.alias("seq"), F.col("s_name").alias("name"), F.lower("s_name").alias("code"), F.when(seq % 3 != 0, description).alias("description"))
    stored = merge.upsert_last_wins(rows.limit(0), rows.filter("seq % 2 = 0"), ["id"], "seq")
    return merge.upsert_last_wins(stored, rows.filter("seq % 2 = 1"), ["id"], "seq")


# Searches


_ARTICLE_SEARCHES = ((1, "article f", "1-URGENT"), (2, "Article О сделках", "2-HIGH"), (3, "article zzzz", "1-URGENT"), (4, "text f сделках", "5-LOW"))
_ARTICLE_TITLE = "CASE WHEN eo % 3 = 0 THEN 'О сделках' WHEN eo % 3 = 1 THEN concat('Об участии ', article_number) END"


@query(search_sql(f"SELECT eo, code_id, concat(article_text, ' ', coalesce({_ARTICLE_TITLE}, '')) AS text FROM versions", "eo", _ARTICLE_SEARCHES, "code_id", 10, False))
def c4_search_articles(s, d):
    v = table(s, d, "versions").withColumn("article_title", F.expr(_ARTICLE_TITLE))
    folder = fresh_folder(s, "index")
    token_index.write_index(v, folder, "eo", F.concat_ws(" ", "article_text", F.coalesce("article_title", F.lit(""))), ["code_id"])
    return token_index.search_index(s, folder, [token_index.Search(q, t, (("code_id", code),)) for q, t, code in _ARTICLE_SEARCHES], "eo", fallback=False)


@query(f"""WITH l AS (SELECT id * 1000 + turn AS id, {SQL_LETTERS} FROM letters), g AS (SELECT DISTINCT agency_id, upper(agency_id) AS agency_name FROM l WHERE agency_id <> 'system'), j AS (SELECT * FROM l JOIN g USING (agency_id))
 SELECT 'one' AS asked, id, agency_name, document_date FROM (SELECT * FROM j WHERE agency_id = 'user' AND interpretation_type = 'letter' AND document_date BETWEEN DATE '2021-01-05' AND DATE '2021-01-25' AND ({any_like_sql('de', 'title', 'question', 'answer')}) ORDER BY document_date DESC, id LIMIT 10) x
 UNION ALL SELECT 'topic', id, agency_name, document_date FROM (SELECT * FROM j WHERE {any_like_sql('topic 2', 'topic')} ORDER BY document_date DESC, id LIMIT 25) y
 UNION ALL SELECT 'number', id, agency_name, document_date FROM (SELECT * FROM j WHERE {any_like_sql('n-_', 'title', 'question', 'answer')} ORDER BY document_date DESC, id LIMIT 10) z""")
def c6_search_interpretations(s, d):
    letters = letters_in_full(s, d)
    agencies = letters.filter("agency_id <> 'system'").select("agency_id").distinct().withColumns({"agency_short": F.col("agency_id"), "agency_name": F.upper("agency_id")})
    found = {
        "one": lookups.search_interpretations(letters, agencies, "user", "letter", query="de", start="2021-01-05", end="2021-01-25"),
        "topic": lookups.search_interpretations(letters, agencies, topic="topic 2", most=25),
        "number": lookups.search_interpretations(letters, agencies, query="n-_"),
    }
    rows = [f.select(F.lit(name).alias("asked"), "id", "agency_name", "document_date") for name, f in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT id, block, substr(full_text, 1, 1000) AS content FROM docs JOIN content ON id = document_id WHERE block ILIKE '%RC1%' AND (title ILIKE '%le%' OR full_text ILIKE '%le%') ORDER BY id LIMIT 10")
def c7_search_regional(s, d):
    joined = table(s, d, "docs").join(table(s, d, "content"), F.col("id") == F.col("document_id"))
    found = joined.filter(F.col("block").ilike("%RC1%") & (F.col("title").ilike("%le%") | F.col("full_text").ilike("%le%")))
    return found.select("id", "block", F.substring("full_text", 1, 1000).alias("content")).orderBy("id").limit(10)


@query("SELECT id, publish_date, CASE WHEN length(full_text) > 0 THEN md5(full_text) ELSE '' END AS text_hash FROM docs LEFT JOIN content ON id = document_id JOIN countries c ON country = c.code WHERE c.name = 'FR' ORDER BY publish_date DESC, id LIMIT 100")
def c12_content_worklist(s, d):
    named = table(s, d, "countries").filter("name = 'FR'").withColumnRenamed("code", "country")
    joined = table(s, d, "docs").join(named, "country").join(table(s, d, "content"), F.col("id") == F.col("document_id"), "left")
    return joined.select("id", "publish_date", tx.text_hash(F.col("full_text"), "md5").alias("text_hash")).orderBy(F.desc("publish_date"), "id").limit(100)


_BLOCKS = "SELECT DISTINCT block AS code, CASE WHEN block LIKE '%1%' THEN 'Конституционный Суд' ELSE block END AS name FROM docs"


@query(f"SELECT code, name FROM ({_BLOCKS}) b WHERE code IN ('src0', 'src3') OR lower(name) LIKE '%суд%'")
def c14_court_blocks(s, d):
    name = F.when(F.col("block").contains("1"), "Конституционный Суд").otherwise(F.col("block"))
    blocks = table(s, d, "docs").select(F.col("block").alias("code"), name.alias("name")).distinct()
    return blocks.filter(F.col("code").isin("src0", "src3") | F.lower("name").contains("суд"))


@query("SELECT code_id, count(*) AS n, CAST(row_number() OVER (ORDER BY code_id) AS INTEGER) AS place FROM versions GROUP BY 1")
def c16_list_codes(s, d):
    counts = table(s, d, "versions").groupBy("code_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy("code_id")))  # a row a code


@query("""WITH r AS (SELECT event_id, event_id % 5 AS region, code_id, article_number, on_date FROM requests), v AS (SELECT eo % 5 AS region, * FROM versions)
 SELECT event_id, region, code_id, article_number, on_date, version_date, eo FROM (SELECT r.*, v.version_date, v.eo, row_number() OVER (PARTITION BY r.event_id ORDER BY v.version_date DESC) AS rk FROM r JOIN v
 ON r.region = v.region AND r.code_id = v.code_id AND r.article_number = v.article_number AND v.version_date <= r.on_date) x WHERE rk = 1""")
def d2_regional_article_as_of(s, d):
    v = table(s, d, "versions").withColumn("region", F.col("eo") % 5)
    return versions.article_as_of(v, table(s, d, "requests").withColumn("region", F.col("event_id") % 5), ["region", *versions.KEY])


# Aggregations and windows


@query(f"SELECT code_id, article_number, version_date, CAST(row_number() OVER (PARTITION BY code_id ORDER BY {_NATURAL}, version_date) AS INTEGER) AS place, count(*) OVER (PARTITION BY code_id) AS total_articles FROM versions")
def e5_code_structure(s, d):
    return versions.place_in_code(table(s, d, "versions").select(*versions.KEY, "version_date"))


@query("SELECT eo % 5 AS region, code_id, count(*) AS n, count(*) FILTER (WHERE is_current) AS n_current FROM versions GROUP BY 1, 2")
def e9_regional_stats(s, d):
    return table(s, d, "versions").groupBy((F.col("eo") % 5).alias("region"), "code_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_current").alias("n_current"))


_SOURCES = ("kremlin", "pravo", "government")


@query("""WITH v AS (SELECT *, (eo % 3) AS priority FROM versions), q AS (SELECT code_id, priority, count(*) AS n, count(*) FILTER (WHERE CAST(regexp_extract(article_number, '^([0-9]+)', 1) AS INTEGER) > 10 * largest) AS suspicious
 FROM v JOIN code_facts USING (code_id) GROUP BY 1, 2), g AS (SELECT code_id, min(priority) FILTER (WHERE suspicious * 10 <= n) AS best, sum(suspicious) AS suspicious FROM q GROUP BY 1)
 SELECT code_id, CASE best WHEN 0 THEN 'kremlin' WHEN 1 THEN 'pravo' WHEN 2 THEN 'government' END AS source, CAST(suspicious AS BIGINT) AS suspicious FROM g""")
def e12_source_quality(s, d):
    source = F.get(F.array(*map(F.lit, _SOURCES)), (F.col("eo") % 3).cast("int"))
    return versions.pick_source(table(s, d, "versions").withColumn("source", source), table(s, d, "code_facts"), _SOURCES)


@query()
def f7_version_diff(s, d):
    return consolidation.version_diff(table(s, d, "versions"))


@query("""WITH m AS (SELECT conv_id, turn, text, turn % 3 = 0 AS head, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations)
 SELECT conv_id, CAST(no AS BIGINT) AS article_no, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS article_text FROM m WHERE no > 0 AND NOT head GROUP BY 1, 2""")
def f8_assemble_articles(s, d):
    return consolidation.assemble(table(s, d, "conversations"), "conv_id", "turn", F.col("turn") % 3 == 0, "text")


#: Lines of an "article" for each conversation: numbers in and out of sequence, notes, and the turns' own texts.
_LINES = """CASE (conv_id + turn * 3) % 8 WHEN 0 THEN text WHEN 1 THEN concat(CAST(turn * 10 + conv_id % 10 AS STRING), '. Подпункт статьи') WHEN 2 THEN concat(CAST(turn + 1 AS STRING), '. Сроки (в редакции закона)')
 WHEN 3 THEN concat(CAST(conv_id % 40 AS STRING), '.Раздел о сроках') WHEN 4 THEN 'Поделиться' ELSE concat(CAST((turn + conv_id % 2) / 2 AS INTEGER) + 1, '. Абзац ', text) END"""
_SQL_LINES = _LINES.replace("CAST((turn + conv_id % 2) / 2 AS INTEGER)", "(turn + conv_id % 2) // 2")
_SPARK_LINES = _LINES.replace("CAST((turn + conv_id % 2) / 2 AS INTEGER)", "(turn + conv_id % 2) div 2")


@query(f"""WITH RECURSIVE l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rk, {_SQL_LINES} AS line FROM conversations),
 t AS (SELECT *, trim(coalesce(line, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w FROM l),
 n AS (SELECT conv_id, turn, rk, line, regexp_extract(w, '^([0-9]+)\\.\\s*(.+)$', 1) AS num, regexp_matches(w, '(?i){paragraphs.AMENDMENT_NOTE}') AS note, {content.content_reason_sql('line')} AS why FROM t),
 m AS (SELECT *, CASE WHEN num = '' OR note THEN NULL ELSE CAST(num AS BIGINT) END AS paragraph FROM n),
 s AS (SELECT conv_id, 0::BIGINT AS rk, 1::BIGINT AS expected, 1::BIGINT AS following FROM m GROUP BY 1 UNION ALL
 SELECT m.conv_id, m.rk, s.following, CASE WHEN m.paragraph = s.following THEN s.following + 1 ELSE s.following END FROM s JOIN m ON m.conv_id = s.conv_id AND m.rk = s.rk + 1),
 r AS (SELECT conv_id, turn, paragraph, expected, CASE WHEN num = '' THEN why WHEN note THEN 'amendment_note' WHEN paragraph > expected AND paragraph // 10 <> expected AND NOT (expected > 1 AND paragraph // 10 = expected - 1) THEN 'out_of_sequence' END AS reason FROM m JOIN s USING (conv_id, rk))
 SELECT *, reason IS NULL AS kept FROM r""")
def f9_check_paragraph_sequence(s, d):
    lines = table(s, d, "conversations").select("conv_id", "turn", F.expr(_SPARK_LINES).alias("line"))
    return paragraphs.judge_paragraphs(lines, ["conv_id"], "turn", "line").drop("line")


# Reconciliation


@query("""WITH o AS (SELECT DISTINCT code_id, article_number FROM versions WHERE eo % 3 <> 0), r AS (SELECT code_id, regexp_replace(article_number, '\\.([0-9])([0-9])$', '.\\1.\\2') AS ref, min(CASE WHEN eo % 2 = 0 THEN concat('Title ', article_number) END) AS title FROM versions GROUP BY 1, 2),
 f AS (SELECT *, string_split(ref, '.') AS p FROM r), g AS (SELECT *, CASE WHEN len(p) < 3 THEN ref WHEN len(p) = 3 AND length(p[2]) = 1 THEN concat(p[1], '.', p[2], p[3]) END AS form FROM f)
 SELECT g.code_id, o.article_number AS number_source, ref AS number_reference, o.article_number IS NOT NULL AS is_verified, CASE WHEN o.article_number IS NOT NULL THEN concat('Auto-matched: ', o.article_number, ' -> ', ref) ELSE concat('Missing from official sources - Title: ', coalesce(title, 'Unknown title')) END AS verification_notes
 FROM g LEFT JOIN o ON o.code_id = g.code_id AND o.article_number = g.form""")
def g2_reconcile_numbers(s, d):
    v = table(s, d, "versions")
    reference = v.select("code_id", F.regexp_replace("article_number", r"\.([0-9])([0-9])$", ".$1.$2").alias("article_number"), F.when(F.col("eo") % 2 == 0, F.concat(F.lit("Title "), "article_number")).alias("title"))
    return numbering.reconcile_numbers(v.filter("eo % 3 <> 0"), reference)


# Text functions


# Lines as they come from a page: controls, headings and notes in between.
_LINE = """CASE doc_id % 16 WHEN 0 THEN '' WHEN 1 THEN 'Показать' WHEN 2 THEN 'Раздел I. Общие положения' WHEN 3 THEN '§ 7. Унитарные организации' WHEN 4 THEN '1. Понятия и термины (в редакции закона)' WHEN 5 THEN 'Поделиться Подписаться'
 WHEN 6 THEN 'Telegram-канал' WHEN 7 THEN 'https://example.com/a' WHEN 8 THEN concat(CAST(doc_id * 7919 AS STRING), ' 12345678 знаков') WHEN 9 THEN concat('Показать еще ', text) WHEN 10 THEN '1999 год     .' WHEN 11 THEN 'Обратиться к Президенту письмом' ELSE text END"""


@query(f"SELECT doc_id, {content.content_reason_sql('line')} AS reason FROM (SELECT doc_id, {_LINE} AS line FROM documents) l")
def h24_content_validity(s, d):
    lines = table(s, d, "documents").select("doc_id", F.expr(_LINE).alias("line"))
    return lines.select("doc_id", content.content_validity(F.col("line"))["reason"].alias("reason"))


@query()
def h27_html_main_text(s, d):
    return table(s, d, "pages").select("page_id", F.md5(html.main_text(F.col("html"))).alias("main_md5"))


@query("""WITH a AS (SELECT doc_id AS page_id, unnest(range(1, CAST(3 + doc_id % 3 AS BIGINT))) AS article_no, text FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0)
 SELECT page_id, CAST(article_no AS BIGINT) AS article_no, CAST(article_no AS STRING) || CASE WHEN page_id % 2 = 0 THEN '.1' ELSE '' END AS article_number,
 concat('Статья ', article_no, CASE WHEN page_id % 2 = 0 THEN '.1' ELSE '' END, '. О документах') AS article_title, concat('Положение ', article_no, ' о документе ', page_id, chr(10), chr(10), 'Второй абзац положения') AS article_text FROM a""")
def h28_split_articles(s, d):
    article = lambda i: F.concat(F.lit("<h4>Статья "), i.cast("string"), F.when(F.col("doc_id") % 2 == 0, ".1").otherwise(""), F.lit(". О <b>документах</b></h4><div><p>Положение "), i.cast("string"), F.lit(" о документе "), F.col("doc_id").cast("string"), F.lit("</p><p>Поделиться</p><p>Второй абзац положения</p></div>"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 2).cast("int")), article), "\n")
    docs = table(s, d, "documents").filter(F.length(F.btrim("text", F.lit(" \t\n\r\f\v"))) > 0)
    page = F.concat(F.lit("<html><body><p>Статья 9. Вне закона</p><div class='reader_act_body'>"), body, F.lit("</div><div>Контакты сайта и поиск</div></body></html>"))
    return consolidation.split_articles(docs.select(F.col("doc_id").alias("page_id"), page.alias("html")), "kremlin", "reader_act_body")


@query("SELECT document_id, CASE WHEN length(full_text) > 0 THEN sha256(full_text) END AS sha256, CASE WHEN length(full_text) > 0 THEN md5(full_text) ELSE '' END AS md5 FROM content")
def h3_text_hash(s, d):
    return table(s, d, "content").select("document_id", tx.text_hash(F.col("full_text"), "sha256").alias("sha256"), tx.text_hash(F.col("full_text"), "md5").alias("md5"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN title ELSE concat(title, chr(10), chr(10), block) END AS full_text FROM docs")
def h4_compose_full_text(s, d):
    name = F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(F.col("block"))
    return table(s, d, "docs").select("id", lg.compose_full_text(F.col("title"), name, F.concat(F.lit("<b>"), F.col("block"), F.lit("</b>"))).alias("full_text"))


@query("SELECT id, concat('https://example.org/file/pdf?eoNumber=', eo_number) AS pdf, concat('https://example.org/Document/View/', eo_number) AS view FROM docs")
def h5_document_urls(s, d):
    return table(s, d, "docs").select("id", lg.document_urls(F.col("eo_number"), "https://example.org").alias("u")).select("id", "u.*")


_NUMBERED = "concat(CASE page_id % 4 WHEN 0 THEN concat('Письмо № БС-4-', CAST(page_id % 40 AS STRING), '/', CAST(page_id AS STRING), '@ от ') WHEN 1 THEN concat('№', CAST(page_id AS STRING), ' и ') WHEN 2 THEN '№ , ' ELSE '' END, lpad(CAST(page_id % 100 AS STRING), 2, '0'), '-', lpad(CAST(page_id % 90 AS STRING), 2, '0'), '-07/', CASE WHEN page_id % 5 > 0 THEN CAST(page_id * 31 AS STRING) ELSE 'x' END)"


@query(rf"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN CAST(page_id + 7 AS VARCHAR) ELSE substr(md5(url), 1, 8) END AS case_id,
 nullif(regexp_extract({_NUMBERED}, '{tx.NUMBER_FORMS["letter"]}', 1), '') AS letter_number, nullif(regexp_extract({_NUMBERED}, '{tx.NUMBER_FORMS["dashed"]}', 1), '') AS dashed_number FROM pages""")
def h8_extract_number(s, d):
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://x/?case_id="), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("http://x/ms/"), (F.col("page_id") + 7).cast("string"))).otherwise(F.col("url"))
    line = F.expr(_NUMBERED)
    return table(s, d, "pages").select("page_id", lg.case_id(made).alias("case_id"), tx.document_number(line, "letter").alias("letter_number"), tx.document_number(line, "dashed").alias("dashed_number"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN concat('KREMLIN_', CAST(id AS VARCHAR)) ELSE eo_number END AS eo_number FROM docs")
def h9_eo_number(s, d):
    return table(s, d, "docs").select("id", lg.eo_number(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("eo_number")), F.col("id")).alias("eo_number"))


@query("""WITH a AS (SELECT DISTINCT CAST(regexp_extract(article_number, '^([0-9]+)', 1) AS INTEGER) AS base, TRY_CAST(regexp_extract(article_number, '\\.([0-9]+)', 1) AS INTEGER) AS ins,
 TRY_CAST(regexp_extract(article_number, '-([0-9]+)', 1) AS INTEGER) AS sub, article_number FROM versions)
 SELECT article_number, CASE WHEN base <> 25 THEN CAST(concat_ws('.', base, ins) AS DOUBLE) < 25.2 ELSE (coalesce(ins, -1), coalesce(sub, -1)) < (2, -1) END AS before FROM a""")
def h12_article_compare(s, d):
    articles = table(s, d, "versions").select("article_number").distinct()
    return articles.select("article_number", lg.article_less(tx.article_parts(F.col("article_number")), tx.article_parts(F.lit("25.2"))).alias("before"))


@query("SELECT DISTINCT article_number, regexp_matches(article_number, '^[0-9]+(\\.[0-9]{1,2})*$') AS valid FROM versions")
def h13_valid_reference_number(s, d):
    return table(s, d, "versions").select("article_number").distinct().withColumn("valid", lg.valid_reference_number(F.col("article_number")))


#: Amendments with several changes of a kind, in words that follow the row.
_VARIED = """concat(full_text, ' Пункт «', CAST(eo % 50 AS STRING), '» ЗАМЕНИТЬ «срок ', CAST(eo % 9 AS STRING), '»; слово "налог" заменить "сбор" и фразу «старая» заменить словом «новая».', chr(10),
 CASE WHEN eo % 4 = 0 THEN concat('Дополнить статью ', CAST(eo % 30 + 1 AS STRING), ' частью второй:  новые права ', CAST(eo AS STRING), '; прочее. ') ELSE 'Дополнить статьей без номера: текст. ' END, 'Признать утратившим силу статьи ', CAST(eo % 77 AS STRING), ' и 5.')"""


@query(f"SELECT eo, {changes_sql('line')} AS changes FROM (SELECT eo, {_VARIED} AS line FROM amendments) l")
def h17_amendment_changes(s, d):
    lines = table(s, d, "amendments").select("eo", F.expr(_VARIED.replace("chr(10)", "char(10)")).alias("line"))
    return lines.select("eo", shown_changes(amendments.change_details(F.col("line"))).alias("changes"))


@query("SELECT eo, document_date AS effective FROM amendments")
def h18_effective_date(s, d):
    day, month = F.date_format("document_date", "d"), F.month("document_date")
    numeric, year = F.date_format("document_date", "d.M.yyyy"), F.date_format("document_date", "yyyy")
    named = F.concat(F.lit("вступает в силу с "), day, F.lit(" "), F.element_at(F.array(*map(F.lit, tx.MONTHS)), month), F.lit(" "), year, F.lit(" года"))
    text = F.when(F.col("eo") % 3 == 0, F.concat(F.lit("Федеральный закон от "), numeric)).when(F.col("eo") % 3 == 1, F.concat(F.lit("Дата опубликования: "), numeric)).otherwise(named)
    return table(s, d, "amendments").select("eo", lg.effective_date(text).alias("effective"))


@query("SELECT id, title FROM docs")
def h19_strip_metadata(s, d):
    text = F.concat(F.lit("Номер опубликования: 12 "), F.col("title"), F.lit("  СТРАНИЦА 2 из 3 "), F.lit("Дата опубликования: 01.02.2020"))
    return table(s, d, "docs").select("id", lg.strip_metadata(text).alias("title"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'interpreted' WHEN 2 THEN 'distinguished' ELSE 'cited' END AS kind FROM decisions")
def h22_classify_reference(s, d):
    said = F.element_at(F.array(*map(F.lit, ("Суд применил", "суд считает", "дело ОТЛИЧАЕТСЯ", "указал"))), (F.col("id") % 4 + 1).cast("int"))
    return table(s, d, "decisions").select("id", lg.classify_reference(F.concat_ws(" ", said, F.col("case_number"))).alias("kind"))


@query("SELECT page_id, CASE WHEN length(url) > 30 THEN concat(substr(url, 1, 30), '...') ELSE url END AS question, CAST(page_id AS VARCHAR) AS answer FROM pages")
def h25_question_answer(s, d):
    text = F.concat(F.lit("Вопрос: "), F.col("url"), F.lit("\nОтвет: "), F.col("page_id").cast("string"))
    return table(s, d, "pages").select("page_id", lg.question_answer(text, 30).alias("q")).select("page_id", "q.*")


@query("SELECT eo AS id, title FROM amendments")
def h26_repair_mojibake(s, d):
    whole = "".join(bytes([b]).decode("cp1251") for b in range(192, 256))
    broken = F.translate("title", whole, "".join(map(chr, range(192, 256))))
    return table(s, d, "amendments").select(F.col("eo").alias("id"), lg.repair_mojibake(broken).alias("title"))


_LINKS = "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS label"


@query(f"SELECT DISTINCT page_id, href, label FROM (SELECT page_id, {_LINKS} FROM pages) x WHERE length(label) >= 4")
def h29_extract_links(s, d):
    return table(s, d, "pages").select("page_id", F.inline(lg.links(F.col("html")))).filter(F.length("label") >= 4).distinct()


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unknown' END AS valid FROM pages")
def h30_letter_validity(s, d):
    said = F.when(F.col("page_id") % 3 == 0, "Актуально").when(F.col("page_id") % 3 == 1, "Не актуально").otherwise("")
    valid = lg.letter_validity(F.concat(F.lit('<span class="tooltip">'), said, F.lit("</span>"), F.col("html")))
    return table(s, d, "pages").select("page_id", F.coalesce(valid.cast("string"), F.lit("unknown")).alias("valid"))


@query("SELECT page_id, concat('/f/', CAST(page_id AS VARCHAR), '.pdf') AS pdf, CAST(1 AS BIGINT) AS n_docx FROM pages")
def h32_download_urls(s, d):
    made = F.concat(F.col("html"), F.lit('<a href="/f/'), F.col("page_id").cast("string"), F.lit('.pdf">p</a><a href="/f/x.docx">d</a>'))
    return table(s, d, "pages").select("page_id", lg.download_urls(made).alias("u")).select("page_id", F.array_join(F.col("u")["pdf"], ",").alias("pdf"), F.size(F.col("u")["docx"]).cast("long").alias("n_docx"))


@query("SELECT id, turn, CASE WHEN turn % 2 = 0 THEN letter_date ELSE DATE '2026-01-01' END AS letter_date, coalesce(number, '') AS number, 'letter' AS document_type FROM letters")
def h33_letter_from_raw(s, d):
    given = tx.parse_api_date(F.when(F.col("turn") % 2 == 0, F.col("letter_date").cast("string")).otherwise("unknown"))
    return table(s, d, "letters").select("id", "turn", F.coalesce(given, F.lit("2026-01-01").cast("date")).alias("letter_date"), F.coalesce("number", F.lit("")).alias("number"), F.lit("letter").alias("document_type"))


# Rules by country

#: Rules for the languages of the test documents: (country, purpose, place, pattern, value).
_RULES = (
    ("EN", "code", 1, "licen[cs]e", "LICENCE"),
    ("en", "code", 2, "(?:public|private) key|password", "SECRET"),
    ("en", "code", 3, "the .* of", "PROSE"),
    ("de", "code", 1, "lizenz", "LIZENZ"),
    ("de", "code", 2, "heit(en)? ", "HEIT"),
    ("fr", "code", 1, "tion", "TION"),
    ("en", "action", 1, "\\+[0-9]{2}", "phone"),
    ("en", "action", 2, "[a-z0-9]@[a-z0-9]", "mail"),
    ("en", "action", 3, "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "address"),
    ("es", "action", 1, "[a-z0-9]@[a-z0-9]", "mail"),
    ("en", "standalone", 1, "^Click here", None),
    ("de", "standalone", 1, "^(Impressum|Datenschutz)", None),
)
_BY_COUNTRY = {c: [r for r in _RULES if r[0].lower() == c] for c in ("en", "de", "fr", "es")}
_SQL_CODE = " ".join(f"WHEN lang = '{c}' AND regexp_matches(low, '{r[3]}') THEN '{r[4]}'" for c, own in _BY_COUNTRY.items() for r in own if r[1] == "code")
_SQL_FOUND = " + ".join(f"CASE WHEN lang = '{c}' AND regexp_matches(low, '{r[3]}') THEN 1 ELSE 0 END" for c, own in _BY_COUNTRY.items() for r in own if r[1] == "action")
_SQL_KIND = " ".join(f"WHEN lang = '{c}' AND regexp_matches(low, '{r[3]}') THEN '{r[4]}'" for c, own in _BY_COUNTRY.items() for r in own if r[1] == "action")


@query(f"""WITH d AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS low FROM documents), f AS (SELECT *, {_SQL_FOUND} AS found FROM d)
 SELECT doc_id, CASE {_SQL_CODE} ELSE 'UNKNOWN' END AS code, CASE WHEN found > 1 THEN 'mixed' {_SQL_KIND} ELSE 'modification' END AS action FROM f""")
def l1_rules_by_country(s, d):
    table_of_rules = rules.read_rules(s.createDataFrame(_RULES, rules.RULES))
    docs, none = table(s, d, "documents"), F.lit(None).cast("string")
    return docs.select("doc_id", table_of_rules.code(none, F.col("text"), F.col("lang")).alias("code"), table_of_rules.action(none, F.col("text"), F.col("lang")).alias("action"))


# Consolidation


@query("""SELECT code_id, article_number, version_date, CASE WHEN contains(article_text, 'Article text O') THEN replace(article_text, 'Article text O', 'New text')
 ELSE concat('New text ', array_to_string(string_split(article_text, ' ')[4:], ' ')) END AS text FROM versions""")
def i2_replace_text(s, d):
    # The old text differs by a letter in two of three rows: those are found by similarity.
    return table(s, d, "versions").select(*versions.KEY, "version_date", consolidation.replaced(F.col("article_text"), "Article text O", "New text").alias("text"))


@query("""SELECT doc_id, md5(changed) AS changed_md5, changed <> text AS success FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, 'the', 'a'), 'de ', '') AS changed FROM documents) x""")
def i4_apply_changes(s, d):
    changed = lg.replace_first(lg.replace_first(F.col("text"), "the", "a"), "de ", "")
    return table(s, d, "documents").select("doc_id", F.md5(changed).alias("changed_md5"), (changed != F.col("text")).alias("success"))


_FOLDED = """WITH RECURSIVE g AS (SELECT code_id, article_number, version_date, eo, CASE WHEN eo % 11 = 0 THEN 'repeal' WHEN eo % 13 = 0 THEN 'addition' ELSE 'modification' END AS kind,
 CASE eo % 3 WHEN 0 THEN 'quick' WHEN 1 THEN 'brown ' END AS old, CASE eo % 3 WHEN 0 THEN 'slow' WHEN 2 THEN concat('line ', eo) END AS new, row_number() OVER (PARTITION BY code_id, article_number ORDER BY version_date, eo) AS rk FROM changes),
 f AS (SELECT DISTINCT code_id, article_number, 0::BIGINT AS rk, NULL::DATE AS version_date, NULL::BIGINT AS eo, NULL::VARCHAR AS kind, 'The quick brown fox' AS article_text, NULL::DATE AS repealed_date, 'applied' AS status FROM g UNION ALL
 SELECT g.code_id, g.article_number, g.rk, g.version_date, g.eo, g.kind, CASE g.kind WHEN 'addition' THEN coalesce(g.new, '') WHEN 'repeal' THEN f.article_text ELSE CASE WHEN g.old IS NULL THEN concat(f.article_text, chr(10), g.new)
 WHEN contains(f.article_text, g.old) THEN concat(substr(f.article_text, 1, strpos(f.article_text, g.old) - 1), coalesce(g.new, ''), substr(f.article_text, strpos(f.article_text, g.old) + length(g.old))) ELSE f.article_text END END,
 CASE g.kind WHEN 'repeal' THEN g.version_date WHEN 'addition' THEN NULL ELSE f.repealed_date END,
 CASE WHEN g.kind = 'modification' AND g.old IS NOT NULL AND NOT contains(f.article_text, g.old) THEN 'failed' ELSE 'applied' END FROM f JOIN g ON f.code_id = g.code_id AND f.article_number = g.article_number AND g.rk = f.rk + 1),
 l AS (SELECT *, row_number() OVER (PARTITION BY code_id, article_number, version_date ORDER BY rk DESC) = 1 AS snapshot, max(version_date) OVER (PARTITION BY code_id, article_number) AS newest FROM f WHERE rk > 0)"""
_BETWEEN = "1995-06-30"


def _consolidated(s, d):
    """A store after two batches of changes, the second carrying the first on."""
    v = table(s, d, "changes")
    base = v.select(*versions.KEY).distinct().withColumn("text", F.lit("The quick brown fox"))
    eo = F.col("eo")
    old = F.when(eo % 3 == 0, "quick").when(eo % 3 == 1, "brown ")
    new = F.when(eo % 3 == 0, "slow").when(eo % 3 == 2, F.concat(F.lit("line "), eo.cast("string")))
    kind = F.when(eo % 11 == 0, "repeal").when(eo % 13 == 0, "addition").otherwise("modification")
    changes = v.select(*versions.KEY, "version_date", "eo", kind.alias("kind"), old.alias("old"), new.alias("new"))
    store = snapshots.snapshot_store(fresh_folder(s, "snapshots"))
    store.create(s)
    for number, part in enumerate((F.col("version_date") <= _BETWEEN, F.col("version_date") > _BETWEEN)):
        snapshots.consolidate_batch(store, base, changes.filter(part), number, F.lit(f"2024-01-0{number + 1}"))
    return store


@query(f"""{_FOLDED} SELECT code_id, article_number, version_date, article_text, repealed_date, version_date = newest AND repealed_date IS NULL AS is_current, repealed_date IS NOT NULL AS is_repealed, md5(article_text) AS text_hash, eo AS last_eo,
 CASE WHEN version_date <= DATE '{_BETWEEN}' THEN DATE '2024-01-01' ELSE DATE '2024-01-02' END AS amendment_date FROM l WHERE snapshot""")
def i5_consolidate(s, d):
    return _consolidated(s, d).read(s)


@query(f"""{_FOLDED} SELECT code_id, count(DISTINCT eo) AS amendments, count(DISTINCT CASE WHEN status = 'applied' THEN article_number END) AS articles_updated, count_if(snapshot)::BIGINT AS snapshots_saved,
 count_if(status = 'applied')::BIGINT AS applied, count_if(status = 'failed')::BIGINT AS failed, 0::BIGINT AS conflict FROM l GROUP BY 1""")
def i7_consolidation_report(s, d):
    return snapshots.consolidation_report(snapshots.read_log(s, _consolidated(s, d)))


_ADDED = "CASE WHEN o_orderkey % 4 = 0 THEN 'repeal' ELSE 'addition' END"


@query(f"""WITH c AS (SELECT o_orderpriority AS code_id, concat('N', CAST(o_custkey AS STRING)) AS article_number, CAST(o_orderdate AS DATE) AS day, o_orderkey AS eo, {_ADDED} AS kind FROM orders),
 t AS (SELECT *, max(CASE WHEN kind = 'addition' THEN struct_pack(day := day, eo := eo) END) OVER (PARTITION BY code_id, article_number ORDER BY day, eo) AS added FROM c),
 r AS (SELECT *, max(day) OVER (PARTITION BY code_id, article_number) AS last_day, row_number() OVER (PARTITION BY code_id, article_number, day ORDER BY eo DESC) AS rk FROM t WHERE added IS NOT NULL)
 SELECT code_id, article_number, day AS version_date, concat('Article of ', CAST(added.eo AS STRING)) AS text, kind = 'repeal' AS is_repealed, kind <> 'repeal' AND day = last_day AS is_current, md5(concat('Article of ', CAST(added.eo AS STRING))) AS text_hash FROM r WHERE rk = 1""")
def i3_add_and_repeal(s, d):
    o = table(s, d, "orders")
    added = F.when(F.col("o_orderkey") % 4 == 0, "repeal").otherwise("addition")
    changes = o.select(F.col("o_orderpriority").alias("code_id"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("article_number"), F.col("o_orderdate").cast("date").alias("version_date"), F.col("o_orderkey").alias("eo"), added.alias("kind"), F.lit(None).cast("string").alias("old"), F.concat(F.lit("Article of "), F.col("o_orderkey").cast("string")).alias("new"))
    base = changes.limit(0).select(*versions.KEY, F.col("new").alias("text"))
    return consolidation.consolidate(base, changes).select(*versions.KEY, "version_date", "text", "is_repealed", "is_current", "text_hash")


@query()
def i6_compare_versions(s, d):
    """Each article's oldest version against its newest."""
    row = F.struct("version_date", "article_number", F.col("article_text").alias("text"), "is_repealed", F.when(F.col("is_repealed"), F.col("version_date")).alias("repealed_date"))
    ends = table(s, d, "versions").groupBy(*versions.KEY).agg(F.min(row).alias("old"), F.max(row).alias("new"))
    return ends.withColumn("c", consolidation.compare_versions(F.col("old"), F.col("new"))).select(*versions.KEY, "c.*")


@query(f"""{_FOLDED} SELECT eo, code_id, min(version_date) AS amendment_date, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS amendment_type, array_to_string(list_sort(list_distinct(list(article_number))), ',') AS affected,
 coalesce(string_agg(DISTINCT article_number, ',' ORDER BY article_number) FILTER (WHERE kind = 'addition'), '') AS added, coalesce(string_agg(DISTINCT article_number, ',' ORDER BY article_number) FILTER (WHERE kind = 'modification'), '') AS modified,
 coalesce(string_agg(DISTINCT article_number, ',' ORDER BY article_number) FILTER (WHERE kind = 'repeal'), '') AS repealed, max(status) AS status, CASE WHEN max(status) = 'failed' THEN 'text to replace not found' END AS error FROM l GROUP BY 1, 2""")
def i8_build_amendment_log(s, d):
    told = snapshots.amendment_log(snapshots.read_log(s, _consolidated(s, d)))
    return told.select("eo", "code_id", "amendment_date", "amendment_type", *[F.array_join(c, ",").alias(c) for c in ("affected", "added", "modified", "repealed")], "status", "error")


@query()
def i9_correct_article_numbers(s, d):
    """Every article's number without its dots, put right from its neighbours; ``true_number`` is what it was."""
    numbers = table(s, d, "versions").select("code_id", F.col("article_number").alias("true_number")).distinct()
    parts = numbers.withColumn("p", tx.article_parts(F.col("true_number"))).select("code_id", "true_number", "p.*", F.lit("kremlin").alias("source"))
    raw = F.regexp_replace("true_number", r"\.", "")
    articles = parts.select("*", raw.alias("article_number"), F.concat(F.lit("Статья "), raw, F.lit(". О сделках")).alias("article_title"))
    ranges = {f"{i}-{name}": (0, 97) for i, name in enumerate(("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"), 1)}
    known = numbers.filter(F.crc32(F.col("true_number").cast("binary")) % 2 == 0).select("code_id", F.col("true_number").alias("article_number"))
    found = numbering.correct_article_numbers(articles, ["base", "insertion", "subdivision"], ranges, known)
    return found.select("code_id", "true_number", "raw_number", "article_number", "article_title", "suspicious")


@query(f"""WITH y AS ({_CITED}) SELECT d.id AS decision_id, coalesce(d.case_number, '') AS case_number, CASE WHEN d.id % 4 = 0 THEN 'stored' ELSE 'new' END AS title, md5(CASE WHEN length(d.full_text) > 500 THEN concat(regexp_replace(substr(d.full_text, 1, 500), ' [^ ]*$', ''), '...') ELSE d.full_text END) AS summary_md5,
 sha256(d.full_text) AS text_hash, y.code AS code_id, y.article AS article_number, CASE WHEN d.id % 8 = 0 AND y.code = 'UK_RF' THEN 'stored' ELSE y.kind END AS reference_type, y.position AS position_in_text FROM decisions d JOIN y ON y.id = d.id""")
def i10_court_rows(s, d):
    # A quarter of the decisions are stored with an older text, and some of their references.
    raw = spread_out(table(s, d, "decisions")).select("id", "case_number", "full_text", F.lit("new").alias("title"))
    rows = courts.decision_rows(raw)
    old = raw.filter("id % 4 = 0").select("id", "case_number", F.lit("Старый текст").alias("full_text"), F.lit("stored").alias("title"), F.lit("").alias("summary"), F.lit("").alias("text_hash"))
    decisions = courts.merge_decisions(old, rows, ["full_text", "summary", "text_hash"])
    references = courts.reference_rows(rows)
    known = references.filter("decision_id % 8 = 0 and code_id = 'UK_RF'").withColumn("reference_type", F.lit("stored"))
    merged = courts.merge_references(known, references)
    found = decisions.select(F.col("id").alias("decision_id"), F.coalesce("case_number", F.lit("")).alias("case_number"), "title", F.md5("summary").alias("summary_md5"), "text_hash").join(merged, "decision_id")
    return found.drop("reference_context")


# Chunks and vectors


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
_MARKS = " ".join(f"WHEN contains(w, {m}) THEN s + length(w) - strpos(reverse(w), reverse({m})) + 1" for m in ("'. '", "'! '", "'? '", "chr(10)", "('.' || chr(10))", "('!' || chr(10))", "('?' || chr(10))"))
#: A chunk after the other: s and e its span, stalls the short steps in a row, plain once there were three.
_CHUNKS = f"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
 c AS (SELECT doc_id, 0::BIGINT AS no, -1::BIGINT AS s, 0::BIGINT AS e, 0 AS stalls, false AS plain, 0::BIGINT AS following FROM t UNION ALL
 SELECT doc_id, no + 1, s, CASE WHEN stalls >= 3 THEN least(s + 512, n) ELSE e END, stalls, plain OR stalls >= 3, CASE WHEN (CASE WHEN stalls >= 3 THEN least(s + 512, n) ELSE e END) >= n THEN n ELSE greatest((CASE WHEN stalls >= 3 THEN least(s + 512, n) ELSE e END) - 50, 0) END
 FROM (SELECT *, CASE WHEN n <= 512 THEN 0 WHEN plain THEN 3 WHEN e - s < 128 THEN stalls_before + 1 ELSE 0 END AS stalls FROM (
 SELECT *, CASE WHEN n <= 512 THEN n WHEN plain THEN least(s + 512, n) WHEN s + 512 >= n THEN s + 512 {_MARKS} ELSE s + 512 END AS e FROM (
 SELECT t.doc_id, t.n, c.no, c.following AS s, c.stalls AS stalls_before, c.plain, substr(t.text, c.following + 1, 512) AS w FROM c JOIN t ON c.doc_id = t.doc_id WHERE c.following < t.n) x) y) z),
 k AS (SELECT c.doc_id AS document_id, no, CASE WHEN n <= 512 THEN text ELSE trim(substr(text, s + 1, e - s), {_BLANK}) END AS chunk_text FROM c JOIN t ON c.doc_id = t.doc_id WHERE no > 0),
 r AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY no) - 1 AS INTEGER) AS chunk_index, chunk_text FROM k WHERE chunk_text <> '')"""


@query(f"{_CHUNKS} SELECT * FROM r")
def j1_chunk_text(s, d):
    return consolidation.chunk_rows(table(s, d, "documents"))


@query(f"""{_CHUNKS}, h AS (SELECT *, sha1(unhex('{consolidation.X500}') || CAST(concat(md5(chunk_text), '_', chunk_index) AS BLOB)) AS h FROM r)
 SELECT document_id, 'text' AS source_field, chunk_index, md5(chunk_text) AS chunk_md5, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS chunk_id FROM h""")
def j2_chunk_ids(s, d):
    chunks = consolidation.chunk_rows(table(s, d, "documents"))
    name = F.concat(F.md5("chunk_text"), F.lit("_"), F.col("chunk_index").cast("string"))
    return chunks.select("document_id", F.lit("text").alias("source_field"), "chunk_index", F.md5("chunk_text").alias("chunk_md5"), lg.name_uuid5(name, consolidation.X500).alias("chunk_id"))


def _digest_vectors(texts: list[str]) -> list[list[float]]:
    return [[b / 255.0 for b in hashlib.md5(t.encode()).digest()] for t in texts]


_ASKED = "concat(CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'query: ' ELSE 'passage: ' END, coalesce(text, ''))"


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 5 THEN '  ' ELSE text END AS text FROM conversations)
 SELECT conv_id, turn, array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE CAST(concat('0x', substr(md5({_ASKED}), 2 * i + 1, 2)) AS INTEGER) END), ',') AS vector FROM c""")
def j3_embed(s, d):
    text = F.when(F.col("turn") % 7 == 5, "  ").otherwise(F.col("text"))
    prompt = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "query: ").otherwise("passage: ")
    chunks = table(s, d, "conversations").select("conv_id", "turn", text.alias("text"), prompt.alias("prompt"))
    found = consolidation.embed(chunks, "text", _digest_vectors, size=16, prompt=F.col("prompt"))
    return found.select("conv_id", "turn", F.array_join(F.transform("embedding", lambda x: F.round(x * 255).cast("int").cast("string")), ",").alias("vector"))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
 x AS (SELECT query, vec_id AS id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> query),
 v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rk FROM x) y WHERE rk <= 100),
 k AS (SELECT id, 2 / (1 + ln(4)) AS score FROM docs WHERE block = 'src3'),
 b AS (SELECT query, coalesce(v.id, w.id) AS id, round(0.7 * coalesce(v.score, 0) + 0.3 * coalesce(w.score, 0), 6) AS score FROM v FULL JOIN (SELECT query, id, score FROM (SELECT query FROM q) a, k) w USING (query, id))
 SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rk FROM b) y WHERE rk <= 20""")
def j6_hybrid_search(s, d):
    points = table(s, d, "embeddings")
    asked = points.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    semantic = search.vector_search(points, asked, 100).select("query", F.col("vec_id").alias("id"), F.col("score").alias("semantic"))
    titles = table(s, d, "docs").select(F.col("id").alias("document_id"), F.col("title").alias("full_text"))
    keyword = search.keyword_scores(titles, [(0, ["document", "src3"])]).select(F.col("document_id").alias("id"), F.lit(0).alias("all"), F.col("score").alias("keyword"))
    # The keyword part is the same for all queries; of documents without a semantic score only its best can be among the 20.
    best = search.top_k(keyword, "all", "keyword", "id", 120).select("id", "keyword")
    others = asked.select("query").join(F.broadcast(best)).join(semantic.select("query", "id"), ["query", "id"], "left_anti")  # 120 rows
    both = semantic.join(keyword.drop("all"), "id", "left").unionByName(others, allowMissingColumns=True)
    score = 0.7 * F.coalesce("semantic", F.lit(0.0)) + 0.3 * F.coalesce("keyword", F.lit(0.0))
    return search.top_k(both.select("query", "id", F.round(score, 6).alias("score")), "query", "score", "id", 20).drop("rank")


# Streams


def _events(s, d) -> T.StructType:
    return table(s, d, "events").schema


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def k1_stream_upsert(s, d):
    return stream_upsert(s, d, "events.parquet", _events(s, d), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT *, epoch_ms(ts) AS ms FROM events), w AS (SELECT max(ms) - 2 * 86400000 AS passed FROM e)
 SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM e WHERE ms <= (SELECT passed FROM w)) x WHERE before IS DISTINCT FROM event_type""")
def k2_stream_changes(s, d):
    return stream_changes(s, d, "events.parquet", _events(s, d), "user_id", "event_type", "event_id", "ts")
