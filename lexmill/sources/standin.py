"""Legal tables made from the generic ones, by SQL that Spark and other engines both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_ARTICLE = """CASE WHEN o_custkey % 5 = 0 THEN concat(CAST(o_custkey % 97 AS STRING), '.', CAST(o_custkey % 12 AS STRING))
    WHEN o_custkey % 7 = 0 THEN concat(CAST(o_custkey % 97 AS STRING), '.', CAST(o_custkey % 12 AS STRING), '-', CAST(o_custkey % 3 + 1 AS STRING))
    ELSE CAST(o_custkey % 97 AS STRING) END"""

#: Table -> SQL over the test tables or other entries.
TABLES: dict[str, str] = {
    "changes": f"""SELECT o_orderkey AS eo, o_orderpriority AS code_id, {_ARTICLE} AS article_number, CAST(o_orderdate AS DATE) AS version_date,
        o_orderstatus = 'F' AS is_repealed, concat('Article text ', o_orderstatus, ' ', CAST(o_orderkey AS STRING)) AS article_text FROM orders""",
    "versions": """SELECT code_id, article_number, version_date, eo, is_repealed, article_text, version_date = newest AND NOT is_repealed AS is_current FROM (
        SELECT *, row_number() OVER (PARTITION BY code_id, article_number, version_date ORDER BY eo DESC) AS rk, max(version_date) OVER (PARTITION BY code_id, article_number) AS newest FROM changes) v WHERE rk = 1""",
    "requests": f"""SELECT event_id, o_orderpriority AS code_id, {_ARTICLE} AS article_number, CAST(o_orderdate AS DATE) + CAST(event_id % 200 AS INT) AS on_date
        FROM events JOIN orders ON o_orderkey = event_id % 4000""",
    "docs": """SELECT doc_id AS id, lpad(CAST(doc_id AS STRING), 10, '0') AS eo_number, source AS block, lang AS country, DATE '2020-01-01' + CAST(doc_id % 1500 AS INT) AS publish_date,
        concat('Document ', CAST(doc_id AS STRING), ' of ', source) AS title FROM documents""",
    "content": "SELECT doc_id AS document_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS full_text FROM documents",
    "countries": "SELECT DISTINCT lang AS code, upper(lang) AS name FROM documents",
    "decisions": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'supreme' WHEN o_orderkey % 3 = 1 THEN 'constitutional' ELSE 'general' END AS court_type,
        CASE WHEN o_orderkey % 4 = 0 THEN 'plenary_resolution' ELSE 'ruling' END AS decision_type, concat('A-', CAST(o_orderkey AS STRING)) AS case_number, CAST(o_orderdate AS DATE) AS decision_date,
        concat('Дело. ', CASE o_custkey % 4 WHEN 0 THEN 'Суд применил ' WHEN 1 THEN 'Дано толкование ' ELSE '' END, 'ст. ', CAST(o_custkey % 300 + 1 AS STRING), ' ТК РФ применяется судом; ч. 2 ст. ', CAST(o_orderkey % 100 + 1 AS STRING), ' УК РФ, статья ', CAST(o_custkey % 50 + 1 AS STRING), '.1 ГК РФ',
               CASE o_custkey % 7 WHEN 0 THEN ', п. 3 ст. 12 Жилищный кодекс' WHEN 1 THEN '. Статья 5 Водный кодекс Российской Федерации. Далее' WHEN 2 THEN concat('; ст.', CAST(o_orderkey % 90 + 1 AS STRING), ' НК') WHEN 3 THEN ' (ч. 1.1 ст. 12.8 КоАП РФ)' WHEN 4 THEN ', СТ. 9 кодекса и ст. 80 ВК РФ' WHEN 5 THEN concat(', ст. ', CAST(o_custkey % 300 + 1 AS STRING), ' ТК РФ') ELSE '' END) AS full_text,
        o_orderstatus <> 'P' AS is_active FROM orders""",
    "amendments": """SELECT o_orderkey AS eo, CAST(o_orderdate AS DATE) AS document_date,
        CASE o_orderkey % 4 WHEN 0 THEN 'О внесении изменений в Трудовой кодекс Российской Федерации' WHEN 1 THEN 'Об изменении Уголовный кодекс Российской Федерации' WHEN 2 THEN 'Налоговый кодекс Российской Федерации' ELSE CASE o_custkey % 7 WHEN 0 THEN 'К статье Жилищного кодекса' WHEN 1 THEN 'О применении СК РФ' WHEN 2 THEN 'Кодекс об административных правонарушениях' WHEN 3 THEN 'Поправки Гражданского кодекса' WHEN 4 THEN 'Земельный кодекс' WHEN 5 THEN 'О порядке по ТК РФ' ELSE 'О бюджете' END END AS title,
        concat(CASE WHEN o_orderkey % 5 = 0 THEN concat('дополнить статьей ', CAST(o_custkey % 90 + 1 AS STRING), ' следующего содержания: новый текст. ') ELSE '' END,
               CASE WHEN o_orderkey % 3 = 0 THEN 'слово «старый» заменить «новый». ' ELSE '' END,
               CASE WHEN o_orderkey % 7 = 0 THEN concat('Признать утратившим силу статью ', CAST(o_custkey % 40 + 1 AS STRING), '. ') ELSE '' END,
               'В статье ', CAST(o_custkey % 60 + 1 AS STRING), ' изменения.') AS full_text FROM orders""",
    "letters": "SELECT conv_id AS id, role AS agency, CASE WHEN turn % 3 = 0 THEN NULL ELSE concat('N-', CAST(turn % 5 AS STRING)) END AS number, DATE '2021-01-01' + CAST(conv_id % 30 AS INT) AS letter_date, turn, text FROM conversations",
    "amendment_log": """SELECT o_orderkey AS eo, o_orderpriority AS code_id, CASE WHEN o_custkey % 11 = 0 THEN 'conflict' WHEN o_orderstatus = 'F' THEN 'applied' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS status, CAST(o_orderdate AS DATE) AS amendment_date,
        o_custkey % 4 AS n_affected, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 5 END AS n_added, o_orderkey % 3 AS n_modified, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey % 2 END AS n_repealed FROM orders""",
    "code_facts": """SELECT code_id, 60 + 20 * CAST(substr(code_id, 1, 1) AS INT) AS expected, 5 + CAST(substr(code_id, 1, 1) AS INT) AS largest FROM (SELECT DISTINCT o_orderpriority AS code_id FROM orders) c""",
}


def _needs(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]


def with_tables(sql: str) -> str:
    """``sql`` with the stand-ins it reads as common table expressions in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _needs(TABLES[name]):
            add(other)
        if name not in order:
            order.append(name)

    for name in _needs(sql):
        add(name)
    if not order:
        return sql
    head = ",\n".join(f"{name} AS ({TABLES[name]})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in, or a test table by its own name."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, frames = TABLES[name], {}
    for source in {*re.findall(r"\b(?:FROM|JOIN) (\w+)\b", sql)}:
        frames[source] = table(spark, sf_dir, source)
        sql = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", sql)
    return spark.sql(sql, **frames)
