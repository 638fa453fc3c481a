"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.audio import align_recordings, fingerprint_audio
from lexmill.llm.bpe_codec import encode_bpe
from lexmill.llm.common import read_table, shared_table, text_or_empty
from lexmill.llm.exact_dedup import exact_duplicates
from lexmill.llm.filter_audit import audit_filters, judge_documents
from lexmill.llm.language_id import fit_languages, identify_languages
from lexmill.llm.ngram_join import near_duplicate_components
from lexmill.llm.packing import pack_documents
from lexmill.llm.pii import BASE_KINDS, find_pii
from lexmill.llm.repeats import remove_repeats
from lexmill.llm.sharding import shard_by_bytes
from lexmill.llm.token_prefix import count_prefixes
from lexmill.llm.token_alignment import align_tokens, aligner, count_pairs, score_links
from lexmill.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit_toxicity(docs, labels, ~held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, toxicity_model(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = text_or_empty("text")
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"))
    return shard_by_bytes(sized, "size", "group", "doc_id", shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_prefixes(read_table(spark, sf_dir, "documents"), TOKENIZER, budgets=(512,))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("fits_512") < F.col("n_chars")).alias("over_limit"), "n_chars", "fits_512")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(read_table(spark, sf_dir, "documents"), width=5, percent=80)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("pii_spans")
    joined = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return find_pii(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio; the bytes of each text are taken as its 8-bit samples."""
    recordings = read_table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").cast("binary").alias("audio"))
    return align_recordings(fingerprint_audio(recordings, "doc_id", "audio"), "doc_id").withColumn("bit_error_rate", F.round("bit_error_rate", 6))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read_table(spark, sf_dir, "documents"), window=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_bpe(read_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=0)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return identify_languages(docs, fit_languages(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return audit_filters(judged, "ABCDE")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(read_table(spark, sf_dir, "documents"), TOKENIZER, PIECES)
    digest = F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    written = shared_table(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
    return score_links(written, count_pairs(written, aligner(TOKENIZER, PIECES).size_b))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_sharding, op3_token_counts, op4_ngram_join, op5_pii, op6_chroma, op7_repeats, op8_bpe_codec, op9_packing, op10_exact_dedup, op11_language_id, op12_filter_audit, op13_token_alignment, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op7_repeats": r"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        s AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM t WHERE len(words) >= 13),
        w AS (SELECT doc_id, p, hash(array_to_string(words[p : p + 12], ' ')) AS h, md5(array_to_string(words[p : p + 12], ' ')) AS m FROM s),
        d AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h, m) AS least FROM w) WHERE least < doc_id),
        g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM d),
        r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id),
        f AS (SELECT t.doc_id, t.words, coalesce(r.gone, []::BIGINT[]) AS gone FROM t LEFT JOIN r ON t.doc_id = r.doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(words, lambda w, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
        FROM f
    """,
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm, row_number() OVER w AS rk, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
              FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, rk = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
                     + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
                     + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(least < w.doc_id, false) AS INT) AS mask
              FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        c AS (SELECT part, mask, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM m GROUP BY part, mask),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
        o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
              FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
        r AS (SELECT part, filter_order, step, bit,
                     sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                     sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                     sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                     sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                     sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
                     sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
