"""The registered corpus queries: thin wrappers that derive the returned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import bpe, embedding, fill_in_middle, language, quality, revisits, token_counts, toxicity
from tillstream.llm.common import share_of, table
from tillstream.llm.decontamination import benchmark_hits
from tillstream.llm.exact_dedup import exact_duplicates
from tillstream.llm.filter_audit import filter_interactions
from tillstream.llm.sharding import LAW, stratified_shards
from tillstream.llm.simhash import near_duplicates


def word_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def digests_of_tokens(docs: DataFrame, vocabulary: bpe.Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    return bpe.encode_decode(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests_of_tokens(table(spark, sf_dir, "documents"), word_vocabulary())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = token_counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counts = token_counts.edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.PATTERN, ranks)
    return counts.select(
        "doc_id", "n_tokens", "n_pieces", "n_edits",
        F.col("after.n_tokens").alias("n_tokens_after"), F.col("after.n_encoded").alias("n_encoded"),
        F.sha2("after.text", 256).alias("text_sha256"),
    )


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.capture_records(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return found.select(
        "record_id", "url_key", "response_id", "outcome", F.array_join(lines, "\n").alias("headers")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    graded = _graded(scores, quality.PARTS, quality.HELD_OUT, quality.THRESHOLD)
    return graded.select("doc_id", "held_out", "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def _graded(scores: DataFrame, parts: int, held_out: int, threshold: float) -> DataFrame:
    """Scores with the held-out flag (false for a null id) and the prediction."""
    return scores.withColumns(
        {
            "held_out": F.coalesce(share_of(F.col("doc_id"), parts) == held_out, F.lit(False)),
            "predicted": (F.col("score") >= threshold).cast("int"),
        }
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    graded = _graded(
        toxicity.toxicity_scores(docs, model), toxicity.PARTS, toxicity.HELD_OUT, toxicity.THRESHOLD
    )
    return graded.select("doc_id", "held_out", "score", "predicted", "start", "end", "sentence_score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.languages(docs, language.trained(docs))
    held_out = share_of(F.col("doc_id"), language.PARTS) == language.HELD_OUT
    return found.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

ORACLE = {
    "op3_warc_revisits": r"""
        WITH urls AS (
            SELECT page_id, html,
                   regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host,
                   regexp_replace(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
                   list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)')) AS params
            FROM pages
        ), captures AS (
            SELECT page_id, '"' || left(md5(html), 16) || '"' AS tag, 'day-' || (page_id // 100) AS day, strlen(html) AS bytes,
                   page_id * 60 AS sent, page_id * 60 + 30 + 3600 * (page_id % 48) AS asked,
                   CASE WHEN host <> '' THEN host || path || CASE WHEN len(params) > 0
                        THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END END AS url_key
            FROM urls
        ), revisits AS (
            SELECT *, CASE WHEN page_id % 7 = 3 THEN '"stale"' WHEN page_id % 7 < 5 THEN tag END AS fresh_tag,
                   CASE WHEN page_id % 7 = 3 THEN '"stale"' WHEN page_id % 7 >= 5 THEN NULL
                        WHEN page_id % 2 = 0 THEN 'W/' || tag ELSE tag END AS sent_tag
            FROM captures
        ), joined AS (
            SELECT r.*, c.page_id AS found, c.tag AS old_tag, c.day AS old_day, c.bytes AS old_bytes
            FROM revisits r ASOF LEFT JOIN (SELECT * FROM captures WHERE page_id % 11 <> 10 AND url_key IS NOT NULL) c
            ON r.url_key = c.url_key AND r.asked > c.sent
        ), decided AS (
            SELECT *, CASE WHEN url_key IS NULL THEN 'no_url' WHEN found IS NULL THEN 'no_response'
                           WHEN fresh_tag IS NOT NULL THEN CASE WHEN fresh_tag = old_tag THEN 'resolved' ELSE 'changed' END
                           WHEN page_id % 7 = 5 THEN CASE WHEN day = old_day THEN 'resolved' ELSE 'changed' END
                           ELSE 'unvalidated' END AS outcome
            FROM joined
        )
        SELECT page_id * 2 + 1 AS record_id, url_key, CASE WHEN outcome = 'resolved' THEN found * 2 END AS response_id, outcome,
               CASE WHEN outcome = 'resolved' THEN
                    'Content-Length: ' || old_bytes || chr(10) || 'Content-Type: text/html' || chr(10) || 'Date: ' || asked
                    || chr(10) || 'ETag: ' || coalesce(sent_tag, old_tag) || chr(10) || 'Expires: ' || (asked + 600)
                    || chr(10) || 'Last-Modified: ' || old_day END AS headers
        FROM decided
    """,
    "op5_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents
        ), ranked AS (
            SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM rows
            WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
    """,
    "op11_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
        ), read_texts AS (
            SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                   min(doc_id) OVER (PARTITION BY text) AS first_id
            FROM texts
        ), failing AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN first_id < doc_id THEN 'E' ELSE '' END AS fails
            FROM read_texts
        ), marked AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id
        ), groups AS (
            SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
            FROM failing LEFT JOIN marked USING (doc_id) GROUP BY part, fails
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
        ), orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), steps AS (
            SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS earlier
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ), seen AS (
            SELECT part, n, good, toxic, filter_order, step, f, contains(fails, f) AS failing, fails = f AS alone,
                   fails <> '' AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AS gone
            FROM groups, steps
        ), counted AS (
            SELECT part, filter_order, step, f,
                   coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept,
                   coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
                   coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
                   coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
            FROM seen GROUP BY part, filter_order, step, f
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM counted
    """,
    "op12_fill_in_middle": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
            FROM documents
        ), numbers AS (
            SELECT *, len(units) AS n, [CAST('0x' || digest[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM texts
        ), cut AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers
        ), parts AS (
            SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
                   array_to_string(units[high + 1:], '') AS suffix
            FROM cut
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
    "op13_embedding_near_dedup": r"""
        WITH RECURSIVE vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
                   embedding IS NOT NULL AND len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS compared
            FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM (SELECT * FROM vectors WHERE compared) a JOIN (SELECT * FROM vectors WHERE compared) b
            ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach AS (
            SELECT vec_id, vec_id AS low FROM vectors
            UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.vec_id
        ), least AS (
            SELECT vec_id, min(low) AS component_id FROM reach GROUP BY vec_id
        ), degrees AS (
            SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM vectors JOIN least USING (vec_id) LEFT JOIN degrees USING (vec_id)
    """,
}
