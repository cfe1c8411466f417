"""The registered queries over the given tables: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.substring_dedup import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"), window=20, digest=True)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    lists = [F.expr(f"transform(draws, d -> d.{c})").alias(f"{c}s") for c in ("shard", "order")]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *lists)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.pii import personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone", "term")]
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = F.sha2(F.expr(listed.format("filter(spans, s -> s.kind <> 'term')")), 256).alias("base_sha256")
    removed = F.expr("cast(size(filter(spans, s -> s.action = 'remove')) as long)").alias("n_removed")
    return found.select("doc_id", *counts[:4], base, F.expr(listed.format("spans")).alias("spans"), counts[4], removed, F.size("spans").cast("long").alias("n_spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.quality import quality

    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("score", "text_score", "meta_score")], "kept")


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.line_rules import judge_lines

    judged = judge_lines(table(spark, sf_dir, "documents"), host_col="source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), F.round("score", 6).alias("score"), "passages", F.round("question", 6).alias("question"), F.round("answer", 6).alias("answer"), "start", "end")


def op7_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.sparse_suffix import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"), length=50)
    spans = [F.expr(f"array_join(transform({c}, s -> concat_ws(':', s.start, s.end)), ',')").alias(c) for c in ("repeated", "later")]
    return found.select("doc_id", "n_words", "n_repeated", "n_later", *spans, "class_id", "n_linked")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.sharding import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=24)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=6)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_line_rules": op5_line_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_sparse_suffix_dedup": op7_sparse_suffix_dedup,
    "op8_kd_shards": op8_kd_shards,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_toxicity": op10_toxicity,
}

#: DuckDB's form of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS pos
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list FROM documents)
        ), windows AS (
            SELECT doc_id, pos, string_agg(word, ' ') OVER w AS body, count(*) OVER w AS n
            FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
        ), later AS (
            SELECT doc_id, pos FROM windows WHERE n = 20
            QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1
        ), flagged AS (
            SELECT w.doc_id, w.pos, word, max(l.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos) AS last
            FROM words w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.pos = w.pos
        ), judged AS (
            SELECT *, coalesce(pos - last < 20, false) AS gone FROM flagged
        ), spans AS (
            SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM judged
        ), result AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
                   coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept
            FROM spans GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans
        FROM documents d LEFT JOIN result USING (doc_id)""",
    "op5_line_rules": r"""
        WITH base AS (
            SELECT doc_id, coalesce(source, chr(1) || 'none') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS list FROM documents
        ), words AS (
            SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS pos FROM base
        ), windows AS (
            SELECT doc_id, pos, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS body FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
        ), again AS (
            SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, body) > 1 AND body IS NOT NULL AS twice FROM windows
        ), covered AS (
            SELECT doc_id, count(*) FILTER (near) AS n_repeat_words FROM (
                SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM again
            ) GROUP BY doc_id
        ), split AS (
            SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM base
        ), lines AS (
            SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                   trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D!-/:-@\[-`{-~]+', ' ', 'g')) AS norm
            FROM split
        ), dup AS (
            SELECT doc_id, count(*) FILTER (n > 0 AND nth > 1) AS n_dup_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth FROM lines) GROUP BY doc_id
        ), hosts AS (
            SELECT host, greatest(20, count(*) / 1000.0) AS most FROM base GROUP BY host
        ), hot AS (
            SELECT host, norm FROM lines JOIN hosts USING (host) WHERE norm <> '' GROUP BY host, norm, most HAVING count(DISTINCT doc_id) > most
        ), removed AS (
            SELECT doc_id, sum(n)::BIGINT AS n_removed_words FROM lines JOIN hot USING (host, norm) GROUP BY doc_id
        ), result AS (
            SELECT b.doc_id, len(list)::BIGINT AS n_words, coalesce(length(array_to_string(list, '')), 0)::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
            FROM base b LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * (n_words - n_removed_words) >= 3 * n_words AS kept
        FROM result""",
    "op7_sparse_suffix_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) - 1 AS pos, len(list) AS n_words
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list FROM documents)
        ), windows AS (
            SELECT doc_id, pos, n_words, md5(string_agg(word, ' ') OVER w) AS body, count(*) OVER w AS n
            FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
        ), again AS (
            SELECT doc_id, pos, n_words, row_number() OVER o > 1 AS later, first_value(doc_id) OVER o AS head
            FROM windows WHERE n = 50 WINDOW o AS (PARTITION BY body ORDER BY doc_id, pos)
            QUALIFY count(*) OVER (PARTITION BY body) > 1
        ), runs AS (
            SELECT doc_id, kind, start, max(pos) + 50 AS "end" FROM (
                SELECT doc_id, kind, pos, max(CASE WHEN opens THEN pos END) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS start FROM (
                    SELECT doc_id, kind, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id, kind ORDER BY pos) > 50, true) AS opens FROM (
                        SELECT doc_id, pos, 'all' AS kind FROM again UNION ALL SELECT doc_id, pos, 'later' FROM again WHERE later)))
            GROUP BY doc_id, kind, start
        ), spans AS (
            SELECT doc_id, coalesce(sum("end" - start) FILTER (kind = 'all'), 0)::BIGINT AS n_repeated, coalesce(sum("end" - start) FILTER (kind = 'later'), 0)::BIGINT AS n_later,
                   coalesce(string_agg(start || ':' || "end", ',' ORDER BY start) FILTER (kind = 'all'), '') AS repeated,
                   coalesce(string_agg(start || ':' || "end", ',' ORDER BY start) FILTER (kind = 'later'), '') AS later
            FROM runs GROUP BY doc_id
        ), edges AS (
            SELECT DISTINCT doc_id AS a, head AS b FROM again WHERE doc_id <> head UNION SELECT DISTINCT head, doc_id FROM again WHERE doc_id <> head
        ), reach AS (
            SELECT DISTINCT doc_id AS node, doc_id AS other FROM again UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other
        )
        SELECT doc_id, (SELECT max(n_words) FROM words w WHERE w.doc_id = s.doc_id)::BIGINT AS n_words, n_repeated, n_later, repeated, later, class_id, n_linked
        FROM spans s JOIN (SELECT node AS doc_id, min(other) AS class_id, count(*) - 1 AS n_linked FROM reach GROUP BY node) USING (doc_id)""",
}
