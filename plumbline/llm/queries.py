"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    fingerprints,
    jaccard_join,
    katz,
    language,
    lexical,
    packing,
    periodic,
    pii,
    quality,
    sentencepieces,
    substring_dedup,
    suffix_dedup,
    topk,
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_attention_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.predict(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op2_rlz_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(_documents(spark, folder))


def op3_disclosure_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(_documents(spark, folder))


def op4_viterbi_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(_documents(spark, folder))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(_documents(spark, folder))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_classes(_documents(spark, folder))


def op8_sentencepiece_scan(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.round_trip(_documents(spark, folder))


def op9_nra_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes(_documents(spark, folder))


def op11_k2_treap_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    return katz.held_out_scores(_documents(spark, folder))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(_documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_attention_quality,
        op2_rlz_dedup,
        op3_disclosure_pii,
        op4_viterbi_language,
        op5_best_fit_packing,
        op6_suffix_dedup,
        op7_minhash,
        op8_sentencepiece_scan,
        op9_nra_topk,
        op10_jaccard_join,
        op11_k2_treap_search,
        op12_katz_scores,
        op13_periodic_runs,
    )
}

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: CRC-32 of a decimal number, bit by bit.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(
        range(8 * len(CAST({0} AS VARCHAR))),
        lambda i: CASE WHEN i % 8 = 0 THEN ascii(CAST({0} AS VARCHAR)[i // 8 + 1])::BIGINT ELSE 0::BIGINT END
    )),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))
))"""

SQL: dict[str, str] = {
    "op2_rlz_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
        placed AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
        win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM placed),
        firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE m < doc_id
        ),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p)
            GROUP BY doc_id
        ),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op6_suffix_dedup": """
        WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
        chunks AS (
            SELECT doc_id, k * 512 AS first, len(x) // 2 - k * 512 AS rest, x[k * 1024 + 1 : k * 1024 + 1122] AS c
            FROM (SELECT *, unnest(range(0, len(x) // 1024 + 1)) AS k FROM b)
        ),
        placed AS (SELECT *, unnest(range(0, least(512, rest - 49))) AS i FROM chunks),
        win AS (SELECT doc_id, first + i AS i, md5(c[2 * i + 1 : 2 * i + 100]) AS h FROM placed),
        firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE m < doc_id
        ),
        lost AS (
            SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE fresh) AS runs
            FROM (
                SELECT doc_id, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS fresh FROM gone
            )
            GROUP BY doc_id
        ),
        every AS (SELECT *, unnest(range(0, least(512, rest))) AS i FROM chunks JOIN lost USING (doc_id)),
        bytes AS (SELECT doc_id, first + i AS p, c[2 * i + 1 : 2 * i + 2] AS one FROM every),
        left_over AS (
            SELECT doc_id, string_agg(one, '' ORDER BY p) AS t FROM bytes ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(runs, 0) AS n_spans,
            sha256(unhex(CASE WHEN n IS NULL THEN x ELSE coalesce(t, '') END)) AS kept_sha256
        FROM b LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)
    """,
    "op9_nra_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        ),
        met AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
            FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM met
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
    """,
    "op10_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'
            ) AS ws
            FROM documents
        ),
        placed AS (
            SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 3, 2) END)) AS i
            FROM w
        ),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM placed),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
            FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
        ),
        links AS (
            SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * k >= 75 * (x.n + y.n - k)
        ),
        sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (
            SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a
        )
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles,
            least(w.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = w.doc_id), w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id)
    """,
    "op11_k2_treap_search": f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, {LOWER_CASE}), '{TERM}') AS ts
            FROM documents WHERE doc_id IS NOT NULL
        ),
        sized AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
        total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
        tf AS (
            SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM sized) GROUP BY ALL
        ),
        df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {LOWER_CASE}), '{TERM}')) AS t
            FROM benchmark WHERE item_id IS NOT NULL
        ),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(
                CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT)
                * (1000000000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * n * docs // terms)))
            ) AS BIGINT) AS score
            FROM asked JOIN tf USING (t) JOIN df USING (t), total GROUP BY item_id, doc_id
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r
            FROM scored WHERE score > 0
        )
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 50
    """,
    "op13_periodic_runs": f"""
        WITH w AS (
            SELECT doc_id, {CRC32.format("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
            FROM documents
        ),
        placed AS (SELECT *, len(ws) AS n, h // 10 % nullif(len(ws), 0) AS a, h // 10 AS g FROM w),
        spaced AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
        x AS (
            SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(
                range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]
            ) ELSE ws END AS ws
            FROM spaced
        ),
        -- A run's words equal the words one period on, at five places at least.
        grams AS (
            SELECT doc_id, n, i, md5(array_to_string(ws[i + 1 : i + 5], ' ')) AS gram
            FROM (SELECT doc_id, ws, len(ws) AS n, unnest(range(len(ws) - 4)) AS i FROM x)
        ),
        met AS (
            SELECT l.doc_id, l.i, r.i - l.i AS period
            FROM grams l JOIN grams r ON l.doc_id = r.doc_id AND l.gram = r.gram AND l.i < r.i AND 4 * (r.i - l.i) <= l.n
        ),
        stretches AS (
            SELECT doc_id, period, min(i) AS start, count(*) + 4 + period AS length
            FROM (
                SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM met
            )
            GROUP BY doc_id, period, island
            HAVING count(*) + 4 + period >= greatest(6, 4 * period)
        ),
        runs AS (
            SELECT * FROM stretches s WHERE NOT EXISTS (
                SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.period < s.period
                AND t.start <= s.start AND t.start + t.length >= s.start + s.length
            )
        ),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
            FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM x) ANTI JOIN gone USING (doc_id, i)
            GROUP BY doc_id
        ),
        told AS (
            SELECT doc_id, count(*) AS n_runs,
                string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                min({{'l': -length, 's': start, 'p': period}}) AS best
            FROM runs GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period,
            1000 * -best.l // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
            sha256(coalesce(t, '')) AS collapsed_sha256
        FROM x LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
