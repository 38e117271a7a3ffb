"""The subpackage's queries over the tables of a folder, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.store import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import jaccard_join

    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import kd_shards

    return kd_shards.shard_documents(table(spark, sf_dir, "documents"))


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import pivot_search

    return pivot_search.top_k(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import sentencepiece_codec

    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import substring_dedup

    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import token_output

    path = Scratch(spark, "tokens").path("blocks")
    token_output.write_blocks(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path, end_id=2)
    return token_output.digests(spark.read.parquet(path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import quality

    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), free_ends=True)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm import lm_scoring

    scores = lm_scoring.scores(table(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})  # sums in any order


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_ngram_jaccard_join, op2_kd_sharding, op3_pivot_top_k, op4_sentencepiece, op5_html_extraction, op6_substring_dedup, op7_token_output, op8_quality_classifier, op9_decontamination, op10_lm_scoring)}
#: Words of a text as SQL, with A-Z in lower case.
_LOWER_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce({_LOWER_WORDS}, []) AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        sets AS (SELECT list_sort(s) AS s, min(doc_id) AS class_id, len(any_value(s)) AS n FROM s GROUP BY list_sort(s)),
        e AS (SELECT class_id, n, unnest(s) AS g FROM sets),
        p AS (SELECT x.class_id AS a, y.class_id AS b FROM e x JOIN e y ON x.g = y.g AND x.class_id <> y.class_id
              GROUP BY x.class_id, y.class_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        r(a, b) AS (SELECT class_id, class_id FROM sets UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        c AS (SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
               CASE WHEN len(s.s) = 0 THEN doc_id ELSE component_id END AS component_id,
               CASE WHEN len(s.s) = 0 THEN doc_id ELSE class_id END AS class_id
        FROM s JOIN sets ON list_sort(s.s) = sets.s JOIN c USING (class_id)""",
    "op3_pivot_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
              FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        i AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM i),
        r AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN r USING (k)),
        v AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS x, count(*) AS n FROM v ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_lm_scoring": f"""
        WITH w AS (SELECT doc_id, coalesce({_LOWER_WORDS}, []) AS w FROM documents),
        t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        g AS (SELECT doc_id, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM t),
        c1 AS (SELECT a, count(*) AS n1 FROM g GROUP BY a), c2 AS (SELECT b, a, count(*) AS n2 FROM g WHERE b IS NOT NULL GROUP BY b, a),
        c3 AS (SELECT c, b, a, count(*) AS n3 FROM g WHERE c IS NOT NULL GROUP BY c, b, a),
        n AS (SELECT g.*, n1, h1.m1, n2, h2.m2, n3 FROM g JOIN c1 USING (a) LEFT JOIN c2 USING (b, a) LEFT JOIN c3 USING (c, b, a)
              LEFT JOIN (SELECT a AS b, n1 AS m1 FROM c1) h1 USING (b) LEFT JOIN (SELECT b AS c, a AS b, n2 AS m2 FROM c2) h2 USING (c, b)),
        s1 AS (SELECT *, ln(n1 / (SELECT count(*) FROM g)) AS s1 FROM n),
        s2 AS (SELECT *, CASE WHEN b IS NULL THEN s1 WHEN n2 >= 2 THEN ln(n2 / m1) ELSE s1 + ln(0.4) END AS s2 FROM s1),
        s3 AS (SELECT doc_id, CASE WHEN c IS NULL THEN s2 WHEN n3 >= 2 THEN ln(n3 / m2) ELSE s2 + ln(0.4) END AS s3 FROM s2),
        d AS (SELECT doc_id, sum(s3) AS s FROM s3 GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 6) AS log_score, round(coalesce(s, 0) / greatest(1, len(w)), 6) AS mean_log_score
        FROM w LEFT JOIN d USING (doc_id)""",
}
