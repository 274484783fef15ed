"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    decontamination, embedding_dedup, language_id, mixing, quality, secret_scan, simhash, substring_dedup, toxicity, url_filter, vector_codes, warc, whitening,
)
from millrace.llm.common import table

#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs.select("doc_id", "text", toxicity.held_out("doc_id").alias("held_out"))).select("doc_id", "held_out", "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    found = vector_codes.with_label_errors(coded)
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    index = warc.normalise(warc.write(table(spark, sf_dir, "pages"), folder))
    return warc.digest(warc.read(index))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation over the range of a long is an error here; the operator gives it as a decimal."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_mix_sources": op5_mix_sources,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_warc": op12_warc,
    "op13_whitening": op13_whitening,
}


def _codes_sql(rounds: int = 6) -> str:
    """Lloyd's rounds one after the other: distances of all parts from all entries, the least (of equal ones the first), and the floors of the means."""
    nearest = """SELECT vec_id, p, min(d * 16 + e) % 16 AS e, min(d) AS d FROM (
            SELECT a.vec_id, a.p, b.e, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS d FROM v a JOIN b{r} b ON a.p = b.p AND a.i = b.i GROUP BY a.vec_id, a.p, b.e
        ) GROUP BY vec_id, p"""
    moved = """SELECT b.p, b.e, b.i, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (
            SELECT p, e, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM v JOIN a{r} USING (vec_id, p) GROUP BY p, e, i
        ) n ON n.p = b.p AND n.e = b.e AND n.i = b.i"""
    steps = [f"a{r} AS MATERIALIZED ({nearest.format(r=r)}), b{r + 1} AS MATERIALIZED ({moved.format(r=r)})" for r in range(rounds)]
    return f"""
        WITH ok AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        parts AS (SELECT vec_id, len(embedding) // 8 AS w, unnest(embedding) AS c, generate_subscripts(embedding, 1) - 1 AS k FROM ok),
        v AS MATERIALIZED (SELECT vec_id, k // w AS p, k % w AS i, CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT) AS x FROM parts),
        b0 AS (SELECT v.p, f.e, v.i, v.x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM ok ORDER BY vec_id LIMIT 16) f USING (vec_id)),
        {", ".join(steps)},
        final AS ({nearest.format(r=rounds)}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN ok USING (vec_id)
    """


ORACLE_SQL = {
    "op3_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (SELECT page_id, host, path, arg_max(r, length(rhost || rpath)) AS r
                 FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path)
        SELECT page_id, host, path, r.rhost || r.rpath AS rule, coalesce(r.verdict, 'allow') AS verdict FROM best
    """,
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
               AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
        SELECT v.vec_id, (SELECT count(*) FROM link WHERE x = v.vec_id) AS n_links, min(reach.y) AS component_id, v.vec_id = min(reach.y) AS kept
        FROM v JOIN reach ON reach.x = v.vec_id GROUP BY v.vec_id
    """,
    "op9_decontamination": r"""
        WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        w AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_shingles, count(*) AS n_found, count(*) / n.n AS containment
        FROM s d JOIN s i ON d.side = 'd' AND i.side = 'i' AND d.shingle = i.shingle JOIN n ON n.id = i.id GROUP BY d.id, i.id, n.n HAVING count(*) >= 0.8 * n.n - 1e-9
    """,
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
        least AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN least USING (h) WHERE doc_id > first),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS text, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op11_vector_codes": _codes_sql(),
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM d
    """,
}
