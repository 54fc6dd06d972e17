"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, bpe, digests, embeddings, exact, html, langid, mixing, passages, simhash, spelling, suffixes, urls
from .common import table, written


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mixture(written(docs), size_col="size").select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"),
        (F.col("_epochs") * F.col("_size")).alias("taken"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False, decoded=False)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(urls.labelled_urls(spark))
    return urls.judge_urls(table(spark, sf_dir, "pages"), model)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_url_filter that SQL can say: host, path and the longest rule that fits."""
    host, path = urls.host_and_path(F.col("url"))
    rule, action = urls.rule_of(host, path)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), action.alias("action"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents"), digests=True)


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.ball_kmeans(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_suffix_dedup,
        op3_embedding_dedup,
        op4_mixing,
        op5_bpe,
        op6_language,
        op7_html_text,
        op8_url_filter,
        url_rules,
        op9_simhash,
        op10_substring_dedup,
        op11_ball_clusters,
        op12_spelling,
        op13_fingerprints,
    )
}



def kmeans_sql(rounds: int = 10) -> str:
    """Plain k-means in SQL, round by round: each compares every vector with every centroid."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c, e FROM v
           QUALIFY row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) <= 8)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, k.e) + list_inner_product(k.e, k.e), c := k.c)) AS m
                FROM v, c{i} k GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT m.c AS c, p, floor(sum(e[p]) / count(*)) AS x FROM (SELECT m, e, unnest(range(1, 65)) AS p FROM a{i} JOIN v USING (r)) GROUP BY m.c, p),
                c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(any_value(n.e), any_value(k.e)) AS e
                    FROM c{i} k LEFT JOIN (SELECT c, list(x ORDER BY p) AS e FROM s{i} GROUP BY c) n ON n.c = k.c GROUP BY k.c)"""
            )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(k.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} k ON k.c = m.c"""


#: CRC-32 (reflected polynomial 3988292384) of a list of bytes, with the table t.x of one row in scope.
CRC_TABLE_SQL = """(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS x)"""
CRC_SQL = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(c >> 8, t.x[1 + (xor(c, b) & 255)])))"
#: UTF-8 of a string of code points below 2048.
BYTES_SQL = "flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END))"

ORACLE_SQL = {
    "op11_ball_clusters": kmeans_sql(),
    "op12_spelling": f"""
        WITH RECURSIVE t AS {CRC_TABLE_SQL},
        u AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        o AS (SELECT doc_id, run, count(*) AS k FROM u GROUP BY ALL),
        b AS (SELECT run, k, {BYTES_SQL.format(text="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS bytes FROM o),
        h AS (SELECT run, k, {CRC_SQL.format(bytes="bytes")} AS h FROM b, t),
        x AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
        w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
        cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM p),
        gap AS (SELECT word, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS wild FROM p),
        near AS MATERIALIZED (SELECT a.word, b.word AS other FROM gap a JOIN gap b ON a.wild = b.wild AND a.word <> b.word
            UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.less = w.word UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.less = w.word),
        best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(m := -w.n, o := other)) AS b FROM near JOIN w ON w.word = other GROUP BY near.word),
        f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * w.n THEN b.o END AS form, CASE WHEN -b.m >= 2 * w.n THEN -b.m END AS form_n
            FROM w LEFT JOIN best USING (word)),
        r(word, reached) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.reached WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, r.reached AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.reached AND e.form IS NULL
    """,
    "op13_fingerprints": """
        WITH RECURSIVE bounds(code, b) AS (SELECT 1, 1::BIGINT UNION ALL SELECT code + 1, b + greatest(1, b // 8) FROM bounds WHERE code < 255),
        d AS (SELECT doc_id, coalesce(text, '') AS s, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS following,
                     coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM documents WINDOW o AS (ORDER BY doc_id)),
        e AS (SELECT doc_id, next_id, s, length(s) AS n, substr(s, 1, length(s) - length(s) // 4) || substr(following, 1, length(s) // 4) AS edited FROM d),
        x AS (SELECT doc_id, 0 AS kind, hex(encode(s)) AS x FROM e UNION ALL SELECT doc_id, 1, hex(encode(edited)) FROM e),
        blocks AS (SELECT doc_id, kind, len(x) // 2 AS n, j, substr(x, 1024 * j + 1, 1024 + 4) AS y FROM (SELECT *, unnest(range(0, len(x) // 1024 + 1)) AS j FROM x)),
        triplets AS (SELECT doc_id, kind, ((CAST('0x' || substr(y, 2 * i + 1, 6) AS BIGINT) * 2654435761) % 4294967296) >> 24 AS k
            FROM (SELECT *, unnest(range(0, greatest(0, least(512, n - 2 - 512 * j)))) AS i FROM blocks)),
        counts AS (SELECT doc_id, kind, k, count(*) AS c FROM triplets GROUP BY ALL),
        full_counts AS (SELECT x.doc_id, x.kind, len(x.x) // 2 AS n_bytes, k, coalesce(c, 0) AS c
            FROM (SELECT *, unnest(range(0, 256)) AS k FROM x) x LEFT JOIN counts USING (doc_id, kind, k)),
        q AS (SELECT doc_id, kind, any_value(n_bytes) AS n_bytes, list(c ORDER BY k) AS c, list_sort(list(c)) AS s FROM full_counts GROUP BY doc_id, kind),
        codes AS (SELECT doc_id, kind, (SELECT count(*) FROM bounds WHERE b <= n_bytes) AS len_code,
                         least(15, 16 * s[64] // greatest(1, s[192])) AS r1, least(15, 16 * s[128] // greatest(1, s[192])) AS r2,
                         list_transform(c, lambda v: (v > s[64])::INT + (v > s[128])::INT + (v > s[192])::INT) AS code FROM q),
        prints AS (SELECT *, lower(printf('%02x', len_code) || printf('%02x', 16 * r1 + r2) || array_to_string(list_transform(range(0, 64),
                         lambda i: printf('%02x', 64 * code[4 * i + 1] + 16 * code[4 * i + 2] + 4 * code[4 * i + 3] + code[4 * i + 4])), '')) AS f FROM codes),
        pairs AS (SELECT e.doc_id, e.n, sha256(e.edited) AS sha, a.f AS fa, b.f AS fb, [a.len_code, a.r1, a.r2] || a.code AS va, [b.len_code, b.r1, b.r2] || b.code AS vb,
                         [c.len_code, c.r1, c.r2] || c.code AS vc
            FROM e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN prints c ON c.doc_id = e.next_id AND c.kind = 0),
        scores AS (SELECT *, 4 * least(32, abs(va[1] - vb[1])) + 4 * (abs(va[2] - vb[2]) + abs(va[3] - vb[3]))
                             + list_sum(list_transform(range(4, 260), lambda i: [0, 1, 2, 6][1 + abs(va[i] - vb[i])])) AS s1,
                             4 * least(32, abs(va[1] - vc[1])) + 4 * (abs(va[2] - vc[2]) + abs(va[3] - vc[3]))
                             + list_sum(list_transform(range(4, 260), lambda i: [0, 1, 2, 6][1 + abs(va[i] - vc[i])])) AS s2 FROM pairs)
        SELECT doc_id, n AS n_chars, sha AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, 1 - least(s1, 512) / 512.0::DOUBLE AS near_edited, 1 - least(s2, 512) / 512.0::DOUBLE AS near_next FROM scores
    """,
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op2_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        e AS (SELECT doc_id, x, len(x) // 2 AS n FROM d),
        -- Blocks of 512 bytes, as cutting a window out of a long string takes time in proportion to its place.
        b AS (SELECT doc_id, j, substr(x, 1024 * j + 1, 1024 + 198) AS y, n FROM (SELECT *, unnest(range(0, n // 512 + 1)) AS j FROM e)),
        w AS (SELECT doc_id, 512 * j + i AS p, md5(substr(y, 2 * i + 1, 200)) AS h
              FROM (SELECT *, unnest(range(0, greatest(0, least(512, n - 99 - 512 * j)))) AS i FROM b)),
        r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
        g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS s
              FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM r)),
        spans AS (SELECT doc_id, s, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, s),
        cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER o, 0) AS before, row_number() OVER o = count(*) OVER (PARTITION BY doc_id) AS final
                 FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
        kept AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN final THEN substr(x, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS rest,
                        sum(z - a) AS gone, count(*) AS runs FROM cuts JOIN e USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
        FROM e LEFT JOIN kept USING (doc_id)
    """,
    "op4_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          md5(CAST(doc_id AS VARCHAR) || ':42') AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
                     [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
        v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
              FROM s WINDOW b AS (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT min_by(level, cap / w) FILTER (level * w <= cap) AS level FROM v),
        g AS (SELECT source, source_size, least(cap, coalesce(l.level * w, cap)) AS target FROM s, l),
        n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
        m AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS need,
                     sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
              FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
               CAST(size * (whole + CASE WHEN need > 0 AND upto - own / 2 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
    """,
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, c.b AS component_id, c.b = vec_id AS kept
        FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "url_rules": r"""
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        r(action, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        f AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(action, length(h || q)) AS action
              FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
        SELECT page_id, host, path, rule, action FROM p LEFT JOIN f USING (page_id)
    """,
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        k AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        rep AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
        cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM k JOIN rep USING (h)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n FROM t ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
}
