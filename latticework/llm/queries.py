"""One query per operator, with production parameters over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, jaccard_join, license_scan, merkle_manifest, pii, quality_classifier, quality_rules, source_divergence, substring_dedup, suffix_dedup, url_filters, warc
from .common import new_path, table

#: (host, path, action)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", F.round("p_quality", 4).alias("p_quality"), F.round("p_clean", 4).alias("p_clean"), F.col("accepted").alias("kept"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source / language / block of a hundred ids / id."""
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan.scan(files).select("doc_id", "path", "license", F.round("score", 4).alias("score"), "origin", "license_dir")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontamination.find_matches(docs, table(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    return decontamination.digest(found, "doc_id").drop("longest_match")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    back = warc.read(spark, path, payload="verify")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"]), path, "doc_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"]), "doc_id")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(table(spark, sf_dir, "documents"), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of documents whose id has an even CRC are checked with a copy without line ends."""
    copy = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle_manifest.leaf_of(text=F.translate("text", "\n", "")))
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), altered_leaf=copy)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES = {f.__name__: f for f in (op11_suffix_dedup, op12_merkle_manifest, op13_source_divergence, op1_jaccard_join, op2_quality_classifier, op4_quality_rules, op5_license_scan, op6_url_filters, op8_benchmark_decontamination, op9_warc, op7_bpe, op10_pii, op3_substring_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL = {
    "op1_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[k:k + 3], ' ') FOR k IN range(1, len(w) - 2)])
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g
            FROM d),
        x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.c)
        SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(g)""",
    "op3_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
        win AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
        least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN least USING (s) WHERE doc_id > m),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[q:q + 9], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS q FROM i WHERE len(w) > 0)),
        places AS (
            SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) lengths)),
        hits AS (SELECT doc_id, item_id, k, n FROM places JOIN win USING (n, s)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_url_filters": r"""
        WITH p AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^(?:.|\n)*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        hits AS (
            SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
            FROM (SELECT DISTINCT host, path FROM p) d, r
            WHERE (d.host = h OR suffix(d.host, '.' || h)) AND starts_with(d.path, r.p)
            GROUP BY ALL)
        SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict
        FROM p LEFT JOIN hits ON p.host = hits.host AND p.path = hits.path""",
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha FROM p),
        b AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS best FROM d),
        bits AS (SELECT *, [CAST(('0x' || substr(sha, 5 * i + 1, 5)) AS BIGINT) FOR i IN range(8)] AS parts FROM b)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM bits""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
                   FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN df USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
        gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
        ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
        p AS (
            SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.n, 0) + 2 * v.v) AS p
            FROM g JOIN df USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gn USING (lang, source)),
        q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (t.n + 2)) // (ln.n + 2 * v.v) AS q
            FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) t JOIN v USING (lang) JOIN ln USING (lang)),
        gap AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        rows_ AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE crc(byte, value) AS (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) FROM (SELECT unnest(range(256)) AS i)),
        tbl AS (SELECT list(value ORDER BY byte) AS t FROM crc),
        f AS (
            SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, d: xor(t[(xor(c, d) & 255) + 1], c >> 8))) % 2 = 0 AS tampered
            FROM documents, tbl),
        leaf AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
                   CASE WHEN tampered THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS held
            FROM f),
        lv(source, l, pos, n, h) AS (
            SELECT source, 0, pos, n, leaf FROM leaf
            UNION ALL
            SELECT source, l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY source, l, lv.pos // 3, n),
        sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
        tv(l, pos, n, h) AS (
            SELECT 0, pos, n, h FROM sub
            UNION ALL
            SELECT l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tv WHERE n > 1 GROUP BY l, tv.pos // 3, n),
        steps AS (
            SELECT d.doc_id, v.l AS step, string_agg(CASE WHEN v.pos < d.pos // CAST(pow(3, v.l) AS BIGINT) THEN v.h END, '' ORDER BY v.pos) AS a,
                   string_agg(CASE WHEN v.pos > d.pos // CAST(pow(3, v.l) AS BIGINT) THEN v.h END, '' ORDER BY v.pos) AS b
            FROM leaf d JOIN lv v ON v.source IS NOT DISTINCT FROM d.source AND v.n > 1 AND v.pos // 3 = d.pos // CAST(pow(3, v.l + 1) AS BIGINT) GROUP BY ALL
            UNION ALL
            SELECT d.doc_id, 100 + v.l, string_agg(CASE WHEN v.pos < s.pos // CAST(pow(3, v.l) AS BIGINT) THEN v.h END, '' ORDER BY v.pos),
                   string_agg(CASE WHEN v.pos > s.pos // CAST(pow(3, v.l) AS BIGINT) THEN v.h END, '' ORDER BY v.pos)
            FROM leaf d JOIN sub s ON s.source IS NOT DISTINCT FROM d.source JOIN tv v ON v.n > 1 AND v.pos // 3 = s.pos // CAST(pow(3, v.l + 1) AS BIGINT) GROUP BY ALL),
        numbered AS (SELECT doc_id, coalesce(a, '') AS a, coalesce(b, '') AS b, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k FROM steps),
        folds(doc_id, k, x) AS (
            SELECT doc_id, 0, held FROM leaf
            UNION ALL
            SELECT doc_id, folds.k + 1, sha256(a || x || b) FROM folds JOIN numbered USING (doc_id) WHERE numbered.k = folds.k + 1),
        proof AS (SELECT doc_id, string_agg(a || b, '' ORDER BY k) AS p FROM numbered GROUP BY doc_id),
        root AS (SELECT h FROM tv WHERE n = 1)
        SELECT d.doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(p, '')) AS proof_sha256, x AS folded_root, x = root.h AS verified
        FROM leaf d JOIN sub ON sub.source IS NOT DISTINCT FROM d.source CROSS JOIN root LEFT JOIN proof USING (doc_id) JOIN (SELECT doc_id, max_by(x, k) AS x FROM folds GROUP BY doc_id) USING (doc_id)""",
    "op11_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        part AS (SELECT doc_id, 2000 * b AS first, least(2000, n - 399 - 2000 * b) AS m, substr(x, 4000 * b + 1, 4798) AS y FROM (SELECT *, unnest(range((n + 1600) // 2000)) AS b FROM d WHERE n >= 400)),
        w AS (SELECT doc_id, first + k AS k, md5(substr(y, 2 * k + 1, 800)) AS h FROM (SELECT *, unnest(range(m)) AS k FROM part)),
        hit AS (SELECT doc_id, k FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
        fresh AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 400 THEN 0 ELSE 1 END AS f FROM hit),
        r AS (SELECT doc_id, min(k) AS a, max(k) + 400 AS e FROM (SELECT doc_id, k, sum(f) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM fresh) GROUP BY doc_id, g),
        n AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last FROM r GROUP BY doc_id),
        gap AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s, a AS t FROM r UNION ALL SELECT doc_id, coalesce(last, 0), n FROM d LEFT JOIN n USING (doc_id)),
        kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (t - s)), '' ORDER BY s) AS x FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
