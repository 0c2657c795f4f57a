"""The registered queries of the numbered operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, divergence, langid, mixing, ngram_join, packing, periods, quality, secretscan, spotsigs, suffixes, topk, warc
from siftline.llm.runtime import table, text_or_empty

RANKS = "byte_bpe_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards as they are written: id matrices, cumulative segment lengths and position resets as raw arrays."""
    return packing.write(table(spark, sf_dir, "documents"), *vocabulary())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors, vectors.where(F.pmod("id", F.lit(50)) == 0))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a doc_id has held_out null: it is judged, and nothing is learned from it."""
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(~langid.held_out(4, 2)))
    found = langid.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", langid.held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_cover").alias("cover"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"), secretscan.learn(secretscan.labelled_table(spark)))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))


def spotsigs_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near documents of op6's fingerprints, as classes."""
    return spotsigs.near_documents(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), *vocabulary(), then=bpe.digester(*vocabulary()))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a doc_id has held_out null: it is scored, and nothing is learned from it or from a label without one."""
    docs, held = table(spark, sf_dir, "documents"), langid.held_out(3, 1)
    net = quality.learn(docs, table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(periods.find(periods.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_topk, op3_language, op4_secrets, op5_ngram_join, op6_spotsigs, spotsigs_near_documents, op7_bpe, op8_warc, op9_mixing, op10_quality, op11_periods, op12_divergence, op13_suffixes)}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
          SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
          SELECT a.own, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.own <> b.own AND len(a.q) = len(b.q)),
        r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        g AS (
          SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh
          FROM w),
        n AS (SELECT doc_id, len(sh) AS n FROM g),
        p AS (SELECT doc_id, unnest(sh) AS s FROM g),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM p a JOIN p b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
        SELECT n.doc_id, n.n AS n_shingles, min(c.b) AS component_id FROM n JOIN c ON c.a = n.doc_id GROUP BY 1, 2""",
    "spotsigs_near_documents": rf"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
        a AS (SELECT doc_id, i, word, word IN ({", ".join(f"'{x}'" for x in spotsigs.ANCHORS)}) AS anchor FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w)),
        b AS (
          SELECT doc_id, lag(anchor, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS spot,
            count(*) FILTER (NOT anchor) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {spotsigs.GAP - 1} FOLLOWING) AS plain,
            coalesce(count(*) FILTER (NOT anchor) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
          FROM a),
        c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, word FROM a WHERE NOT anchor),
        s AS (
          SELECT DISTINCT b.doc_id, unnest([x.word, concat_ws(' ', x.word, y.word)]) AS s
          FROM b JOIN c x ON x.doc_id = b.doc_id AND x.k = b.k + 1 LEFT JOIN c y ON y.doc_id = b.doc_id AND y.k = b.k + 2 WHERE spot OR plain = {spotsigs.GAP}),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS INTEGER) AS n_signatures, min(r.b) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY 1""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        x AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
          CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN first <> page_id THEN first END AS refers_to
        FROM x""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS own, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT own, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS lang_count FROM w GROUP BY 1, 2 HAVING count(DISTINCT own) >= 10),
        c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
        l AS (SELECT lang, count(*) AS v, sum(lang_count) AS total FROM k GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
        p AS (
          SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // CAST(t.total + 2 * l.v AS HUGEINT) AS p,
            1 + CAST(1000000000 AS HUGEINT) * (k.lang_count + 2) // CAST(l.total + 2 * l.v AS HUGEINT) AS q
          FROM t JOIN l ON l.lang = t.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
        r AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
        SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10""",
    "op13_suffixes": """
        WITH d AS (SELECT row_number() OVER () AS own, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT own, unnest(range(1, octet_length(b) - 198)) AS i, b FROM d WHERE octet_length(b) >= 200),
        h AS (SELECT own, i, b[i : i + 199] AS s FROM w),
        m AS (SELECT s FROM h GROUP BY s HAVING count(*) > 1),
        f AS (SELECT own, i FROM h SEMI JOIN m ON m.s = h.s),
        x AS (SELECT own, i, CASE WHEN i <= lag(i) OVER (PARTITION BY own ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM f),
        y AS (SELECT own, i, sum(new) OVER (PARTITION BY own ORDER BY i) AS span FROM x),
        z AS (SELECT own, span, min(i) AS first, max(i) + 199 AS last FROM y GROUP BY 1, 2),
        e AS (SELECT own, span, first, last, coalesce(lag(last) OVER (PARTITION BY own ORDER BY first), 0) + 1 AS begins FROM z),
        k AS (
          SELECT own, count(*) AS n_spans, CAST(sum(last - first + 1) AS BIGINT) AS n_removed, max(last) AS ends, list({'a': begins, 'b': first - 1} ORDER BY first) AS gaps
          FROM e GROUP BY 1)
        SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
          sha256(CASE WHEN k.own IS NULL THEN d.b ELSE unhex(array_to_string(list_transform(k.gaps, lambda g: hex(d.b[g.a : g.b])), '') || hex(d.b[k.ends + 1 : octet_length(d.b)])) END) AS kept_sha256
        FROM d LEFT JOIN k ON k.own = d.own""",
}
