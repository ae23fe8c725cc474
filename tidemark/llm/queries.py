"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_codec
from .common import read
from .embedding_dedup import near_vectors
from .expiring_dedup import expiring_clicks
from .jpeg import media_column
from .language_id import language_id
from .lattice_lm import score_documents
from .minhash import near_documents
from .packing import pack
from .pii import find
from .sequence_packing import pack_in_order
from .source_audit import divergence
from .token_counts import length_histogram, limit_table
from .url_rules import judge

BYTE_RANKS, WORD_MODEL, PIECE_MODEL, BYTE_MODEL = (tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(read(spark, sf_dir, "documents"), BYTE_RANKS, tokenizers.PATTERN)


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), PIECE_MODEL)


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), WORD_MODEL)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_table(length_histogram(read(spark, sf_dir, "documents"), BYTE_RANKS, tokenizers.PATTERN))


def op7_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(read(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


def op12_expiring_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiring_clicks(read(spark, sf_dir, "clicks"))


def op13_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_in_order(read(spark, sf_dir, "documents"), BYTE_MODEL, tokenizers.PATTERN)


_ALL = (
    op1_byte_bpe, op2_cross_polytope, op3_lattice_lm, op4_pii_boosting, op5_best_fit_packing,
    op6_token_counts, op7_odd_sketches, op8_url_rules, op9_progressive_jpeg, op10_language_id,
    op11_source_divergence, op12_expiring_clicks, op13_order_packing,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: Only whole operators are here: a tokenizer or a trained model (operators 1, 3 to 6, 8, 10, 13) and stored media (9) are beyond SQL; tests compare those with brute force.
ORACLES: dict[str, str] = {
    "op2_cross_polytope": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN embedding IF c <> 0]) > 0
        ),
        u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
        reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
        FROM embeddings LEFT JOIN degree d ON d.a = vec_id LEFT JOIN least l ON l.a = vec_id
    """,
    "op7_odd_sketches": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 2], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS t(k) WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
    """,
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kt AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        kl AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kt GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kt ON kt.lang = w.lang AND kt.term = w.term GROUP BY ALL),
        gn AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM g),
        s AS (
            SELECT g.lang, g.source, kt.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * kl.v)::HUGEINT AS p,
                1 + (1000000000::HUGEINT * (kt.n_lang + 5)) // (kl.total + 5 * kl.v)::HUGEINT AS q
            FROM gn g JOIN kt ON kt.lang = g.lang JOIN kl ON kl.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kt.term
        ),
        x AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(p.p - q.p)) FROM s p JOIN s q ON p.lang = q.lang AND p.term = q.term WHERE p.lang = a.lang AND p.source = a.source AND q.source = b.source), 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
    """,
    "op12_expiring_clicks": r"""
        WITH RECURSIVE r AS (
            SELECT row_number() OVER () AS id, click_id, client_id, kind, value, ts, props, floor(epoch_us(arrived_at) / 3600000000)::BIGINT AS arrived FROM clicks
            WHERE click_id IS NOT NULL AND arrived_at IS NOT NULL
        ),
        j AS (SELECT r.*, unnest(range(0, click_id % 3 + 1)) AS j FROM r),
        crc AS (SELECT b.b::BIGINT AS b, list_reduce(list_prepend(b.b::BIGINT, range(8)), lambda a, x: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) AS b(b)),
        tab AS (SELECT list(v ORDER BY b) AS t FROM crc),
        c AS (
            SELECT j.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(click_id || ':' || j, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])), 4294967295) AS c FROM j, tab
        ),
        h AS (SELECT *, arrived + 6 * j * (c % 10) AS hour FROM c),
        l AS (SELECT *, hour + (c // 10) % 200 AS late FROM h),
        e AS (
            SELECT click_id, hour, ((late - min(late) OVER ()) * 8 // (max(late) OVER () - min(late) OVER () + 1))::INT AS batch,
                sha256(concat(coalesce(client_id::VARCHAR, ''), '|', coalesce(kind, ''), '|', coalesce(floor(100 * value + 0.5)::BIGINT::VARCHAR, ''), '|', coalesce(epoch_us(ts)::VARCHAR, ''), '|', coalesce(props, ''), '|', c % 3)) AS hash
            FROM l
        ),
        m AS (SELECT b AS batch, (SELECT max(hour) FROM e WHERE e.batch < b) AS m FROM range(9) AS t(b)),
        k AS (SELECT click_id, hour, e.batch, hash, row_number() OVER (PARTITION BY click_id ORDER BY e.batch, hour, hash) AS n FROM e JOIN m ON m.batch = e.batch WHERE e.batch = 0 OR hour >= m.m - 96),
        until AS (SELECT k.*, coalesce((SELECT min(a.batch) FROM m a WHERE a.batch > k.batch AND a.batch < 8 AND k.hour + 24 < a.m - 96), 8) - 1 AS expires FROM k),
        w AS (
            SELECT click_id, n, batch, hash, hour AS start_hour, hash AS first_hash, expires, n AS opener FROM until WHERE n = 1
            UNION ALL
            SELECT u.click_id, u.n, u.batch, u.hash, CASE WHEN again THEN u.hour ELSE w.start_hour END, CASE WHEN again THEN u.hash ELSE w.first_hash END, CASE WHEN again THEN u.expires ELSE w.expires END, CASE WHEN again THEN u.n ELSE w.opener END
            FROM w JOIN until u ON u.click_id = w.click_id AND u.n = w.n + 1, LATERAL (SELECT u.batch > w.expires OR u.hour > w.start_hour + 24 AS again)
        ),
        f AS (
            SELECT click_id, opener, any_value(start_hour) AS start_hour, any_value(first_hash) AS hash, any_value(expires) AS expires, max(batch) FILTER (n = opener) AS opened, count(*) - 1 AS n_repeats, count(*) FILTER (w.hash <> first_hash) AS n_conflicts,
                coalesce(sum(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(w.hash, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])), 4294967295)) FILTER (w.hash <> first_hash), 0) AS conflict_crc
            FROM w, tab GROUP BY click_id, opener
        )
        SELECT click_id, start_hour, least(expires, coalesce(lead(opened) OVER (PARTITION BY click_id ORDER BY opener), 8))::BIGINT AS closed_batch, n_repeats::BIGINT AS n_repeats, n_conflicts::BIGINT AS n_conflicts, conflict_crc::BIGINT AS conflict_crc, hash FROM f
    """,
}
