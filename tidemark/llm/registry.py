"""The queries of this folder, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_byte_bpe
from .chat import op6_chat
from .decontaminate import op13_decontaminate
from .divergence import op12_divergence
from .jaccard import op1_jaccard_join
from .katz import op9_katz
from .mixing import op2_mixing
from .quality import op3_quality
from .sharding import op7_jump_sharding
from .substrings import op10_recompression
from .topk import op5_top_k
from .toxicity import op4_toxicity
from .whitening import op11_whitening

FIRST = (op1_jaccard_join, op2_mixing, op3_quality, op4_toxicity, op5_top_k, op6_chat, op7_jump_sharding, op8_byte_bpe, op9_katz, op10_recompression)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*FIRST, op11_whitening, op12_divergence, op13_decontaminate)}
SQL: dict[str, str] = {
    "op6_chat": r"""
        WITH said AS (
            SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
                length(replace(replace(replace(text, '&', '&amp;'), '#', '&num;'), '<', '&lt;')) AS text_chars,
                length(replace(replace(replace(replace(role, '&', '&amp;'), '#', '&num;'), '<', '&lt;'), ':', '&col;')) AS role_chars FROM said
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id
    """,
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (
            SELECT lang, source, coalesce(n, 0)::BIGINT AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
            LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)
        ),
        p AS (
            SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p
            FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
        ),
        q AS (SELECT p.lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)::HUGEINT) // (any_value(l.n) + 2 * any_value(l.v)) AS q
            FROM p JOIN (SELECT lang, sum(n)::HUGEINT AS n, max(v) AS v FROM g GROUP BY lang) AS l USING (lang) GROUP BY p.lang, term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g AS a JOIN g AS b USING (lang)
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source WHERE a.source <> b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op13_decontaminate": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ),
        b AS (
            SELECT row_number() OVER () AS item, coalesce(item_id::VARCHAR, '') AS name,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ),
        bw AS (SELECT item, name, k, size, w[k : k + size - 1] AS phrase FROM (SELECT *, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
        dt AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
        dw AS (SELECT r, pos, size, w[pos : pos + size - 1] AS phrase FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM bw))),
        hits AS (SELECT r, pos, bw.size, item, name FROM dw JOIN bw USING (phrase)),
        hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + size)) FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, name FROM hits) GROUP BY r),
        terms AS (SELECT item, k, size, term, count(*) AS times FROM (SELECT item, k, size, unnest(phrase) AS term FROM bw) GROUP BY ALL),
        f AS (SELECT term, count(*) AS f FROM dt GROUP BY term),
        anchors AS (SELECT item, k, arg_min(term, (f, term)) AS term FROM terms JOIN f USING (term) GROUP BY item, k),
        starts AS (SELECT DISTINCT a.item, a.k, dt.r, dt.pos AS at FROM anchors AS a JOIN dt USING (term)),
        events AS (
            SELECT DISTINCT s.item, s.k, t.size, s.r, x.pos, x.term, t.times FROM starts AS s JOIN terms AS t USING (item, k)
            JOIN dt AS x ON x.r = s.r AND x.term = t.term AND x.pos BETWEEN s.at - t.size - 9 AND s.at + t.size + 9
        ),
        held AS (SELECT a.item, a.k, a.r, a.pos, b.term, b.times FROM events AS a JOIN events AS b ON b.item = a.item AND b.k = a.k AND b.r = a.r AND b.pos BETWEEN a.pos AND a.pos + a.size + 9 GROUP BY ALL HAVING count(*) >= b.times),
        kinds AS (SELECT item, k, count(*) AS kinds FROM terms GROUP BY item, k),
        covering AS (SELECT item, k, r, pos FROM held JOIN kinds USING (item, k) GROUP BY item, k, r, pos, kinds HAVING count(*) = kinds),
        near AS (SELECT r, count(DISTINCT name) AS n_near FROM covering JOIN b USING (item) WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.r = covering.r AND hits.item = covering.item) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
    """,
}
