"""The registered queries opN_* of the training-data operators and their SQL."""

from __future__ import annotations

from veilframe.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@register("op5_mix_sources")
def op5(spark, sf_dir):
    from veilframe.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@register(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op6(spark, sf_dir):
    from veilframe.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from veilframe.llm.license_scan import oracle

    return oracle()


@register("op1_license_scan", _license_sql())
def op1(spark, sf_dir):
    from veilframe.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@register("op9_toxicity")
def op9(spark, sf_dir):
    from veilframe.llm.toxicity import toxicity_query

    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_quality")
def op3(spark, sf_dir):
    from veilframe.llm.quality import quality_query

    return quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op2_language_id")
def op2(spark, sf_dir):
    from veilframe.llm.langid import language_query

    return language_query(table(spark, sf_dir, "documents"))


@register(
    "op10_embedding_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
    n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
    """,
)
def op10(spark, sf_dir):
    from veilframe.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


@register("op7_bpe_chunks")
def op7(spark, sf_dir):
    from veilframe.llm.bpe_chunks import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"))


@register("op8_token_files")
def op8(spark, sf_dir):
    from veilframe.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


@register(
    "op4_jaccard_join",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in generate_series(1, len(w) - 3)]) END AS s FROM w),
    c AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS cid FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
    t AS (SELECT cid, n, unnest(s) AS t FROM c),
    l AS (SELECT a.cid AS a, b.cid AS b FROM t a JOIN t b ON a.t = b.t AND a.cid <> b.cid AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
          GROUP BY a.cid, b.cid, a.n, b.n HAVING count(*) * 100 >= 85 * (a.n + b.n - count(*))),
    r(a, b) AS (SELECT cid, cid FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    k AS (SELECT a AS cid, min(b) AS component_id FROM r GROUP BY a)
    SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id
    FROM s d LEFT JOIN c ON list_sort(d.s) = c.s LEFT JOIN k USING (cid)
    """,
)
def op4(spark, sf_dir):
    from veilframe.llm.near_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


@register(
    "op11_chat_format",
    r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS ends, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
      length(text) + len(regexp_extract_all(text, '\\')) + list_sum([(length(text) - length(replace(text, k, ''))) // length(k) for k in ['<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '[OUT]', '[ROLE]', '[/ROLE]', '[/TURN]']])
        + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 18 WHEN 'assistant' THEN 12 END AS chars FROM c),
    f AS (SELECT *, coalesce(role = CASE before WHEN 'user' THEN 'assistant' ELSE 'user' END OR (before IS NULL AND role = 'system'), false) AS fits FROM e)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
      bool_and(fits) AND bool_or(ends AND role = 'assistant') AS valid, min(i) FILTER (NOT fits) AS bad_turn
    FROM f GROUP BY conv_id
    """,
)
def op11(spark, sf_dir):
    from veilframe.llm.chat import chat_query

    return chat_query(table(spark, sf_dir, "conversations"))


def _merkle_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda n: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', n, 'text')))})"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT), lambda c, b: {bits}), 4294967295)"
    beside = "sha256(CASE WHEN q.i % 2 = 0 THEN q.fold || coalesce(s.h, '') ELSE s.h || q.fold END), q.sib || coalesce(s.h, '')"
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, {leaf("n_chars")} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars + 1")} END AS changed FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m FROM d),
    n(tree, l, i, h, m) AS (SELECT tree, 0, pos, leaf, m FROM p UNION ALL SELECT tree, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (m + 1) // 2 FROM n WHERE m > 1 GROUP BY tree, l, i // 2, m),
    t AS (SELECT tree, l AS top, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS m FROM n WHERE m = 1),
    k(l, i, h, m) AS (SELECT 0, pos, subroot, m FROM t UNION ALL SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (m + 1) // 2 FROM k WHERE m > 1 GROUP BY l, i // 2, m),
    q(rid, tree, l, i, fold, sib) AS (SELECT rid, tree, 0, pos, coalesce(changed, leaf), '' FROM p
      UNION ALL SELECT q.rid, q.tree, q.l + 1, q.i // 2, {beside} FROM q JOIN t ON q.tree = t.tree AND q.l < t.top LEFT JOIN n s ON s.tree = q.tree AND s.l = q.l AND s.i = xor(q.i, 1)),
    w AS (SELECT l AS top, h AS root FROM k WHERE m = 1),
    u(rid, l, i, fold, sib) AS (SELECT q.rid, 0, t.pos, q.fold, q.sib FROM q JOIN t ON q.tree = t.tree AND q.l = t.top
      UNION ALL SELECT q.rid, q.l + 1, q.i // 2, {beside} FROM u q JOIN w ON q.l < w.top LEFT JOIN k s ON s.l = q.l AND s.i = xor(q.i, 1))
    SELECT p.doc_id, p.leaf, t.subroot, w.root, sha256(u.sib) AS proof_sha256, u.fold AS folded_root, u.fold = w.root AS verified
    FROM u JOIN w ON u.l = w.top JOIN p ON p.rid = u.rid JOIN t ON t.tree = p.tree
    """


@register("op12_merkle_manifest", _merkle_sql())
def op12(spark, sf_dir):
    from veilframe.llm.merkle import merkle_query

    return merkle_query(table(spark, sf_dir, "documents"))


@register(
    "op13_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT g.lang, g.source, k.term, k.n AS all_n, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x USING (lang, source, term)),
    p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w) AS p, 1 + 1000000000::HUGEINT * (all_n + 2) // (sum(all_n) OVER w + 2 * count(*) OVER w) AS q FROM c WINDOW w AS (PARTITION BY lang, source)),
    s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM o)
    SELECT * FROM r WHERE part = 'pair' OR rank <= 10
    """,
)
def op13(spark, sf_dir):
    from veilframe.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))
