"""DuckDB SQL that computes the registered results independently, where SQL can.

Operators 4, 6, 7, 8, 10 and 12 have none: they learn models, compress, permute by
Spark's hash, search a trie or decompose a matrix, and are tested against brute force instead.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def _groups(k: int, percent: int, more: str = "") -> str:
    """Components of the documents linked by at least ``percent`` per cent of their distinct k-word shingles."""
    shingle = " || ' ' || ".join(["w[i]", *(f"w[i + {j}]" for j in range(1, k))])
    return f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
    FROM documents
), member AS (
    SELECT doc_id, unnest(list_distinct(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle}) END)) AS s
    FROM words
), size AS (SELECT doc_id, count(*) AS n FROM member GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter
    FROM member a JOIN member b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
    WHERE 100 * inter >= {percent} * (p.n + q.n - inter)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(reach.y) AS component_id{more}
FROM documents d LEFT JOIN size USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
"""


OP1 = _groups(3, 90)
OP13 = _groups(4, 80, ", d.doc_id = min(reach.y) AS kept")

OP2 = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS begins,
        length(text) + length(regexp_replace(text, '[^~<\\[]', '', 'g')) AS body,
        length(role) + length(regexp_replace(role, '[^~<\\[]', '', 'g')) AS head
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(body + CASE WHEN begins THEN head + length('<|start|><|message|><|end|>') ELSE length('<|next|>') END)::BIGINT AS formatted_chars,
    count(*) FILTER (begins) AS n_blocks
FROM marked GROUP BY conv_id
"""

OP3 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP5 = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
place AS (SELECT r, h, unnest(range(0, strlen(text) - 399)) AS p FROM doc WHERE strlen(text) >= 400),
keyed AS (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM place),
hit AS (SELECT r, p FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
mark AS (SELECT r, p, p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p) + 400, -1) AS begins FROM hit),
run AS (SELECT r, p, sum(begins::INT) OVER (PARTITION BY r ORDER BY p) AS g FROM mark),
span AS (SELECT r, g, min(p) AS b, max(p) + 400 AS e FROM run GROUP BY r, g),
gap AS (
    SELECT span.r, b, e, coalesce(lag(e) OVER (PARTITION BY span.r ORDER BY b), 0) AS before FROM span
), cut AS (
    SELECT gap.r, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS kept
    FROM gap JOIN doc USING (r) GROUP BY gap.r
)
SELECT doc_id, strlen(text)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256,
    decode(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_text
FROM doc LEFT JOIN cut USING (r)
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
    SELECT *, max(page_id) OVER (PARTITION BY h) AS top,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS digest
    FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact
FROM named
"""


# The runs' crc32 is taken byte by byte (no built-in one); near words share a word with one place left out.
OP11 = """
WITH RECURSIVE step AS (
    SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END FROM step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
run AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents
), long_run AS (SELECT head, w, count(*) AS n FROM run WHERE length(w) >= 7 GROUP BY head, w),
hashed AS (
    SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(head || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
            ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END))),
        lambda s, b: xor(t[xor(s % 256, b) + 1], s // 256))) AS h
    FROM long_run, crc_table
), word AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 31 = 0 THEN w[:(h % length(w))::INT] || w[(h % length(w) + 2)::INT:] ELSE w END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM word)),
near AS (
    SELECT a.word, a.n, b.word AS o, b.n AS o_n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN word b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN word b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(o, (-o_n, o)) AS o, max(o_n) AS o_n FROM near GROUP BY word
), formed AS (
    SELECT word.word, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= 10 * word.n THEN o END AS form, CASE WHEN o_n >= 10 * word.n THEN o_n END AS form_n
    FROM word LEFT JOIN best USING (word)
), follow AS (
    SELECT word, word AS here, 0 AS d FROM formed
    UNION ALL SELECT follow.word, formed.form, d + 1 FROM follow JOIN formed ON follow.here = formed.word WHERE formed.form IS NOT NULL
), ended AS (SELECT word, arg_max(here, d) AS root FROM follow GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ended USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": OP1, "op2_chat_format": OP2, "op3_exact_topk": OP3, "op5_suffix_dedup": OP5, "op9_warc": OP9,
        "op11_spelling_variants": OP11, "op13_chosen_path": OP13,
    }
