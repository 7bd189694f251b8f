"""DuckDB statements for the operators that SQL can express."""

STATEMENTS = {}

STATEMENTS["op1_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

STATEMENTS["op10_decontaminate"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item WHERE len(w) > 0)
), doc_window AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, d.n, p, item_id FROM doc_window d JOIN item_window i ON d.n = i.n AND d.s = i.s
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The lengths of the markers of a turn, and what makes a conversation need escapes.
STATEMENTS["op2_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 19 + length(role) END AS marks,
         length(regexp_replace(text, '\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[TEXT\]|\\', '\0.', 'g')) AS escaped,
         regexp_matches(text, '\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[TEXT\]') OR regexp_matches(text, '\\(.|\n)') AS conflict
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(marks) + CASE WHEN bool_or(conflict) THEN sum(escaped) ELSE sum(length(text)) END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

STATEMENTS["op8_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, n - 1 AS pos, len(l) AS n_lines, l[n] AS line,
         len(regexp_extract_all(l[n], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), summed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS w1,
         sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS w0 FROM line
), run AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM summed a JOIN summed b
  ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.w1 >= a.w0 + 10 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM summed a JOIN summed b
  ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.w1 >= a.w0 + 10 GROUP BY ALL
), content AS (
  SELECT r.doc_id, s, e, string_agg(line, chr(10) ORDER BY pos) AS t
  FROM run r JOIN line l ON r.doc_id = l.doc_id AND l.pos BETWEEN s AND e GROUP BY ALL
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM content) WHERE k > 1
)
SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_chars,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM line LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
"""

STATEMENTS["op9_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '17', doc_id)), 1, 15))::BIGINT AS draw FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap,
         (SELECT sum(source_size) FROM per_source)::DOUBLE AS whole FROM per_source
), capped AS (
  -- A source is full if the level that fills all before it (by cap / weight) would fill it too.
  SELECT a.*, a.cap * (SELECT sum(w) FROM weighed b WHERE (b.cap / b.w, b.rank) >= (a.cap / a.w, a.rank))
         < a.w * (a.whole - coalesce((SELECT sum(cap) FROM weighed b WHERE (b.cap / b.w, b.rank) < (a.cap / a.w, a.rank)), 0)) AS is_full
  FROM weighed a
), aimed AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE w * (whole - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
                / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM capped
), won AS (
  SELECT rank, count(*) AS seats FROM (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank, k) AS place
    FROM (SELECT rank, target, unnest(range(1, (source_size * 3 // 32 + 3)::BIGINT)) AS k FROM aimed WHERE target > 0)
  ) WHERE place <= (SELECT round(sum(target) / 32) FROM aimed) GROUP BY rank
), dealt AS (
  SELECT s.*, a.rank, a.source_size, a.target, coalesce(won.seats, 0) AS seats,
         s.draw % ceil(greatest(a.source_size, 1) / 262144)::BIGINT AS shard
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN won USING (rank)
), shard AS (
  SELECT rank, shard, any_value(seats) AS seats, sum(size)::BIGINT AS words,
         greatest(round(sum(size) / 32), 1)::BIGINT AS blocks FROM dealt GROUP BY rank, shard
), shard_won AS (
  SELECT rank, shard, count(*) AS quota FROM (
    SELECT rank, shard, seats, row_number() OVER (PARTITION BY rank ORDER BY words / (2 * k - 1) DESC, shard, k) AS place
    FROM (SELECT *, unnest(range(1, seats + 1)) AS k FROM shard WHERE words > 0)
  ) WHERE place <= seats GROUP BY rank, shard
), planned AS (
  SELECT d.*, words, blocks, least(coalesce(quota, 0), blocks * 3) AS quota,
         ('0x' || substr(md5(concat_ws(':', '17', rank, shard)), 1, 15))::BIGINT % blocks AS start,
         coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY draw, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM dealt d JOIN shard USING (rank, shard) LEFT JOIN shard_won USING (rank, shard)
), taken AS (
  SELECT doc_id, draw, sum((least((b + 1) * words // blocks, place + size) - greatest(b * words // blocks, place))
                     * ((b + 1 + start) * quota // blocks - (b + start) * quota // blocks))::BIGINT AS taken
  FROM (SELECT *, unnest(range(((place + 1) * blocks - 1) // words, ((place + size) * blocks - 1) // words + 1)) AS b
        FROM planned WHERE size > 0) GROUP BY doc_id, draw
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM planned LEFT JOIN taken USING (doc_id)
"""

STATEMENTS["op11_ranked_search"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
    totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
    m AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM docs, totals),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM tf, totals GROUP BY term, n_docs),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

STATEMENTS["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang
), places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
), counted AS (
  SELECT lang, w[i:i + k - 1] AS words, count(*) AS f FROM places, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
  HAVING count(*) >= 100
), candidates AS (SELECT lang, words, f AS a FROM counted WHERE len(words) >= 2
), cuts AS (
  SELECT c.lang, c.words, c.a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM candidates) c JOIN sizes USING (lang)
  JOIN counted x ON x.lang = c.lang AND x.words = c.words[1:k]
  JOIN counted y ON y.lang = c.lang AND y.words = c.words[k + 1:len(c.words)]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT DISTINCT q.lang, q.words[i:j] AS words, q.a FROM candidates q, range(1, 6) s(i), range(1, 6) e(j)
  WHERE j > i AND j <= len(q.words) AND j - i + 1 < len(q.words)
), gone AS (
  SELECT DISTINCT c.lang, c.words FROM candidates c JOIN inner_phrases q ON q.lang = c.lang AND q.words = c.words AND q.a >= c.a
), ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM best ANTI JOIN gone USING (lang, words)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n,
       score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000
"""
