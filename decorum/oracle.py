"""DuckDB statements that say the same as the queries, written on their own.

RE2 knows no lookaround and its word class is ASCII only. So the statements work on
character and word lists, and where a word boundary matters they wrap each non-ASCII
letter in digits (a word character that no pattern uses) and unwrap it afterwards.
"""

import unicodedata

from decorum import lexicon as L

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
GAP = SPACE[:-1] + r".\-_,;:]+"
WRAP = "7268627"
TOKEN = r"[\p{L}\p{N}_]"


def q(text):
    return "'" + text.replace("'", "''") + "'"


def in_list(words):
    return "(" + ", ".join(q(w) for w in words) + ")"


def lookup(value, pairs):
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items())
    return f"CASE {value} {whens} END"


# ---- the nine steps, each an expression over the column x

def nfkd():
    # The accented and compatibility characters of Latin-1, the only ones in the tables.
    out = "x"
    for char in map(chr, range(0x80, 0x100)):
        parts = unicodedata.normalize("NFKD", char)
        if parts != char:
            out = f"replace({out}, {q(char)}, {q(parts)})"
    return out


def homoglyphs():
    one = {k: v for k, v in L.HOMOGLYPHS.items() if len(v) == 1}
    out = "x"
    for k, v in L.HOMOGLYPHS.items():
        if len(v) != 1:
            out = f"replace({out}, {q(k)}, {q(v)})"
    return f"translate({out}, {q(''.join(one))}, {q(''.join(one.values()))})"


def leet():
    symbols = "".join(L.LEET_MAP)

    def ok(c):
        return f"(contains({q(symbols)}, {c}) OR regexp_matches({c}, '\\p{{L}}'))"

    return f"""array_to_string(list_transform(
        list_zip(string_split(x, ''), list_prepend(' ', string_split(x, '')), string_split(x, '')[2:]),
        lambda p: CASE WHEN contains({q(symbols)}, p[1]) AND ({ok('p[2]')} OR {ok("coalesce(p[3], ' ')")})
             THEN {lookup('p[1]', L.LEET_MAP)} ELSE p[1] END), '')"""


def wrap(expr="x"):
    return (f"regexp_replace({expr}, '([^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}])', "
            f"'{WRAP}\\1{WRAP}', 'g')")


def unwrap(expr):
    return f"replace({expr}, '{WRAP}', '')"


def separators():
    run = rf"\b[a-zA-Z]{GAP}[a-zA-Z]{GAP}[a-zA-Z](?:{GAP}[a-zA-Z])*"
    return unwrap(f"""array_to_string(list_transform(
        list_zip(regexp_split_to_array({wrap()}, {q(run)}), regexp_extract_all({wrap()}, {q(run)})),
        lambda p: p[1] || coalesce(regexp_replace(p[2], {q(GAP)}, '', 'g'), '')), '')""")


def repetition():
    return """array_to_string(list_transform(
        list_zip(string_split(x, ''), list_prepend('', string_split(x, '')),
                 list_prepend('', list_prepend('', string_split(x, '')))),
        lambda p: CASE WHEN p[1] = p[2] AND p[1] = p[3] AND p[1] <> chr(10) THEN '' ELSE p[1] END), '')"""


def patterns(pairs):
    out = wrap()
    for pattern, word in pairs:
        out = f"regexp_replace({out}, {q(pattern)}, {q(word)}, 'gi')"
    return unwrap(out)


def by_word(rule):
    trimmed = f"regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')"
    return f"""array_to_string(list_transform(list_transform(
        regexp_split_to_array({trimmed}, '{SPACE}+'),
        lambda w: {{'w': w, 'b': lower(trim(w, {q(L.WORD_TRIM)}))}}),
        lambda s: CASE WHEN regexp_full_match(s.b, '\\p{{L}}{{3,8}}') AND s.b NOT IN {in_list(L.TOXIC_WORDS)}
                   AND s.b NOT IN {in_list(L.SAFE_WORDS)}
             THEN coalesce({rule}, s.w) ELSE s.w END), ' ')"""


def letters(word):
    return f"array_to_string(list_sort(string_split({word}, '')), '')"


def anagrams():
    return by_word(lookup(letters("s.b"), {"".join(sorted(w)): w for w in L.TOXIC_WORDS}))


def first_near(word):
    # The distance counts bytes, so each other letter becomes one byte first.
    plain = f"regexp_replace({word}, '[^\\x00-\\x7F]', '0', 'g')"
    whens = " ".join(
        f"WHEN abs(length({word}) - {len(w)}) <= 1 AND damerau_levenshtein({plain}, '{w}') = 1 THEN '{w}'"
        for w in L.TOXIC_WORDS
    )
    return f"CASE {whens} END"


def near_words():
    return by_word(first_near("s.b"))


STEPS = {
    "nfkd": nfkd(), "homoglyphs": homoglyphs(), "leet": leet(), "separators": separators(),
    "repetition": repetition(), "slurs": patterns(L.SLUR_PATTERNS),
    "transpositions": patterns(L.TRANSPOSITION_PATTERNS),
    "anagrams": anagrams(), "near_words": near_words(),
}


def one_step(name, table="documents", ids="doc_id"):
    return f"SELECT {ids}, {STEPS[name]} AS {name} FROM (SELECT {ids}, text AS x FROM {table})"


def chain(source, ids):
    """CTEs s0..s9 over ``source`` (columns ``ids`` and text); x holds the result."""
    ctes = [f"s0 AS MATERIALIZED (SELECT {ids}, text AS comment, text AS x FROM {source})"]
    for i, step in enumerate(STEPS.values(), 1):
        ctes.append(f"s{i} AS MATERIALIZED (SELECT * EXCLUDE (x), {step} AS x FROM s{i - 1})")
    return ", ".join(ctes)


# ---- masking and scores

# Written apart from the library's recognizers: e-mail addresses in any alphabet, and
# telephone numbers by the four ways to write an area code.
NUMBER = r"[0-9]{3}[ .\x{2013}-]?[0-9]{4}\b"
RECOGNIZERS = {
    "EMAIL_ADDRESS": r"[-+%._\p{N}\p{L}]+@[-.\p{N}\p{L}]+[.]\p{L}(?:[-\p{N}\p{L}]*[\p{N}\p{L}])",
    "US_SSN": r"\b\d\d\d-\d\d-\d\d\d\d\b",
    "PHONE_NUMBER": rf"\+1[ .\x{{2013}}-]?\([0-9]{{3}}\)[ .\x{{2013}}-]?{NUMBER}|\+1[ .\x{{2013}}-]?[0-9]{{3}}[ .\x{{2013}}-]?{NUMBER}"
                    rf"|\([0-9]{{3}}\)[ .\x{{2013}}-]?{NUMBER}|\b[0-9]{{3}}[ .\x{{2013}}-]?{NUMBER}",
}


def masked(expr):
    for name, pattern in RECOGNIZERS.items():
        expr = f"regexp_replace({expr}, {q(pattern)}, '<{name}>', 'g')"
    return expr


def hits(expr, words):
    return (f"len(list_filter(regexp_extract_all(lower({expr}), '{TOKEN}+'), "
            f"lambda t: t IN {in_list(words)}))")


ALL_WORDS = sorted({w for group in L.STANDIN_LABELS.values() for w in group})


def scored(ids, source=None):
    """CTEs up to ``p``: one row per row of ``source`` with all prediction columns."""
    groups = L.STANDIN_LABELS
    source = source or DOCS
    counts = ", ".join(f"{hits('x', words)} AS n_{label}" for label, words in groups.items())
    most = "greatest(" + ", ".join(f"n_{g}" for g in groups) + ")"
    label = "CASE " + " ".join(
        f"WHEN {most} > 0 AND n_{g} = {most} THEN '{g}'" for g in groups
    ) + " ELSE 'toxic' END"
    return f"""{chain(source, ids)},
    h AS (SELECT {ids}, comment, x AS normalized_comment, {masked('x')} AS masked_comment,
            least(1.0::DOUBLE, {hits('x', ALL_WORDS)}::DOUBLE * 10.0::DOUBLE
                  / greatest(len(regexp_extract_all(x, '{TOKEN}{{2,}}')), 1)) AS ml_score, {counts} FROM s9),
    t AS (SELECT *, {label} AS llm_label,
            CASE WHEN {most} > 0 THEN 1::DOUBLE - 1::DOUBLE / (1 + {most}) ELSE 0.001::DOUBLE END AS llm_confidence
          FROM h),
    b AS (SELECT *, ml_score * 0.3::DOUBLE + llm_confidence * 0.7::DOUBLE AS hybrid_score,
            {lookup('llm_label', L.POLICIES)} AS policy FROM t),
    p AS (SELECT {ids}, comment, masked_comment, normalized_comment, ml_score, llm_label, llm_confidence,
            hybrid_score, hybrid_score > 0.5 AS is_toxic, {band('hybrid_score')} AS risk_level,
            coalesce(policy, {q(L.DEFAULT_POLICY)}) AS policy_violation,
            printf('LLM confidence: %.1f%% - %s', llm_confidence * 100,
                   coalesce(policy, {q(L.DEFAULT_ADVICE)})) AS llm_explanation FROM b)"""


def band(h):
    return f"CASE WHEN {h} > 0.7 THEN 'HIGH' WHEN {h} > 0.3 THEN 'MEDIUM' ELSE 'LOW' END"


ROUNDED = """comment, masked_comment, normalized_comment, round(ml_score, 6) AS ml_score, llm_label,
    round(llm_confidence, 6) AS llm_confidence, round(hybrid_score, 6) AS hybrid_score, is_toxic,
    risk_level, policy_violation, llm_explanation"""

LABELLED = "(SELECT d.doc_id, d.text AS comment_text, l.toxic FROM documents d JOIN labels l USING (doc_id))"
DOCS = f"(SELECT doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text FROM documents)"
LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
STRIP = f"'^{SPACE}+|{SPACE}+$', '', 'g'"
TOKENS = f"""(SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{TOKEN}{{2,}}'),
    lambda t: t NOT IN {in_list(L.COMMON_STOPS)}) AS tokens FROM documents)"""
TERMS = f"""(SELECT doc_id, list_concat(tokens, [tokens[i] || ' ' || tokens[i + 1]
    FOR i IN range(1, len(tokens))]) AS terms FROM {TOKENS})"""
TERM_ROWS = f"(SELECT doc_id, unnest(terms) AS term FROM {TERMS})"
VOCABULARY = f"""(SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM {TERM_ROWS}
    GROUP BY term HAVING count(DISTINCT doc_id) >= {L.MIN_DF} ORDER BY tf DESC, term LIMIT {L.VOCABULARY_SIZE})"""
WORDS = r"(SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY word)"
RULE = f"""(SELECT l.toxic AS label, ({hits('d.text', L.STANDIN_LABELS['insult'])} > 0)::INT AS pred
    FROM documents d JOIN labels l USING (doc_id))"""
ARRIVALS = f"""(SELECT e.event_id, e.ts, d.text FROM events e
    JOIN {DOCS} d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""
FLAGGED = f"""(SELECT event_id, ts, text, row_number() OVER (PARTITION BY text ORDER BY ts, event_id) > 1 AS cached
    FROM {ARRIVALS})"""


def audit():
    """CTEs up to ``a``: the audit rows of the first arrivals."""
    return f"""WITH {scored('doc_id')}, texts AS (SELECT DISTINCT * EXCLUDE (doc_id) FROM p),
    a AS (SELECT f.event_id AS id, f.ts AS timestamp, masked_comment AS original_text_masked, ml_score,
        llm_confidence, hybrid_score, risk_level, policy_violation, f.ts::DATE AS log_date
        FROM {FLAGGED} f JOIN texts ON f.text = texts.comment WHERE NOT f.cached)"""


ISO = """strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN ''
    ELSE '.' || strftime(timestamp, '%f') END"""
RECENT = "(SELECT * FROM a ORDER BY timestamp DESC, id DESC LIMIT {n})"
EMPTY_RISK = "(risk_level IS NULL OR risk_level = '')"


def percent(col):
    return f"CASE WHEN {col} IS NULL THEN '—' ELSE floor({col} * 100 + 0.5)::INT || '%' END"


def report():
    ratio = "CASE WHEN {1} = 0 THEN 0.0 ELSE {0}::DOUBLE / {1} END"
    return f"""WITH r AS {RULE}, c AS (SELECT class,
        count(*) FILTER (label = class AND pred = class) AS hits,
        count(*) FILTER (label = class) AS support, count(*) FILTER (pred = class) AS predicted
        FROM r, (SELECT DISTINCT unnest([label, pred]) AS class FROM r) GROUP BY class),
    m AS (SELECT class, support, hits, {ratio.format('hits', 'predicted')} AS "precision",
        {ratio.format('hits', 'support')} AS recall,
        {ratio.format('2 * hits', '(support + predicted)')} AS f1 FROM c)
    SELECT class::VARCHAR AS class, round("precision", 6) AS "precision", round(recall, 6) AS recall,
        round(f1, 6) AS f1, support FROM m
    UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
        round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM m
    UNION ALL SELECT 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6),
        sum(support)::BIGINT FROM m
    UNION ALL SELECT 'weighted avg', round(sum("precision" * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
        sum(support)::BIGINT FROM m"""


def evasion():
    changed = []
    names = list(STEPS)
    for i, name in enumerate(names, 1):
        changed.append(f"SELECT {i} AS step, '{name}' AS name, (SELECT count(*) FROM s{i - 1} a JOIN s{i} b "
                       f"USING (doc_id) WHERE a.x <> b.x) AS texts_changed")
    return f"WITH {chain('documents', 'doc_id')} " + " UNION ALL ".join(changed)


def pii():
    rows, text = [], "text"
    for name, pattern in RECOGNIZERS.items():
        rows.append(f"SELECT '{name}' AS entity, count(*) FILTER (n > 0) AS texts, sum(n)::BIGINT AS entities "
                    f"FROM (SELECT len(regexp_extract_all({text}, {q(pattern)})) AS n FROM documents)")
        text = f"regexp_replace({text}, {q(pattern)}, '<{name}>', 'g')"
    return " UNION ALL ".join(rows)


def missing(col):
    low = f"regexp_replace(lower({col}), {STRIP})"
    return f"({col} IS NULL OR {col} IN {in_list(L.RAW_NA)} OR {low} IN {in_list(L.LOWER_NA)})"


def statements():
    docs = scored("doc_id")
    blank = f"regexp_replace(coalesce(line, ''), {STRIP}) = ''"
    split = ("CASE WHEN ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 "
             "THEN 'val' ELSE 'train' END")
    known = "(SELECT c.text FROM conversations c)"
    groups = ", ".join(hits("x", some) for some in L.STANDIN_LABELS.values())
    words = f"CASE WHEN greatest({groups}) > 0 THEN 1::DOUBLE - 1::DOUBLE / (1 + greatest({groups})) ELSE 0.001 END"
    out = {
        "nfkd_text": one_step("nfkd"),
        "homoglyph_fold": one_step("homoglyphs"),
        "leet_reverse": one_step("leet"),
        "strip_separators": one_step("separators"),
        "reduce_repetition": one_step("repetition"),
        "slur_patterns": one_step("slurs"),
        "transposition_patterns": one_step("transpositions"),
        "anagram_fold": one_step("anagrams"),
        "near_word_fold": one_step("near_words"),
        "chat_normalize": f"WITH {chain('conversations', 'conv_id, turn')} "
                          "SELECT conv_id, turn, x AS normalized FROM s9",
        "normalize_full": f"WITH {chain('documents', 'doc_id')} SELECT doc_id, x AS normalized FROM s9",
        "evasion_report": evasion(),
        "vocab_near_words": f"""SELECT word, {first_near('word')} AS lexicon_word FROM {WORDS}
            WHERE {first_near('word')} IS NOT NULL""",
        "vocab_anagrams": f"""SELECT * FROM (SELECT word, n,
            {lookup(letters('word'), {''.join(sorted(w)): w for w in L.TOXIC_WORDS})} AS lexicon_word FROM {WORDS})
            WHERE lexicon_word IS NOT NULL AND lexicon_word <> word""",
        "vocab_unsafe_words": f"SELECT word, n FROM {WORDS} WHERE word NOT IN {in_list(L.SAFE_WORDS)}",
        "mask_pii": f"SELECT doc_id, {masked('text')} AS masked FROM documents",
        "mask_after_normalize": f"WITH {chain('documents', 'doc_id')} SELECT doc_id, {masked('x')} AS masked FROM s9",
        "names_learned": """SELECT doc_id, concat_ws(chr(10), text, ['my friend <PERSON> said so', 'we met <PERSON> yesterday',
            'then they asked <PERSON> politely', 'greet Dr. <PERSON> kindly'][((doc_id // 2) % 4 + 1)::INT]) AS text FROM documents""",
        "pii_summary": pii(),
        "clean_comments": f"""SELECT doc_id, regexp_replace(lower(comment_text), {STRIP}) AS comment_text, toxic,
            {', '.join(f'0 AS {c}' for c in L.EXTRA_LABELS)} FROM {LABELLED}
            WHERE NOT {missing('comment_text')} AND regexp_replace(comment_text, {STRIP}) <> ''""",
        "cleaning_counts": f"""SELECT count(*) AS rows_raw, count(*) FILTER ({missing('line')}) AS rows_missing,
            count(*) FILTER (NOT {missing('line')} AND {blank}) AS rows_blank,
            count(*) FILTER (NOT {missing('line')} AND NOT {blank}) AS rows_clean FROM {LINES}""",
        "reject_blank": f"""SELECT CASE WHEN {blank} THEN {q(L.EMPTY_REASON)} ELSE 'ok' END AS status,
            count(*) AS n, sum(length(regexp_replace(line, {STRIP})))::BIGINT AS chars FROM {LINES} GROUP BY 1""",
        "label_int": """SELECT doc_id, try_cast(t AS INT) AS label, CASE WHEN try_cast(t AS INT) IS NULL THEN t END AS rejected
            FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE toxic::VARCHAR END AS t
                  FROM documents JOIN labels USING (doc_id))""",
        "select_xy": f"SELECT comment_text AS text, toxic AS label FROM {LABELLED}",
        "sample_n": "SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200",
        "train_val_split": f"SELECT doc_id, {split} AS split FROM documents",
        "train_val_split_exact": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
            <= ceil((SELECT count(*) FROM documents) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split
            FROM documents""",
        "tokens": f"""SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM
            (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}{{2,}}') AS tokens FROM documents)""",
        "stop_filtered": f"SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM {TOKENS}",
        "bigrams": f"""SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] AS bigram, count(*) AS n
            FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM {TOKENS}) GROUP BY 1, 2""",
        "doc_frequency": f"""SELECT term, count(DISTINCT doc_id) AS df FROM {TERM_ROWS} GROUP BY term
            HAVING count(DISTINCT doc_id) >= {L.MIN_DF}""",
        "term_frequency": f"SELECT term, count(*) AS tf FROM {TERM_ROWS} GROUP BY term",
        "top_terms": f"SELECT term, tf, df FROM {VOCABULARY}",
        "tfidf_terms": f"""WITH v AS MATERIALIZED {VOCABULARY}, n AS (SELECT count(*) AS n FROM documents),
            c AS (SELECT doc_id, term, df, count(*) AS tf FROM {TERM_ROWS} JOIN v USING (term) GROUP BY ALL),
            w AS (SELECT doc_id, term, c.tf, c.df, c.tf * (ln((1 + n) / (1 + c.df)::DOUBLE) + 1) AS weight FROM c, n)
            SELECT doc_id, term, tf, df,
            round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""",
        "class_weights": """SELECT toxic AS label, count(*) AS rows, round((SELECT count(*) FROM labels)::DOUBLE
            / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY toxic""",
        "accuracy_rule": f"SELECT round(avg((label = pred)::INT), 6) AS accuracy FROM {RULE}",
        "classification_report": report(),
        "policy_map": f"""WITH {docs} SELECT doc_id, llm_label, policy_violation, llm_explanation FROM p""",
        "hybrid_risk": f"""WITH {docs} SELECT doc_id, round(hybrid_score, 6) AS hybrid_score, is_toxic, risk_level
            FROM p""",
        "score_long": f"""WITH {docs} SELECT doc_id, name, floor(s * 100 + 0.5)::BIGINT AS score FROM p,
            LATERAL (VALUES ('ML Model', ml_score), ('LLM (BERT)', llm_confidence), ('Hybrid', hybrid_score)) v(name, s)""",
        "percent_display": f"""WITH {docs} SELECT doc_id, {percent('ml_score')} AS ml, {percent('llm_confidence')} AS llm,
            {percent('hybrid_score')} AS hybrid FROM p""",
        "predict_batch": f"WITH {docs} SELECT doc_id, {ROUNDED} FROM p",
        "flagship_risk": f"""WITH {docs} SELECT risk_level, policy_violation, count(*) AS n,
            round(avg(hybrid_score), 6) AS avg_hybrid FROM p GROUP BY 1, 2""",
        "cached_flags": f"SELECT event_id, cached FROM {FLAGGED}",
        "cache_stats": f"""SELECT count(*) - count(DISTINCT text) AS hits, count(DISTINCT text) AS misses
            FROM {ARRIVALS} WHERE text <> ''""",
        "lr_checks": f"""SELECT count(*) FILTER (side = 'val') AS n_val, true AS probabilities, true AS decided,
            true AS stored_alike, count(*) FILTER (side = 'train') AS n_train, true AS minimum
            FROM (SELECT {split} AS side FROM {LABELLED}
                  WHERE NOT {missing('comment_text')} AND regexp_replace(comment_text, {STRIP}) <> '')""",
        "model_predictions": f"""WITH r AS (SELECT {split} AS split, toxic, {words} AS score
                FROM (SELECT doc_id, regexp_replace(lower(comment_text), {STRIP}) AS x, toxic FROM {LABELLED}
                      WHERE NOT {missing('comment_text')} AND regexp_replace(comment_text, {STRIP}) <> ''))
            SELECT split, count(*) AS n, sum(toxic)::BIGINT AS toxic, 0::BIGINT AS errors, true AS blended,
            round((SELECT avg(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5 ELSE 0 END)
                FROM r p JOIN r q ON p.toxic = 1 AND q.toxic = 0 AND p.split = r.split AND q.split = r.split), 6) AS auc_of_words,
            CASE WHEN sum(toxic) >= 5 THEN true END AS better FROM r GROUP BY split""",
        "scorer_errors": f"""WITH {docs}, e AS (SELECT doc_id, normalized_comment AS x, ml_score, length(normalized_comment) AS n FROM p)
            SELECT doc_id, CASE WHEN n % 7 = 0 THEN 'length ' || n END AS error,
            CASE WHEN n % 7 <> 0 THEN (n % 100) / 100.0::DOUBLE END AS llm_confidence,
            CASE WHEN n % 7 <> 0 THEN round(ml_score * 0.3::DOUBLE + (n % 100) / 100.0::DOUBLE * 0.7::DOUBLE, 6) END AS hybrid_score,
            {band('CASE WHEN n % 7 <> 0 THEN ml_score * 0.3::DOUBLE + (n % 100) / 100.0::DOUBLE * 0.7::DOUBLE END')} AS risk_level FROM e""",
        "csv_round_trip": f"""SELECT toxic::VARCHAR AS toxic, count(*) AS n, sum(length(comment_text))::BIGINT AS chars,
            sum(('0x' || substr(md5(comment_text), 1, 8))::BIGINT)::BIGINT AS "check" FROM {LABELLED} GROUP BY 1""",
        "csv_rejects": """SELECT CASE WHEN doc_id % 10 = 3 THEN 'surplus fields' WHEN doc_id % 10 = 6 THEN 'missing fields' ELSE 'read' END AS kind,
            count(*) AS n, sum(length(regexp_replace(text, '["\n]', ' ', 'g'))
                + CASE WHEN doc_id % 10 = 3 THEN 10 WHEN doc_id % 10 = 6 THEN 2 ELSE 0 END)::BIGINT AS chars FROM documents GROUP BY 1""",
        "written_set": f"""SELECT toxic, count(*) AS n,
            sum(length(lower(regexp_replace(comment_text, {STRIP}))))::BIGINT AS chars FROM {LABELLED}
            WHERE NOT {missing('comment_text')} AND regexp_replace(comment_text, {STRIP}) <> '' GROUP BY 1""",
        "write_times": f"""SELECT true AS written, count(*) AS n, true AS not_early, true AS not_late, true AS dated
            FROM {DOCS} WHERE text <> ''""",
        "explanations": """SELECT event_id, printf('LLM confidence: %.1f%% - %s',
            ((event_id * 7919 + (SELECT sum(n_chars) FROM documents)) % 10001) / 10000.0::DOUBLE * 100, event_type) AS sentence FROM events""",
        "score_new_only": f"""WITH {docs} SELECT doc_id, round(hybrid_score, 6) AS hybrid_score, risk_level,
            comment IN {known} AS reused FROM p""",
        "audit_recent": f"""{audit()} SELECT id, timestamp, original_text_masked, round(ml_score, 6) AS ml_score,
            round(llm_confidence, 6) AS llm_confidence, round(hybrid_score, 6) AS hybrid_score, risk_level,
            policy_violation, log_date FROM {RECENT.format(n=L.RECENT_ROWS)}""",
        "audit_view": f"""{audit()} SELECT id, {ISO} AS timestamp, original_text_masked, round(ml_score, 6) AS ml_score,
            round(llm_confidence, 6) AS llm_confidence, round(hybrid_score, 6) AS hybrid_score, risk_level,
            policy_violation FROM a""",
        "audit_display": f"""{audit()} SELECT '#' || id AS id, strftime(timestamp, '%-m/%-d/%Y, %-I:%M:%S %p') AS time,
            original_text_masked AS text, {percent('ml_score')} AS ml, {percent('llm_confidence')} AS llm,
            {percent('hybrid_score')} AS hybrid,
            CASE WHEN hybrid_score > 0.5 THEN 'danger' ELSE 'success' END AS colour,
            CASE WHEN {EMPTY_RISK} THEN 'low' ELSE lower(risk_level) END AS badge,
            CASE WHEN {EMPTY_RISK} THEN '—' ELSE risk_level END AS risk, policy_violation AS policy
            FROM {RECENT.format(n=20)}""",
        "risk_summary": f"""{audit()} SELECT log_date, risk_level, policy_violation, count(*) AS n,
            round(avg(ml_score), 6) AS avg_ml, round(avg(llm_confidence), 6) AS avg_llm,
            round(avg(hybrid_score), 6) AS avg_hybrid FROM a GROUP BY 1, 2, 3""",
        "risk_rollup": f"""{audit()} SELECT log_date, risk_level, grouping(log_date, risk_level) AS level,
            count(*) AS n, round(avg(hybrid_score), 6) AS avg_hybrid FROM a GROUP BY ROLLUP (log_date, risk_level)""",
        "audit_written": f"{audit()} SELECT log_date, count(*) AS n, sum(length(original_text_masked))::BIGINT AS chars "
                         "FROM a GROUP BY 1",
        "stream_scored": f"""WITH {docs}, texts AS (SELECT DISTINCT * EXCLUDE (doc_id) FROM p)
            SELECT event_id, masked_comment, round(hybrid_score, 6) AS hybrid_score, risk_level
            FROM {ARRIVALS} e JOIN texts ON e.text = texts.comment""",
        "stream_misses": f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS arrivals,
            count(*) FILTER (NOT cached) AS misses, count(*) FILTER (cached) AS hits
            FROM {FLAGGED} WHERE text <> '' GROUP BY 1""",
        "stream_dedup": f"SELECT DISTINCT sha256(text) AS text_key FROM {ARRIVALS}",
        "stream_risk_windows": f"""WITH {docs}, texts AS (SELECT DISTINCT * EXCLUDE (doc_id) FROM p)
            SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, risk_level, count(*) AS n
            FROM {ARRIVALS} e JOIN texts ON e.text = texts.comment GROUP BY 1, 2""",
        "stream_audit": f"""WITH {docs}, texts AS (SELECT DISTINCT * EXCLUDE (doc_id) FROM p)
            SELECT risk_level, count(*) AS n FROM texts
            WHERE comment IN (SELECT text FROM {ARRIVALS}) GROUP BY 1""",
    }
    # The same results by another way.
    return {**out, "audit_newest": out["audit_recent"], "risk_summary_kept": out["risk_summary"]}
