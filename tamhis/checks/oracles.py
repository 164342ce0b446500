"""DuckDB statements of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from tamhis.checks import queries as q
from tamhis.functions import fixed
from tamhis.functions.text import punctuation_characters

W = r"[\p{L}\p{N}_]"
# White space of a Unicode string, for RE2.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


COSINE_KNN = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.id, b.id AS neighbor, round(1 - list_cosine_similarity(a.v, b.v), 9) AS d FROM e a JOIN e b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS rank FROM p)
    SELECT id, neighbor, rank::INTEGER AS rank, round(d, 6) AS distance FROM r WHERE rank <= 15"""


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arabic(c: str = "text") -> str:
    return f"translate(lower({c}), {s(q.LATIN)}, {s(q.ARABIC)})"


def mixed(c: str = "text") -> str:
    return f"translate({c}, {s(q.LATIN)}, {s(q.ARABIC)})"


FOLDS = ("".join(a for a, _ in fixed.LETTER_FOLDS), "".join(b for _, b in fixed.LETTER_FOLDS))


def strip_space(c):
    return f"regexp_replace(regexp_replace({c}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def normalize(c):
    return strip_space(f"translate({c}, {s(FOLDS[0] + fixed.DIACRITICS + fixed.TATWEEL)}, {s(FOLDS[1])})")


def url_email(c):
    return f"regexp_replace({c}, 'http[^{WS}]+|[^{WS}]+@[^{WS}]+', '', 'g')"


def punct(c):
    return f"translate(replace({c}, '/', ' '), {s(punctuation_characters())}, '')"


def chars(c):
    split = f"string_split({c}, '')"
    pairs = f"list_zip({split}, list_concat([NULL], {split}), true)"
    kept = f"list_filter({pairs}, lambda x: x[1] IS DISTINCT FROM x[2] OR x[1] = chr(10))"
    return f"array_to_string(list_transform({kept}, lambda x: x[1]), '')"


def words(c):
    w, g = f"regexp_extract_all({c}, '{W}+')", f"regexp_split_to_array({c}, '{W}+')"
    runs = f"list_zip({w}, list_concat([NULL], {w}), {g}, true)"
    parts = f"list_transform({runs}, lambda x: CASE WHEN x[1] IS NOT DISTINCT FROM x[2] THEN '' ELSE x[3] || x[1] END)"
    return f"CASE WHEN len({w}) = 0 THEN {c} ELSE array_to_string({parts}, '') || ({g})[-1] END"


def tokens_where(c, test):
    return f"array_to_string(list_filter(string_split({c}, ' '), lambda w: {test}), ' ')"


def listed(values) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]"


def stopped(c, values):
    return tokens_where(c, f"NOT list_contains({listed(values)}, w)")


def long_words(c):
    return tokens_where(c, "length(w) < 10")


def latin(c):
    return f"regexp_replace({c}, '[a-zA-Z]', '', 'g')"


def _prefix(w):
    cases = " ".join(f"WHEN starts_with({w}, {s(p)}) AND length({w}) >= {len(p) + 2} THEN {s(p)}" for p in fixed.PREFIXES)
    return f"CASE {cases} ELSE '' END"


def _suffix(w):
    cases = " ".join(f"WHEN ends_with({w}, {s(p)}) AND length({w}) >= {len(p) + 2} THEN {s(p)}" for p in fixed.SUFFIXES)
    return f"CASE {cases} ELSE '' END"


def _affixes(c):
    heads = f"list_transform(string_split({c}, ' '), lambda w: {{'w': w, 'p': {_prefix('w')}}})"
    rests = f"list_transform({heads}, lambda x: {{'p': x.p, 'r': substr(x.w, length(x.p) + 1)}})"
    return f"list_transform({rests}, lambda x: {{'p': x.p, 'r': x.r, 's': {_suffix('x.r')}}})"


def stem(c):
    return f"array_to_string(list_transform({_affixes(c)}, lambda x: left(x.r, length(x.r) - length(x.s))), ' ')"


def segment(c):
    return (
        f"array_to_string(list_transform({_affixes(c)}, lambda x: concat(CASE WHEN x.p = '' THEN '' ELSE x.p || '+' END, "
        "left(x.r, length(x.r) - length(x.s)), CASE WHEN x.s = '' THEN '' ELSE '+' || x.s END)), ' ')"
    )


def rule(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


def chain(start: str, steps, source="documents", extra="") -> str:
    """Common table expressions t0, t1, ... applying the steps one after another."""
    parts = [f"t0 AS (SELECT doc_id{extra}, {start} AS text FROM {source})"]
    for i, step in enumerate(steps):
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT doc_id{extra}, {step('text')} AS text FROM t{i})")
    return ", ".join(parts), f"t{len(steps)}"


CHAIN = (normalize, url_email, punct, chars, words, long_words, latin, lambda c: stopped(c, fixed.cleaning_stopwords()), stem)

TOKENS = f"regexp_extract_all(lower(text), '{W}{{2,}}')"


def term_rows(by="lang", source="documents"):
    return f"(SELECT {by}, unnest({TOKENS}) AS term FROM {source})"


def weights(source="documents", form="bm25", damp=True, by="lang"):
    """Body of a WITH list that ends in ``weighted (by, term, n, weight)``."""
    tf = "n / class_n"
    tf = f"sqrt({tf})" if damp else tf
    idf = "ln(1 + (a - f + 0.5) / (f + 0.5))" if form == "bm25" else "ln(1 + a / f)"
    return f"""
    cnt AS (SELECT {by}, term, count(*)::DOUBLE AS n FROM {term_rows(by, source)} GROUP BY {by}, term),
    cls AS (SELECT {by}, sum(n) AS class_n FROM cnt GROUP BY {by}),
    trm AS (SELECT term, sum(n) AS f FROM cnt GROUP BY term),
    avg_n AS (SELECT avg(class_n) AS a FROM cls),
    weighted AS (SELECT cnt.{by}, cnt.term, n::BIGINT AS n, {tf} * {idf} AS weight
        FROM cnt JOIN cls USING ({by}) JOIN trm USING (term) CROSS JOIN avg_n)"""


RANKED = "row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term)"
LABELS = "SELECT d.doc_id, {cols}, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
EN = "regexp_matches(left({c}, 10), '[\\x41-\\x7A]') AND NOT regexp_matches(left({c}, 10), '[\\x{{600}}-\\x{{6FF}}]')"
MEMORY = (
    f"SELECT text AS source_text, min({arabic()}) AS target_text FROM documents "
    "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY text"
)
CENTRES = """
    cells AS (SELECT vec_id AS doc_id, label, unnest(embedding)::DOUBLE AS v,
        generate_subscripts(embedding, 1) AS i FROM embeddings),
    centre AS (SELECT label, i, avg(v) AS m FROM cells GROUP BY label, i),
    dist AS (SELECT c.doc_id, m.label AS topic, sqrt(sum((c.v - m.m) * (c.v - m.m))) AS d
        FROM cells c JOIN centre m USING (i) GROUP BY c.doc_id, m.label)"""
DESCRIBED = f"""
    {weights()},
    cand AS (SELECT lang, term FROM (SELECT *, {RANKED} AS r FROM weighted) WHERE r <= 50),
    vec AS (SELECT doc_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i, lang, text
        FROM documents JOIN embeddings ON doc_id = vec_id),
    centre AS (SELECT lang, i, avg(v) AS m FROM vec GROUP BY lang, i),
    holds AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({TOKENS}) AS term
        FROM documents JOIN embeddings ON doc_id = vec_id) WHERE term IN (SELECT term FROM cand)),
    tvec AS (SELECT term, i, avg(v) AS v FROM holds JOIN vec USING (doc_id) GROUP BY term, i)"""
COSINE = "sum(t.v * c.m) / (sqrt(sum(t.v * t.v)) * sqrt(sum(c.m * c.m)))"


def _metrics(rows: str) -> str:
    """Weighted metrics of a relation (y, p)."""
    return f"""
    WITH pairs AS ({rows}), cnt AS (SELECT y, p, count(*)::DOUBLE AS n FROM pairs GROUP BY y, p),
    lab AS (SELECT y AS label FROM cnt UNION SELECT p FROM cnt),
    per AS (SELECT label,
        coalesce((SELECT sum(n) FROM cnt WHERE y = label AND p = label), 0) AS hit,
        coalesce((SELECT sum(n) FROM cnt WHERE p = label), 0) AS pred,
        coalesce((SELECT sum(n) FROM cnt WHERE y = label), 0) AS sup FROM lab),
    rat AS (SELECT *, CASE WHEN pred = 0 THEN 1 ELSE hit / pred END AS prec,
        CASE WHEN sup = 0 THEN 1 ELSE hit / sup END AS rec,
        CASE WHEN pred + sup = 0 THEN 1 ELSE 2 * hit / (pred + sup) END AS f1 FROM per)"""


def _weighted(rows: str) -> str:
    return _metrics(rows) + """
    SELECT 'accuracy' AS metric, round(sum(hit) / sum(sup), 6) AS value FROM rat
    UNION ALL SELECT 'precision', round(sum(prec * sup) / sum(sup), 6) FROM rat
    UNION ALL SELECT 'recall', round(sum(rec * sup) / sum(sup), 6) FROM rat
    UNION ALL SELECT 'f1_score', round(sum(f1 * sup) / sum(sup), 6) FROM rat"""


K = "(('0x' || substring(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {n})"
SCORES = f"""
    scored AS (SELECT quality, [(1000 - {K.format(n=1000)}) / 1000.0::DOUBLE, {K.format(n=1000)} / 1000.0::DOUBLE] AS pr FROM labels),
    cell AS (SELECT quality = i AS hit, pr[i + 1] AS score FROM scored, (SELECT unnest([0, 1]) AS i)),
    cnt AS (SELECT score, count(*) FILTER (WHERE hit)::DOUBLE AS pos, count(*) FILTER (WHERE NOT hit)::DOUBLE AS neg
        FROM cell GROUP BY score),
    run AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
        sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM cnt)"""


def _clean_words_sql() -> str:
    dedupe = "(SELECT min(doc_id) AS doc_id, lang, text FROM documents GROUP BY lang, text)"
    body, last = chain("text", (url_email, punct, chars, words), dedupe, ", lang")
    return f"""WITH {body}, {weights(last)}
    SELECT lang, term, round(weight, 6) AS weight, r AS rank
    FROM (SELECT *, ({RANKED})::INTEGER AS r FROM weighted) WHERE r <= 15"""


def _coherence_sql(words: int = fixed.TOP_TERMS) -> str:
    return f"""
    WITH {weights()},
    top AS (SELECT lang, term, r FROM (SELECT *, {RANKED} AS r FROM weighted) WHERE r <= {words}),
    tok AS (SELECT doc_id, {TOKENS} AS w FROM documents),
    total AS (SELECT sum(greatest(len(w) - 109, 1))::DOUBLE AS n FROM tok WHERE len(w) > 0),
    spot AS (SELECT doc_id, len(w) AS size, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM tok),
    seen AS (SELECT DISTINCT doc_id, lang, r, unnest(generate_series(greatest(pos - 109, 0), least(pos, greatest(size - 110, 0)))) AS win
        FROM spot JOIN top USING (term)),
    pair AS (SELECT a.lang, a.r AS i, b.r AS j, count(*)::DOUBLE AS c FROM seen a JOIN seen b
        ON a.doc_id = b.doc_id AND a.lang = b.lang AND a.win = b.win GROUP BY a.lang, a.r, b.r),
    grid AS (SELECT a.lang, a.r AS i, b.r AS j FROM top a JOIN top b ON a.lang = b.lang),
    prob AS (SELECT g.lang, g.i, g.j, coalesce(p.c, 0) / n + 1e-12 AS pij, coalesce(x.c, 0) / n AS pi, coalesce(y.c, 0) / n AS pj
        FROM grid g CROSS JOIN total LEFT JOIN pair p ON p.lang = g.lang AND p.i = g.i AND p.j = g.j
        LEFT JOIN pair x ON x.lang = g.lang AND x.i = g.i AND x.j = g.i
        LEFT JOIN pair y ON y.lang = g.lang AND y.i = g.j AND y.j = g.j),
    npmi AS (SELECT lang, i, j, CASE WHEN pi * pj = 0 THEN 0 ELSE ln(pij / (pi * pj)) / -ln(pij) END AS v FROM prob),
    whole AS (SELECT lang, j, sum(v) AS s FROM npmi GROUP BY lang, j),
    word AS (SELECT lang, i, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS c FROM npmi JOIN whole USING (lang, j) GROUP BY lang, i)
    SELECT lang, round(avg(c), 6) AS coherence FROM word GROUP BY lang"""


def _distribution_sql() -> str:
    return f"""
    WITH {weights()},
    size AS (SELECT lang, sqrt(sum(weight * weight)) AS len_t FROM weighted GROUP BY lang),
    tok AS (SELECT doc_id, {TOKENS} AS w FROM documents),
    win AS (SELECT doc_id, i, w[i:i + 3] AS part FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i
        FROM tok WHERE len(w) > 0)),
    bag AS (SELECT doc_id, i, term, count(*)::DOUBLE AS x FROM (SELECT doc_id, i, unnest(part) AS term FROM win) GROUP BY doc_id, i, term),
    len_w AS (SELECT doc_id, i, sqrt(sum(x * x)) AS size_w FROM bag GROUP BY doc_id, i),
    cosines AS (SELECT doc_id, i, lang, sum(x * weight) / any_value(size_w) / any_value(len_t) AS c
        FROM bag JOIN len_w USING (doc_id, i) JOIN weighted USING (term) JOIN size USING (lang) GROUP BY doc_id, i, lang),
    sums AS (SELECT doc_id, lang, sum(c) AS t FROM cosines GROUP BY doc_id, lang)
    SELECT doc_id, lang, round(t / sum(t) OVER (PARTITION BY doc_id), 6) AS share FROM sums"""


def _per_class_sql() -> str:
    rows = "(SELECT d.doc_id, d.text, d.lang AS topic, l.quality AS class FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
    return f"""
    WITH src AS {rows},
    cnt AS (SELECT class, topic, term, count(*)::DOUBLE AS n FROM (SELECT class, topic, unnest({TOKENS}) AS term FROM src) GROUP BY ALL),
    grp AS (SELECT class, topic, sum(n) AS g FROM cnt GROUP BY class, topic),
    trm AS (SELECT term, sum(n) AS f FROM cnt GROUP BY term),
    mean AS (SELECT avg(m) AS a FROM (SELECT topic, sum(n) AS m FROM cnt GROUP BY topic)),
    wgt AS (SELECT class, topic, term, sqrt(n / g) * ln(1 + (a - f + 0.5) / (f + 0.5)) AS weight
        FROM cnt JOIN grp USING (class, topic) JOIN trm USING (term) CROSS JOIN mean),
    rnk AS (SELECT *, row_number() OVER (PARTITION BY class, topic ORDER BY weight DESC, term) AS r FROM wgt),
    wrd AS (SELECT class, topic, string_agg(term, ', ' ORDER BY r) AS words FROM rnk WHERE r <= 5 GROUP BY class, topic)
    SELECT class, topic, coalesce(words, '') AS words, count(*) AS freq FROM src LEFT JOIN wrd USING (class, topic) GROUP BY class, topic, words"""


def _encode_sql() -> str:
    return f"""
    WITH tok AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '{W}+') AS w FROM documents),
    freq AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM tok) GROUP BY term),
    voc AS (SELECT term, 3 + row_number() OVER (ORDER BY n DESC, term) AS id FROM freq),
    head AS (SELECT doc_id, unnest(w[1:28]) AS term, generate_subscripts(w[1:28], 1) AS pos FROM tok),
    body AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM head JOIN voc USING (term) GROUP BY doc_id),
    marked AS (SELECT doc_id, lang, list_concat([2], list_concat(coalesce(ids, []), [3])) AS ids FROM tok LEFT JOIN body USING (doc_id))
    SELECT doc_id, lang AS label,
        array_to_string(list_transform(generate_series(1, 30), lambda i: coalesce(ids[i], 0)), ' ') AS ids,
        array_to_string(list_transform(generate_series(1, 30), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ' ') AS mask
    FROM marked"""


def _spelling_sql() -> str:
    # levenshtein counts bytes here, so letters outside ASCII are first renamed to unused one-byte characters.
    return r"""
    WITH voc AS (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
        WHERE word <> '' GROUP BY word HAVING count(*) >= 5),
    tok AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM benchmark),
    unk AS (SELECT token FROM tok WHERE length(token) >= 1 AND token NOT IN (SELECT word FROM voc)),
    wide AS (SELECT DISTINCT unnest(string_split(w, '')) AS ch FROM (SELECT token AS w FROM unk UNION ALL SELECT word FROM voc)),
    code AS (SELECT string_agg(ch, '' ORDER BY ch) AS a, string_agg(chr(i::INTEGER), '' ORDER BY ch) AS b
        FROM (SELECT ch, row_number() OVER (ORDER BY ch) AS i FROM wide)),
    u AS (SELECT token, translate(token, a, b) AS t FROM unk, code),
    v AS (SELECT word, freq, translate(word, a, b) AS w FROM voc, code),
    near AS (SELECT token, word, freq, levenshtein(t, w) AS d FROM u JOIN v
        ON abs(length(t) - length(w)) <= 2 WHERE levenshtein(t, w) <= 2),
    best AS (SELECT token, word AS fix FROM near QUALIFY row_number() OVER (PARTITION BY token ORDER BY d, freq DESC, word DESC) = 1),
    pos AS (SELECT item_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark),
    done AS (SELECT item_id, string_agg(coalesce(fix, token), ' ' ORDER BY i) AS text, count(*) AS n FROM pos LEFT JOIN best USING (token) GROUP BY item_id)
    SELECT b.item_id, CASE WHEN n > 1 THEN done.text ELSE b.text END AS text FROM benchmark b JOIN done USING (item_id)"""


def all_oracles() -> dict[str, str]:
    clean, last = chain(mixed(), CHAIN)
    table_clean, table_last = chain("text", CHAIN, "uniq", ", lang")
    marked = f"translate(lower(text), {s(q.MARKED_FROM)}, {s(q.MARKED_TO)})"
    smiling = f"translate(text, {s(q.EMOJI_FROM)}, {s(q.EMOJI_TO)})"
    mapped = smiling
    for emoji, word in q.EMOJI_WORDS.items():
        mapped = f"replace({mapped}, {s(emoji)}, {s(word + ' ')})"
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in fixed.EMOJI_RANGES)
    stop = "('the', 'de', 'und')"
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS term FROM "
        f"(SELECT lang, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM tok)" for n in (1, 2, 3)
    )
    found = {
        "normalize_arabic": rule(normalize(arabic())),
        "fold_letters": rule(f"translate({arabic()}, {s(FOLDS[0])}, {s(FOLDS[1])})"),
        "strip_marks": rule(f"translate({marked}, {s(fixed.DIACRITICS + fixed.TATWEEL)}, '')"),
        "strip_space": rule(strip_space("(' ' || chr(9) || ' ' || text || ' ' || chr(10) || ' ')")),
        "remove_url_email": rule(url_email("text")),
        "remove_punct": rule(punct("text")),
        "collapse_chars": rule(chars("text")),
        "collapse_words": rule(words("text")),
        "drop_long_words": rule(long_words("text")),
        "map_emojis": rule(mapped),
        "remove_emojis": rule(f"regexp_replace({smiling}, '[{ranges}]+', '', 'g')"),
        "remove_latin": rule(latin(mixed())),
        "drop_stopwords": rule(stopped("text", ("the", "of", "de", "und"))),
        "light_stem": rule(stem(arabic())),
        "segment": rule(segment(arabic())),
        "dedupe_rows": "SELECT min(doc_id) AS doc_id, lang, source, text FROM documents GROUP BY lang, source, text",
        "drop_nulls": f"SELECT * FROM ({LABELS.format(cols='d.lang, d.source, d.text, d.n_chars')}) WHERE COLUMNS(*) IS NOT NULL",
        "quality_report": f"""WITH src AS ({LABELS.format(cols='d.lang, d.text')}),
            grp AS (SELECT lang, text, quality, count(*) AS n FROM src GROUP BY lang, text, quality)
            SELECT sum(n)::BIGINT AS original_rows, sum(n - 1)::BIGINT AS duplicates_removed,
            count(*) FILTER (WHERE quality IS NULL) AS null_rows_removed,
            count(*) FILTER (WHERE quality IS NOT NULL) AS final_rows FROM grp""",
        "recheck_quality": f"""WITH src AS (SELECT doc_id, lang, {punct('text')} AS text FROM documents),
            done AS (SELECT doc_id, lang, {chars('text')} AS text FROM src)
            SELECT min(doc_id) AS doc_id, lang, text FROM done GROUP BY lang, text""",
        "strip_page_links": f"""WITH src AS (SELECT page_id, url || ' ' || html AS text FROM pages)
            SELECT page_id, {url_email('text')} AS text FROM src""",
        "detect_language": f"""WITH src AS (SELECT doc_id, text, {mixed()} AS m FROM documents)
            SELECT doc_id, CASE WHEN {EN.format(c='text')} THEN 'en' ELSE 'ar' END AS plain,
            CASE WHEN {EN.format(c='m')} THEN 'en' ELSE 'ar' END AS mixed FROM src""",
        "clean_chain": f"WITH {clean} SELECT doc_id, text FROM {last}",
        "clean_table": f"""WITH uniq AS (SELECT min(doc_id) AS doc_id, lang, text FROM
            (SELECT doc_id, lang, {mixed()} AS text FROM documents) GROUP BY lang, text), {table_clean}
            SELECT min(doc_id) AS doc_id, lang, text FROM {table_last} GROUP BY lang, text""",
        "translate_routed": f"""SELECT d.doc_id, CASE WHEN {EN.format(c='d.text')} THEN coalesce(m.target_text, d.text)
            ELSE d.text END AS text FROM documents d LEFT JOIN ({MEMORY}) m ON d.text = m.source_text""",
        "translation_rounds": f"SELECT doc_id, CASE WHEN {EN.format(c='text')} THEN {arabic()} ELSE text END AS text FROM documents",
        "untranslated_texts": f"""SELECT DISTINCT text AS source_text FROM documents WHERE {EN.format(c='text')}
            AND text NOT IN (SELECT source_text FROM ({MEMORY}))""",
        "spelling_fix": _spelling_sql(),
        "spelling_documents": _spelling_sql().replace("benchmark", "documents").replace("item_id", "doc_id"),
        "count_terms": f"SELECT doc_id, term, count(*) AS n FROM {term_rows('doc_id')} WHERE term NOT IN {stop} GROUP BY doc_id, term",
        "ngrams": f"""WITH tok AS (SELECT lang, list_filter({TOKENS}, lambda w: w NOT IN {stop}) AS w FROM documents), g AS ({grams})
            SELECT lang, term, count(*) AS n FROM g GROUP BY lang, term""",
        "ctfidf": f"WITH {weights(form='base', damp=False)} SELECT lang, term, n, round(weight, 6) AS weight FROM weighted",
        "ctfidf_bm25": f"WITH {weights()} SELECT lang, term, n, round(weight, 6) AS weight FROM weighted",
        "top_terms": _clean_words_sql(),
        "encode_fixed": _encode_sql(),
        "encode_labels": """WITH src AS (SELECT doc_id, CASE quality WHEN 0 THEN 'Negative' WHEN 1 THEN 'Positive' END AS name, toxic FROM labels),
            w AS (SELECT doc_id, name, CASE WHEN toxic = 1 THEN 'Toxic' ELSE name END AS word FROM src)
            SELECT *, (CASE word WHEN 'Negative' THEN 0 WHEN 'Positive' THEN 1 END)::INTEGER AS code FROM w""",
        "holdout_split": f"SELECT doc_id, lang, CASE WHEN {K.format(n=100)} < 20 THEN 'test' ELSE 'train' END AS split FROM documents",
        "assemble_result": "SELECT d.doc_id, text AS review, quality AS label, lang AS topic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "nearest_centroid": f"""WITH {CENTRES} SELECT doc_id, topic, round(d, 6) AS distance FROM dist
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, topic) = 1""",
        "topic_probabilities": f"""WITH {CENTRES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY topic) - 1)::INTEGER AS place,
            round(exp(-d) / sum(exp(-d)) OVER (PARTITION BY doc_id), 6) AS share FROM dist""",
        "topic_sizes": "SELECT label AS topic, count(*) AS n FROM embeddings GROUP BY label",
        "min_topic_size": """SELECT vec_id AS doc_id, CASE WHEN count(*) OVER (PARTITION BY label) >= 50 THEN label ELSE -1 END AS topic FROM embeddings""",
        "cosine_knn": COSINE_KNN,
        # The tables of the checks fit into one window of the start, where the refined lists are the exact ones.
        "knn_descent": COSINE_KNN,
        "topic_similarity": f"""WITH {weights()}, size AS (SELECT lang, sqrt(sum(weight * weight)) AS z FROM weighted GROUP BY lang),
            prod AS (SELECT a.lang AS t1, b.lang AS t2, sum(a.weight * b.weight) AS w FROM weighted a JOIN weighted b USING (term) GROUP BY a.lang, b.lang)
            SELECT t1, t2, round(w / (x.z * y.z), 6) AS cosine FROM prod JOIN size x ON t1 = x.lang JOIN size y ON t2 = y.lang""",
        "term_decline": f"""WITH {weights()} SELECT lang, r AS rank, round(weight, 6) AS weight
            FROM (SELECT *, ({RANKED})::INTEGER AS r FROM weighted) WHERE r <= 15""",
        "topic_words": f"""WITH {weights()} SELECT lang, string_agg(term, ', ' ORDER BY r) AS words
            FROM (SELECT *, {RANKED} AS r FROM weighted) WHERE r <= 5 GROUP BY lang""",
        "topic_distribution": _distribution_sql(),
        "topics_per_class": _per_class_sql(),
        "weighted_metrics": _weighted("SELECT quality AS y, toxic AS p FROM labels"),
        "confusion": """WITH lab AS (SELECT quality AS v FROM labels UNION SELECT toxic FROM labels)
            SELECT a.v AS y_true, b.v AS y_pred, count(l.doc_id) AS n FROM lab a CROSS JOIN lab b
            LEFT JOIN labels l ON l.quality = a.v AND l.toxic = b.v GROUP BY a.v, b.v""",
        "confusion_wide": """SELECT quality AS y_true, count(*) FILTER (WHERE toxic = 0) AS pred_0,
            count(*) FILTER (WHERE toxic = 1) AS pred_1 FROM labels GROUP BY quality""",
        "class_report": _metrics("SELECT quality AS y, toxic AS p FROM labels") + """
            SELECT label, CASE label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Positive' END AS name, round(prec, 6) AS precision,
            round(rec, 6) AS recall, round(f1, 6) AS f1, sup::BIGINT AS support FROM rat""",
        "roc_points": f"WITH {SCORES} SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM run",
        "roc_micro": f"WITH {SCORES} SELECT 'roc_auc_micro' AS metric, round(sum(neg * (tp - pos + pos / 2)) / any_value(p * n), 6) AS value FROM run",
        "metrics_on_topics": _weighted("""SELECT l.quality AS y, m.label AS p FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id JOIN
            (SELECT topic, quality AS label FROM (SELECT label AS topic, quality, count(*) AS c FROM embeddings JOIN labels ON vec_id = doc_id GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY topic ORDER BY c DESC, quality) = 1) m ON m.topic = e.label"""),
        "classify_nb": f"""WITH src AS (SELECT doc_id, {TOKENS} AS w, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS label,
                {K.format(n=100)} < 20 AS test FROM documents),
            cnt AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(w) AS term FROM src WHERE NOT test) GROUP BY label, term),
            voc AS (SELECT DISTINCT term FROM cnt),
            cls AS (SELECT label, count(*) AS docs, sum(len(w)) AS words FROM src WHERE NOT test GROUP BY label),
            prior AS (SELECT label, ln((docs + 1) / ((SELECT sum(docs) FROM cls) + (SELECT count(*) FROM cls))) AS p,
                ln(words + (SELECT count(*) FROM voc)) AS size FROM cls),
            tok AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM src WHERE test) JOIN voc USING (term) GROUP BY doc_id, term),
            sums AS (SELECT doc_id, c.label, sum(t.n * (ln(coalesce(k.n, 0) + 1) - c.size)) AS s FROM tok t CROSS JOIN prior c
                LEFT JOIN cnt k ON k.term = t.term AND k.label = c.label GROUP BY doc_id, c.label)
            SELECT src.doc_id, src.label, c.label AS prediction FROM src CROSS JOIN prior c LEFT JOIN sums ON sums.doc_id = src.doc_id AND sums.label = c.label
            WHERE test QUALIFY row_number() OVER (PARTITION BY src.doc_id ORDER BY c.p + coalesce(s, 0) DESC, c.label) = 1""",
        "density_topics": """WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
            near AS (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE round(list_distance(a.v, b.v), 9) <= 1.15),
            core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 5),
            link AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
            reach AS (SELECT a, a AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
            comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
            num AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS k FROM comp GROUP BY c HAVING count(*) >= 2)
            SELECT e.id AS doc_id, coalesce(num.k, -1)::INTEGER AS cluster FROM e LEFT JOIN comp ON comp.a = e.id LEFT JOIN num ON num.c = comp.c""",
        "table_digest": f"""SELECT count(*) AS rows, sum(('0x' || substr(md5(concat_ws('|', {', '.join(
            f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ('doc_id', 'text', 'lang', 'source', 'n_chars'))})), 1, 15))::BIGINT)::VARCHAR AS digest
            FROM documents""",
        "word_position_vectors": f"""WITH src AS (SELECT doc_id, {TOKENS} AS w, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON doc_id = vec_id),
            holds AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(w) AS term FROM src)),
            cell AS (SELECT doc_id, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM src),
            mean AS (SELECT term, i, avg(v) AS v FROM holds JOIN cell USING (doc_id) GROUP BY term, i),
            top AS (SELECT term, max(v) AS m FROM mean GROUP BY term),
            head AS (SELECT doc_id, unnest(w[1:30]) AS term, generate_subscripts(w[1:30], 1) AS pos FROM src)
            SELECT src.doc_id, 1920::INTEGER AS width, round(greatest(max(m), CASE WHEN count(m) < 30 THEN 0 ELSE max(m) END), 6) AS largest,
            round(coalesce(max(m) FILTER (pos = 1), 0), 6) AS first
            FROM src LEFT JOIN head ON head.doc_id = src.doc_id LEFT JOIN top USING (term) GROUP BY src.doc_id""",
        "coherence_cv": _coherence_sql(),
        "coherence_wide": _coherence_sql(q.WIDE_TERMS),
        "rerank_terms": f"""WITH {DESCRIBED},
            sc AS (SELECT c.lang, t.term, {COSINE} AS weight FROM cand JOIN tvec t USING (term) JOIN centre c ON c.lang = cand.lang AND c.i = t.i GROUP BY c.lang, t.term)
            SELECT lang, term, round(weight, 6) AS weight, r AS rank FROM (SELECT *, ({RANKED})::INTEGER AS r FROM sc) WHERE r <= 15""",
        "zero_shot_names": f"""WITH {DESCRIBED},
            nm AS (SELECT DISTINCT term FROM (SELECT *, {RANKED} AS r FROM weighted) WHERE r <= 2),
            sc AS (SELECT c.lang, t.term, {COSINE} AS weight FROM nm JOIN tvec t USING (term) JOIN centre c ON c.i = t.i GROUP BY c.lang, t.term)
            SELECT lang, CASE WHEN weight >= 0.2 THEN term END AS name, round(weight, 6) AS similarity
            FROM sc QUALIFY {RANKED} = 1""",
    }
    # Counts of two batches add up to those of all rows.
    found["retrain_nb"] = found["classify_nb"]
    return found
