"""DuckDB SQL that the queries of this folder must agree with."""

from __future__ import annotations

import re

from tamhis.llm.chat import CONTROL
from tamhis.llm.licenses import TEMPLATES
from tamhis.llm.quality_rules import WORD

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _pattern(markup: str) -> str:
    """The markup as a pattern over words that each end in one blank."""
    out = " "
    for part in re.split(r"(<<.*?>>)", markup):
        if part == "<<beginOptional>>":
            out += "(?:"
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var"):
            low, high = re.findall(r"\d+", part)
            out += f"(?:[^ ]+ ){{{low},{high}}}"
        else:
            out += "".join(f"{word} " for word in part.split())
    return out


def op1() -> str:
    base = [t for t in TEMPLATES if t.base]
    starts = " || ".join(
        f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(t.markup.split()))})" for t in base)
    hits = [f"regexp_matches(s, '{_pattern(t.markup)}')" for t in TEMPLATES]
    mandatory = [len(re.sub(r"<<beginOptional>>.*?<<endOptional>>|<<.*?>>", " ", t.markup).split()) for t in TEMPLATES]
    labels = lambda keep: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(
        f"CASE WHEN {h} THEN '{t.label}' END" for t, h in zip(TEMPLATES, hits, strict=True) if keep(t)) + "], lambda x: x IS NOT NULL))), ',')"
    best = "greatest(0, " + ", ".join(f"CASE WHEN {h} THEN {m} ELSE 0 END" for h, m in zip(hits, mandatory, strict=True)) + ")"
    return f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
u AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS s, {starts} AS places FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word,
  list_max(places)::BIGINT AS last_word, {labels(lambda t: t.base)} AS base_labels, {labels(lambda t: True)} AS labels,
  {best}::DOUBLE / ({best} + 1) AS score
FROM u"""


OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{WORD}') AS words FROM d),
win AS (SELECT r, i, words[i:i + 4] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS o(k) GROUP BY r),
lines AS (SELECT r, host, line, md5(trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS m,
    len(regexp_extract_all(line, '{WORD}')) AS n
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
h AS (SELECT r, host, n, m AS h, md5(text) AS t FROM lines JOIN (SELECT r, text FROM d) USING (r)),
freq AS (SELECT host, h, count(DISTINCT t) AS n FROM h GROUP BY host, h),
tot AS (SELECT host, count(DISTINCT t) AS n FROM h GROUP BY host),
bad AS (SELECT f.host, f.h FROM freq f JOIN tot t ON f.host IS NOT DISTINCT FROM t.host WHERE f.n >= 10 AND f.n > 0.05 * t.n),
lost AS (SELECT r, sum(n) AS n FROM h JOIN bad ON h.h = bad.h AND h.host IS NOT DISTINCT FROM bad.host GROUP BY r),
res AS (SELECT d.doc_id, len(w.words)::BIGINT AS n_words, len(array_to_string(w.words, ''))::BIGINT AS word_chars,
    len(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce((SELECT count(*) - count(DISTINCT line) FROM lines WHERE lines.r = d.r), 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.5 * n_words)) AS kept
FROM res"""


# crc32 is not a DuckDB function; the bits of each byte are folded in by the polynomial of the checksum.
OP5 = """
WITH r AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
o AS (SELECT *, sum(size) OVER w - size AS before, row_number() OVER w AS row FROM r WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN count(*) OVER q > 1 AND sum(size) OVER q <= (SELECT max(size) FROM r) THEN min(before) OVER q ELSE before END AS start
  FROM o WINDOW q AS (PARTITION BY h)),
s AS (SELECT *, least(floor(start * 16 / (SELECT sum(size) FROM r)), 15)::INT AS shard FROM g),
b AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, shard, (row - min(row) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM s, b"""

_ESCAPED = "{}"
for _old, _new in [("\\", "\\\\"), *[(c, c[0] + "\\" + c[1:]) for c in CONTROL]]:
    _ESCAPED = f"replace({_ESCAPED}, '{_old}', '{_new}')"
OP6 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w - 1 AS place, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
    {_ESCAPED.format("text")} AS safe FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 11 + length(role) END)::BIGINT AS formatted_chars,
  bool_and(CASE coalesce(before, '') WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant' ELSE before IN ('system', 'assistant') AND role = 'user' END)
    AND bool_or(back = 1 AND role = 'assistant') AS valid,
  min(place) FILTER (NOT CASE coalesce(before, '') WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant' ELSE before IN ('system', 'assistant') AND role = 'user' END)::INT AS first_bad
FROM p GROUP BY conv_id"""


OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT DISTINCT item_id, text FROM benchmark),
b AS (SELECT row_number() OVER () AS n, item_id, {_WORDS} AS w FROM i),
ks AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
p AS (SELECT r, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
l AS (SELECT r, doc_id, x, x || ' ' || lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4, lead(x, 4) OVER o AS x5
  FROM p WINDOW o AS (PARTITION BY r ORDER BY j)),
ds AS (SELECT DISTINCT r, doc_id, CASE k WHEN 1 THEN x WHEN 2 THEN x2 WHEN 3 THEN x2 || ' ' || x3 WHEN 4 THEN x2 || ' ' || x3 || ' ' || x4
  ELSE x2 || ' ' || x3 || ' ' || x4 || ' ' || x5 END AS s FROM l, ks),
bs AS (SELECT DISTINCT n, item_id, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM (SELECT *, least(len(w), 5) AS k FROM b WHERE len(w) > 0))),
q AS (SELECT n, count(*) AS q FROM bs GROUP BY n)
SELECT doc_id, item_id, any_value(q)::BIGINT AS shingles, count(*)::BIGINT AS found, count(*)::DOUBLE / any_value(q) AS containment
FROM ds JOIN bs USING (s) JOIN q USING (n) GROUP BY r, doc_id, n, item_id HAVING count(*) >= 0.8 * any_value(q)"""


def all_oracles() -> dict[str, str]:
    return {"op1_license_scan": op1(), "op2_quality_rules": OP2, "op5_byte_shards": OP5, "op6_chat_format": OP6, "op9_benchmark_leaks": OP9}
