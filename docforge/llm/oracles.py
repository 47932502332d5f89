"""The numbered queries that SQL can express, as DuckDB SQL over the base tables."""

from __future__ import annotations

from docforge.llm import mixing, quality, secrets
from docforge.llm.chat import LEARNED, MARKS

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM docs),
windows AS (
  SELECT doc_id, s AS place, array_to_string(ws[s:s + 19], ' ') AS body
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM docs WHERE len(ws) >= 20)
),
later AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) AS n FROM windows) WHERE n > 1
),
marked AS (
  SELECT doc_id, word, place, max(CASE WHEN l.place IS NOT NULL THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN later l USING (doc_id, place)
),
cut AS (
  SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (gone = 0), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SIMILAR = """
WITH RECURSIVE docs AS (SELECT doc_id, {words} AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + {shingle} - 1], ' ') AS body
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) + 2 - {shingle}, 2))) AS s FROM docs WHERE len(ws) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.body = b.body AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT *{more} FROM (
  SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM docs LEFT JOIN sizes USING (doc_id))"""

JACCARD = _SIMILAR.format(words=_WORDS.format(text=_LOWER), shingle=5, percent=75, more="")
MINHASH = _SIMILAR.format(words=_WORDS.format(text=_LOWER), shingle=4, percent=80, more=", component_id = doc_id AS kept")



def _filled(name: str, nodes: str, parents: str, own: str) -> str:
    """Siblings filled up to the level that the first open one sets."""
    order = f"(PARTITION BY {parents} ORDER BY cap / weight, coalesce({own}, '')"
    return f"""
{name}_sized AS (
  SELECT *, cap / weight AS rate, coalesce(sum(cap) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM ({nodes})
),
{name}_levels AS (SELECT *, CASE WHEN (budget - filled) / open < rate THEN (budget - filled) / open END AS own_level FROM {name}_sized),
{name} AS (
  SELECT * EXCLUDE (budget), least(cap, greatest(coalesce(level * weight, cap), 0)) AS given FROM (
    SELECT *, first_value(own_level IGNORE NULLS) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM {name}_levels)
)"""


def _weigh(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{name}' THEN {weight}" for name, weight in weights.items())} ELSE 1.0 END::DOUBLE AS weight"


def mixing_sql(domains: dict[str, float], langs: dict[str, float], share: float, epochs: int, seed: int) -> str:
    """The mixture over domain, language and source; languages have weights under the weighted domains, all else weighs 1."""
    return f"""
WITH docs AS (
  SELECT *, regexp_extract(source, '([0-9]+)', 1) AS digits, CAST(len({_WORDS.format(text="text")}) AS BIGINT) AS tokens FROM documents
),
light AS (
  SELECT *, 'd' || CASE WHEN digits = '' THEN 'x' ELSE (CAST(right(digits, 2) AS BIGINT) % 4)::VARCHAR END AS domain FROM docs WHERE tokens > 0
),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST({epochs} * sum(tokens) AS BIGINT) AS cap FROM light GROUP BY ALL),
{_filled("tops", f"SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_weigh('domain', domains)}, "
         f"CAST(sum(sum(cap)) OVER () AS BIGINT) * {share / epochs}::DOUBLE AS budget FROM leaves GROUP BY domain", "1", "domain")},
{_filled("middle", "SELECT n.*, b.given AS budget FROM (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, "
         f"CASE WHEN domain IN ({', '.join(f"'{name}'" for name in domains)}) THEN weight ELSE 1 END AS weight "
         f"FROM (SELECT *, {_weigh('lang', langs)} FROM leaves) GROUP BY domain, lang, weight) n "
         "JOIN tops b ON n.domain IS NOT DISTINCT FROM b.domain", "domain", "lang")},
{_filled("low", "SELECT n.*, 1.0::DOUBLE AS weight, b.given AS budget FROM leaves n "
         "JOIN middle b ON n.domain IS NOT DISTINCT FROM b.domain AND n.lang IS NOT DISTINCT FROM b.lang", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, CAST(round(given) AS BIGINT) // supply AS whole, CAST(round(given) AS BIGINT) % supply AS rest FROM low),
placed AS (
  SELECT d.*, whole, rest, CAST('0x' || substr(md5('{seed}:' || whole || ':' || doc_id || ':' || md5(text)), 1, {mixing.DIGITS}) AS BIGINT) AS place
  FROM light d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source
),
chosen AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place)
    - sum(tokens) OVER (PARTITION BY domain, lang, source, place) AS ahead FROM placed
)
SELECT doc_id, lang, source, tokens, CAST(whole + CASE WHEN ahead < rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM chosen WHERE whole > 0 OR ahead < rest"""


_FAILED = " + ".join(f"CASE WHEN {rule.fails} THEN {quality.BIT[rule.name]} ELSE 0 END" for rule in quality.RULES)

QUALITY = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM docs),
windows AS (
  SELECT doc_id, s AS place, array_to_string(ws[s:s + 7], ' ') AS body
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS s FROM docs WHERE len(ws) >= 8)
),
twice AS (SELECT doc_id, place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, body) AS n FROM windows) WHERE n > 1),
marked AS (
  SELECT doc_id, word, max(CASE WHEN t.place IS NOT NULL THEN 1 ELSE 0 END) OVER (
      PARTITION BY doc_id ORDER BY place ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS again,
    word = lag(word) OVER (PARTITION BY doc_id ORDER BY place) AS stutter
  FROM words LEFT JOIN twice t USING (doc_id, place)
),
counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(again) AS n_repeat_words,
    count(*) FILTER (stutter) AS n_stutters,
    sum(length(regexp_replace(word, '[^A-Z]', '', 'g'))) AS n_upper,
    sum(length(regexp_replace(word, '[^A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g'))) AS n_letters,
    sum(length(regexp_replace(word, '[^!?]', '', 'g'))) AS n_marks
  FROM marked GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
),
measured AS (
  SELECT doc_id, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    {", ".join(f"coalesce({name}, 0) AS {name}" for name in quality.MEASURES if name != "n_symbols")}
  FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id)
),
judged AS (SELECT *, {_FAILED} AS fail_bits FROM measured)
SELECT doc_id, {", ".join(f"CAST({name} AS BIGINT) AS {name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits"))},
  fail_bits & {quality.BASE} <> 0 AS base_failed, fail_bits & {quality.POLICIES[quality.CURRENT]} = 0 AS kept
FROM judged"""



def _spans(number: int, rule: secrets.SecretRule) -> str:
    """Matches and the pieces between them follow each other, so their lengths add up to where each match ends."""
    pattern = _SQL_PATTERNS.get(rule.kind, rule.pattern).replace("'", "''")
    return f"""
  SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, length(hit) AS size,
    sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS parts,
      string_split_regex(text, '{pattern}') AS gaps FROM docs))
  QUALIFY length(part) >= {rule.least}"""


def _either_case(word: str) -> str:
    return "".join(f"[{letter.upper()}{letter}]" if letter.isalpha() else letter for letter in word)


#: Rules that are written otherwise over code points than over bytes.
_SQL_PATTERNS = {
    "assign": f"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "url_login": r"://[A-Za-z0-9._-]+:[^\x00-\x20/@:\x7f-\x{10FFFF}]+@",
}

SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_spans(number, rule) for number, rule in enumerate(secrets.RULES))}),
named AS (SELECT doc_id, number, kind, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM spans),
found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in secrets.BASE_KINDS)},
    string_agg(span, ',' ORDER BY start, number) FILTER (number < {len(secrets.BASE_RULES)}) AS base,
    string_agg(span, ',' ORDER BY start, number) AS spans
  FROM named GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in secrets.BASE_KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc_id)"""

WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN size >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM payloads"""

_MARKED = " ".join(f"WHEN '{role}' THEN {len(before) + len(after)}" for role, (before, after) in MARKS.items())

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '(\[)(/?(?:INST|SYS|RESP|TURN))', '\1\\\2', 'g'),
    '(<)(/?s>|(?:image|audio|document|file):)', '\1\\\2', 'g') AS body FROM turns
),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{LEARNED}'), '') AS loss,
    sum(length(body) + CASE role {_MARKED} END) AS size
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(size AS BIGINT) AS formatted_chars FROM joined"""

# Of each distance, the places where five words and the five behind that distance agree form islands; an island is a
# maximal pair, and the least distance of a stretch its period.
_CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: CAST(ascii((doc_id::VARCHAR)[i]) AS BIGINT)),
  lambda c, x: list_reduce([xor(c, x)] || range(0, 8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)"""

PERIODS = f"""
WITH plain AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
drawn AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, {_CRC} AS h FROM plain),
placed AS (SELECT *, (h // 10) % greatest(n, 1) AS a, h // 10 % 8 AS k FROM drawn),
docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN ws[:a] || list_transform(range(a, n), lambda i: ws[a + (i - a) % (1 + (n - a) // (3 + k)) + 1]) ELSE ws END AS ws FROM placed
),
grams AS (
  SELECT doc_id, s - 1 AS place, n, array_to_string(ws[s:s + 4], ' ') AS body FROM (SELECT *, unnest(range(1, n - 3)) AS s FROM docs WHERE n >= 6)
),
often AS (SELECT * FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, body) > 1),
pairs AS (
  SELECT x.doc_id, x.place, y.place - x.place AS gap FROM often x JOIN often y
  ON x.doc_id = y.doc_id AND x.body = y.body AND y.place > x.place AND y.place - x.place <= x.n // 4
),
islands AS (
  SELECT doc_id, gap, min(place) AS start, count(*) + 4 + gap AS length
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id, gap ORDER BY place) AS island FROM pairs) GROUP BY doc_id, gap, island
),
runs AS (
  SELECT doc_id, start, length, min(gap) AS period FROM islands WHERE length >= greatest(6, 4 * gap) GROUP BY ALL
),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
),
best AS (SELECT * FROM runs r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, n)) AS place FROM docs),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS place FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS body FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, CAST(length AS BIGINT) AS length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256, n AS n_words
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

INTERACTIONS = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS ws FROM documents),
failed AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS f
  FROM docs LEFT JOIN labels USING (doc_id)
),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS l, 1 << (ascii(filter_order[s]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INTEGER AS before FROM orders, range(1, 6) t(s)
),
judged AS (
  SELECT part, filter_order, step, l, n, good, bad, f & bit <> 0 AS mine, f & before <> 0 AS gone, f = bit AS alone FROM cells, steps
),
counted AS (
  SELECT part, filter_order, step, l, coalesce(sum(n) FILTER (NOT mine AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (mine AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (mine AND gone), 0) AS redundant, coalesce(sum(n) FILTER (mine AND alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mine AND NOT gone), 0) AS good_lost, coalesce(sum(bad) FILTER (mine AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM counted"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING,
    "op2_jaccard_join": JACCARD,
    "op4_quality_rules": QUALITY,
    "op6_secret_scans": SECRETS,
    "op7_warc": WARC,
    "op10_chat_formatting": CHAT,
    "op11_periodic_runs": PERIODS,
    "op12_filter_interactions": INTERACTIONS,
    "op13_minhash_dedup": MINHASH,
}
