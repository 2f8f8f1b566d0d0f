"""DuckDB SQL of full-text search for the oracles: stems, positions and both ranks, written for sets of words and pairs of positions."""

from __future__ import annotations

from folioflow.functions import english as E

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_V, _C = "[aeiouy]", "[^aeiouy]"
_SHORT = f"regexp_matches({{}}, '(^{_V}{_C}|{_C}{_V}[^aeiouywxY])$')"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def _cut(source: str, ends) -> str:
    """w, its longest end e out of a list, and what stands before."""
    return f"(SELECT *, left(w, length(w) - length(e)) AS b FROM (SELECT *, regexp_extract(w, '({'|'.join(ends)})$') AS e FROM {source}))"


def _to(ends: dict) -> str:
    return "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ends.items()) + " END"


#: stems (word, lexeme) of words (word): null for stop words.
STEMS = f"""
stem0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM words),
stem1 AS (SELECT *, CASE WHEN regexp_matches(w, '^({'|'.join(E.PREFIXES)})') THEN length(regexp_extract(w, '^({'|'.join(E.PREFIXES)})')) WHEN regexp_matches(w, '{_V}{_C}') THEN length(regexp_extract(w, '^.*?{_V}{_C}')) ELSE length(w) END AS r1 FROM stem0),
stem2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{_V}{_C}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?{_V}{_C}')) ELSE length(w) END AS r2 FROM stem1),
stem3 AS (SELECT word, r1, r2, CASE WHEN suffix(w, 'sses') THEN left(w, length(w) - 2) WHEN suffix(w, 'ied') OR suffix(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN suffix(w, 'us') OR suffix(w, 'ss') THEN w WHEN suffix(w, 's') AND length(w) > 2 AND regexp_matches(left(w, length(w) - 2), '{_V}') THEN left(w, length(w) - 1) ELSE w END AS w FROM stem2),
stem4 AS (SELECT word, r1, r2, w AS plural, CASE WHEN e = '' THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '{_V}') THEN w
  WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1) WHEN length(b) <= r1 AND {_SHORT.format('b')} THEN b || 'e' ELSE b END AS w
  FROM {_cut('stem3', ['eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'])}),
stem5 AS (SELECT word, r1, r2, plural, CASE WHEN length(w) > 2 AND regexp_matches(w, '{_C}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM stem4),
stem6 AS (SELECT word, r1, r2, plural, CASE WHEN e = '' OR length(b) < r1 THEN w WHEN e = 'ogi' THEN CASE WHEN suffix(b, 'l') THEN b || 'og' ELSE w END WHEN e = 'li' THEN CASE WHEN regexp_matches(b, '[{E.LI}]$') THEN b ELSE w END ELSE b || {_to(E.STEP2)} END AS w
  FROM {_cut('stem5', [*E.STEP2, 'ogi', 'li'])}),
stem7 AS (SELECT word, r1, r2, plural, CASE WHEN e = '' OR length(b) < CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN w WHEN e = 'ative' THEN b ELSE b || {_to(E.STEP3)} END AS w FROM {_cut('stem6', [*E.STEP3, 'ative'])}),
stem8 AS (SELECT word, r1, r2, plural, CASE WHEN e = '' OR length(b) < r2 OR e = 'ion' AND NOT regexp_matches(b, '[st]$') THEN w ELSE b END AS w FROM {_cut('stem7', [*E.STEP4, 'ion'])}),
stem9 AS (SELECT word, plural, CASE WHEN suffix(w, 'e') AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {_SHORT.format('left(w, length(w) - 1)')}) OR suffix(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM stem8),
stems AS (SELECT word, CASE WHEN word IN {_in(E.STOP)} THEN NULL WHEN NOT regexp_matches(word, '^\\p{{L}}+$') OR length(word) <= 2 OR word IN {_in(E.STAY)} THEN word
  {' '.join(f"WHEN word = '{k}' THEN '{v}'" for k, v in E.OWN.items())} WHEN plural IN {_in(E.PLURAL_ONLY)} THEN plural ELSE replace(w, 'Y', 'y') END AS lexeme FROM stem9)"""


def tokens(where: str) -> str:
    """tok (id, pos, word) of chunks."""
    return f"tok AS (SELECT id, i AS pos, w[i] AS word FROM (SELECT id, {WORDS.format('content')} AS w FROM chunks WHERE {where}), unnest(range(1, len(w) + 1)) AS u(i))"


def postings(asked: str) -> str:
    """posts (id, lexeme, pos) of the lexemes in `asked`."""
    return f"posts AS (SELECT id, lexeme, least(pos, 16383) AS pos FROM tok JOIN stems USING (word) WHERE lexeme IN (SELECT lexeme FROM {asked}) QUALIFY row_number() OVER (PARTITION BY id, lexeme ORDER BY pos) <= 256)"


#: Needs qt (query_id, q) and chunks. hits (query_id, id, lexeme, pos), m (query_id, id, n_terms) of chunks with all terms.
TERMS = f"""qwords AS (SELECT query_id, unnest({WORDS.format('q')}) AS word FROM qt),
words AS (SELECT word FROM tok UNION SELECT word FROM qwords),{STEMS},
terms AS (SELECT DISTINCT query_id, lexeme FROM qwords JOIN stems USING (word) WHERE lexeme IS NOT NULL),
nterms AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
{postings('terms')},
hits AS (SELECT query_id, id, lexeme, pos FROM posts JOIN terms USING (lexeme)),
m AS (SELECT query_id, id, n_terms FROM hits JOIN nterms USING (query_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT lexeme) = n_terms)"""

#: lex (query_id, id, score, rank, total) of search_all_terms over usable chunks.
LEX = f"""{tokens('dense_lexical_use')},
{TERMS},
near AS (SELECT query_id, id, 1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(d / 1.5::DOUBLE - 2)))))) AS s
  FROM (SELECT a.query_id, a.id, abs(a.pos - b.pos) AS d FROM hits a JOIN m ON a.query_id = m.query_id AND a.id = m.id JOIN hits b ON a.query_id = b.query_id AND a.id = b.id AND a.lexeme < b.lexeme AND abs(a.pos - b.pos) BETWEEN 1 AND 100) GROUP BY 1, 2),
alone AS (SELECT query_id, id, sum(0.1::DOUBLE / (j * j)) / 1.64493406685::DOUBLE AS s FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS j FROM hits JOIN m USING (query_id, id) WHERE n_terms = 1) GROUP BY 1, 2),
lexs AS (SELECT query_id, id, round(CASE WHEN n_terms = 1 THEN alone.s ELSE coalesce(near.s, 0) END, 8) AS score FROM m LEFT JOIN near USING (query_id, id) LEFT JOIN alone USING (query_id, id)),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM lexs)"""

#: cover (query_id, id, p, q) to covered (query_id, id, score), by the places (query_id, id, pos) of the query's lexemes.
COVERED = """covered AS (SELECT query_id, id, sum(0.1::DOUBLE / (1 + CASE WHEN q - p >= n - 1 THEN q - p - (n - 1) ELSE (n - 1) // 2 END)) AS score
  FROM (SELECT c.query_id, c.id, p, q, count(*) AS n FROM cover c JOIN places s ON c.query_id = s.query_id AND c.id = s.id AND s.pos BETWEEN p AND q GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"""

#: Given gp (query_id, id): given (query_id, id, score, rank) of rank_given.
GIVEN = f"""{tokens('id IN (SELECT id FROM gp)')},
{TERMS},
mine AS (SELECT h.*, n_terms FROM hits h JOIN m USING (query_id, id) JOIN gp USING (query_id, id)),
ahead AS (SELECT a.query_id, a.id, a.n_terms, a.pos AS p, b.lexeme, min(b.pos) AS e FROM mine a JOIN mine b ON a.query_id = b.query_id AND a.id = b.id AND b.pos >= a.pos GROUP BY 1, 2, 3, 4, 5),
cover AS (SELECT query_id, id, max(p) AS p, q FROM (SELECT query_id, id, p, max(e) AS q FROM ahead GROUP BY 1, 2, 3, n_terms HAVING count(*) = n_terms) GROUP BY 1, 2, 4),
places AS (SELECT DISTINCT query_id, id, pos FROM mine),
{COVERED},
given AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT gp.query_id, gp.id, round(coalesce(score, 0), 8) AS score FROM gp LEFT JOIN covered USING (query_id, id)))"""

#: `w1 w2 or "w3 w4" -w5` of every benchmark item over chunks with vectors: web (query_id, id, score, rank).
WEB = f"""{tokens("dense_lexical_use AND vector_status = 'vec'")},
bt AS (SELECT item_id AS query_id, {WORDS.format('text')} AS ws FROM benchmark),
asked AS (SELECT query_id, 0 AS branch, 1 AS term, FALSE AS ex, ws[1] AS word, 1 AS place FROM bt UNION ALL SELECT query_id, 0, 2, FALSE, ws[2], 1 FROM bt UNION ALL SELECT query_id, 1, 3, FALSE, ws[3], 1 FROM bt
  UNION ALL SELECT query_id, 1, 3, FALSE, ws[4], 2 FROM bt UNION ALL SELECT query_id, 1, 4, TRUE, ws[5], 1 FROM bt),
words AS (SELECT word FROM tok UNION SELECT word FROM asked),{STEMS},
tw AS (SELECT query_id, branch, term, ex, lexeme, place FROM asked JOIN stems USING (word) WHERE lexeme IS NOT NULL),
{postings('tw')},
places AS (SELECT DISTINCT query_id, id, pos FROM tw JOIN posts USING (lexeme)),
parts AS (SELECT query_id, branch, term, count(*) AS n FROM tw GROUP BY 1, 2, 3),
occ AS (SELECT t.query_id, t.branch, t.term, t.ex, p.id, p.pos AS s, p.pos AS e FROM tw t JOIN parts USING (query_id, branch, term) JOIN posts p ON p.lexeme = t.lexeme WHERE n = 1
  UNION ALL SELECT a.query_id, a.branch, a.term, a.ex, x.id, x.pos, y.pos FROM tw a JOIN tw b ON a.query_id = b.query_id AND a.term = b.term AND a.place = 1 AND b.place = 2
  JOIN posts x ON x.lexeme = a.lexeme JOIN posts y ON y.lexeme = b.lexeme AND y.id = x.id AND y.pos = x.pos + 1),
need AS (SELECT query_id, branch, count(DISTINCT term) FILTER (NOT ex) AS n FROM tw GROUP BY 1, 2),
bad AS (SELECT DISTINCT query_id, branch, id FROM occ WHERE ex),
full_ AS (SELECT query_id, branch, id FROM occ JOIN need USING (query_id, branch) WHERE NOT ex GROUP BY 1, 2, 3, n HAVING count(DISTINCT term) = n
  UNION ALL SELECT query_id, branch, id FROM need, (SELECT id FROM chunks WHERE dense_lexical_use AND vector_status = 'vec') WHERE n = 0),
matched AS (SELECT DISTINCT query_id, id FROM full_ ANTI JOIN bad USING (query_id, branch, id)),
pos_occ AS (SELECT o.* FROM occ o JOIN matched USING (query_id, id) WHERE NOT ex),
starts AS (SELECT DISTINCT query_id, branch, id, s FROM pos_occ),
ahead AS (SELECT a.query_id, a.branch, a.id, a.s AS p, b.term, min(b.e) AS e FROM starts a JOIN pos_occ b ON a.query_id = b.query_id AND a.branch = b.branch AND a.id = b.id AND b.s >= a.s GROUP BY 1, 2, 3, 4, 5),
stretch AS (SELECT query_id, id, max(p) AS p, q FROM (SELECT query_id, branch, id, p, max(e) AS q FROM ahead JOIN need USING (query_id, branch) GROUP BY 1, 2, 3, 4, n HAVING count(*) = n) GROUP BY 1, 2, 4
  UNION SELECT query_id, id, pos, pos FROM places JOIN (SELECT DISTINCT query_id FROM need WHERE n = 0) USING (query_id) JOIN matched USING (query_id, id)),
cover AS (SELECT * FROM stretch a WHERE NOT EXISTS (SELECT 1 FROM stretch b WHERE a.query_id = b.query_id AND a.id = b.id AND b.p >= a.p AND b.q <= a.q AND (b.p <> a.p OR b.q <> a.q))),
{COVERED},
web AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(coalesce(score, 0), 8) AS score FROM matched LEFT JOIN covered USING (query_id, id)))"""
