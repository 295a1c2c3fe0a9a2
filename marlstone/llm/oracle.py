"""DuckDB statements of the text queries that can be said in SQL."""

from __future__ import annotations

from marlstone.functions.text import WS
from marlstone.llm import canonical, spans
from marlstone.llm.queries import NEAR_RUN, NEAR_THRESHOLD

TABLES = (("documents", "doc_id", "text"), ("social_post", "id", "text"), ("news_item", "delivery_id", "text"))


def rows(tables: tuple, all_of: str = "DISTINCT") -> str:
    return " UNION ALL ".join(rf"SELECT {all_of} '{t}' AS tbl, {k} AS id, {x} AS text FROM {t} WHERE regexp_matches({x}, '[^{WS}\x{{200B}}\x{{FEFF}}]')" for t, k, x in tables)


def stripped(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def same_look() -> str:
    looks = f"r AS ({rows(TABLES)}), l AS (SELECT tbl, id, text AS stored, {canonical.statement()} AS look FROM r)"
    return f"WITH {looks} SELECT DISTINCT a.tbl, a.id AS id_1, b.id AS id_2 FROM l a JOIN l b ON a.tbl = b.tbl AND a.look = b.look AND a.id < b.id WHERE a.stored <> b.stored"


def spelled() -> str:
    looks = f"r AS ({rows(TABLES, '')}), l AS (SELECT tbl, id, text AS stored, {canonical.statement()} AS canonical FROM r), c AS (SELECT tbl, canonical, count(DISTINCT stored) AS spellings, count(*) AS rows FROM l GROUP BY 1, 2)"
    return f"WITH {looks} SELECT tbl, id, canonical, spellings, rows FROM l JOIN c USING (tbl, canonical)"


def junk() -> str:
    """Documents by words and sentences, posts by what is left without links, tags and figures."""
    around = "\"''“”„«»()[]*-–—•.,;:!?…"
    ends = r"""(\n|[.!?…]+["''”»)\]]*[WS]|[。！？]+["''”»」』）)\]]*[WS]?)""".replace("WS", WS)
    closed = r"""[.!?…。！？．]["''”»)\]」』）]*$"""
    bare = r"(?i)(?:https?://|www\.)[^WS]+|[$#@][\p{L}\p{N}_]+|[+-]?\p{Nd}[\p{Nd}.,]*(?:[kmb]|bn|mln|x|st|nd|rd|th|am|pm)?\b".replace("WS", WS)
    return rf"""WITH k AS (SELECT list(DISTINCT lower(trim(word))) AS known FROM common_word), r AS ({rows(TABLES[:2])}), t AS (SELECT tbl, id, {canonical.statement()} AS t FROM r),
u AS (SELECT id, length(t) AS n_chars, unnest(string_split(regexp_replace(t, '{ends}', '\1' || chr(1), 'g'), chr(1))) AS u FROM t WHERE tbl = 'documents'),
s AS (SELECT id, n_chars, {stripped('u')} AS s FROM u), w AS (SELECT id, n_chars, s, string_split_regex(s, '[{WS}]+') AS ws FROM s),
p AS (SELECT *, list_filter(list_transform(ws, lambda w: {{'c': trim(w, '{around}'), 'l': right(w, 1)}}), lambda x: regexp_matches(x.c, '^[\p{{L}}''’-]+$') AND regexp_matches(x.c, '\p{{L}}')) AS pl FROM w),
v AS (SELECT id, n_chars, length(s) AS size, len(ws) AS n, len(pl) AS plain, len(list_filter(pl, lambda x: list_contains(known, lower(x.c)))) AS common, len(list_filter(pl, lambda x: NOT regexp_matches(x.c, '^\p{{Lu}}') OR NOT regexp_matches(x.c, '[\p{{Ll}}\p{{Lt}}]'))) AS small,
 len(list_filter(pl, lambda x: x.l IN (',', ';'))) AS commas, regexp_matches(s, '{closed}') AS closed, len(regexp_extract_all(s, '[㐀-鿿豈-﫿]')) AS han, len(regexp_extract_all(s, '[\p{{L}}\p{{Nl}}\p{{No}}]')) AS letters, contains(s, ',') AS comma FROM p, k),
o AS (SELECT id, n_chars, size, CASE WHEN han >= 6 AND han * 2 >= letters THEN closed OR comma ELSE n >= 4 AND plain * 2 >= n AND small * 4 >= n AND commas * 2 < n AND (common > 0 OR (small >= 3 AND closed)) END AS ok FROM v)
SELECT 'documents' AS tbl, id AS rec_id FROM o GROUP BY id, n_chars HAVING coalesce(sum(size) FILTER (ok), 0) / n_chars < 1.0 / 3
UNION ALL SELECT DISTINCT tbl, id FROM t WHERE tbl = 'social_post' AND NOT regexp_matches(regexp_replace(t, '{bare}', ' ', 'g'), '[\p{{L}}\p{{Nl}}\p{{No}}]')"""


WINDOWS = f"""t AS (SELECT text, md5(text) AS k FROM documents WHERE length(text) >= {spans.LEAST} GROUP BY 1), w AS (SELECT k, i, md5(substring(text, i, {spans.LEAST})) AS g FROM (SELECT k, text, unnest(range(1, length(text) - {spans.LEAST - 2})) AS i FROM t)),
s AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT k) > 1), m AS (SELECT k, i, g FROM w SEMI JOIN s USING (g)), d AS (SELECT doc_id, md5(text) AS k FROM documents WHERE length(text) >= {spans.LEAST})"""


def shared_pairs() -> str:
    """Every window of the least length, met by equality."""
    return f"""WITH {WINDOWS}, p AS (SELECT DISTINCT a.k AS k1, b.k AS k2 FROM (SELECT DISTINCT k, g FROM m) a JOIN (SELECT DISTINCT k, g FROM m) b USING (g)), e AS (SELECT k1, k2 FROM p UNION SELECT k, k FROM d)
SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM e JOIN d a ON a.k = k1 JOIN d b ON b.k = k2 WHERE a.doc_id < b.doc_id"""


def shared_part() -> str:
    """Windows that stand in another text, and copies from end to end, as stretches."""
    return f"""WITH {WINDOWS}, c AS (SELECT k, count(DISTINCT doc_id) AS copies FROM d GROUP BY 1), g AS (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= {spans.LEAST} THEN 0 ELSE 1 END AS new FROM m),
h AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS part FROM g), x AS (SELECT k, min(i) - 1 AS a, max(i) - 1 + {spans.LEAST} AS b FROM h GROUP BY k, part), y AS (SELECT k, sum(b - a) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM x GROUP BY 1),
z AS (SELECT doc_id, length(text) AS n_chars, md5(text) AS k FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, n_chars, CASE WHEN copies > 1 THEN n_chars ELSE coalesce(n, 0) END AS n, CASE WHEN copies > 1 THEN '0-' || n_chars ELSE coalesce(spans, '') END AS spans FROM z LEFT JOIN c USING (k) LEFT JOIN y USING (k))
SELECT doc_id, CAST(n_chars AS INTEGER) AS n_chars, CAST(n AS INTEGER) AS shared_chars, round(coalesce(n / nullif(n_chars, 0), 0), 6) AS shared_share, spans FROM q"""


def alike(run: int, threshold: float) -> str:
    """Sets of word runs met by the rarest of their runs, as many as a similar set can't do without, and compared whole."""
    tables = (*TABLES[:2], ("news_item", "delivery_id", "concat_ws(' ', title, text)"))
    gram = " || ' ' || ".join(f"w[i + {n}]" for n in range(run))
    return rf"""WITH r AS ({rows(tables)}), w AS (SELECT tbl, id, regexp_extract_all(lower({canonical.statement()}), '[\p{{L}}\p{{N}}_]+') AS w FROM r),
u AS (SELECT tbl, id, list_sort(list_distinct(list_transform(range(1, len(w) - {run - 2}), lambda i: {gram}))) AS runs FROM w WHERE len(w) >= 20),
k AS (SELECT tbl, id, md5(array_to_string(runs, '|')) AS k, runs FROM u), c AS (SELECT tbl, k, any_value(runs) AS runs FROM k GROUP BY 1, 2),
x AS (SELECT tbl, k, len(runs) AS n, unnest(runs) AS g FROM c), f AS (SELECT tbl, g, count(*) AS often FROM x GROUP BY 1, 2),
o AS (SELECT x.tbl, k, n, g, row_number() OVER (PARTITION BY x.tbl, k ORDER BY often, g) AS place FROM x JOIN f USING (tbl, g)),
h AS (SELECT * FROM o WHERE place <= n - ceil(n * {threshold}) + 1),
p AS (SELECT DISTINCT a.tbl, a.k AS k1, b.k AS k2 FROM h a JOIN h b ON a.tbl = b.tbl AND a.g = b.g AND a.k < b.k AND a.n >= {threshold} * b.n AND b.n >= {threshold} * a.n),
s AS (SELECT p.tbl, k1, k2, len(list_intersect(a.runs, b.runs)) AS met, len(a.runs) + len(b.runs) AS n FROM p JOIN c a ON a.tbl = p.tbl AND a.k = k1 JOIN c b ON b.tbl = p.tbl AND b.k = k2),
v AS (SELECT tbl, k1, k2 FROM s WHERE met >= {threshold} * (n - met)), e AS (SELECT tbl, k1, k2 FROM v UNION ALL SELECT tbl, k2, k1 FROM v UNION ALL SELECT tbl, k, k FROM c)
SELECT DISTINCT a.tbl, a.id AS id_1, b.id AS id_2 FROM e JOIN k a ON a.tbl = e.tbl AND a.k = k1 JOIN k b ON b.tbl = e.tbl AND b.k = k2 WHERE a.id < b.id"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": junk(), "p2_found": same_look(), "p2_canonical": spelled(), "p7_found": alike(NEAR_RUN, NEAR_THRESHOLD), "p10_found": shared_pairs(), "p10_shared": shared_part()}
