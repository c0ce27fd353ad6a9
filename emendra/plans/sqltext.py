"""SQL for DuckDB that says what the queries say: tokens, the matcher, and what follows from its operations."""

from __future__ import annotations

#: White space in Python's sense, spelled for RE2.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '(?:\n *)+'), lambda p: {strip('p')}), lambda p: p <> '')"


def marked(x: str) -> str:
    return f"coalesce(array_to_string({paragraphs(x)}, ' ¶ '), '')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '((?:[^(){SPACE}]+|[().?!-])[{SPACE}]*)', 1)"


def keys(x: str) -> str:
    return f"list_transform({x}, lambda t: {strip('t')})"


def one_line(x: str) -> str:
    return rf"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')"


def joined(x: str, start: str, end: str) -> str:
    return f"coalesce(array_to_string({x}[{start}+1:{end}], ''), '')"


def unmark(x: str) -> str:
    return f"replace({x}, '¶ ', chr(10) || chr(10))"


def operations(pairs: str) -> str:
    """CTEs up to ops(id, n, tag, i1, i2, j1, j2) and p(id, source, test, st, tt, a, b) for a query of (id, source, test).

    The matcher: longest common block, earliest in both texts, then left and
    right of it. With 200 or more test tokens, those that occur in over 1 % of
    places seed no block but may extend one.
    """
    return f"""
    p AS MATERIALIZED (SELECT id, source, test, st, tt, {keys('st')} AS a, {keys('tt')} AS b FROM (
        SELECT id, source, test, {tokens(marked('source'))} AS st, {tokens(marked('test'))} AS tt FROM ({pairs}))),
    ta AS MATERIALIZED (SELECT id, unnest(a) AS tok, generate_subscripts(a, 1) - 1 AS i FROM p),
    tb AS MATERIALIZED (SELECT id, unnest(b) AS tok, generate_subscripts(b, 1) - 1 AS j FROM p),
    popular AS (SELECT tb.id, tok FROM tb JOIN p ON p.id = tb.id WHERE len(b) >= 200 GROUP BY tb.id, tok, len(b) HAVING count(*) > len(b) // 100 + 1),
    every AS MATERIALIZED (SELECT ta.id, i, j, popular.tok IS NULL AS seeds FROM ta JOIN tb ON ta.id = tb.id AND ta.tok = tb.tok LEFT JOIN popular ON popular.id = ta.id AND popular.tok = ta.tok),
    -- runs of equal tokens along a diagonal
    runs AS MATERIALIZED (SELECT id, i, j, min(i) OVER w AS lo, max(i) OVER w AS hi FROM (
        SELECT id, i, j, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS g FROM every) WINDOW w AS (PARTITION BY id, i - j, g)),
    m AS MATERIALIZED (SELECT id, i, j FROM every WHERE seeds),
    seg AS (
      SELECT id, 0 AS alo, len(a) AS ahi, 0 AS blo, len(b) AS bhi, -1 AS bi, -1 AS bj, 0 AS k, true AS open FROM p WHERE len(a) > 0 AND len(b) > 0
      UNION ALL SELECT id, alo, ahi, blo, bhi, bi, bj, k, open FROM (
        WITH seeded AS (SELECT id, alo, ahi, blo, bhi, arg_min({{'i': i0, 'j': j0, 'k': n}}, (-n, i0, j0)) AS s FROM (
          SELECT id, alo, ahi, blo, bhi, min(i) AS i0, min(j) AS j0, count(*) AS n FROM (
            SELECT s.id, alo, ahi, blo, bhi, m.i, m.j, m.i - row_number() OVER (PARTITION BY s.id, alo, blo, ahi, bhi, m.i - m.j ORDER BY m.i) AS g
            FROM seg s JOIN m ON m.id = s.id AND m.i >= alo AND m.i < ahi AND m.j >= blo AND m.j < bhi WHERE s.open)
          GROUP BY id, alo, ahi, blo, bhi, i - j, g
          UNION ALL SELECT id, alo, ahi, blo, bhi, alo, blo, 0 FROM seg WHERE open) GROUP BY id, alo, ahi, blo, bhi),
        best AS (SELECT id, alo, ahi, blo, bhi, {{'i': s.i - back, 'j': s.j - back, 'k': s.k + back + forth}} AS b FROM (
          SELECT x.*, CASE WHEN l.lo IS NULL THEN 0 ELSE least(s.i - l.lo, s.i - alo, s.j - blo) END AS back, CASE WHEN r.hi IS NULL THEN 0 ELSE least(r.hi - s.i - s.k + 1, ahi - s.i - s.k, bhi - s.j - s.k) END AS forth
          FROM seeded x LEFT JOIN runs l ON l.id = x.id AND l.i = s.i - 1 AND l.j = s.j - 1 LEFT JOIN runs r ON r.id = x.id AND r.i = s.i + s.k AND r.j = s.j + s.k))
        SELECT id, alo, ahi, blo, bhi, b.i AS bi, b.j AS bj, b.k AS k, false AS open FROM best WHERE b.k > 0
        UNION ALL SELECT id, alo, b.i, blo, b.j, -1, -1, 0, true FROM best WHERE b.k > 0 AND alo < b.i AND blo < b.j
        UNION ALL SELECT id, b.i + b.k, ahi, b.j + b.k, bhi, -1, -1, 0, true FROM best WHERE b.k > 0 AND b.i + b.k < ahi AND b.j + b.k < bhi)),
    {from_blocks("SELECT id, bi, bj, k FROM seg WHERE NOT open")}"""


def from_blocks(blocks: str) -> str:
    """CTE ops from matching blocks (id, bi, bj, k) of the pairs p: adjacent blocks are joined, gaps become changes."""
    return f"""
    joined AS (SELECT id, min(bi) AS bi, min(bj) AS bj, sum(k) AS k FROM (
        SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY bi, bj) AS island FROM (
          SELECT *, CASE WHEN bi = lag(bi + k) OVER w AND bj = lag(bj + k) OVER w THEN 0 ELSE 1 END AS starts FROM ({blocks}) WINDOW w AS (PARTITION BY id ORDER BY bi, bj)))
      GROUP BY id, island),
    ended AS (SELECT id, bi, bj, k FROM joined UNION ALL SELECT id, len(a), len(b), 0 FROM p),
    gaps AS (SELECT id, bi, bj, k, coalesce(lag(bi + k) OVER w, 0) AS pi, coalesce(lag(bj + k) OVER w, 0) AS pj FROM ended WINDOW w AS (PARTITION BY id ORDER BY bi, bj, k DESC)),
    ops AS MATERIALIZED (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i1, j1, i2, j2) AS INTEGER) AS n, tag, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, CAST(j1 AS INTEGER) AS j1, CAST(j2 AS INTEGER) AS j2 FROM (
        SELECT id, CASE WHEN pi < bi AND pj < bj THEN 'replace' WHEN pi < bi THEN 'delete' ELSE 'insert' END AS tag, pi AS i1, bi AS i2, pj AS j1, bj AS j2 FROM gaps WHERE pi < bi OR pj < bj
        UNION ALL SELECT id, 'equal', bi, bi + k, bj, bj + k FROM gaps WHERE k > 0))"""


#: CTEs after `operations`: texts of each operation, and the statistics of each pair.
TEXTS = f"""
    texts AS MATERIALIZED (SELECT ops.*, {joined('st', 'i1', 'i2')} AS s, {joined('tt', 'j1', 'j2')} AS t FROM ops JOIN p USING (id))"""

STATS = """
    stats AS MATERIALIZED (
      SELECT p.id, CAST(count(tag) AS INTEGER) AS total_changes,
        CAST(count(*) FILTER (tag = 'delete') AS INTEGER) AS deletions, CAST(count(*) FILTER (tag = 'insert') AS INTEGER) AS insertions, CAST(count(*) FILTER (tag = 'replace') AS INTEGER) AS replacements,
        CAST(coalesce(max(size), 0) AS INTEGER) AS longest_change_length, CAST(coalesce(min(size), 0) AS INTEGER) AS shortest_change_length,
        CASE WHEN count(tag) > 0 THEN CAST(sum(size) AS DOUBLE) / count(tag) ELSE 0.0 END AS average_change_length,
        CASE WHEN greatest(length(any_value(source)), length(any_value(test))) > 0 THEN CAST(coalesce(sum(size), 0) AS DOUBLE) / greatest(length(any_value(source)), length(any_value(test))) ELSE 0.0 END AS change_ratio,
        CAST(coalesce(sum(length(t)), 0) AS INTEGER) AS chars_added, CAST(coalesce(sum(length(s)), 0) AS INTEGER) AS chars_deleted,
        CAST(coalesce(sum(length(t)), 0) - coalesce(sum(length(s)), 0) AS INTEGER) AS chars_net_change
      FROM p LEFT JOIN (SELECT *, CASE WHEN tag = 'insert' THEN length(t) ELSE length(s) END AS size FROM texts WHERE tag <> 'equal') x ON x.id = p.id GROUP BY p.id)"""
STATS_COLUMNS = "total_changes, deletions, insertions, replacements, longest_change_length, shortest_change_length, average_change_length, change_ratio, chars_added, chars_deleted, chars_net_change"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rendered(ins: str, ins_end: str, gone: str, gone_end: str) -> str:
    """Markup of an operation of `texts`."""
    deleted = f"{quoted(gone)} || s || {quoted(gone_end)}"
    inserted = f"array_to_string(list_transform(string_split(t, '¶ '), lambda x: {quoted(ins)} || x || {quoted(ins_end)}), chr(10) || chr(10))"
    return f"CASE tag WHEN 'equal' THEN {unmark('s')} WHEN 'delete' THEN {deleted} WHEN 'insert' THEN {inserted} ELSE {deleted} || {inserted} END"
