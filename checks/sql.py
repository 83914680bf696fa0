"""The adapters' views in DuckDB's SQL, and the patterns in RE2's dialect."""

from __future__ import annotations

import re

from bitext import constants as K

VIEWS: dict[str, str] = {}
WS = "[" + K.SPACES + "]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str, wide: bool = True) -> str:
    """A Java pattern as a quoted RE2 pattern; look-around other than word edges is refused."""
    p = K.wide_space(pattern) if wide else pattern
    p = p.replace("(?:(?<=\\.)(?=[A-Za-z0-9_])|(?<!\\.)(?![A-Za-z0-9_]))", r"\b")
    p = p.replace(K.WS, WS)
    p = p.replace(K.WORD_START, r"\b").replace(K.WORD_END, r"\b")
    p = p.replace("(?iu)", "(?i)").replace("(?imu)", "(?im)").replace("IsGreek", "Greek")
    if "(?<" in p or "(?=" in p or "(?!" in p:
        raise ValueError(p)
    return lit(p)


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {re2(pattern)}))"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {re2(pattern)})"


def money(x: str) -> str:
    cents = f"CAST(round({x} * 100) AS BIGINT)"
    return f"(({cents}) // 100)::VARCHAR || '.' || lpad((({cents}) % 100)::VARCHAR, 2, '0')"


def query(body: str) -> str:
    """``body`` with a WITH list of every view it needs."""
    if body.startswith("WITH "):
        return body
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bv_\w+", sql):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    return f"WITH {parts}\n{body}"


NL = "chr(10)"
C_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

VIEWS["v_doc_pages"] = f"""
SELECT doc_id, CAST(p AS INT) AS page, method,
       array_to_string(lines[(p - 1) * 5 + 1 : p * 5], {NL} || {NL}) AS text,
       CAST(n_chars % 4 AS INT) AS image_count, CAST(n_chars % 40 AS INT) AS vector_path_count
FROM (SELECT doc_id, n_chars, string_split(text, {NL}) AS lines,
             CASE WHEN lang IN ('de', 'es') THEN 'ocr' ELSE 'native' END AS method,
             unnest(range(1, CAST(ceil(len(string_split(text, {NL})) / 5.0) AS BIGINT) + 1)) AS p
      FROM documents)
"""

VIEWS["v_order_pages"] = f"""
SELECT -o_custkey AS doc_id, CAST(o_orderkey AS INT) AS page, 'native' AS method,
  'Order report ' || o_orderkey || {NL} || {NL} || 'The customer ' || o_custkey ||
  ' placed an order for ' || {money('o_totalprice')} || ' in ' || year(o_orderdate) ||
  ' and the clerk com-' || {NL} || 'pleted the record for the archive.' || {NL} ||
  'A second line follows.' ||
  CASE o_orderpriority
    WHEN '1-URGENT' THEN {NL} || {NL} || 'Figure ' || o_orderkey || '. Price trend of the order' || {NL} ||
                         'with a second caption line' || {NL}
    WHEN '2-HIGH' THEN {NL} || {NL} || 'Table ' || o_orderkey || ': Items of the order' || {NL}
    WHEN '3-MEDIUM' THEN {NL} || {NL} || 'Γr(Y) = ∑ Y_i + ' || o_orderkey || {NL}
    WHEN '5-LOW' THEN {NL} || {NL} || 'Write to clerk' || o_custkey || '@shop.example for https://shop.example/o/'
                      || o_orderkey || {NL}
    ELSE '' END ||
  {NL} || 'Closing prose of the page.' ||
  CASE o_orderstatus
    WHEN 'F' THEN {NL} || {NL} || {lit(K.FOOTNOTE_BOUNDARY)} || {NL} || {NL} || '1. Smith: Cited work, ' ||
                  year(o_orderdate) || '. 2. Jones: Another work, ' || (year(o_orderdate) - 1) || '.'
    WHEN 'O' THEN {NL} || {NL} || '3. Author: Article title, Journal 12, ' || year(o_orderdate) || '.'
    ELSE '' END AS text,
  CAST({C_CENTS} % 4 AS INT) AS image_count, CAST({C_CENTS} % 40 AS INT) AS vector_path_count
FROM orders
"""

VIEWS["v_corpus_pages"] = "SELECT * FROM v_doc_pages UNION ALL SELECT * FROM v_order_pages"

VIEWS["v_order_notes"] = f"""
SELECT o_custkey AS doc_id, printf('seg_%05d', o_orderkey) AS segment_id,
       CAST(o_orderkey AS INT) AS ordinal, CAST(year(o_orderdate) AS INT) AS page,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'equation-marker' ELSE 'paragraph' END AS block_type,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Γr(Y) = ∑ Y_i. (' || o_orderkey || ')'
       ELSE 'Order ' || o_orderkey || ' of customer no' || o_custkey || ' costs ' || {money('o_totalprice')} ||
            ' since ' || year(o_orderdate) ||
            CASE o_orderstatus
              WHEN 'F' THEN '; p < 0.05 with β and X_{{' || o_custkey || '}} ≤ 7 %'
              WHEN 'O' THEN '; see https://shop.example/o/' || o_orderkey || ') or doi:10.1234/' || o_orderkey
              ELSE '; $y_' || o_custkey || ' = ' || o_orderkey || '$ by mail to clerk.' || o_custkey ||
                   '@shop.example, [[NUMBER_00001]] stays' END || '.' END AS text,
       o_orderpriority AS priority, o_orderstatus AS status
FROM orders
"""
