"""DuckDB SQL that states, from the tables alone, what registered queries must return."""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TOKEN = r"[0-9A-Za-z\x{370}-\x{3FF}]+(?:[-''][0-9A-Za-z\x{370}-\x{3FF}]+)*"
END = r"[.!?:;][\"'')\]]*$"


def clean(x: str) -> str:
    x = f"translate({x}, '‐‑‒–—‘’“”', '-----''''\"\"')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '{WS}', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({clean(x)}), '{TOKEN}')"


def split(x: str, before: str, after: str = "") -> str:
    """Stripped non-empty parts, cut at white space after a character of `before` (and before one of `after`)."""
    marked = f"regexp_replace({x}, '([{before}])\\s+([{after}])', '\\1' || chr(1) || '\\2', 'g')" if after else f"regexp_replace({x}, '([{before}])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: trim(p)), lambda p: p <> '')"


def n_words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda p: p <> ''))"


def alpha(x: str, cut: str) -> str:
    return f"coalesce(nullif(substr(trim({clean(x)}, ' :.-'), 1, {cut}), ''), "


#: Blocks of documents: one per non-empty line, eight to a page.
BLOCKS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS block_pos FROM documents),
b AS (SELECT doc_id, block_pos // 8 + 1 AS page_number, block_pos, 'p' || (block_pos // 8 + 1) || '-b' || (block_pos % 8) AS block_id, text,
CAST(50 AS DOUBLE) AS x0, CAST(40 + (block_pos % 8) * 90 AS DOUBLE) AS y0, CAST(50 + least(length(text), 100) * 5 AS DOUBLE) AS x1,
least(CAST(792 AS DOUBLE), 40 + (block_pos % 8) * 90 + 12 * ceil(CAST(greatest(length(text), 1) AS DOUBLE) / 100)) AS y1,
CAST(CASE WHEN length(text) <= 60 AND NOT ends_with(text, '.') THEN 14 ELSE 10 END AS DOUBLE) AS font
FROM lines WHERE {clean("text")} <> '')"""

EDGES = "html|head|body|title|h[1-6]|p|li|ul|ol|dl|dt|dd|div|article|section|main|aside|nav|header|footer|table|tr|td|th|pre|blockquote|form|hr"
_bare = r"regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|[\x01-\x03]', '', 'g')"
_open = rf"regexp_replace({_bare}, '(?i)<(title|h1|p|li)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g')"
_shut = rf"regexp_replace(regexp_replace({_open}, '(?i)</?(?:{EDGES})(?:\s[^>]*)?/?>', chr(3), 'g'), '(?i)<br\s*/?>', ' ', 'g')"
#: Blocks of web pages: the whole text of titles, headings, paragraphs and list items.
HTML = f"""raw AS (SELECT page_id AS doc_id, regexp_extract_all(regexp_replace({_shut}, '<[^>]*>', '', 'g'), '\\x01[^\\x01\\x03]*') AS es FROM pages),
els AS (SELECT doc_id, unnest(es) AS e, CAST(unnest(range(len(es))) AS INT) AS block_pos FROM raw),
h AS (SELECT doc_id, block_pos, regexp_replace(e, '^\\x01[^\\x02]*\\x02', '') AS text, regexp_matches(e, '(?i)^\\x01(title|h1)') AS head FROM els),
b AS (SELECT doc_id, block_pos // 8 + 1 AS page_number, block_pos, text, CAST(CASE WHEN head THEN 20 ELSE 10 END AS DOUBLE) AS font,
CAST(40 + (block_pos % 8) * 90 AS DOUBLE) AS y0, least(CAST(792 AS DOUBLE), 40 + (block_pos % 8) * 90 + 12 * ceil(CAST(greatest(length(text), 1) AS DOUBLE) / 100)) AS y1 FROM h WHERE {clean("text")} <> '')"""

REF_HEAD = r"(?i)^(?:\d+(?:\.\d+)*\.?\s+)?references\b"
REF_ENTRY = r"^\[[0-9]+\]|\([12][0-9]{3}\)"
is_ref = f"(regexp_matches(trim(text), '{REF_ENTRY}'))"
WORDS = "length(regexp_replace(text, '[^ ]', '', 'g'))"
WORD_COUNT = f"len(list_filter(string_split(text, ' '), lambda w: len({tokens('w')}) > 0))"
CANDIDATE = f"(NOT {is_ref} AND {WORD_COUNT} >= 12)"


def over_blocks(select: str, where: str = "") -> str:
    return f"WITH {BLOCKS} SELECT {select} FROM b {where}"


def frame(expression: str, lo: int, hi: int, condition: str = "true") -> str:
    return f"list({expression}) FILTER (WHERE {condition}) OVER (PARTITION BY doc_id, page_number ORDER BY block_pos ROWS BETWEEN {-lo} PRECEDING AND {hi} FOLLOWING)"
