"""Text functions as column expressions, evaluated inside the JVM.

Each takes and returns a Column. Patterns spell out their character classes, since `\\s` and `\\w`
mean different sets in different regex engines.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------------------------
#: Characters replaced one for one: five dashes, four quotes.
FROM_CHARS = "‐‑‒–—‘’“”"
TO_CHARS = "-----''\"\""
#: Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
SPACES = r"[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
TOKEN = r"[0-9A-Za-z\u0370-\u03FF]+(?:[-'][0-9A-Za-z\u0370-\u03FF]+)*"
SENTENCE_END = r"[.!?:;][\"')\]]*$"
#: Words that leave a quote hanging.
DANGLING = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with")
# --------------------------------------------------------------------------------------------
#: A character that makes a word have a token, before clean().
TOKEN_CHAR = r"[0-9A-Za-z\u0370-\u03FF" + "".join(LIGATURES) + "]"


def clean(c: Column) -> Column:
    """Dashes, quotes and ligatures made plain, control characters out, white space to single blanks. For text already in NFKC form."""
    c = F.translate(c, FROM_CHARS, TO_CHARS)
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.btrim(F.regexp_replace(F.regexp_replace(c, CONTROL, ""), SPACES, " "))


@F.pandas_udf(T.StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Unicode NFKC form; the JVM side has no function for it."""
    return c.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


#: Characters that NFKC leaves alone next to any other of them: ASCII, most Latin, Greek and Cyrillic letters, common marks, kana, ideographs, Hangul.
STABLE = r"\x00-\x7f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0391-\u03a1\u03a3-\u03ce\u0400-\u0482\u2012-\u2016\u2018-\u201e\u2020-\u2022\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"


def normal(c: Column) -> Column:
    """Text in NFKC form. Only texts with a character that may change go to Python; sources apply this once, and clean() builds on it."""
    change = (F.octet_length(c) != F.char_length(c)) & F.rlike(c, F.lit(f"[^{STABLE}]"))
    return F.coalesce(nfkc(F.when(change, c)), c)


def tokens(c: Column) -> Column:
    """Lowered runs of digits, Latin and Greek letters with inner hyphens or apostrophes, of cleaned text."""
    return F.transform(F.regexp_extract_all(clean(c), F.lit(TOKEN), F.lit(0)), F.lower)


def first_token(c: Column) -> Column:
    return F.coalesce(F.get(tokens(c), F.lit(0)), F.lit(""))


def pieces(c: Column, pattern: str) -> Column:
    """Parts between matches, stripped, without empty ones. A bare F.btrim would get each part's index as the characters to strip."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.btrim(x)), lambda x: x != "")


def sentences(c: Column) -> Column:
    return pieces(c, r"(?<=[.!?])\s+")


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def or_else(c: Column, default: str) -> Column:
    return F.when(c == "", F.lit(default)).otherwise(c)


def selected_quote(c: Column) -> Column:
    """A quote short enough to mark: whole if at most two sentences and 55 words, else its first sentence or two."""
    q = clean(c)
    s = sentences(q)
    first, two = F.get(s, F.lit(0)), F.array_join(F.slice(s, 1, 2), " ")
    short = (F.size(s) <= 2) & (n_words(q) <= 55)
    return F.when(q == "", "").when(short, q).when(n_words(first) >= 8, first).when((F.size(s) >= 2) & (n_words(two) <= 55), two).otherwise(q)


def sentence_candidates(c: Column) -> Column:
    """Sentences of five tokens or more; if there are none, the whole text, if that isn't empty."""
    t = clean(c)
    long = F.filter(pieces(t, r"(?<=[.!?:;])\s+(?=[A-Z0-9\"'“(])"), lambda x: F.size(tokens(x)) >= 5)
    return F.when(t == "", F.array().cast("array<string>")).when(F.size(long) > 0, long).otherwise(F.array(t))


def note_title(c: Column) -> Column:
    return or_else(F.substring(F.btrim(clean(c), F.lit(" :.-")), 1, 48), "Study note")


def plain_math(c: Column) -> Column:
    """LaTeX markup out of prose, in this order."""
    for mark in ("\\(", "\\)", "\\[", "\\]", "$"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    for pattern, to in ((r"\\text\{([^}]*)\}", "$1"), (r"\\mathbb\{E\}", "E"), (r"\\hat\{([^}]*)\}", "$1-hat"), (r"\\mid", "|"), (r"\\[a-zA-Z]+", "")):
        c = F.regexp_replace(c, pattern, to)
    return F.replace(F.replace(c, F.lit("{"), F.lit("")), F.lit("}"), F.lit(""))


def note_body(c: Column) -> Column:
    """At most 260 characters: whole, else one or two sentences, else cut at a blank."""
    b = clean(plain_math(c))
    s = sentences(b)
    one, two = F.get(s, F.lit(0)), F.array_join(F.slice(s, 1, 2), " ")
    trimmed = F.rtrim(F.substring(b, 1, 260), F.lit(" ,;:-"))
    at = F.length(trimmed) - F.instr(F.reverse(trimmed), " ")  # the last blank, from zero; the length itself if there is none
    cut = F.when(F.contains(trimmed, F.lit(" ")) & (at >= 180), F.substr(trimmed, F.lit(1), at)).otherwise(trimmed)
    return F.when(F.length(b) <= 260, b).when(F.length(one) <= 220, one).when((F.size(s) >= 2) & (F.length(two) <= 260), two).otherwise(F.rtrim(cut, F.lit(" ,;:-")))


def equation_title(c: Column, label: Column) -> Column:
    t = or_else(F.substring(F.btrim(clean(c), F.lit(" :.-")), 1, 34), "Equation note")
    prefix = F.concat(F.lit("Eq. "), label, F.lit(" "))
    return F.when(F.coalesce(label, F.lit("")) == "", t).when(F.startswith(t, prefix), t).otherwise(F.substring(F.concat(prefix, t), 1, 34))


def equation_latex(c: Column) -> Column:
    """Display LaTeX, or null if there is none or it is prose."""
    s = F.btrim(c)
    inner = F.when(F.startswith(s, F.lit("$")) & F.endswith(s, F.lit("$")) & (F.length(s) >= 2), F.btrim(F.substr(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0))))).otherwise(s)
    t = F.regexp_replace(inner, SPACES, " ")
    prose = F.contains(t, F.lit("\\text{")) & (F.contains(t, F.lit(":")) | (F.regexp_count(t, F.lit("[A-Za-z]{4,}")) > 6))
    return F.when((t == "") | F.contains(t, F.lit("@")) | prose, None).otherwise(F.substring(t, 1, 220))


def symbol_map(entries: Column) -> Column:
    """At most four (symbol, meaning) of an ordered array of them; empty ones go, keys of 20 and meanings of 80 characters. A later entry with the key of an earlier one gives its meaning."""
    rows = F.transform(entries, lambda e: F.struct(F.btrim(e["symbol"]).alias("s"), note_body(e["meaning"]).alias("m")))
    rows = F.transform(F.filter(rows, lambda e: (e["s"] != "") & (e["m"] != "")), lambda e: F.struct(F.substring(e["s"], 1, 20).alias("symbol"), F.substring(e["m"], 1, 80).alias("meaning")))
    keys = F.slice(F.array_distinct(F.transform(rows, lambda e: e["symbol"])), 1, 4)
    # A later duplicate counts only while fewer than four keys are known, that is before the fourth key's first place.
    stop = F.when(F.size(keys) == 4, F.array_position(F.transform(rows, lambda e: e["symbol"]), F.get(keys, F.lit(3))).cast("int")).otherwise(F.size(rows))
    seen = F.slice(rows, F.lit(1), stop)
    return F.transform(keys, lambda k: F.struct(k.alias("symbol"), F.element_at(F.filter(seen, lambda e: e["symbol"] == k), -1)["meaning"].alias("meaning")))


def equation_text(c: Column, label: Column) -> Column:
    t = clean(c)
    has = (F.coalesce(label, F.lit("")) != "") & F.endswith(t, label)
    return F.when(has, F.rtrim(F.substr(t, F.lit(1), F.length(t) - F.length(label)))).otherwise(t)


def compact_label(c: Column) -> Column:
    return F.regexp_replace(clean(c), SPACES, "")


def equation_body(body: Column, intuition: Column) -> Column:
    more = F.when((F.length(body) < 150) & (F.coalesce(intuition, F.lit("")) != ""), intuition)
    return F.btrim(F.substring(F.concat_ws(" ", F.when(body != "", body), more), 1, 280))


def slug(c: Column) -> Column:
    return or_else(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), "paper")


def without_thinking(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), F.lit(" \t\n\r\f\x0b"))


def repaired_escapes(c: Column) -> Column:
    """JSON text with every backslash that starts no valid escape doubled."""
    return F.regexp_replace(c, r'\\(?!["\\/bfnrtu])', r"\\\\")


def response_text(body: Column) -> Column:
    """The answer in any of three response shapes: output_text, the first text of the first message that has one, or the first choice."""
    message = F.from_json(body, "output array<struct<type string, content array<struct<type string, text string>>>>")["output"]
    texts = F.flatten(F.transform(F.filter(message, lambda m: m["type"] == "message"), lambda m: F.filter(m["content"], lambda x: (x["type"] == "output_text") & x["text"].isNotNull())))
    choices = F.filter(F.from_json(body, "choices array<struct<message struct<content string>>>")["choices"], lambda x: x["message"]["content"].isNotNull())
    return without_thinking(F.coalesce(F.get_json_object(body, "$.output_text"), F.get(texts, F.lit(0))["text"], F.get(choices, F.lit(0))["message"]["content"]))


def parsed(c: Column, schema: str) -> Column:
    """JSON by a schema, with one attempt at repair; null if neither parses, so that one bad answer does not fail a batch."""
    ok = F.get_json_object(c, "$").isNotNull()
    return F.when(ok, F.from_json(c, schema)).otherwise(F.from_json(F.when(F.get_json_object(repaired_escapes(c), "$").isNotNull(), repaired_escapes(c)), schema))


def confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def quad(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners in the order upper left, upper right, lower left, lower right."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.struct(p(x0, y0).alias("ul"), p(x1, y0).alias("ur"), p(x0, y1).alias("ll"), p(x1, y1).alias("lr"))


def equation_question(label: Column, equation_id: Column, role: Column) -> Column:
    of = F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(equation_id)
    return F.format_string("Explain exactly what equation %s is doing in this paper as a %s. Resolve symbols from the supplied page, section, and paper context before giving any interpretation.", of, role)


def note_question(section: Column) -> Column:
    return F.format_string("Explain the technical role of this highlighted passage in section %s.", F.when(F.coalesce(section, F.lit("")) != "", section).otherwise("unknown section"))


def has_content(size: Column) -> Column:
    """An upload of no bytes is rejected."""
    return F.coalesce(size > 0, F.lit(False))


def plan_path(out_dir: Column, title: Column) -> Column:
    """Where a document's annotated copy goes if no place is named."""
    return F.concat(F.rtrim(out_dir, F.lit("/")), F.lit("/"), slug(title), F.lit(".annotated.pdf"))


def latex_key(latex: Column, size: Column, colour: Column) -> Column:
    """Equal keys need one drawing only."""
    return F.sha2(F.concat_ws("\x1f", render_latex(latex), size.cast("string"), colour), 256)


def is_pdf(name: Column, kind: Column) -> Column:
    return F.coalesce(F.endswith(F.lower(F.btrim(name)), F.lit(".pdf")), F.lit(False)) | F.coalesce(F.lower(F.btrim(kind)) == "application/pdf", F.lit(False))


def status_label(status: Column) -> Column:
    return F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))


def render_latex(c: Column) -> Column:
    """LaTeX as a renderer wants it: no enclosing dollars, empty for null."""
    s = F.btrim(F.coalesce(c, F.lit("")))
    return F.when(F.startswith(s, F.lit("$")) & F.endswith(s, F.lit("$")) & (F.length(s) >= 2), F.btrim(F.substr(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0))))).otherwise(s)


def ends_sentence(c: Column) -> Column:
    return F.rlike(c, F.lit(SENTENCE_END))


def byte_range(content: Column, header: Column) -> Column:
    """What a 'bytes=a-b' header asks of content: (status, first, last, body). An absent header gives all of it with 200, one that can't be met 416."""
    size = F.octet_length(content)
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i) for i in (1, 2))
    first = F.when(a != "", a.try_cast("long")).otherwise(F.greatest(size - b.try_cast("long"), F.lit(0)))
    last = F.when((a != "") & (b != ""), F.least(b.try_cast("long"), size - 1)).otherwise(size - 1)
    bad = ~F.rlike(header, F.lit(r"^bytes=(\d+-\d*|-\d+)$")) | (first >= size) | (first > last)
    part = F.substring(content, first.cast("int") + 1, (last - first + 1).cast("int"))
    whole = F.struct(F.lit(200).alias("status"), F.lit(0).cast("long").alias("first"), (size - 1).cast("long").alias("last"), content.alias("body"))
    none = F.struct(F.lit(416).alias("status"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("binary").alias("body"))
    return F.when(header.isNull(), whole).when(bad, none).otherwise(F.struct(F.lit(206).alias("status"), first.cast("long").alias("first"), last.cast("long").alias("last"), part.alias("body")))
