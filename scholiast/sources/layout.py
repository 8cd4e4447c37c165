"""Blocks and words, the tables that all structure operators start from.

A block is one row: doc_id, page_number, block_pos (its place in the document), block_id, text, x0,
y0, x1, y1, font, page_width, page_height. Order is always (doc_id, page_number, block_pos); block_id
is a name only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, first_token, normal

PER_PAGE, WIDTH, HEIGHT = 8, 612.0, 792.0


def _placed(rows: DataFrame, font: Column) -> DataFrame:
    """Geometry for (doc_id, block_pos, text): eight blocks a page, each as wide and high as its text needs."""
    slot, n = F.pmod("block_pos", F.lit(PER_PAGE)), F.length("text")
    page = F.floor(F.col("block_pos") / PER_PAGE).cast("int") + 1
    y0 = F.lit(40.0) + slot * 90.0
    return rows.where(clean(F.col("text")) != "").select(
        "doc_id",
        page.alias("page_number"),
        "block_pos",
        F.concat(F.lit("p"), page, F.lit("-b"), slot).alias("block_id"),
        "text",
        F.lit(50.0).alias("x0"),
        y0.alias("y0"),
        (F.lit(50.0) + F.least(n, F.lit(100)) * 5.0).alias("x1"),
        F.least(F.lit(HEIGHT), y0 + F.lit(12.0) * F.ceil(F.greatest(n, F.lit(1)) / 100.0)).cast("double").alias("y1"),
        font.alias("font"),
        F.lit(WIDTH).alias("page_width"),
        F.lit(HEIGHT).alias("page_height"),
    )


def document_blocks(docs: DataFrame) -> DataFrame:
    """Every non-empty line of a text is a block; short lines without a full stop are set larger."""
    docs = docs.select("doc_id", normal(F.col("text")).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_pos", "text"))
    return _placed(lines, F.when((F.length("text") <= 60) & ~F.endswith("text", F.lit(".")), 14.0).otherwise(10.0))


#: Elements that are blocks, and others that end one. All other tags stand inside a block.
BLOCK_TAGS = "title|h1|p|li"
EDGE_TAGS = "html|head|body|title|h[1-6]|p|li|ul|ol|dl|dt|dd|div|article|section|main|aside|nav|header|footer|table|tr|td|th|pre|blockquote|form|hr"


def html_blocks(pages: DataFrame) -> DataFrame:
    """Titles, headings, paragraphs and list items of raw HTML, scripts, styles and comments aside, each with all of its text.

    Opening tags of blocks become a mark with the tag's name, edges of other elements an end mark, line breaks a blank; what is then still a tag goes.
    """
    bare = F.regexp_replace(normal(F.col("html")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|[\x01-\x03]", "")
    marked = F.regexp_replace(bare, rf"(?i)<({BLOCK_TAGS})(?:\s[^>]*)?>", "\x01$1\x02")
    ended = F.regexp_replace(F.regexp_replace(marked, rf"(?i)</?(?:{EDGE_TAGS})(?:\s[^>]*)?/?>", "\x03"), r"(?i)<br\s*/?>", " ")
    found = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all(F.regexp_replace(ended, r"<[^>]*>", ""), F.lit(r"\x01[^\x01\x03]*"), F.lit(0))).alias("block_pos", "e"))
    rows = found.select("doc_id", "block_pos", F.regexp_replace("e", r"^\x01[^\x02]*\x02", "").alias("text"), F.rlike("e", F.lit(r"(?i)^\x01(title|h1)")).alias("head"))
    return _placed(rows, F.when(F.col("head"), 20.0).otherwise(10.0))


def words(blocks: DataFrame) -> DataFrame:
    """One row per blank-separated word of a block, twelve to a line, each with its normalized form and box."""
    w = blocks.select("doc_id", "page_number", "block_pos", "block_id", "x0", "y0", F.posexplode(F.split("text", " ")).alias("word_pos", "text")).where("text <> ''")
    line = F.floor(F.col("word_pos") / 12).cast("int")
    x0, y0 = F.col("x0") + F.pmod("word_pos", F.lit(12)) * 40.0, F.col("y0") + line * 12.0
    return w.select("doc_id", "page_number", "block_pos", "block_id", "word_pos", line.alias("line_number"), "text", first_token(F.col("text")).alias("normalized"), x0.alias("x0"), y0.alias("y0"), (x0 + 36.0).alias("x1"), (y0 + 10.0).alias("y1"))


def placed_words(text: Column, block_id: Column, x0: Column, y0: Column) -> Column:
    """The words of one block as an array of (text, block_id, x0, y0, x1, y1), as words() places them."""

    def placed(t: Column, i: Column) -> Column:
        x, y = x0 + F.pmod(i, F.lit(12)) * 40.0, y0 + F.floor(i / 12).cast("int") * 12.0
        return F.struct(t.alias("text"), block_id.alias("block_id"), x.alias("x0"), y.alias("y0"), (x + 36.0).alias("x1"), (y + 10.0).alias("y1"))

    return F.filter(F.transform(F.split(text, " "), placed), lambda w: w["text"] != "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, paper_id): whole files with their SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("paper_id"))


def title(meta: Column, first_block: Column, path: Column) -> Column:
    """Metadata title, else the first block's first 160 characters, else the file's stem."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(clean(meta), F.lit("")), F.nullif(F.substring(clean(first_block), 1, 160), F.lit("")), stem)
