"""What a document's blocks are: baselines, headings, sections, references, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure as S
from ..functions.alignment import repair_text_udf
from ..functions.text import TOKEN_CHAR, clean

PAGE = ("doc_id", "page_number")
ORDER = ("page_number", "block_pos")


def upper_median(c: Column, default: float) -> Column:
    """The element at n div 2 of the sorted values; of an even number, the upper middle one. An aggregate."""
    v = F.array_sort(F.collect_list(c))
    return F.coalesce(F.get(v, F.floor(F.size(v) / 2).cast("int")), F.lit(default))


def baselines(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, base_font, base_height) of each page."""
    return blocks.groupBy(*PAGE).agg(upper_median(F.when(F.col("font") > 0, F.col("font")), 10.0).alias("base_font"), upper_median(F.col("y1") - F.col("y0"), 12.0).alias("base_height"))


def reference_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, is_reference_page): a page with a reference heading or five reference entries."""
    heads, entries = F.count_if(S.is_reference_heading(F.col("text"))), F.count_if(S.is_reference_entry(F.col("text")))
    return blocks.groupBy(*PAGE).agg(((heads > 0) | (entries >= 5)).alias("is_reference_page"))


def with_headings(blocks: DataFrame) -> DataFrame:
    """Adds base_font, base_height, is_heading. Pages are partitioned once; the join reuses that."""
    b = blocks.join(baselines(blocks), list(PAGE))
    return b.withColumn("is_heading", S.is_heading(F.col("text"), F.col("font"), F.col("base_font"), F.col("y1") - F.col("y0"), F.col("base_height")))


def with_sections(blocks: DataFrame) -> DataFrame:
    """Adds inline_title and section_title: the last heading or inline title up to each block, over page ends."""
    b = blocks.withColumn("inline_title", S.leading_section_title(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("section_title", F.last(F.when(F.col("is_heading"), F.col("text")).otherwise(F.col("inline_title")), ignorenulls=True).over(w))


def with_references(blocks: DataFrame) -> DataFrame:
    """Adds is_reference_page and is_reference, once for all operators that ask."""
    b = blocks.join(reference_pages(blocks), list(PAGE))
    return b.withColumn("is_reference", S.is_reference_block(F.col("text"), F.col("section_title")))


def with_word_counts(blocks: DataFrame) -> DataFrame:
    """Adds word_count: blank-separated words that have a token, each matched once from its first token character to its end."""
    return blocks.withColumn("word_count", F.regexp_count("text", F.lit(f"{TOKEN_CHAR}[^ ]*")))


def structured_in_place(blocks: DataFrame) -> DataFrame:
    """As structured(), for blocks dealt by doc_id: each step is a frame over pages or documents, so nothing is shuffled. Blocks without a doc_id go, as in its joins."""
    page = "OVER (PARTITION BY doc_id, page_number)"
    median = lambda v, default: F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v} DESC) {page}"), F.lit(default))
    b = blocks.where("doc_id IS NOT NULL").withColumn("base_font", median("CASE WHEN font > 0 THEN font END", 10.0)).withColumn("base_height", median("y1 - y0", 12.0))
    b = with_sections(b.withColumn("is_heading", S.is_heading(F.col("text"), F.col("font"), F.col("base_font"), F.col("y1") - F.col("y0"), F.col("base_height"))))
    own = Window.partitionBy(*PAGE)
    b = b.withColumn("_h", S.is_reference_heading(F.col("text"))).withColumn("_e", S.is_reference_entry(F.col("text")))
    b = b.withColumn("is_reference_page", (F.count_if("_h").over(own) > 0) | (F.count_if("_e").over(own) >= 5)).drop("_h", "_e")
    return _planned(b.withColumn("is_reference", S.is_reference_block(F.col("text"), F.col("section_title"))))


def structured(blocks: DataFrame) -> DataFrame:
    """Blocks with all that the planning operators need, and is_candidate."""
    return _planned(with_references(with_sections(with_headings(blocks))))


def _planned(blocks: DataFrame) -> DataFrame:
    b = with_word_counts(blocks)
    return b.withColumn("is_candidate", S.is_candidate(F.col("text"), F.col("section_title"), F.col("is_heading"), F.col("word_count"), F.col("is_reference_page")))


def attach_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks with their words as an array in reading order, empty where there are none."""
    row = F.struct("word_pos", "text", "normalized", "block_id", "x0", "y0", "x1", "y1")
    own = words.groupBy("doc_id", "page_number", "block_pos").agg(F.array_sort(F.collect_list(row)).alias("words"))
    return blocks.join(own, ["doc_id", "page_number", "block_pos"], "left").withColumn("words", F.coalesce("words", F.array().cast(own.schema["words"].dataType)))


def words_in_box(blocks: DataFrame, words: DataFrame, slack: float = 2.0, share: float = 0.8) -> DataFrame:
    """(doc_id, page_number, block_pos, inside): whether the share of a block's own words whose centre lies in its box reaches `share`; true without words."""
    w = words.select("doc_id", "page_number", "block_pos", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    j = blocks.select("doc_id", "page_number", "block_pos", "x0", "y0", "x1", "y1").join(w, ["doc_id", "page_number", "block_pos"], "left")
    hit = F.col("cx").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("cy").between(F.col("y0") - slack, F.col("y1") + slack)
    return j.groupBy("doc_id", "page_number", "block_pos").agg((F.coalesce(F.avg(F.when(F.col("cx").isNotNull(), hit.cast("int"))), F.lit(1.0)) >= share).alias("inside"))


def words_by_place(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Words whose centre lies in a block's box on the same page: an equi-join on the page with the boxes as residual."""
    b, w = blocks.alias("b"), words.alias("w")
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    on = (F.col("b.doc_id") == F.col("w.doc_id")) & (F.col("b.page_number") == F.col("w.page_number")) & cx.between(F.col("b.x0"), F.col("b.x1")) & cy.between(F.col("b.y0"), F.col("b.y1"))
    return b.join(w, on).select("b.doc_id", "b.page_number", "b.block_pos", F.col("w.block_pos").alias("word_block"), "w.word_pos", "w.text")


def fragment_score(text: Column) -> Column:
    """(twice the single-letter tokens plus the two-letter ones, minus all letters): less is better."""
    t = F.filter(F.transform(F.split(clean(text), " "), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), lambda x: F.rlike(x, F.lit(r"^\p{L}+$")))
    one, two = F.size(F.filter(t, lambda x: F.length(x) == 1)), F.size(F.filter(t, lambda x: F.length(x) == 2))
    return F.struct((one * 2 + two).alias("broken"), (-F.aggregate(t, F.lit(0), lambda a, x: a + F.length(x))).alias("letters"))


def less_broken(span_text: Column, word_text: Column) -> Column:
    """The better of two readings of a block, both repaired; the first on ties."""
    a, b = repair_text_udf(span_text), repair_text_udf(word_text)
    return F.when(a == "", b).when(b == "", a).when(fragment_score(b) < fragment_score(a), b).otherwise(a)


def average_font(sizes: DataFrame, *keys: str) -> DataFrame:
    return sizes.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(10.0)).alias("avg_font"))


def budget(blocks: DataFrame, per_page: int = 3) -> DataFrame:
    """(doc_id, content_pages, budget, ideas): highlights a document may have, and how many ideas to ask for."""
    pages = blocks.select(*PAGE, "is_reference_page").distinct()
    n = F.count_if(~F.col("is_reference_page"))
    out = pages.groupBy("doc_id").agg(n.alias("content_pages"))
    b = F.greatest(F.lit(4), F.col("content_pages") * max(1, per_page - 1))
    return out.select("doc_id", "content_pages", b.alias("budget"), F.greatest(F.lit(4), F.least(b, F.lit(10))).alias("ideas"))


def useful_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, useful): two distinct section titles or more among body blocks."""
    body = ~F.col("is_heading") & ~F.col("is_reference")
    t = F.nullif(F.btrim("section_title"), F.lit(""))
    return blocks.groupBy("doc_id").agg((F.count_distinct(F.when(body, t)) >= 2).alias("useful"))
