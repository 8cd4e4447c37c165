"""Margin notes: heights, order, positions, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import CRITICAL_ROLES
from ..functions.text import equation_body
from .select import top_per

TOP, BOTTOM, GUTTER = 24.0, 24.0, 12.0
# --- fixed values: red, green and blue of each label and role ----------------------------------
LABEL_COLOURS = {"contribution": (0.99, 0.93, 0.45), "method": (0.75, 0.9, 1.0), "result": (0.81, 0.95, 0.78), "setup": (0.92, 0.88, 1.0), "limitation": (1.0, 0.84, 0.84), "definition": (1.0, 0.9, 0.73)}
ROLE_COLOURS = {"objective": (0.74, 0.88, 1.0), "definition": (0.84, 0.93, 1.0), "transition": (0.78, 0.9, 1.0), "update": (0.78, 0.95, 0.9), "constraint": (1.0, 0.9, 0.78), "result": (0.83, 0.95, 0.83)}
# -----------------------------------------------------------------------------------------------


def colour(name: Column, table: dict, default: str) -> Column:
    """Three doubles for a name, those of `default` for any other."""
    m = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(m[name], F.array(*map(F.lit, table[default])))


def note_height(title: Column, body: Column, has_latex: Column, symbols: Column, width: float) -> Column:
    per_title, per_body = max(18, int(width / 7.5)), max(20, int(width / 5.7))
    lines_t = F.greatest(F.lit(1), F.ceil(F.length(title) / per_title))
    lines_b = F.greatest(F.lit(3), F.ceil(F.length(body) / per_body) + 1)
    return (F.lit(22.0) + lines_t * 14 + F.when(has_latex, 34).otherwise(0) + F.least(symbols, F.lit(2)) * 18 + lines_b * 12).cast("double")


def place(notes: DataFrame, keys: list[str], width: float, page_height: float, most: int) -> DataFrame:
    """Adds y0 and y1 to notes (keys, note_id, title, body, priority, anchor_y, has_latex, symbols); those that don't fit go.

    In order of anchor, priority and id, each note takes its wanted place or the first below the note before it. As a closed form over
    prefixes: with P the summed heights and gutters before a note, y = P + max over itself and earlier ones of (wanted - P). If the last one
    overflows, all move up; if the first then leaves the page, they are packed from the top.
    """
    room = page_height - BOTTOM
    n = top_per(notes, keys, ["anchor_y", "priority", "note_id"], most)
    w = Window.partitionBy(*keys).orderBy("anchor_y", "priority", "note_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    h = note_height(F.col("title"), F.col("body"), F.col("has_latex"), F.col("symbols"), width)
    n = n.withColumn("_h", h).withColumn("_p", F.sum(F.col("_h") + GUTTER).over(upto) - F.col("_h") - GUTTER)
    wanted = F.greatest(F.lit(TOP), F.least(F.col("anchor_y") - F.col("_h") / 2, F.lit(room) - F.col("_h")))
    n = n.withColumn("_y", F.col("_p") + F.max(wanted - F.col("_p")).over(upto))
    page = Window.partitionBy(*keys)
    over = F.greatest(F.lit(0.0), F.max(F.col("_y") + F.col("_h")).over(page) - room)
    n = n.withColumn("_over", over).withColumn("_first", F.min("_y").over(page) - F.col("_over"))
    packed = (F.col("_over") > 0) & (F.col("_first") < TOP)
    n = n.withColumn("_packed", packed).withColumn("y0", F.when(packed, F.col("_p") + TOP).otherwise(F.col("_y") - F.col("_over"))).withColumn("y1", F.col("y0") + F.col("_h"))
    return n.where(~F.col("_packed") | (F.col("y1") <= room)).drop("_h", "_p", "_y", "_over", "_first", "_packed")


def anchor_y(quads: Column) -> Column:
    """The middle of the right side of the first quad."""
    q = F.get(quads, F.lit(0))
    return (q["ur"]["y"] + q["lr"]["y"]) / 2


def highlight_notes(highlights: DataFrame, notes: DataFrame, most: int) -> DataFrame:
    """Notes to draw for highlights that have quads, in highlight order; of several notes for one highlight the last counts."""
    last = notes.groupBy("doc_id", "page_number", "highlight_id").agg(F.max_by(F.struct("note_id", "title", "body"), "note_pos").alias("n"))
    j = highlights.where(F.size("quads") > 0).join(last, ["doc_id", "page_number", "highlight_id"])
    j = top_per(j, ["doc_id", "page_number"], ["highlight_pos"], most)
    return j.select("doc_id", "page_number", "n.note_id", "n.title", "n.body", F.lit(1).alias("priority"), anchor_y(F.col("quads")).alias("anchor_y"), F.lit(False).alias("has_latex"), F.lit(0).alias("symbols"))


def equation_notes(equations: DataFrame, explained: DataFrame, most: int) -> DataFrame:
    """Notes to draw for explained equations; critical roles come first where anchors tie."""
    last = explained.groupBy("doc_id", "page_number", "equation_id").agg(F.max_by(F.struct("title", "body", "intuition", "display_latex", "symbol_map"), "pos").alias("e"))
    j = equations.where(F.size("quads") > 0).join(last, ["doc_id", "page_number", "equation_id"])
    j = top_per(j, ["doc_id", "page_number"], ["equation_pos"], most)
    pri = F.when(F.col("role").isin(*CRITICAL_ROLES), 0).otherwise(1)
    return j.select("doc_id", "page_number", F.col("equation_id").alias("note_id"), "e.title", equation_body(F.col("e.body"), F.col("e.intuition")).alias("body"), pri.alias("priority"), anchor_y(F.col("quads")).alias("anchor_y"), F.col("e.display_latex").isNotNull().alias("has_latex"), F.size("e.symbol_map").alias("symbols"))


def page_widths(pages: DataFrame, notes: DataFrame, margin: float) -> DataFrame:
    """(doc_id, page_number, width): pages with notes are wider by the margin."""
    has = notes.select("doc_id", "page_number").distinct().withColumn("_has", F.lit(True))
    return pages.join(has, ["doc_id", "page_number"], "left").select("doc_id", "page_number", F.when(F.col("_has"), F.col("page_width") + margin).otherwise(F.col("page_width")).alias("width"))


def connector(anchor_x: Column, anchor: Column, note_x: Column, y0: Column, y1: Column) -> Column:
    """A line from the anchor to the nearest height of its note."""
    return F.struct(anchor_x.alias("x0"), anchor.alias("y0"), note_x.alias("x1"), F.greatest(y0, F.least(anchor, y1)).alias("y1"))


def fitted(width: Column, height: Column, room: Column) -> Column:
    """An image's size in a box of that width, never enlarged."""
    s = F.least(F.lit(1.0), room / F.greatest(width, F.lit(1.0)))
    return F.struct((width * s).alias("width"), (height * s).alias("height"))
