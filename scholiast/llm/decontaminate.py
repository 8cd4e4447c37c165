"""Benchmark decontamination: a prefix-filtered containment join, in DataFrame functions only.

Every benchmark window (13 consecutive words, or a whole shorter item) is a set of shingles of five
words, or of all its words if it has fewer, each with its offset. A document holds the window only
if it holds all of its shingles, so with the required overlap equal to the set's size the necessary
prefix is one shingle: the rarest in the corpus. One pass over the texts cuts words, counts them and
keeps the places of benchmark shingles; windows with a shingle that no document holds are out, and
of the others the prefix alone joins. Length and positional bounds drop candidates that would begin
before the document or end after it. What is left is a number of places in few documents: their
texts are read again, and the words of each place are compared with the windows by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: all ASCII but digits and small letters, once A-Z are lowered.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands behind the shingles of each document; told from a shingle by its place, not by its value.
MARK = 0x5851F42D4C957F2D
#: Above all sizes of shingles.
LAST = 1 << 20


def words(text: Column) -> Column:
    """Lowered words of a text; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() has a fast path for ASCII, but lowers other letters too.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BREAK), "")


def shingles(hashes: Column, size: int) -> Column:
    """Hash of every `size` consecutive word hashes; empty for fewer words."""
    firsts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
    if size == 1:
        return F.transform(firsts, lambda x: F.xxhash64(x, F.lit(1)))
    return F.transform(firsts, lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, size)), F.lit(size)))


def benchmark_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, body, len): distinct windows; (wid, item_id): the items that hold them. Null and wordless items have none."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("body"))
    each = each.select("item_id", "body", F.sha2(F.array_join("body", " "), 256).alias("wid"))
    return each.groupBy("wid").agg(F.first("body").alias("body")).withColumn("len", F.size("body")), each.select("wid", "item_id").distinct()


def places(d: DataFrame, wanted: DataFrame, sizes: list[int], small: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, n_words) of every row of d; (doc_id, rk, n_words, pos, sh): every place where a document holds a shingle in wanted (sh, k).

    If wanted is small, both come from one pass: each document has one more element behind its shingles, MARK, which the broadcast table holds too.
    Otherwise the shingles are joined by a shuffle, and a second pass counts the words.
    """
    hashed = d.select("doc_id", "rk", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    number = {k: F.greatest(F.col("n_words") - (k - 1), F.lit(0)) for k in sizes}
    before = {k: sum((number[j] for j in sizes if j < k), F.lit(0)) for k in (*sizes, LAST)}
    each = F.concat(*(shingles(F.col("h"), k) for k in sizes), F.array(F.lit(MARK)))
    spread = hashed.select("doc_id", "rk", F.size("h").cast("long").alias("n_words"), F.posexplode(each).alias("at", "sh"))
    pos = F.coalesce(*(F.when(F.col("k") == k, F.col("at") - before[k]) for k in sizes)).cast("int").alias("pos")
    mark = F.col("at") == before[LAST]
    if not small:
        hits = stored(spread.where(~mark).join(wanted, "sh").select("doc_id", "rk", "n_words", pos, "sh"), "bench-hits")
        return d.select("doc_id", "rk", F.size(words(F.col("text"))).cast("long").alias("n_words")), hits
    marked = wanted.unionByName(wanted.sparkSession.range(1).select(F.lit(MARK).alias("sh"), F.lit(0).alias("k"))).dropDuplicates(["sh"])
    met = stored(spread.join(F.broadcast(marked), "sh").select("doc_id", "rk", "n_words", pos, "sh", mark.alias("mark")), "bench-hits")
    return met.where("mark").select("doc_id", "rk", "n_words"), met.where("NOT mark")


def covered(found: Column) -> Column:
    """How many positions the spans (start, len) of an array cover."""
    zero = F.struct(F.lit(0).alias("done"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["done"], x["start"] + x["len"]).alias("done"), (acc["n"] + F.greatest(x["start"] + x["len"] - F.greatest(acc["done"], x["start"]), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(found), zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 13, shingle: int = 5, share: int = 20, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    Null and wordless texts have no words and no hits. Rows with the same id and text get the same result each; rows with the same
    id and different texts are judged by their own text. Items with a null id hit words but are not listed. Empty tables give no rows or no
    hits; other columns of docs and items are not read.
    The benchmark's shingles, and the keys of documents with candidates, are broadcast if there are at most broadcast_rows of them and joined by shuffle otherwise.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("rk", F.xxhash64("doc_id", "text"))
    windows, holders = benchmark_windows(items.select("item_id", F.col("text").cast("string").alias("text")), window)
    windows, holders = stored(windows, "bench-windows"), stored(holders, "bench-holders")
    size = F.least(F.col("len"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(size.alias("k")).distinct().collect()) or [shingle]  # at most `shingle` values
    own = F.transform("body", lambda x: F.xxhash64(x))
    pieces = F.coalesce(*(F.when(size == k, shingles(own, k)) for k in sizes))
    grams = windows.select("wid", "len", F.posexplode(pieces).alias("off", "sh"))
    wanted = stored(grams.select("sh", size.alias("k")).distinct(), "bench-grams")
    small = wanted.count() <= broadcast_rows
    counted, hits = places(d, wanted, sizes, small)

    # The rarest shingle of each window; a window with an absent shingle has none.
    rarity = hits.groupBy("sh").agg(F.count("*").alias("n"))
    ranked = grams.join(rarity, "sh", "left").groupBy("wid", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "sh")).alias("p"))
    prefix = ranked.where("p.n > 0").select("len", F.col("p.off").alias("off"), F.col("p.sh").alias("sh")).distinct()
    begin = F.col("pos") - F.col("off")
    inside = (begin >= 0) & (begin + F.col("len") <= F.col("n_words"))
    found = hits.join(F.broadcast(prefix) if small else prefix, "sh").where(inside).select("doc_id", "rk", begin.alias("start"), "len")

    # One row for a document with candidates, at most one of each place and length: its words are cut once.
    of = stored(found.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("start", "len")).alias("c")), "bench-candidates")
    keys = of.select(F.col("rk").alias("k")).distinct()
    few = keys.count() <= broadcast_rows
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.rk") == F.col(f"{b}.rk"))
    again = d.join(F.broadcast(keys) if few else keys, F.col("rk") == F.col("k"), "left_semi")
    cut = again.alias("d").join(of.alias("f"), same("d", "f")).select("f.doc_id", "f.rk", words(F.col("d.text")).alias("w"), "f.c")
    digest = F.transform("c", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), F.sha2(F.array_join(F.slice(F.col("w"), x["start"] + 1, x["len"]), " "), 256).alias("wid")))
    spans = cut.select("doc_id", "rk", F.explode(digest).alias("x")).select("doc_id", "rk", "x.start", "x.len", "x.wid")
    held = stored(spans.join(F.broadcast(windows.select("wid")) if small else windows.select("wid"), "wid").distinct(), "bench-held")
    hit = held.groupBy("doc_id", "rk").agg(covered(F.collect_set(F.struct("start", "len"))).cast("long").alias("n_hit"))
    listed = held.select("doc_id", "rk", "wid").distinct().join(holders, "wid").groupBy("doc_id", "rk").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = hit.alias("a").join(listed.alias("b"), same("a", "b"), "left").select("a.doc_id", "a.rk", "a.n_hit", "b.items")

    out = counted.alias("d").join(hit.alias("f"), same("d", "f"), "left").select("d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


#: DuckDB: every gram of every needed size of every document against the windows of the items.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[a:a + 12], ' ') AS body FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS a FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
g AS (SELECT doc_id, k, a, array_to_string(w[a:a + k - 1], ' ') AS body FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT g.doc_id, g.k, g.a, win.item_id FROM g JOIN win ON g.k = win.k AND g.body = win.body),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
