"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

1. Test items are cut into windows of consecutive words; corpus counts of the test
   vocabulary rank each window's words from the rarest.
2. The index stores training postings (term, row, position) of the rarest words of the
   windows. Terms that cannot decide a window are never stored.
3. A posting of a window's rarest word, less that word's place in its item, gives a
   diagonal: a row, an item and the position at which the item would start. The posting
   list of the next-rarest word, offset likewise, is intersected with it.
4. The diagonals that are left, one row per row, item and start, meet the whole text again.
   Words are compared one by one, so the result is exact.

Counts are pre-aggregated by the tasks that read the corpus. The vocabulary and the anchors
are broadcast only below a checked number of rows, and joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolattice.llm.common import ascii_lower, materialize

#: What parts words once A-Z are lower-cased: all of ASCII but digits and a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the test side up to which it is broadcast (some tens of MB).
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    """Array of the words of a text with A-Z lower-cased; NULL has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def index_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words): one row per item with words; ``item`` numbers the rows."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    return materialize(rows.filter("size(words) > 0"), "items")


def window_anchors(items: DataFrame, counts: DataFrame, length: int, depth: int) -> DataFrame:
    """(item, start, rank, place, term): the ``depth`` rarest words of each window, rank 1 the rarest.

    Windows with a word that the corpus lacks are left out: they occur nowhere.
    """
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))).alias("start")
    opened = items.select("item", "words", starts)
    words = opened.select("item", "start", F.posexplode(F.expr(f"slice(words, start + 1, {length})")).alias("at", "term"))
    counted = words.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    window = Window.partitionBy("item", "start")
    ranked = counted.withColumn("rank", F.row_number().over(window.orderBy("n", "term", "at"))).withColumn("least", F.min("n").over(window))
    return ranked.filter((F.col("rank") <= depth) & (F.col("least") > 0)).select("item", "start", "rank", (F.col("start") + F.col("at")).alias("place"), "term")


def _row_key(id_col: str, text_col: str) -> Column:
    """Key of a row. Rows that share it by chance only cost a comparison of words."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def corpus_counts(docs: DataFrame, items: DataFrame, text_col: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(term, n): how often each word of the items occurs in the corpus."""
    vocabulary = materialize(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    tokens = docs.select(F.explode(words_of(F.col(f"`{text_col}`"))).alias("term"))
    return materialize(tokens.join(_small(vocabulary, vocabulary.count(), limit), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(term, row, pos): stored postings of the rows of ``docs`` for the given distinct terms."""
    tokens = docs.select(_row_key(id_col, text_col).alias("row"), F.posexplode(words_of(F.col(f"`{text_col}`"))).alias("pos", "term"))
    return materialize(tokens.join(_small(terms, terms.count(), limit), "term", "left_semi").select("term", "row", "pos").distinct(), "postings")


def _diagonals(postings: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """(row, item, diagonal) at which some window's two rarest words (or its only word) stand in place."""
    first = anchors.filter("rank = 1").select("item", "start", F.col("place").alias("place1"), F.col("term").alias("term1"))
    second = anchors.filter("rank = 2").select("item", "start", F.col("place").alias("place2"), F.col("term").alias("term2"))
    pairs = materialize(first.join(second, ["item", "start"], "left").select("item", "place1", "term1", "place2", "term2").distinct(), "anchor-pairs")
    pairs = _small(pairs, pairs.count(), limit)
    rarest = postings.join(pairs, F.col("term") == F.col("term1"))
    found = rarest.select("row", "item", (F.col("pos") - F.col("place1")).alias("diagonal"), "place2", "term2")
    alone = found.filter("term2 IS NULL").select("row", "item", "diagonal")
    sought = found.filter("term2 IS NOT NULL").select("row", "item", "diagonal", F.col("term2").alias("term"), (F.col("diagonal") + F.col("place2")).alias("pos")).distinct()
    return sought.join(postings, ["row", "term", "pos"], "left_semi").select("row", "item", "diagonal").union(alone).distinct()


def _runs(words: Column, candidate: Column, length: int) -> Column:
    """(from, to) spans of document positions where windows of the candidate's item stand on its diagonal."""
    item = candidate["words"]
    need = F.least(F.size(item), F.lit(length))
    empty = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(acc: Column, j: Column) -> Column:
        at = candidate["diagonal"] + j
        run = F.when((at >= 0) & (F.get(words, at) == F.get(item, j)), acc["run"] + 1).otherwise(0)
        span = F.struct((at - need + 1).alias("from"), (at + 1).alias("to"))
        return F.struct(run.alias("run"), F.when(run >= need, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), empty, step, lambda acc: acc["spans"])


def _covered(spans: Column) -> Column:
    """Number of positions inside the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["to"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(acc["end"], s["from"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, broadcast_rows: int = BROADCAST_ROWS, carry: bool = False
) -> DataFrame:
    """Finds windows of ``length`` consecutive item words in whole documents.

    An item of fewer words, but not none, is one window. Returns one row per input row:
    ``id_col``, n_words, n_hit (words inside any occurrence), n_items, items (array of the
    ids, as strings, of items with occurring windows, sorted), contaminated. With ``carry``
    only rows without a hit are returned, with all input columns instead.

    NULL and empty texts have no words. Rows that repeat an id are judged by their own text.
    Items with a NULL id mark words but are not listed. Without items nothing is hit. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    test = index_items(items, item_col, item_text_col)
    counts = corpus_counts(docs, test, text_col, broadcast_rows)
    anchors = materialize(window_anchors(test, counts, length, 2), "anchors")
    terms = materialize(anchors.select("term").distinct(), "anchor-terms")
    postings = positional_index(docs, terms, id_col, text_col, broadcast_rows)
    hits = _diagonals(postings, anchors, broadcast_rows)
    listed = _small(test, test.count(), broadcast_rows // 100)
    found = hits.join(listed, "item").groupBy("row").agg(F.collect_list(F.struct("diagonal", "item_id", "words")).alias("found"))
    found = materialize(found, "diagonals").withColumnRenamed("row", "_row").withColumnRenamed("found", "_found")
    kept = docs.columns if carry else [id_col]
    columns = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)]
    text = F.col(f"`{text_col}`").alias("_text")
    joined = docs.select(*columns, text, _row_key(id_col, text_col).alias("_row")).join(found, "_row", "left")
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)]
    none = F.array().cast("array<string>")

    def exact(words: Column) -> Column:
        spans = F.transform("_found", lambda c: F.struct(c["item_id"].cast("string").alias("id"), _runs(words, c, length).alias("spans")))
        return F.filter(spans, lambda c: F.size(c["spans"]) > 0)

    def judge(words: Column) -> Column:
        found = lambda e: F.struct(_covered(F.flatten(F.transform(e, lambda c: c["spans"]))).cast("long").alias("hit"), F.array_sort(F.array_distinct(F.filter(F.transform(e, lambda c: c["id"]), lambda x: x.isNotNull()))).alias("items"))
        clean = F.struct(F.lit(0).cast("long").alias("hit"), none.alias("items"))
        return F.struct(F.size(words).cast("long").alias("n"), F.when(F.col("_found").isNull(), clean).otherwise(_let(exact(words), found)).alias("e"))

    judged = joined.withColumn("_r", _let(words_of(F.col("_text")), judge))
    if carry:
        return judged.filter("_found IS NULL OR _r.e.hit = 0").select(*back)
    judged = judged.select(*[f"_c{i}" for i in range(len(kept))], "_r")
    return judged.select(*back, F.col("_r.n").alias("n_words"), F.col("_r.e.hit").alias("n_hit"), F.size("_r.e.items").cast("long").alias("n_items"), F.col("_r.e.items").alias("items"), (F.col("_r.e.hit") > 0).alias("contaminated"))


def proximity_matches(
    docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, least: float = 1.0, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(``id_col``, item_id, window): windows of which a share of ``least`` words stand at most ``slop`` words from their places.

    The window's rarest word that a document has there fixes where the window would start.
    With a share of ``least`` at most so many words are missing; so that word is among as many
    and one more of the window's rarest, whose postings are looked up, and every word of the
    window is held against the document's words around its place. Words that the corpus lacks
    count as missing. NULL and empty texts and items have no windows; rows that repeat an id
    are judged by their own text; an empty table gives no rows.
    """
    test = index_items(items, item_col, item_text_col)
    counts = corpus_counts(docs, test, text_col, broadcast_rows)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))).alias("start")
    opened = test.select("item", "words", starts).select("item", "start", F.expr(f"slice(words, start + 1, {length})").alias("window"))
    need = F.ceil(F.size("window") * least - 1e-9).cast("int")
    opened = materialize(opened.withColumn("need", F.greatest(need, F.lit(1))), "windows")
    places = opened.select("item", "start", (F.size("window") - F.col("need") + 1).alias("depth"), F.posexplode("window").alias("at", "term"))
    order = Window.partitionBy("item", "start").orderBy("n", "term", "at")
    # of the words that the corpus lacks each takes one of the places that may be missing
    known = places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(order))
    anchors = materialize(known.filter("rank <= depth AND n > 0").select("item", "start", "at", "term"), "near-anchors")
    terms = materialize(anchors.select("term").distinct(), "anchor-terms")
    postings = positional_index(docs, terms, id_col, text_col, broadcast_rows)
    small = _small(anchors, anchors.count(), broadcast_rows)
    placed = postings.join(small, "term").select("row", "item", "start", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    found = placed.join(_small(opened, opened.count(), broadcast_rows // 100), ["item", "start"]).join(_small(test.select("item", "item_id"), test.count(), broadcast_rows), "item")
    rows = docs.select(_row_key(id_col, text_col).alias("row"), F.col(f"`{id_col}`").alias("_id"), words_of(F.col(f"`{text_col}`")).alias("_words"))
    stands = lambda w, at: F.size(F.filter(F.slice("_words", F.greatest(at - slop, F.lit(0)) + 1, F.greatest(at + slop + 1 - F.greatest(at - slop, F.lit(0)), F.lit(0))), lambda x: x == w)) > 0
    hits = F.size(F.filter(F.transform("window", lambda w, j: stands(w, F.col("diagonal") + j)), lambda x: x))
    near = rows.join(found, "row").filter(hits >= F.col("need"))
    return near.select(F.col("_id").alias(id_col), "item_id", F.col("start").alias("window")).distinct()
