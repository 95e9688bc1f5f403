"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only).

1. The index stores training postings (term number, document, position) of every term that
   occurs in a test item; terms that no item has cannot take part in a match. It is one
   written table, made in one pass without a shuffle. A mark after each text's last word keeps
   its word count in the same table.
2. Terms are counted over the whole index. Each test window (13 consecutive words of an
   item; a shorter item is one window) asks for its rarest terms: their lists, with positions
   less the term's offset in the window, are intersected on (window, document, start).
3. What remains is compared word by word with the document, so matches are exact phrases.
4. Proximity matches (``slop``) read the same lists: items whose rarest terms stand within that
   many words of their places. They are listed beside the exact matches and decide nothing.

Test terms and windows are broadcast only if they were counted to be few; otherwise they
join by shuffle. Lists are never collected: an intersection is an aggregation by (window,
document, start). Only a document's own matches are gathered in one row.

Defined cases: null or empty text has no words, no hits, and is clean; items without words
have no windows; rows that repeat an item_id are one item; a null item_id reads as an empty
string; rows that repeat a document id are documents of their own; a very long text is indexed
and compared whole, its word list in the row of its document; empty tables on either side
work; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, identified, read_table, small, with_ids

WINDOW = 13
RAREST = 2
SLOP = 5                  # words that a window's rarest terms may be off their places in a proximity match
#: fixed values: the word rule (ASCII letters and digits, and all characters beyond ASCII)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows_of(ws: Workspace, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
               window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, asked): distinct windows (pid, len, phrase) with their items (item, pid)."""
    w = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w"))
    w = w.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    at = w.withColumn("s", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)))
    phrases = at.select("item", "len", F.slice("w", F.col("s"), F.col("len")).alias("phrase"))
    phrases = ws.save(phrases.distinct(), "phrases")
    # numbers are by place and so are fixed by writing them
    distinct = ws.save(phrases.select("phrase", "len").distinct()
                       .withColumn("pid", F.monotonically_increasing_id()), "windows")
    asked = phrases.join(distinct.select("phrase", "pid"), "phrase").select("item", "pid").distinct()
    return distinct.select("pid", "len", "phrase"), ws.save(asked, "asked")


def build_index(ws: Workspace, rows: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, terms): postings (tid, uid, pos) with a mark (-1, uid, word count) per document; (term, tid)."""
    terms = windows.select(F.explode("phrase").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id())
    terms = ws.save(terms, "terms")
    # the empty string is no word: it marks the end of the text, and its place is the word count
    wanted = terms.unionByName(ws.spark.createDataFrame([("", -1)], "term string, tid long"))
    placed = rows.select("uid", F.posexplode(F.array_append(words_of(F.col("text")), F.lit(""))).alias("pos", "term"))
    return ws.save(placed.join(small(wanted), "term").select("tid", "uid", "pos"), "postings"), terms


def rarest_terms(ws: Workspace, index: DataFrame, terms: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """(pid, tid, off, rank, asks): each window's rarest terms by their count over all documents."""
    counts = index.filter("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    places = windows.select("pid", F.posexplode("phrase").alias("off", "term")).join(terms, "term")
    # a window with a term that no document has cannot occur
    places = places.join(counts, "tid", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by = Window.partitionBy("pid").orderBy("df", "off")
    few = (places.withColumn("rank", F.row_number().over(by)).withColumn("_min", F.min("df").over(Window.partitionBy("pid")))
           .filter((F.col("rank") <= most) & (F.col("_min") > 0)))
    return ws.save(few.withColumn("asks", F.count(F.lit(1)).over(Window.partitionBy("pid")))
                   .select("pid", "tid", "off", "rank", "asks"), "rarest")


def rarest_lists(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """(pid, uid, at, rank, asks): the lists of the windows' rarest terms, positions less the term's offset."""
    return (index.join(small(rarest), "tid")
            .select("pid", "uid", (F.col("pos") - F.col("off")).alias("at"), "rank", "asks"))


def candidates(lists: DataFrame) -> DataFrame:
    """(pid, uid, start): places where all of a window's rarest terms stand at their offsets."""
    return (lists.filter("at >= 0").groupBy("pid", "uid", F.col("at").alias("start"))
            .agg(F.count(F.lit(1)).alias("n"), F.first("asks").alias("asks"))
            .filter("n = asks").select("pid", "uid", "start"))


def proximity_matches(lists: DataFrame, slop: int = SLOP) -> DataFrame:
    """(pid, uid, near): documents where all of a window's rarest terms stand near their places.

    Near means that the places where they would have the window start lie within ``slop`` words of each
    other; ``near`` is the last place of the first such stretch. A frame holds at most ``slop`` + 1
    places of each term, and each document's lists are a group of their own.
    """
    frame = Window.partitionBy("pid", "uid").orderBy(F.col("at").cast("long")).rangeBetween(-slop, Window.currentRow)
    return (lists.withColumn("_n", F.size(F.collect_set("rank").over(frame))).filter("_n = asks")
            .groupBy("pid", "uid").agg(F.min("at").alias("near")))


def phrase_matches(rows: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """(uid, matches): a document's exact matches (pid, start, len), which may be none."""
    asked = (found.join(small(windows), "pid").groupBy("uid")
             .agg(F.collect_list(F.struct("pid", "start", "len", "phrase")).alias("asked")))
    # texts, not their word lists, go through the join; as the variable of a function the list is made
    # once a row (a column of its own would be put in its place and made anew for every match)
    texts = rows.select("uid", "text").join(asked, "uid")
    exact = F.transform(F.array(words_of(F.col("text"))), lambda w: F.filter(
        "asked", lambda a: F.slice(w, a["start"] + 1, a["len"]) == a["phrase"]))[0]
    return texts.select("uid", F.transform(exact, lambda a: F.struct(a["pid"], a["start"], a["len"])).alias("matches"))


def items_of(found: DataFrame, asked: DataFrame, out: str) -> DataFrame:
    """(uid, out): the sorted items of the windows (uid, pid) that were found in a document."""
    return (found.select("uid", "pid").join(small(asked), "pid").groupBy("uid")
            .agg(F.array_sort(F.collect_set("item")).alias(out)))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, percent: int = 5, slop: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(result, rows, rekeyed): every document's uid, n_words, n_hit, items and verdict.

    A document is contaminated when it has hits and they are ``percent`` of its words or more. With
    ``slop`` the result also has ``near``: the items with proximity matches, exact ones among them.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    rows, rekeyed = identified(ws, docs, id_col, {"text": F.col(text_col)})
    windows, asked = windows_of(ws, items, window=window)
    index, terms = build_index(ws, rows, windows)
    rarest = rarest_terms(ws, index, terms, windows, RAREST)
    lists = rarest_lists(index, rarest)
    if slop is not None:
        lists = ws.save(lists, "lists")
    # the filter reads the written rows; before the write it would compare every match twice
    matches = ws.save(phrase_matches(rows, candidates(lists), windows), "matches").filter(F.size("matches") > 0)
    covered = F.array_distinct(F.flatten(F.transform(
        "matches", lambda m: F.sequence(m["start"], m["start"] + m["len"] - 1))))
    hits = matches.select("uid", F.size(covered).cast("long").alias("n_hit"))
    which = items_of(matches.select("uid", F.explode("matches.pid").alias("pid")).distinct(), asked, "items")
    counts = index.filter("tid = -1").select("uid", F.col("pos").cast("long").alias("n_words"))
    out = counts.join(hits.join(which, "uid"), "uid", "left")
    lacking = ["items"]
    if slop is not None:
        out = out.join(items_of(proximity_matches(lists, slop), asked, "near"), "uid", "left")
        lacking.append("near")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = out.select("uid", "n_words", n_hit.alias("n_hit"),
                     *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lacking])
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)), rows, rekeyed


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    out, rows, rekeyed = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), slop=SLOP)
    out = with_ids(out, rows, rekeyed)
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
                      F.size("near").cast("long").alias("n_near"))
