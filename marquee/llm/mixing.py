"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

1. Targets: sources in code-point order (null last) weigh ``weights`` in turn; they share
   ``share`` times all words. A target stops at ``cap`` times its source's size and the
   excess is reshared by weight until none is above (water filling: with sources sorted
   by cap/weight, the level follows from running sums).
2. Blocks: each source's documents, shuffled by a seeded hash, form a stream of words
   that is cut into blocks of equal word count.
3. Schedule: slot i of the mix lies at the van der Corput point of i (its bits
   reversed); cumulative target shares map the point to a source, and the slot's rank
   among its source's slots names the block it plays (after the last block the stream
   starts again). So every stretch of the mix holds the sources near their shares. The
   schedule runs slightly long; a source stops when its target is reached, its last
   block cut to fit.
4. Slots join blocks; the words that the slots take of each document are summed.

Running sums use counted buckets (``common.ranked``), so a hot source is spread over
many tasks; tables by source hold one row per source and are not collected. Slots are
one row per block, generated by ``spark.range``.

Defined cases: a null or empty text has no words and takes 0; a null source is a source;
rows that repeat an id are rows of their own, shuffled by the hash of their text; rows
that repeat wholly are interchangeable; an empty table, or one without words, gives
targets of 0; a very long text is a document of many words, whose blocks are played in part or
whole like others. Extra columns do not matter: only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, ranked, read_table, seeded_hex, small

SEED = "marquee-mix-1"
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 20_000


def word_count(text: Column) -> Column:
    """Number of words; the white space of the word rule is what ``\\s`` is in a JVM pattern."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source (src, source_size) -> with weight and target by capped sharing.

    The windows run over one row per source.
    """
    turn = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    # sources reach their caps in order of cap/weight; level = what is left / weights left
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("src").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (t.withColumn("_total", F.sum("source_size").over(every) * F.lit(share))
         .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(rest))
         .withColumn("_full", F.col("_level") * F.col("weight") >= F.col("_cap")))
    open_level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)
    return t.select("src", "source_size", "weight",
                    F.when(F.col("_full"), F.col("_cap")).otherwise(open_level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0,
        block: int = 1024, seed: str = SEED, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, schedule).

    rows: every document with ``size``, ``source_size``, ``target`` and ``taken`` beside the
    columns in ``keep`` (default: the id). schedule: (slot, src, block, words), the order
    in which the mix plays blocks.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    keep = [id_col] if keep is None else keep
    size = word_count(F.col(text_col)) if size is None else size
    light = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(source_col).alias("src"),
                        size.cast("long").alias("size"), seeded_hex(seed, F.col(id_col)).alias("_h"),
                        F.col(id_col).cast("string").alias("_id"), F.xxhash64(F.col(text_col)).alias("_x"))
    light = ws.save(light, "sizes")
    buckets = max(2 * partitions(spark), -(-light.count() // ROWS_PER_BUCKET))
    by_hash = F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32))
    placed = ranked(light, ["src"], by_hash, [F.col("_h"), F.col("_id"), F.col("_x")], "off", F.col("size"))
    placed = ws.save(placed.select("_row", "src", "size", "off", F.monotonically_increasing_id().alias("rk")), "placed")
    ws.drop(light)
    plan = targets(placed.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, cap)
    goal = F.round("target").cast("long")
    plan = ws.save(plan.select("src", "source_size", "weight", "target", goal.alias("goal"),
                               F.expr(f"(source_size + {block - 1}L) div {block}L").alias("blocks")), "targets")

    # schedule: enough slots that the discrepancy leaves no source short of its goal
    total = plan.agg(F.sum("goal"), F.count(F.lit(1))).first()
    goal_sum, sources = total[0] or 0, total[1] or 0
    bits = max(1, goal_sum // block).bit_length() + 1
    shares = Window.orderBy(F.col("src").asc_nulls_last())
    # a van der Corput prefix of n points misses an interval's share by at most 1 + log2(n) / 2 points per end;
    # so each source's goal is widened by that many slots before shares are taken
    slack = (bits + 2) * block
    arcs = (plan.withColumn("_wide", F.when(F.col("goal") > 0, F.col("goal") + F.lit(slack)).otherwise(F.lit(0)))
            .withColumn("_hi", F.sum("_wide").over(shares.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    wide_sum = goal_sum + sources * slack
    slots_n = -(-wide_sum // block) if goal_sum else 0
    bits = max(1, slots_n).bit_length()
    arcs = arcs.withColumn("_lo", F.col("_hi") - F.col("_wide")).filter(F.col("_wide") > 0)
    all_wide = arcs.agg(F.sum("_wide")).first()[0] or 1
    # map the unit interval to sources through a table of cells, so that a point finds its arc by an equality join
    cells = 4096
    point = F.conv(F.reverse(F.lpad(F.bin(F.col("id")), bits, "0")), 2, 10).cast("double") / F.lit(float(1 << bits))
    slots = spark.range(slots_n).select(F.col("id").alias("slot"), (point * F.lit(float(all_wide))).alias("_u"))
    slots = slots.withColumn("_cell", F.floor(F.col("_u") * F.lit(cells / all_wide)))
    cut = arcs.select("src", "_lo", "_hi", "goal", "source_size", "blocks", F.explode(F.sequence(
        F.floor(F.col("_lo") * F.lit(cells / all_wide)), F.floor(F.col("_hi") * F.lit(cells / all_wide)))).alias("_cell"))
    slots = slots.join(small(cut), "_cell").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    slots = ranked(slots, ["src"], F.floor(F.col("slot") * F.lit(buckets) / F.lit(max(1, slots_n))), [F.col("slot")], "_r")
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * F.lit(block))
    played = (slots.withColumn("epoch", F.expr("_r div blocks"))
              .withColumn("block", F.expr("_r % blocks"))
              .withColumn("_at", F.col("epoch") * F.col("source_size") + F.col("block") * F.lit(block))
              .withColumn("words", F.least(length, F.col("goal") - F.col("_at")))
              .filter(F.col("words") > 0)
              .select("slot", "src", "epoch", "block", "words"))
    schedule = ws.save(played, "schedule")

    # pieces of documents by block; all the words that slots take of a piece
    pieces = (placed.filter("size > 0")
              .withColumn("block", F.explode(F.expr(f"sequence(off div {block}L, (off + size - 1) div {block}L)")))
              .select("rk", "src", "block",
                      F.greatest(F.col("off") - F.col("block") * F.lit(block), F.lit(0)).alias("_from"),
                      F.least(F.col("off") + F.col("size") - F.col("block") * F.lit(block), F.lit(block)).alias("_to")))
    plays = schedule.groupBy("src", "block").agg(F.collect_list("words").alias("_plays"))
    p = plays.select(F.col("src").alias("_ps"), F.col("block").alias("_pb"), "_plays")
    # a block is played at most cap times, rounded up
    got = F.expr("aggregate(_plays, 0L, (a, w) -> a + greatest(0L, least(_to, w) - _from))")
    taken = (pieces.join(p, F.col("src").eqNullSafe(F.col("_ps")) & (F.col("block") == F.col("_pb")))
             .groupBy("rk").agg(F.sum(got).alias("_taken")))
    t = plan.select(F.col("src").alias("_ts"), "source_size", "target")
    rows = (placed.join(taken, "rk", "left").join(t, F.col("src").eqNullSafe(F.col("_ts")))
            .select("_row.*", "size", F.col("source_size").cast("long").alias("source_size"),
                    F.col("target").cast("double").alias("target"),
                    F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")))
    return rows, schedule


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: words taken of each."""
    rows, _ = mix(read_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")
