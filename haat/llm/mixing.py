"""Mixing sources to target weights by Pfair scheduling (DataFrame operations
only).

A source is a task whose subtasks are its blocks of ``block_docs`` documents.
Target weights become integer shares that add up to the period P, so source s
with share a has weight a / P; block i (from 0) is released at floor(i P / a)
and due at ceil((i + 1) P / a).  In each slot the released block with the
earliest deadline runs (ties: first source by name).  The shares fill the
period, so no slot is idle and no deadline is missed: after t slots a source
has had its a t / P blocks to within less than one.

The schedule repeats after P slots.  One period depends on the shares alone
(P x sources steps, never on the rows) and is folded in one SQL ``aggregate``;
every block finds its slot by joining on (source, block number mod share).

All blocks are scheduled.  When a source runs out its slots are skipped and
the others go on in their proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haat.llm.common import columns, cut, ranked

SCALE = 1 << 20     # weights as integers, so that shares are exact
OUTPUTS = ("mix_share", "mix_period", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position",
           "mix_place")


def source_key(source: Column) -> Column:
    """A name that is never null: "" for a null source, else "=" and its name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def shares(src: DataFrame, weights: dict | None, period: int, block_docs: int) -> DataFrame:
    """One row per source of ``src`` (column src, a source_key): n_docs,
    n_blocks, share, period.  Shares are at least 1 and add up to the period;
    what whole shares leave over goes by largest remainder."""
    n = src.groupBy("src").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        w = F.sqrt(F.col("n_docs").cast("double"))
    else:
        w = F.lit(float(min(weights.values())))
        for k, v in weights.items():
            w = F.when(F.col("src") == ("" if k is None else f"={k}"), F.lit(float(v))).otherwise(w)
    everything = Window.partitionBy(F.lit(1))
    n = n.withColumn("w", F.greatest(F.floor(w * SCALE).cast("long"), F.lit(1))) \
        .withColumn("s", F.count(F.lit(1)).over(everything)) \
        .withColumn("total", F.sum("w").over(everything)) \
        .withColumn("period", F.greatest(F.lit(period).cast("long"), F.col("s") * 8))
    spread, total = "cast((period - s) * w as decimal(38,0))", "cast(total as decimal(38,0))"
    n = n.withColumn("rest", F.expr(f"{spread} % {total}")) \
        .withColumn("base", F.expr(f"1 + ({spread} div {total})"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("rest").desc(), F.col("src"))
    left = F.col("period") - F.sum("base").over(everything)
    return n.withColumn("share", F.col("base") + (F.row_number().over(order) <= left).cast("long")) \
        .withColumn("n_blocks", F.expr(f"(n_docs + {block_docs - 1}) div {block_docs}")) \
        .select("src", "n_docs", "n_blocks", "share", "period")


# One period as a fold over its slots.  st.had[j] is how many blocks source j
# has had; a one-element transform binds the chosen source once.
PERIOD = """
  aggregate(sequence(0L, period - 1),
    named_struct('had', transform(a, x -> 0L),
                 'runs', cast(array() as array<struct<j: int, had: array<bigint>>>)),
    (st, t) -> element_at(transform(
        array(array_min(transform(a, (x, j) ->
          if(st.had[j] < x and (st.had[j] * period) div x <= t,
             named_struct('due', ((st.had[j] + 1) * period + x - 1) div x, 'j', j), null))).j),
        j -> named_struct(
          'had', transform(st.had, (c, i) -> if(i = j, c + 1, c)),
          'runs', concat(st.runs, array(named_struct('j', j, 'had',
                    transform(st.had, (c, i) -> if(i = j, c + 1, c))))))), 1),
    st -> st.runs)"""


def one_period(sources: DataFrame) -> DataFrame:
    """EDF over one period: rows (p_src, k, slot, had, a, n): block k of the
    period of p_src runs in ``slot``; ``had`` counts each source's blocks up to
    and with it; a and n are all shares and block counts."""
    listed = sources.groupBy("period").agg(
        F.sort_array(F.collect_list(F.struct("src", "share", "n_blocks"))).alias("s"))
    runs = listed.select("period", F.col("s.src").alias("names"), F.col("s.share").alias("a"),
                         F.col("s.n_blocks").alias("n")) \
        .select("names", "a", "n", F.posexplode(F.expr(PERIOD)).alias("slot", "run"))
    return runs.select(F.expr("names[run.j]").alias("p_src"), F.expr("run.had[run.j] - 1").alias("k"),
                       F.col("slot").cast("long").alias("slot"), F.col("run.had").alias("had"), "a", "n")


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict | None = None,
        period: int = 1000, block_docs: int = 16) -> DataFrame:
    """The rows of ``docs`` with mix_share, mix_period, mix_block,
    mix_release, mix_deadline, mix_slot, mix_position and mix_place.

    ``weights`` maps a source to its target weight (sources not named get the
    smallest one); without it a source weighs the square root of its number of
    documents.  ``mix_slot`` is the slot of the endless schedule,
    ``mix_position`` the block's place in the output, where the slots of
    sources that have run out are skipped (gapless from 0), ``mix_place`` the
    document's place in its block.  Order by (mix_position, mix_place).

    A source's documents are taken in id order, nulls first.  A null source is
    a source like any other.  Rows that repeat an id take places one after the
    other.  Input columns named like an output are replaced.  An empty table
    gives an empty result.  Sources are assumed to be few beside the rows: one
    period holds at least 8 slots per source.
    """
    key, ident = source_key(F.col(source_col)), F.col(id_col).cast("long")
    slim = docs.select(key.alias("src"), ident.alias("id"))
    rows = docs.select(F.struct(*columns(docs, *OUTPUTS)).alias("row"), key.alias("src"), ident.alias("id"))
    sources = cut(shares(slim, weights, period, block_docs))
    sched = cut(one_period(sources))
    at = ranked(rows, "src", "id", "rank", slim=slim) \
        .withColumn("block", F.expr(f"rank div {block_docs}")) \
        .join(sources.select("src", "share", "period"), "src") \
        .withColumn("turn", F.expr("block div share")).withColumn("k", F.expr("block % share"))
    at = at.join(sched.withColumnRenamed("p_src", "src"), ["src", "k"])
    return at.select(
        "row.*", F.col("share").alias("mix_share"), F.col("period").alias("mix_period"),
        F.col("block").alias("mix_block"),
        F.expr("(block * period) div share").alias("mix_release"),
        F.expr("((block + 1) * period + share - 1) div share").alias("mix_deadline"),
        F.expr("turn * period + slot").alias("mix_slot"),
        F.expr("aggregate(zip_with(zip_with(a, had, (x, c) -> x * turn + c), n, (x, m) -> least(x, m)), "
               "0L, (s, x) -> s + x) - 1").alias("mix_position"),
        F.expr(f"rank % {block_docs}").alias("mix_place"))
