"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by the md5 of their id and text) and put into the queue twice over, as no source gives
more than ``max_epochs`` times its size. A document's virtual finish time is its source's words up to its end, over all
epochs, divided by the source's target. The mix is the queue, range-sorted by virtual finish time and truncated where the
total budget (the sum of the targets) is spent: documents before the cut are taken whole, the one it falls into in part.

The cut is found without a global order: words are summed over ``SLOTS`` stretches of virtual time, then over as many
stretches of the one that the cut falls into; only the documents of that last stretch are ranked one by one.

Edge cases: a null or blank text has size 0 and gives nothing; a null source is a source of its own, the last one;
repeated ids are documents of their own that follow each other; no rows, or no words at all, give targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendspan.llm.common import drop, n_words, table, written

#: Weights of the sources in the order of their names, repeated as often as needed.
WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS = 1.5, 2
#: Stretches of the shuffled order in which words are summed before single documents are.
SLOTS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source with its target, from (source, source_size).

    The budget is shared by weight; what exceeds ``max_epochs`` times a source's size is shared anew among the others.
    So there is a level L such that each source gets the smaller of weight * L and its limit. The sources that stop
    at their limits are the first ones in the order of limit / weight, so running sums over that order give L.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick).withColumn("most", F.col("source_size").cast("double") * max_epochs)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    at = ranked.withColumn("level", level)
    # the first source that doesn't reach its limit at the level found so far sets the level of all that follow
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    return at.select("source", "source_size", "weight", F.when(free.isNull() | (F.col("weight") * free > F.col("most")), F.col("most")).otherwise(F.col("weight") * free).alias("target"))


def schedule(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, columns: tuple[str, ...] = ()) -> DataFrame:
    """The queue: (doc_id, size, source, source_size, target, start) with ``start`` the source's words before the document.

    ``columns``: further columns of ``docs`` to carry along.
    """
    carried = ["doc_id", "source", *[c for c in columns if c not in ("doc_id", "source")]]
    place = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(docs["text"]), F.lit(""))))
    rows = docs.select(*[docs[c] for c in carried], n_words(docs["text"]).alias("size"), place.alias("place"))
    rows = rows.withColumn("slot", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    in_slot = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    to_here = Window.partitionBy("source").orderBy("slot")
    starts = in_slot.select("source", "slot", (F.sum("slot_size").over(to_here) - F.col("slot_size")).alias("slot_start"))
    aimed = targets(in_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, max_epochs)
    known = starts.alias("s").join(aimed.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "slot", "slot_start", "source_size", "target")
    inner = Window.partitionBy("source", "slot").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("inside", F.sum("size").over(inner) - F.col("size"))
    return (
        summed.alias("r")
        .join(known.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.slot") == F.col("k.slot")))
        .select("r.doc_id", "r.size", *[f"r.{c}" for c in columns if c != "doc_id"], *([] if "source" in columns else ["r.source"]), "k.source_size", "k.target", (F.col("k.slot_start") + F.col("r.inside")).alias("start"))
    )


def finish(epoch: Column) -> Column:
    """The virtual finish time of a queued document in an epoch."""
    return (F.col("start") + F.col("size") + epoch * F.col("source_size")) / F.col("target")


def cut(queue: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, slots: int = SLOTS) -> DataFrame:
    """One row at most: (finish, last, source, words) of the document that the truncation falls into, and its words before it."""
    rows = queue.filter("size > 0").select("source", "size", "source_size", "target", "start", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])).alias("epoch"))
    rows = rows.select("source", F.col("source").isNull().alias("last"), "size", finish(F.col("epoch")).alias("finish"))
    sizes = queue.groupBy("source").agg(F.max("source_size").alias("n"))
    budget = F.floor(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(float(share))).cast("long")
    # a source's targets are at finish time 1: the cut is near it, and what lies far beyond shares the last stretch
    left = sizes.agg(budget.alias("budget"), F.lit(0.0).alias("from"), F.lit(2.0 / slots).alias("width"))
    here = rows
    for _ in range(2):
        slot = F.least(F.greatest(F.floor((F.col("finish") - F.col("from")) / F.col("width")), F.lit(0)), F.lit(slots - 1))
        here = here.join(F.broadcast(left), F.lit(True)).withColumn("slot", F.when(F.col("width") > 0, slot).otherwise(F.lit(0)))
        summed = here.groupBy("slot", "budget", "from", "width").agg(F.sum("size").alias("words"))
        to_here = F.sum("words").over(Window.orderBy("slot"))
        inside = summed.withColumn("to_here", to_here).filter("to_here > budget").orderBy("slot").limit(1)
        left = written(inside.select("slot", (F.col("budget") - F.col("to_here") + F.col("words")).alias("left"), (F.col("from") + F.col("slot") * F.col("width")).alias("next"), (F.col("width") / slots).alias("narrow")))
        here = here.join(F.broadcast(left), "slot").select("source", "last", "size", "finish")
        left = left.select(F.col("left").alias("budget"), F.col("next").alias("from"), F.col("narrow").alias("width"))
    ranked = here.join(F.broadcast(left), F.lit(True)).withColumn("to_here", F.sum("size").over(Window.orderBy("finish", "last", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ranked.filter("to_here > budget").orderBy("finish", "last", "source").limit(1).select("finish", "last", "source", (F.col("budget") - F.col("to_here") + F.col("size")).alias("words"))


def truncated(queue: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, at: DataFrame | None = None) -> DataFrame:
    """The queue with ``served``: for each epoch, a document's words before the cut (``at``, if it is known)."""
    at = written(at if at is not None else cut(queue, share, max_epochs)).select(F.struct(F.col("finish"), F.col("last"), F.coalesce("source", F.lit("")).alias("source")).alias("_cut"), F.col("words").alias("_words"))

    def words(epoch: int) -> Column:
        own = F.struct(finish(F.lit(epoch)).alias("finish"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"))
        return F.when(F.col("size") == 0, F.lit(0)).when(F.col("_cut").isNull() | (own < F.col("_cut")), F.col("size")).when(own == F.col("_cut"), F.col("_words")).otherwise(F.lit(0)).cast("long")

    return queue.join(F.broadcast(at), F.lit(True), "left").withColumn("served", F.array(*[words(e) for e in range(max_epochs)])).drop("_cut", "_words")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, columns: tuple[str, ...] = ("text", "lang", "source", "n_chars")) -> DataFrame:
    """The mix itself in order: a row for each document and epoch with (epoch, finish, words), range-sorted by ``finish``."""
    light = written(schedule(docs, weights, share, max_epochs))
    rows = truncated(schedule(docs, weights, share, max_epochs, columns), share, max_epochs, at=cut(light, share, max_epochs))
    drop(light)
    rows = rows.select("*", F.posexplode("served").alias("epoch", "words")).filter("words > 0").withColumn("finish", finish(F.col("epoch")))
    return rows.drop("start", "size", "source_size", "target", "served").orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "epoch")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    queue = truncated(written(schedule(table(spark, sf_dir, "documents"))))
    return queue.select("doc_id", "size", "source_size", "target", F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
             [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER ()
                 - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w),
f AS (SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM f) IS NULL OR weight * (SELECT level FROM f) > most THEN most
                                       ELSE weight * (SELECT level FROM f) END AS target FROM l),
q AS (SELECT d.doc_id, d.source, size, place, source_size, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (done + epoch * source_size) / target AS finish FROM q, (SELECT unnest([0, 1]) AS epoch)),
b AS (SELECT CAST(floor(sum(source_size) * 1.5::DOUBLE) AS BIGINT) AS budget FROM s),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, size = 0, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS to_here FROM e WHERE size > 0),
n AS (SELECT doc_id, source, size, place, done, greatest(0, least(size, budget - to_here + size)) AS words FROM r, b),
k AS (SELECT source, done, sum(words) AS taken FROM n GROUP BY source, done)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE coalesce(taken, 0) END AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source AND q.done = k.done AND q.size > 0
"""
