"""Mixing sources to target weights: a low-discrepancy source schedule over equal-token blocks.

Slot i of the schedule has the golden-ratio point frac((i + 1) * phi); cumulative target weights map the point to a
source, so every stretch of the schedule, however short, holds the sources near their weights. Slots are ranked within their
source, and slot rank r takes block r of the source: its documents in a shuffled order, laid end to end and split into blocks
of ``BLOCK_TOKENS`` tokens, pass after pass. The last slot of a source is cut so that it takes its target exactly. A
source whose points run out early (by the discrepancy, a few slots) gets its last slots at the end of the schedule.

All ranks and positions are two-level prefix sums (bucket totals first, then rows within a bucket), so a source that holds
a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import WorkTables, running

BLOCK_TOKENS = 4096
MAX_PASSES = 3
WEIGHTS = (1, 2, 3)
# Fractional part of the golden ratio, as a 53-bit fraction.
GOLDEN = 0.6180339887498949
# Rows per bucket of the prefix sums.
BUCKET_ROWS = 4096
SIZE = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, tables: WorkTables, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources by code point, null last, weigh in turn.

    The targets share the sum of all sizes by weight. A source that would exceed ``max_passes`` times its size stops
    there, and what it leaves is shared again by weight among the others until none is above. Only sums go to the
    driver. Sources are numbered by range-partitioned parts, so their number is not bound to one task.
    """
    spread = sizes.repartitionByRange(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"))
    ordered = tables.write("ordered", spread)
    before = ordered.groupBy("part").count()
    earlier = before.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("skip")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = tables.write("weighed", ordered.join(earlier, "part").select("source", "source_size", weight.cast("long").alias("weight")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    cap = max_passes * F.col("source_size")
    level, full = None, F.lit(False)
    while True:
        free = weighed.agg(F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(full.cast("long")).alias("n")).first()
        if not free.w:
            return weighed.select("source", "source_size", cap.cast("double").alias("target"))
        if level is not None and free.n == done:
            break
        done = free.n
        level = (total - (free.c or 0)) / free.w
        full = full | (F.col("weight") * F.lit(level) > cap)
    return weighed.select("source", "source_size", F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def documents_in_order(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size, begin): where each document starts in its source's shuffled token stream.

    The order is that of an MD5 of the id, so it is the same on every run; ties (repeated rows, null ids) by size.
    """
    buckets = max(1, sized.count() // BUCKET_ROWS)
    digest = F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    shuffled = sized.withColumn("h", digest).withColumn("bucket", (F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("long"))
    return running(shuffled, "source", "bucket", [F.col("h"), F.col("size")], {"begin": F.col("size")}).drop("h", "bucket")


def schedule(wanted: DataFrame, slots: int, tables: WorkTables, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, block, take): the source, block and number of tokens of every slot.

    ``wanted`` is (source, source_size, target) and ``slots`` the sum of its slot counts.
    """
    spark = wanted.sparkSession
    size = F.col("source_size")
    take = F.round("target").cast("long")
    per_pass = F.ceil(size / block_tokens)
    rest = take - F.floor(take / size) * size
    need = F.floor(take / size) * per_pass + F.ceil(rest / block_tokens)
    # Sources side by side on [0, 1): by name within range parts, sums of parts first.
    spread = wanted.where("source_size > 0").withColumn("part", F.pmod(F.xxhash64("source"), F.lit(64)))
    spread = running(spread.withColumn("one", F.lit(1)), "one", "part", [F.col("source").asc_nulls_first()], {"left": F.col("target")})
    lines = tables.write(
        "lines", spread.select("source", "source_size", take.alias("total"), per_pass.alias("per_pass"), need.alias("need"), "left", (F.col("left") + F.col("target")).alias("right"))
    )
    ends = lines.agg(F.max("right").alias("right"), F.count(F.lit(1)).alias("n")).first()
    whole = ends.right or 0.0
    # A cell of the unit interval knows the few sources that reach into it, so points find theirs by an equal key.
    cells = max(1, max(slots, ends.n) // 16)
    cell = lambda x: F.least(F.floor(x / F.lit(whole or 1.0) * cells), F.lit(cells - 1))
    ranges = lines.select("*", F.explode(F.sequence(cell(F.col("left")), cell(F.col("right")))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 1) * F.lit(GOLDEN)) % 1 * F.lit(whole)).alias("x"))
    hit = points.withColumn("cell", cell(F.col("x"))).join(ranges, "cell").where((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")))
    hit = hit.select("slot", "source", F.floor(F.col("slot") / BUCKET_ROWS).alias("bucket"))
    ranked = running(hit, "source", "bucket", [F.col("slot")], {"rank": F.lit(1)}).drop("bucket")
    counts = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    late = (
        lines.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        .where(F.coalesce("got", F.lit(0)) < F.col("need"))
        .select("source", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("need") - 1)).alias("rank"))
        .select((F.lit(slots) + F.col("rank")).alias("slot"), "source", "rank")
    )
    both = ranked.select("slot", "source", "rank").unionByName(late)
    facts = lines.select(F.col("source").alias("s"), "source_size", "total", "per_pass", "need")
    placed = both.join(facts, F.col("source").eqNullSafe(F.col("s"))).where(F.col("rank") < F.col("need")).drop("s")
    block = F.col("rank") % F.col("per_pass")
    taken_before = F.floor(F.col("rank") / F.col("per_pass")) * size + block * block_tokens
    length = F.least(F.lit(block_tokens).cast("long"), size - block * block_tokens)
    return placed.select("slot", "source", block.alias("block"), F.least(length, F.col("total") - taken_before).alias("take"))


def mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, schedule and pieces of the mix.

    documents: (doc_id, source, size, source_size, target, begin), a row per row of ``docs``; pieces: (slot, doc_id,
    source, begin, tokens), the tokens of a document that a slot takes. The size of a text is its number of words, 0 if
    null. Sources are taken as they are, null as one source of its own; a source without words takes nothing, and a
    document is never taken more than ``max_passes`` times. No rows: no rows. Other columns are not read.
    """
    tables = WorkTables(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long")
    sized = tables.write("sized", docs.select("doc_id", "source", size.alias("size")))
    wanted = tables.write("targets", targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), tables, weights, max_passes))
    slots = wanted.where("source_size > 0").agg(F.sum(F.ceil(F.col("target") / block_tokens))).first()[0] or 0
    plan = tables.write("schedule", schedule(wanted, slots, tables, block_tokens))
    facts = wanted.withColumnRenamed("source", "s")
    placed = tables.write("placed", documents_in_order(sized).join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    end = F.col("begin") + F.col("size")
    first, last = F.floor(F.col("begin") / block_tokens), F.floor((end - 1) / block_tokens)
    parts = placed.where("size > 0").select("doc_id", "source", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("begin"), F.col("block") * block_tokens)
    high = F.least(end, F.col("block") * block_tokens + F.col("take"))
    blocks = plan.withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    pieces = (
        parts.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .where(high > low)
        .select("slot", "doc_id", "source", "begin", (high - low).alias("tokens"))
    )
    return placed, plan, pieces


def taken(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of ``docs``: words that the mix takes, repeats counted."""
    placed, _, pieces = mix(docs, block_tokens)
    sums = pieces.groupBy("source", "begin", "doc_id").agg(F.sum("tokens").alias("taken"))
    sums = sums.select(F.col("source").alias("s"), F.col("begin").alias("b"), F.col("doc_id").alias("d"), "taken")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("begin") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d"))
    joined = placed.join(sums, same & (F.col("size") > 0), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
