"""Mixing sources to target weights (operator 8), in DataFrame operations only.

Every document has a hash ``h`` (63 bits, of id and text) which is its place in
a random permutation of its source. The permutation is cut into blocks by its
leading bits (at most ``2**BLOCK_BITS`` a source), blocks into cells, cells into
documents. A source's target is met by ``passes`` whole passes and a part of
one more: the blocks, then cells, before the cut, then the documents of the
cut's cell that still fit, in permuted order. No step sorts or holds more than
``2**BLOCK_BITS`` rows of a source, except the cut's one cell (about
``CELL_DOCS`` documents, or all rows over ``2**(2*BLOCK_BITS)``).

The drawn blocks (a block of each pass is a draw) are spread over output
shards by a splitting tree: at each node a random half of the node's draws
goes left, so the counts per source are multivariate hypergeometric and add
up exactly to the source's block quota. Then each source's draws, in an
independent permutation, fill the shards' quotas one after another (disjoint
blocks), and a shard is shuffled by a hash of document and pass. All draws
are hashes of ``seed``, so reruns agree.

Defined cases: null texts have size 0; a null source is a source of its own and
sorts last; documents of size 0 are taken as often as their place says, at
no cost; identical rows share a hash and are taken alike; an empty table gives
an empty result. Columns of ``docs`` keep their names, the plan's have the prefix ``mix_``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm.textops import stored

BLOCK_BITS = 10
CELL_DOCS = 64
SPREAD = 256  # hash slices of one tree node's draws, so that no task ranks a whole node
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int, *cols: Column) -> Column:
    """63 uniform bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """Per source (mix_source, mix_docs, mix_total) its mix_target.

    Weighted shares of ``share`` times all words, none above ``max_repeats`` times
    its source; what lies above is shared again by weight. In the order of cap / weight,
    the sources that end at their cap are a prefix; the rest get one common level times weight.
    The windows run over one row per source.
    """
    everywhere = Window.partitionBy()
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("mix_total") * float(max_repeats))
    s = s.withColumn("want", F.sum("mix_total").over(everywhere) * float(share))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_cap = F.sum("cap").over(upto) - F.col("cap")
    rest_w = F.sum("w").over(everywhere) - F.sum("w").over(upto) + F.col("w")
    s = s.withColumn("level", (F.col("want") - before_cap) / rest_w)
    s = s.withColumn("full", F.col("level") > F.col("cap") / F.col("w"))
    s = s.withColumn("common", F.max(F.when(~F.col("full"), F.col("level"))).over(everywhere))
    target = F.least(F.col("cap"), F.when(F.col("full"), F.col("cap")).otherwise(F.col("common") * F.col("w")))
    return s.select("mix_source", "mix_docs", "mix_total", target.alias("mix_target"))


def _cut(parts: DataFrame, left: Column, place: str) -> DataFrame:
    """Per source the part (block or cell) in which its remainder ends, and what is left on entering it; none where nothing remains."""
    w = Window.partitionBy("mix_source").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = parts.withColumn("run", F.sum("part_size").over(w))
    crossing = run.where((F.col("run") > left) & (left > 0)).groupBy("mix_source").agg(
        F.min_by(F.struct(F.col(place).alias("at"), (left - F.col("run") + F.col("part_size")).alias("rest")), place).alias("x")
    )
    return crossing.select(F.col("mix_source").alias("cut_source"), F.col("x.at").alias(f"cut_{place}"), F.col("x.rest").alias("rest"))


def _same_source(other: str = "cut_source") -> Column:
    return F.col("mix_source").eqNullSafe(F.col(other))


def _draws(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """Each source's drawn blocks with their shard, as arrays by pass (0, 1, ..) of arrays by block."""
    blocks = F.expr("shiftleft(1L, mix_bits)")
    draws = plan.select(
        "mix_source",
        F.explode(F.expr("sequence(0L, CAST(mix_passes AS BIGINT))")).alias("pass"),
        "mix_passes", "mix_cut_block", blocks.alias("n_blocks"),
    ).select("mix_source", "pass", "mix_passes", "mix_cut_block", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
    draws = draws.where((F.col("pass") < F.col("mix_passes")) | (F.col("block") <= F.col("mix_cut_block")))
    draws = draws.select("mix_source", "pass", "block", F.lit(0).cast("long").alias("node"))
    tree = draws
    for depth in range(int(math.log2(shards))):
        h = _hash(seed + 101 + depth, F.col("mix_source"), F.col("pass"), F.col("block"))
        tree = tree.withColumn("h", h).withColumn("slice", F.col("h") % SPREAD)
        slices = tree.groupBy("node", "slice").agg(F.count("*").alias("n"))
        up = Window.partitionBy("node").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy("node")
        slices = slices.select("node", "slice", (F.sum("n").over(up) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("all"))
        rank = F.row_number().over(Window.partitionBy("node", "slice").orderBy("h", "mix_source", "pass", "block"))
        tree = tree.withColumn("rank", rank).join(slices, ["node", "slice"])
        right = (F.col("before") + F.col("rank") > F.expr("(all + 1) div 2")).cast("long")
        tree = tree.select("mix_source", "pass", "block", (F.col("node") * 2 + right).alias("node"))
    quota = tree.groupBy("mix_source", "node").agg(F.count("*").alias("q"))
    by_source = Window.partitionBy("mix_source")
    quota = quota.select(
        F.col("mix_source").alias("q_source"), "node",
        (F.sum("q").over(by_source.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("upto"), "q",
    )
    h = _hash(seed + 57, F.col("pass"), F.col("block"))
    placed = draws.drop("node").withColumn("place", F.row_number().over(by_source.orderBy(h, "pass", "block")))
    placed = placed.join(
        quota, F.col("mix_source").eqNullSafe(F.col("q_source")) & (F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("q"))
    )
    return placed.groupBy("mix_source").agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("pass") * (1 << BLOCK_BITS) + F.col("block")).alias("key"), F.col("node").cast("int").alias("v")))).alias("mix_shards")
    ).withColumnRenamed("mix_source", "d_source")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, shards: int = 16, seed: int = 8,
) -> DataFrame:
    """Every document with mix_size, mix_total (its source's size), mix_target, mix_copies and mix_shards
    (the output shard of each copy); copies are 0 to ``max_repeats``. ``shards`` is a power of two."""
    sized = docs.withColumns({
        "mix_source": F.col(source_col),
        "mix_size": word_count(F.col(text_col)),
        "mix_h": _hash(seed, F.col(id_col).cast("string"), F.col(text_col)),
    })
    keys = stored(sized.select("mix_source", "mix_size", "mix_h"))
    sizes = keys.groupBy("mix_source").agg(F.count("*").alias("mix_docs"), F.sum("mix_size").alias("mix_total"))
    plan = targets(sizes, weights, share, max_repeats)
    plan = plan.withColumn("mix_passes", F.when(F.col("mix_total") > 0, F.floor(F.col("mix_target") / F.col("mix_total"))).otherwise(0).cast("long"))
    plan = plan.withColumn("mix_rest", F.col("mix_target") - F.col("mix_passes") * F.col("mix_total"))
    all_bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("mix_docs") / CELL_DOCS))).cast("int")
    plan = plan.withColumn("mix_bits", F.least(F.lit(BLOCK_BITS), all_bits))
    plan = plan.withColumn("mix_cell_bits", F.least(F.lit(BLOCK_BITS), all_bits - F.col("mix_bits")))
    plan = stored(plan.withColumnRenamed("mix_source", "p_source"))

    placed = keys.join(plan, F.col("mix_source").eqNullSafe(F.col("p_source")))
    placed = placed.withColumn("block", F.expr("shiftright(mix_h, 63 - mix_bits)"))
    blocks = placed.groupBy("mix_source", "block").agg(F.sum("mix_size").alias("part_size"), F.first("mix_rest").alias("left"))
    cut = stored(_cut(blocks, F.col("left"), "block"))
    inside = placed.join(cut, _same_source() & (F.col("block") == F.col("cut_block")))
    inside = inside.withColumn("cell", F.expr("shiftright(mix_h, 63 - mix_bits - mix_cell_bits)"))
    cells = inside.groupBy("mix_source", "cell").agg(F.sum("mix_size").alias("part_size"), F.first("rest").alias("left"))
    cut_cell = stored(_cut(cells, F.col("left"), "cell")).select(
        F.col("cut_source").alias("c_source"), "cut_cell", F.col("rest").alias("cell_rest"))
    last = inside.join(cut_cell, F.col("mix_source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("cut_cell")))
    units = last.groupBy("mix_source", "mix_h").agg(F.sum("mix_size").alias("unit_size"), F.first("cell_rest").alias("cell_rest"))
    fits = units.groupBy("mix_source").agg(
        F.sort_array(F.collect_list(F.struct("mix_h", "unit_size"))).alias("units"), F.first("cell_rest").alias("cell_rest"))
    fits = fits.select(F.col("mix_source").alias("f_source"), F.aggregate(
        "units",
        F.struct(F.col("cell_rest").alias("room"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("taken")),
        lambda acc, u: F.when(u.unit_size <= acc.room, F.struct((acc.room - u.unit_size).alias("room"), F.array_append(acc.taken, u.mix_h).alias("taken"))).otherwise(acc),
        lambda acc: acc.taken,
    ).alias("mix_extra"))
    plan = plan.join(cut, F.col("p_source").eqNullSafe(F.col("cut_source")), "left")
    plan = plan.join(cut_cell, F.col("p_source").eqNullSafe(F.col("c_source")), "left")
    plan = plan.join(fits, F.col("p_source").eqNullSafe(F.col("f_source")), "left")
    plan = stored(plan.select(
        F.col("p_source").alias("mix_source"), "mix_docs", "mix_total", "mix_target", "mix_passes", "mix_bits", "mix_cell_bits",
        F.coalesce("cut_block", F.lit(-1).cast("long")).alias("mix_cut_block"),
        F.coalesce("cut_cell", F.lit(-1).cast("long")).alias("mix_cut_cell"),
        F.coalesce("mix_extra", F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("mix_extra"),
    ))
    plan = plan.join(_draws(plan, shards, seed), F.col("mix_source").eqNullSafe(F.col("d_source")), "left").drop("d_source")
    plan = stored(plan.withColumnRenamed("mix_source", "p_source"))

    out = sized.join(plan, F.col("mix_source").eqNullSafe(F.col("p_source")))
    block = F.expr("shiftright(mix_h, 63 - mix_bits)")
    cell = F.expr("shiftright(mix_h, 63 - mix_bits - mix_cell_bits)")
    part = ((block < F.col("mix_cut_block")) | ((block == F.col("mix_cut_block")) & (
        (cell < F.col("mix_cut_cell")) | ((cell == F.col("mix_cut_cell")) & F.array_contains("mix_extra", F.col("mix_h"))))))
    out = out.withColumn("mix_block", block).withColumn("mix_copies", F.col("mix_passes") + part.cast("long"))
    drawn = F.expr(f"transform(filter(sequence(0L, mix_passes), p -> p < mix_copies), p -> mix_shards[p * {1 << BLOCK_BITS} + mix_block])")
    return out.select(*docs.columns, "mix_size", "mix_total", "mix_target", "mix_copies", drawn.alias("mix_copy_shards"), "mix_h")


def shuffled_copies(mixed: DataFrame, columns: Sequence[str], seed: int = 8) -> DataFrame:
    """A row per taken copy with the named columns, shuffled inside each output shard. A shard is cut into ranges of the shuffle
    hash, at least as many as there are shuffle partitions, and these are dealt out to the tasks: a task's share
    is set by the session's number of partitions, not by the number of shards, and its rows are in order of shard and hash."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (n - 1).bit_length())
    rows = mixed.select(*columns, "mix_h", F.posexplode("mix_copy_shards").alias("mix_copy", "mix_shard"))
    rows = rows.withColumn("mix_place", _hash(seed + 7, F.col("mix_h"), F.col("mix_copy")))
    rows = rows.repartition("mix_shard", F.shiftright("mix_place", 63 - bits))
    return rows.sortWithinPartitions("mix_shard", "mix_place").select(*columns)
