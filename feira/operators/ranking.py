"""Exact global RANK / ROW_NUMBER / NTILE without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task. For
per-customer and per-seller rankings that is unbounded, so the global position
of a row is assembled from bounded pieces instead:

1. **Materialise.** The input is checkpointed once (reliable checkpoint in
   ``spark.checkpoint.dir``); every later pass reads those files.
2. **Coarse class.** Cut points of every ranked column come from a bounded hash sample
   (``operators.selection``; the only driver round trip besides the counts): one per ``ROWS_PER_CLASS`` rows, between
   none and ``MAX_CUTS``. With distinct cut values
   u1 < ... < um, a value's class is ``2j`` if it lies strictly between u_j
   and u_(j+1) and ``2j-1`` if it equals u_j — a monotone function of the
   value, found by a binary search over the cut values (log2(m) + 1
   ``element_at`` comparisons per row on one constant array).
   Any cut points give the exact answer; they only affect balance.
3. **Splitting ties.** A value held by a large share of rows (up to all of
   them) appears several times among the cut points. Its class is split by
   the leading hex digits of ``md5(tie-break key)``, with as many digits as
   its number of repetitions asks for (16 sub-classes for 2 to 16
   repetitions, 256 up to 256, ...); NULLs are split the same way by their
   counted share. Rows of such a class are ordered by that hash, so the split
   keeps the order. Rows per group therefore stay near ``ROWS_PER_CLASS``
   at every input size up to ``MAX_CUTS * ROWS_PER_CLASS`` rows (1.6 billion),
   and grow as the count over ``MAX_CUTS`` beyond.
4. **Offsets.** Rows are counted per (column, class, sub-class) in one
   aggregation: at most about ``34 * (K + 1)`` groups per column whatever the
   data. A running sum over that small table gives each group's start offset,
   joined back (Spark broadcasts it when it is below its threshold). Inside a
   group a window partitioned by (class, sub-class) numbers the rows; global
   row number = start + local row number.

NTILE needs none of this: its boundary rows are selected and every row is compared with them
(``operators.selection``), so a tile shuffles no rows. RANK of a tie class is the class
start + 1; elsewhere it is start + the local rank, since equal values never
straddle two classes.

There is one path for every input size.

Tie-break order (needed for deterministic ROW_NUMBER/NTILE) is
``md5(cast(key as string)), key``; the SQL oracle repeats it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from feira.operators.selection import NULL_CLASS, Cuts, Tiles, sampled_cuts, sizes_of, tiebreak_hash, with_classes, with_tiles
from feira.session import materialize

_P = "__rk_"


@dataclass(frozen=True)
class RankOut:
    """One output column: ``kind`` is 'rank', 'row_number' or 'ntile' (with ``n``)."""

    name: str
    column: str
    ascending: bool
    kind: str
    n: int | None = None


def _ordered(c: Column, ascending: bool) -> Column:
    # SQL default null placement: NULLS FIRST for ASC, NULLS LAST for DESC.
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()


def with_global_ranks(
    df: DataFrame,
    tiebreak: str,
    outputs: Sequence[RankOut],
    cuts: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """Append the requested global rank/row_number/ntile columns to ``df``.

    ``cuts`` overrides the number of cut points that the row count gives.
    """
    base = materialize(df) if checkpoint else df
    columns = list(dict.fromkeys(o.column for o in outputs))
    types = {f.name: f.dataType for f in base.schema.fields}
    for c in columns:
        if not isinstance(types[c], T.NumericType):
            raise TypeError(f"ranking supports numeric columns only, got {types[c].simpleString()}")
    sizes = sizes_of(base, columns, cuts)
    cut = sampled_cuts(base, tiebreak, columns, sizes)
    tiles = [Tiles(o.name, o.column, o.ascending, o.n) for o in outputs if o.kind == "ntile"]
    rest = [o for o in outputs if o.kind != "ntile"]
    out = with_tiles(base, tiebreak, tiles, sizes, cut) if tiles and sizes.rows else base.withColumns({t.name: F.lit(1).cast("bigint") for t in tiles})
    if rest:
        out = _numbered(out, tiebreak, rest, cut)
    return out.select(*df.columns, *[o.name for o in outputs])


def _numbered(base: DataFrame, tiebreak: str, outputs: Sequence[RankOut], cut: dict[str, Cuts]) -> DataFrame:
    """Append ranks and row numbers, by classes, offsets and a window within each class."""
    columns = list(dict.fromkeys(o.column for o in outputs))
    types = {f.name: f.dataType for f in base.schema.fields}
    tb = f"{_P}tb"
    classed = with_classes(
        base.withColumn(tb, tiebreak_hash(tiebreak)),
        [(c, cut[c], types[c], f"{_P}cls{i}") for i, c in enumerate(columns)],
    )
    classed = classed.withColumns(
        {
            f"{_P}sub{i}": F.substring(F.coalesce(F.col(tb), F.lit("")), F.lit(1), F.col(f"{_P}cls{i}_digits"))
            for i in range(len(columns))
        }
    )

    # Group sizes for every ranked column in one aggregation.
    stacked = classed.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("col"), F.col(f"{_P}cls{i}").alias("cls"), F.col(f"{_P}sub{i}").alias("sub"))
                    for i in range(len(columns))
                ]
            )
        ).alias("g")
    ).select("g.*")
    counts = materialize(stacked.groupBy("col", "cls", "sub").count())

    out = classed
    for i, c in enumerate(columns):
        cls, sub = f"{_P}cls{i}", f"{_P}sub{i}"
        directions = list(dict.fromkeys(o.ascending for o in outputs if o.column == c))
        offsets = _offsets(counts.filter(F.col("col") == i).drop("col"), i, directions).withColumnsRenamed(
            {"cls": cls, "sub": sub}
        )
        out = out.join(offsets, on=[cls, sub], how="inner")
        part = W.partitionBy(cls, sub)
        is_tie = (F.col(cls) % 2 == 1) | (F.col(cls) == NULL_CLASS)
        for asc in directions:
            d = "a" if asc else "d"
            start, cstart = f"{_P}start{i}{d}", f"{_P}cstart{i}{d}"
            value = _ordered(F.col(c), asc)
            mine = [o for o in outputs if o.column == c and o.ascending == asc]
            kinds = {o.kind for o in mine}
            positions = {}
            if "row_number" in kinds:
                w_rn = part.orderBy(value, F.col(tb).asc_nulls_first(), F.col(tiebreak).asc_nulls_first())
                positions[f"{_P}rn{i}{d}"] = F.col(start) + F.row_number().over(w_rn)
            if "rank" in kinds:
                local = F.rank().over(part.orderBy(value))
                positions[f"{_P}rank{i}{d}"] = F.when(is_tie, F.col(cstart) + 1).otherwise(F.col(start) + local)
            out = out.withColumns(positions)
            results = {}
            for o in mine:
                if o.kind == "rank":
                    results[o.name] = F.col(f"{_P}rank{i}{d}").cast("bigint")
                elif o.kind == "row_number":
                    results[o.name] = F.col(f"{_P}rn{i}{d}").cast("bigint")
                else:
                    raise ValueError(f"unknown rank kind {o.kind!r}")
            out = out.withColumns(results)
    return out


def _offsets(counts: DataFrame, i: int, directions: Sequence[bool]) -> DataFrame:
    """Start offset of every (class, sub-class) group per sort direction.

    ``counts`` has about 34 * (K + 1) rows at most, so these windows (which run
    in one task) work on a bounded table.
    """
    out = counts
    for asc in directions:
        d = "a" if asc else "d"
        key = F.when(F.col("cls") == NULL_CLASS, F.lit(-(10**9) if asc else 10**9)).otherwise(
            F.col("cls") if asc else -F.col("cls")
        )
        running = W.orderBy(key, F.col("sub")).rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumn(f"{_P}start{i}{d}", F.sum("count").over(running) - F.col("count"))
        out = out.withColumn(f"{_P}cstart{i}{d}", F.min(f"{_P}start{i}{d}").over(W.partitionBy("cls")))
    return out.drop("count")
