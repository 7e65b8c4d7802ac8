"""Exact order statistics of many columns at once, and NTILE from the boundary rows alone.

A tile of ``NTILE(n)`` ends at a row whose position is known from the row count. Only those n - 1 rows
matter: once their (value, tie-break hash, key) are known, every row's tile follows by comparing it with them, in one
map-side pass. So no row is shuffled for a tile. The boundary rows are found by narrowing:

1. **Cuts.** A bounded hash sample of the rows gives each column's cut points (``SAMPLE_PER_CUT`` rows a cut,
   collected). Any cuts give the exact answer, they only affect balance.
2. **Count.** The rows of every class (between two cut values, or equal to one) are counted for all columns in one aggregation with
   partial sums; it has at most 2 * cuts + 2 groups a column, so no task merges more than one count per group and task.
   Running sums tell the class that holds each wanted position.
3. **Open.** In those classes alone, equal values are counted and the one at the wanted position is picked. A class that
   is a single cut value needs no opening, however many rows have it. An input of less than ``ROWS_PER_CLASS`` rows has no cuts
   and is one class.
4. **Ties.** If a boundary falls among equal values, they are ordered by ``md5(key), key``: counted by leading hex digits of the hash (as many
   as their number asks for), then the rows of one prefix are numbered.

Steps 3 and 4 shuffle the rows of a few classes (about ``ROWS_PER_CLASS`` each), whatever the input's size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

NULL_CLASS = -1
ROWS_PER_CLASS = 200_000
MAX_CUTS = 8191
SAMPLE_PER_CUT = 16


def tiebreak_hash(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def cut_count(rows: int) -> int:
    """Cut points per column for an input of ``rows`` rows."""
    return min(MAX_CUTS, rows // ROWS_PER_CLASS)


def hex_digits(repetitions: int) -> int:
    """Digits of the tie-break hash that split a class of ``repetitions`` cut steps to about one step each."""
    digits = 0
    while 16**digits < repetitions:
        digits += 1
    return digits


def constant_array(values: Sequence, dtype: T.DataType) -> Column:
    """An array constant of any length (one folded literal, not one expression per element)."""
    if not values:
        return F.array().cast(T.ArrayType(dtype))
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(T.ArrayType(dtype))


@dataclass(frozen=True)
class Cuts:
    """The cut points of one column: sorted distinct values, each one's hash digits, and the NULLs' digits."""

    values: tuple
    digits: tuple[int, ...]
    null_digits: int

    @classmethod
    def of(cls, found: Sequence | None, rows: int, nulls: int, steps: int) -> Cuts:
        repeats = Counter(found or [])
        values = sorted(repeats)
        per_step = max(1, rows // (steps + 1))
        return cls(
            tuple(values),
            tuple(hex_digits(repeats[v]) for v in values),
            hex_digits(-(-nulls // per_step)),
        )


def with_classes(df: DataFrame, specs: Sequence[tuple[str, Cuts, T.DataType, str]]) -> DataFrame:
    """Add the monotone class of each ``(column, cuts, type, output name)`` and the hash digits that split it.

    ``pos`` (the number of cut values below the value) is found by binary
    lifting over a constant array: one ``element_at`` comparison per power of
    two, all columns advanced together in one small code-generated projection
    per step. Outputs: ``name`` (class) and ``name_digits``.
    """
    arrays = {name: constant_array(cuts.values, dtype) for _, cuts, dtype, name in specs}
    positions = {name: f"{name}_pos" for *_, name in specs}
    out = df.withColumns({positions[name]: F.lit(0) for *_, name in specs})
    step = 1 << max(max((len(c.values) for _, c, _, _ in specs), default=1).bit_length() - 1, 0)
    while step >= 1:
        moves = {}
        for column, cuts, _, name in specs:
            if step <= len(cuts.values):
                pos = F.col(positions[name])
                below = F.try_element_at(arrays[name], pos + step) < F.col(column)
                moves[positions[name]] = pos + F.when(below, F.lit(step)).otherwise(F.lit(0))
        if moves:
            out = out.withColumns(moves)
        step >>= 1
    classes = {}
    for column, cuts, _, name in specs:
        v, pos = F.col(column), F.col(positions[name])
        equal = F.coalesce(F.try_element_at(arrays[name], pos + 1) == v, F.lit(False))
        classes[name] = (
            F.when(v.isNull(), F.lit(NULL_CLASS)).when(equal, pos * 2 + 1).otherwise(pos * 2).cast("bigint")
        )
        digits = F.try_element_at(constant_array(cuts.digits, T.IntegerType()), pos + 1)
        classes[f"{name}_digits"] = (
            F.when(v.isNull(), F.lit(cuts.null_digits)).when(equal, digits).otherwise(F.lit(0)).cast("int")
        )
    return out.withColumns(classes).drop(*positions.values())


@dataclass(frozen=True)
class Sizes:
    """Rows of the input, rows with a value per column, and the number of cut points asked for."""

    rows: int
    present: dict[str, int]
    steps: int


def sizes_of(base: DataFrame, columns: Sequence[str], cuts: int | None = None) -> Sizes:
    found = base.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    steps = cut_count(found["n"]) if cuts is None else cuts
    return Sizes(found["n"], {c: found[f"n{i}"] for i, c in enumerate(columns)}, steps)


def sampled_cuts(base: DataFrame, key: str, columns: Sequence[str], sizes: Sizes) -> dict[str, Cuts]:
    """Cut points of every column from a hash sample of the rows; ``key`` is unique, so the sample's size is near its aim."""
    if not sizes.steps:
        return {c: Cuts.of(None, sizes.rows, sizes.rows - sizes.present[c], 0) for c in columns}
    aim = SAMPLE_PER_CUT * (sizes.steps + 1)
    every = max(1, sizes.rows // aim)
    rows = base.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(every)) == 0).select(*columns).collect()
    out = {}
    for i, c in enumerate(columns):
        values = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        picked = [values[(j + 1) * len(values) // (sizes.steps + 1)] for j in range(sizes.steps)] if len(values) > 1 else values
        out[c] = Cuts.of(picked, sizes.rows, sizes.rows - sizes.present[c], sizes.steps)
    return out


@dataclass(frozen=True)
class Found:
    """The value at a position, and in ascending order how many rows lie before the first and how many have it."""

    value: object
    before: int
    equal: int


def values_at(base: DataFrame, wanted: dict[str, Sequence[int]], cuts: dict[str, Cuts], sizes: Sizes) -> dict[tuple[str, int], Found]:
    """The value at each wanted position (from 0, ascending, NULLs first) of each column; steps 2 and 3 above."""
    columns = [c for c, at in wanted.items() if at]
    if not columns:
        return {}
    types = {f.name: f.dataType for f in base.schema.fields}
    classed = with_classes(base.select(*columns), [(c, cuts[c], types[c], f"cls{i}") for i, c in enumerate(columns)])
    if any(cuts[c].values for c in columns):
        cells = [F.struct(F.lit(i).alias("col"), F.col(f"cls{i}").alias("cls")) for i in range(len(columns))]
        counted = [tuple(r) for r in classed.select(F.explode(F.array(*cells)).alias("g")).groupBy("g.col", "g.cls").count().collect()]
    else:  # without cuts the classes are the NULLs and the rest, whose sizes are known
        counted = [(i, cls, m) for i, c in enumerate(columns) for cls, m in ((NULL_CLASS, sizes.rows - sizes.present[c]), (0, sizes.present[c])) if m]

    out: dict[tuple[str, int], Found] = {}
    inside: dict[tuple[int, int], list[tuple[int, int]]] = {}  # open classes: (position within, position)
    starts: dict[tuple[int, int], int] = {}
    for i, c in enumerate(columns):
        start, classes = 0, []
        for _, cls, count in sorted(x for x in counted if x[0] == i):
            classes.append((start, count, cls))
            start += count
        for at in wanted[c]:
            begin, count, cls = next(x for x in classes if x[0] <= at < x[0] + x[1])
            if cls == NULL_CLASS or cls % 2:
                out[c, at] = Found(None if cls == NULL_CLASS else cuts[c].values[(cls - 1) // 2], begin, count)
            else:
                inside.setdefault((i, cls), []).append((at - begin, at))
                starts[i, cls] = begin
    if inside:
        open_columns = sorted({i for i, _ in inside})
        cells = []
        for i in open_columns:
            here = F.col(f"cls{i}").isin([cls for j, cls in inside if j == i])
            values = [(F.col(columns[j]) if i == j else F.lit(None).cast(types[columns[j]])).alias(f"v{j}") for j in open_columns]
            cells.append(F.when(here, F.struct(F.lit(i).alias("col"), F.col(f"cls{i}").alias("cls"), *values)))
        names = [f"v{j}" for j in open_columns]
        groups = classed.select(F.explode(F.array_compact(F.array(*cells))).alias("g")).select("g.*").groupBy("col", "cls", *names).agg(F.count("*").alias("m"))
        running = W.partitionBy("col", "cls").orderBy(*names).rowsBetween(W.unboundedPreceding, W.currentRow)
        groups = groups.withColumn("upto", F.sum("m").over(running))
        holds = [
            (F.col("col") == i) & (F.col("cls") == cls) & (F.col("upto") > within) & (F.col("upto") - F.col("m") <= within)
            for (i, cls), places in inside.items() for within, _ in places
        ]
        for r in groups.where(reduce(lambda a, b: a | b, holds)).collect():
            for within, at in inside[r["col"], r["cls"]]:
                if r["upto"] - r["m"] <= within < r["upto"]:
                    out[columns[r["col"]], at] = Found(r[f"v{r['col']}"], starts[r["col"], r["cls"]] + r["upto"] - r["m"], r["m"])
    return out


def tie_rows(base: DataFrame, key: str, wanted: dict[tuple[str, object], tuple[int, Sequence[int]]]) -> dict[tuple[str, object, int], tuple]:
    """(hash, key) of the rows at the wanted places among the rows of one value, ordered by ``md5(key), key``; step 4 above.

    ``wanted`` has for each (column, value) the number of its rows and the places from 0.
    """
    if not wanted:
        return {}
    groups = list(wanted)

    def has(c: str, v: object) -> Column:
        return F.col(c).isNull() if v is None else F.col(c) == F.lit(v)

    h = F.coalesce(tiebreak_hash(key), F.lit(""))
    cells = [
        F.when(has(c, v), F.struct(F.lit(g).alias("g"), h.alias("h"), F.substring(h, 1, hex_digits(-(-wanted[c, v][0] // ROWS_PER_CLASS))).alias("p")))
        for g, (c, v) in enumerate(groups)
    ]
    rows = base.select(F.col(key).alias("k"), F.explode(F.array_compact(F.array(*cells))).alias("t")).select("k", "t.*")
    if not any(hex_digits(-(-m // ROWS_PER_CLASS)) for m, _ in wanted.values()):
        return _tie_rows(rows, groups, wanted, [(g, "", 0, wanted[x][0]) for g, x in enumerate(groups)])
    running = W.partitionBy("g").orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = rows.groupBy("g", "p").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(running))
    holds = [(F.col("g") == g) & (F.col("upto") > at) & (F.col("upto") - F.col("m") <= at) for g, x in enumerate(groups) for at in wanted[x][1]]
    prefixes = [(r["g"], r["p"], r["upto"] - r["m"], r["upto"]) for r in counts.where(reduce(lambda a, b: a | b, holds)).collect()]
    return _tie_rows(rows, groups, wanted, prefixes)


def _tie_rows(rows: DataFrame, groups: list, wanted: dict, prefixes: list[tuple[int, str, int, int]]) -> dict[tuple[str, object, int], tuple]:
    """Number the rows of the given (group, prefix, first place, place behind the last) and pick the wanted ones."""
    numbered = rows.where(reduce(lambda a, b: a | b, [(F.col("g") == g) & (F.col("p") == p) for g, p, _, _ in prefixes]))
    numbered = numbered.withColumn("at", F.row_number().over(W.partitionBy("g", "p").orderBy("h", F.col("k").asc_nulls_first())) - 1)
    picks = [(g, p, at - lo, at) for g, p, lo, hi in prefixes for at in wanted[groups[g]][1] if lo <= at < hi]
    found = numbered.where(reduce(lambda a, b: a | b, [(F.col("g") == g) & (F.col("p") == p) & (F.col("at") == local) for g, p, local, _ in picks])).collect()
    by = {(r["g"], r["p"], r["at"]): (r["h"], r["k"]) for r in found}
    return {(*groups[g], at): by[g, p, local] for g, p, local, at in picks}


@dataclass(frozen=True)
class Tiles:
    """One NTILE(n) over (column in this direction, md5(key), key)."""

    name: str
    column: str
    ascending: bool
    n: int

    def ends(self, rows: int) -> list[int]:
        """Positions (from 0, in this order) of the last rows of all tiles that have a row behind them."""
        size, more = divmod(rows, self.n)
        ends, at = [], 0
        for k in range(self.n):
            at += size + (k < more)
            if 0 < at < rows:
                ends.append(at - 1)
        return sorted(set(ends))


def with_tiles(base: DataFrame, key: str, tiles: Sequence[Tiles], sizes: Sizes, cuts: dict[str, Cuts]) -> DataFrame:
    """Append each tile's number to ``base`` (stored: it is read once per step)."""
    n = sizes.rows
    # in descending order (NULLS LAST) the values come in reverse, but ties stay in the order of their hashes
    at = {(t, e): e if t.ascending else n - 1 - e for t in tiles for e in t.ends(n)}
    wanted: dict[str, list[int]] = {}
    for (t, _), place in at.items():
        wanted.setdefault(t.column, []).append(place)
    values = values_at(base, {c: sorted(set(p)) for c, p in wanted.items()}, cuts, sizes)

    ties: dict[tuple[str, object], tuple[int, set[int]]] = {}
    within: dict[tuple[Tiles, int], int | None] = {}
    for (t, e), place in at.items():
        f = values[t.column, place]
        local = e - (f.before if t.ascending else n - f.before - f.equal)  # the place among the equal rows
        within[t, e] = None if local == f.equal - 1 else local
        if within[t, e] is not None:
            ties.setdefault((t.column, f.value), (f.equal, set()))[1].add(local)
    rows = tie_rows(base, key, {x: (m, sorted(p)) for x, (m, p) in ties.items()})

    h = F.coalesce(tiebreak_hash(key), F.lit(""))

    def behind(t: Tiles, e: int) -> Column:
        """Whether a row comes after this boundary row."""
        f, c = values[t.column, at[t, e]], F.col(t.column)
        if f.value is None:
            further, same = (c.isNotNull() if t.ascending else F.lit(False)), c.isNull()
        else:
            v = F.lit(f.value)
            further = (c > v) if t.ascending else (c.isNull() | (c < v))
            same = c == v
        if within[t, e] is not None:
            row_h, row_k = rows[t.column, f.value, within[t, e]]
            more = h > F.lit(row_h)
            if row_k is not None:
                more = more | ((h == F.lit(row_h)) & (F.col(key) > F.lit(row_k)))
            further = further | (same & more)
        return F.coalesce(further, F.lit(False)).cast("bigint")

    return base.withColumns({t.name: reduce(lambda a, b: a + b, [behind(t, e) for e in t.ends(n)], F.lit(1).cast("bigint")) for t in tiles})
