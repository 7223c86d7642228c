"""Ordered windows over keys of any size: a key's order is cut into pieces, and what a row needs of earlier or later pieces is carried.

A window over (key, order) puts all rows of a key into one task. Here a hot key, one with more than PIECE rows and more than a HOT-th of all,
is cut at sampled quantiles of its order; windows run within pieces, a few values a piece (its last row, a sum, a
largest value) are carried along the key's pieces by a window over that small table, and come back by a join that needs no further
shuffle of the rows. The quantiles come from a mergeable sketch, HOT keys at most are cut into PIECES pieces in all and one more each whatever the size of
the table, so what is broadcast is bounded. Where no key is hot, which one count of rows by key finds out, a window over the whole key is all there is. Rows of
one place on the axis stand in one piece. The results equal those of plain windows, which ``windows`` has for keys that are bounded by what they are, such as a
trace's samples.

``order`` names the columns of the order, the first a number; together they are unique within a key. Columns must not begin with an underscore. A frame
is read once for the count, twice for a scan where a key is hot: write one that is dear to make first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..workspace import held
from .cuts import part_of, position, shares, two_levels

#: Rows of a piece, where a key has so many; keys that may be cut; pieces of them all.
PIECE, HOT, PIECES = 1 << 18, 1000, 1 << 14
#: Quantiles that the sketch is asked for; a key's cuts are some of them.
SHARES = 4096
#: Rows of a block of ``framed``, at least; a frame's half width or more.
FRAME = 4096

Row = Callable[[str], Column]


def _key(keys: list[str]) -> Column:
    """The key as one value, in which nulls are equal."""
    return F.struct(*keys)


def cut(df: DataFrame, keys: list[str], order: list[str], rows: int = PIECE) -> tuple[DataFrame, bool]:
    """``df`` with _k, its key, and _p, the number of its piece; and whether any key has more than one piece."""
    axis = df.select(_key(keys).alias("_k"), F.col(order[0]).alias("_x"))
    counts = axis.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most <= rows or most * HOT <= total:
        return df.withColumn("_k", _key(keys)).withColumn("_p", F.lit(0)), False
    hot = counts.filter((F.col("_n") > rows) & (F.col("_n") * HOT > total))
    quantiles = axis.join(F.broadcast(hot), "_k").groupBy("_k", "_n").agg(F.percentile_approx("_x", shares(SHARES), 20_000).alias("_all"))
    # Every so many of them, so that a piece has about ``rows`` rows, or a PIECES-th of the table.
    wanted = F.ceil(F.col("_n") / F.lit(float(max(rows, total / PIECES))))
    every = F.greatest(F.floor(F.lit(SHARES) / wanted), F.lit(1)).cast("int")
    chosen = quantiles.withColumn("_every", every).select("_k", F.array_distinct(F.filter("_all", lambda x, i: (i + 1) % F.col("_every") == 0)).alias("_q"))
    first, parts = two_levels("_q")
    cuts = held(chosen.select("_k", first.alias("_first"), parts.alias("_parts")), "cuts")
    at = F.col(order[0])
    inside = F.col("_first").isNotNull() & at.isNotNull()
    made = df.withColumn("_k", _key(keys)).join(F.broadcast(cuts), "_k", "left").withColumn("_c", F.when(inside, part_of("_first", at)).otherwise(0))
    return made.select(*df.columns, "_k", F.when(inside, position(F.col("_c"), "_parts", at)).otherwise(0).cast("int").alias("_p")), True


def _local(order: list[str]) -> WindowSpec:
    return Window.partitionBy("_k", "_p").orderBy(*order)


def _along() -> WindowSpec:
    """Along a key's pieces."""
    return Window.partitionBy("_k").orderBy("_p")


def _earlier() -> WindowSpec:
    return _along().rowsBetween(Window.unboundedPreceding, -1)


def _later() -> WindowSpec:
    return _along().rowsBetween(1, Window.unboundedFollowing)


def _carried(rows: DataFrame, many: bool, summary: dict[str, Column], carry: dict[str, tuple[Callable[[], Column], Column]]) -> DataFrame:
    """``rows`` with the ``carry`` columns of their piece: windows over the table of pieces and their ``summary``, and what stands there for a first piece."""
    if not many:
        return rows.select("*", *(start.alias(n) for n, (_, start) in carry.items()))
    ends = rows.groupBy("_k", "_p").agg(*(c.alias(n) for n, c in summary.items()))
    return rows.join(ends.select("_k", "_p", *(F.coalesce(over(), start).alias(n) for n, (over, start) in carry.items())), ["_k", "_p"])


def _bare(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if not c.startswith("_")))


def shifted(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], ahead: bool = False, rows: int = PIECE) -> DataFrame:
    """``df`` with columns (new name: column) of the row before, or of the one after; null where there is none."""
    row = F.struct(*columns.values())
    parts, many = cut(df, keys, order, rows)
    beside = parts.withColumn("_o", (F.lead if ahead else F.lag)(row, 1).over(_local(order)))
    end = (F.min_by if ahead else F.max_by)(row, F.struct(*order))
    made = _carried(beside, many, {"_end": end}, {"_far": (lambda: (F.lead if ahead else F.lag)("_end").over(_along()), F.lit(None).cast(beside.schema["_o"].dataType))})
    return _bare(made.select(*made.columns, *(F.coalesce("_o", "_far")[c].alias(n) for n, c in columns.items())))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int = PIECE) -> DataFrame:
    """``df`` with the number, from 0, of each row in its key."""
    parts, many = cut(df, keys, order, rows)
    local = parts.withColumn("_i", F.row_number().over(_local(order)) - 1)
    made = _carried(local, many, {"_n": F.count(F.lit(1))}, {"_b": (lambda: F.sum("_n").over(_earlier()), F.lit(0).cast("long"))})
    return _bare(made.withColumn(name, (F.col("_i") + F.col("_b")).cast("long")))


def islands(df: DataFrame, keys: list[str], order: list[str], columns: list[str], breaks: Callable[[Row, Row], Column], name: str = "island", rows: int = PIECE) -> DataFrame:
    """``df`` with runs of rows numbered from 1: the first row of a key begins one, and each row for which ``breaks(before, here)`` holds.

    ``before`` and ``here`` give the named columns of the row before and of the row itself.
    """
    w = _local(order)
    of = lambda struct: lambda c: struct[c]
    rule = lambda a, b: F.coalesce(breaks(of(a), of(b)), F.lit(False)).cast("long")
    parts, many = cut(df, keys, order, rows)
    local = parts.withColumn("_h", F.struct(*columns)).withColumn("_l", F.lag("_h").over(w))
    local = local.withColumn("_f", F.when(F.col("_l").isNull(), F.lit(0).cast("long")).otherwise(rule(F.col("_l"), F.col("_h"))))
    local = local.withColumn("_r", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not many:
        return _bare(local.withColumn(name, F.col("_r") + 1))
    at = F.struct(*order)
    ends = local.groupBy("_k", "_p").agg(F.sum("_f").alias("_n"), F.min_by("_h", at).alias("_first"), F.max_by("_h", at).alias("_last"))
    before = ends.withColumn("_pl", F.lag("_last").over(_along()))
    before = before.withColumn("_s", F.when(F.col("_pl").isNull(), F.lit(1).cast("long")).otherwise(rule(F.col("_pl"), F.col("_first"))))
    carried = before.select("_k", "_p", (F.coalesce(F.sum(F.col("_n") + F.col("_s")).over(_earlier()), F.lit(0)) + F.col("_s")).alias("_b"))
    made = local.join(carried, ["_k", "_p"])
    return _bare(made.withColumn(name, F.col("_b") + F.col("_r")))


def runs(df: DataFrame, keys: list[str], order: list[str], flag: str, name: str = "run", rows: int = PIECE) -> DataFrame:
    """``df`` with runs of equal ``flag`` numbered from 1."""
    return islands(df, keys, order, [flag], lambda a, b: ~a(flag).eqNullSafe(b(flag)), name, rows)


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str, at: str, names: tuple[str, str, str, str], rows: int = PIECE) -> DataFrame:
    """``df`` with value and place of the last row at or before each whose value is known, and of the first at or after, under four ``names``."""
    w = _local(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(at).alias("x")))
    parts, many = cut(df, keys, order, rows)
    local = parts.withColumn("_v", known)
    local = local.withColumn("_b", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    place = F.when(F.col("_v").isNotNull(), F.struct(*order))
    summary = {"_l": F.max_by("_v", place), "_f": F.min_by("_v", place)}
    none = F.lit(None).cast(local.schema["_v"].dataType)
    made = _carried(local, many, summary, {"_pb": (lambda: F.last("_l", ignorenulls=True).over(_earlier()), none), "_pa": (lambda: F.first("_f", ignorenulls=True).over(_later()), none)})
    before, after = F.coalesce("_b", "_pb"), F.coalesce("_a", "_pa")
    found = [before["v"], before["x"], after["v"], after["x"]]
    return _bare(made.select(*made.columns, *(c.alias(n) for c, n in zip(found, names, strict=True))))


def fill_linear(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, hold_ends: bool = False, rows: int = PIECE) -> DataFrame:
    """``df`` with nulls of ``value`` filled linearly over the first order column; ``hold_ends`` repeats the first and last known value outside them."""
    x = order[0]
    names = ("fill_bv", "fill_bx", "fill_av", "fill_ax")
    made = neighbours(df, keys, order, value, x, names, rows)
    bv, bx, av, ax = map(F.col, names)
    inner = bv + (av - bv) * (F.col(x) - bx) / F.when(ax > bx, ax - bx)
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(bv.isNotNull() & av.isNotNull(), inner)
    if hold_ends:
        filled = filled.when(bv.isNull(), av).when(av.isNull(), bv)
    return made.withColumn(out, filled).drop(*names)


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, gap: float, rows: int = PIECE) -> DataFrame:
    """Unions of spans that overlap or stand at most ``gap`` apart: (keys, start, end, members)."""
    order = [start, end]
    w = _local(order)
    parts, many = cut(df.select(*keys, start, end), keys, order, rows)
    far = _carried(parts, many, {"_m": F.max(end)}, {"_c": (lambda: F.max("_m").over(_earlier()), F.lit(None).cast(parts.schema[end].dataType))})
    reach = F.greatest("_c", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    flagged = far.withColumn("_f", (reach.isNull() | (F.col(start) > reach + F.lit(gap))).cast("long"))
    flagged = flagged.withColumn("_r", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = _carried(flagged, many, {"_n": F.sum("_f")}, {"_b": (lambda: F.sum("_n").over(_earlier()), F.lit(0).cast("long"))})
    return made.groupBy(*keys, (F.col("_b") + F.col("_r")).alias("_g")).agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("_g")


def framed(df: DataFrame, keys: list[str], order: list[str], half: int, make: Callable[[DataFrame, WindowSpec], DataFrame], rows: int = PIECE, block: int = FRAME) -> DataFrame:
    """``make(rows, window)`` with frames of up to ``half`` rows to each side.

    Rows are numbered and dealt to blocks of ``block`` of them, with ``half`` rows of both neighbours: a row is copied once at most. The window
    runs over a block by row number, and rows have that number as ``number``; only a block's own rows stay.
    """
    size = max(block, 2 * half)
    counted = numbered(df, keys, order, "number", rows)
    own = F.expr(f"number div {size}")
    blocks = F.array_distinct(F.array(own, F.floor((F.col("number") - half) / size).cast("long"), F.floor((F.col("number") + half) / size).cast("long")))
    dealt = counted.withColumn("_k", _key(keys)).withColumn("_b", F.explode(blocks)).filter("_b >= 0")
    made = make(dealt, Window.partitionBy("_k", "_b").orderBy("number"))
    return _bare(made.filter(F.col("_b") == own).drop("number"))


def moving_mean(df: DataFrame, keys: list[str], order: list[str], value: str, half: int, out: str, repeat_ends: bool = True, rows: int = PIECE, block: int = FRAME) -> DataFrame:
    """``df`` with the mean of the 2 * half + 1 rows around each as ``out``; beyond a key's ends its first and last value repeat, or nothing counts."""
    if not repeat_ends:
        return framed(df, keys, order, half, lambda d, w: d.withColumn(out, F.avg(value).over(w.rowsBetween(-half, half))), rows, block)

    def make(d: DataFrame, w: WindowSpec) -> DataFrame:
        # A frame that a key's end cuts off begins, or ends, with the value that repeats.
        near = w.rowsBetween(-half, half)
        left = F.lit(half) - F.count(F.lit(1)).over(w.rowsBetween(-half, -1))
        right = F.lit(half) - F.count(F.lit(1)).over(w.rowsBetween(1, half))
        return d.withColumn(out, (F.sum(value).over(near) + left * F.first(value).over(near) + right * F.last(value).over(near)) / F.lit(2 * half + 1))

    return framed(df, keys, order, half, make, rows, block)


def dilated(df: DataFrame, keys: list[str], order: list[str], flag: str, least: int, by: int, out: str, rows: int = PIECE, block: int = FRAME) -> DataFrame:
    """``df`` with ``flag`` kept only in runs of ``least`` rows, then grown by ``by`` rows to each side, as ``out``.

    Whether a run is long enough shows within ``least`` rows of any of its rows, so a run of any length needs frames of fixed width alone.
    """

    def make(d: DataFrame, w: WindowSpec) -> DataFrame:
        back, on = w.rowsBetween(-(least - 1), 0), w.rowsBetween(0, least - 1)
        off = F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("number"))
        low = F.coalesce(F.max(off).over(back), F.col("number") - F.count(F.lit(1)).over(back))
        high = F.coalesce(F.min(off).over(on), F.col("number") + F.count(F.lit(1)).over(on))
        kept = d.withColumn("_keep", F.coalesce(F.col(flag), F.lit(False)) & (high - low - 1 >= least))
        return kept.withColumn(out, F.max(F.col("_keep").cast("int")).over(w.rowsBetween(-by, by)) == 1)

    return framed(df, keys, order, by + least - 1, make, rows, block)


def from_marks(df: DataFrame, keys: list[str], order: list[str], weight: str, mark: str, out: str, rows: int = PIECE) -> DataFrame:
    """``df`` with the support of each row as ``out``: 1 at marked rows, else the larger, over both directions, of the smallest weight on the way from a marked row; 0 without one.

    ``weight`` belongs to the link from the row before.
    """
    linked = shifted(df.withColumn("scan_w", F.col(weight).cast("double")), keys, order, {"scan_next": "scan_w"}, True, rows).withColumn("scan_next", F.coalesce("scan_next", F.lit(0.0)))
    parts, many = cut(linked, keys, order, rows)

    def sweep(d: DataFrame, link: str, name: str, ahead: bool) -> DataFrame:
        sort = [F.desc(c) if ahead else F.asc(c) for c in order]
        along = Window.partitionBy("_k").orderBy(F.desc("_p") if ahead else F.asc("_p"))
        since = Window.partitionBy("_k", "_p").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        # Marks met so far in the piece, and the smallest link since the last of them: a mark's own link does not count.
        local = d.withColumn("_g", F.sum(F.col(mark).cast("int")).over(since))
        own = Window.partitionBy("_k", "_p", "_g").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        local = local.withColumn("_m", F.min(F.when(F.col(mark), F.lit(1.0)).otherwise(F.col(link))).over(own))
        if not many:
            return local.withColumn(name, F.when(F.col("_g") > 0, F.least("_m", F.lit(1.0))).otherwise(F.least(F.lit(0.0), "_m"))).drop("_g", "_m")
        ends = local.groupBy("_k", "_p").agg(F.max("_g").alias("_any"), F.max_by("_m", F.struct("_g", -F.col("_m"))).alias("_x"))
        met = ends.withColumn("_c", F.sum((F.col("_any") > 0).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        least = F.min("_x").over(Window.partitionBy("_k", "_c").orderBy(F.desc("_p") if ahead else F.asc("_p")).rowsBetween(Window.unboundedPreceding, 0))
        leaving = met.withColumn("_out", F.when(F.col("_c") > 0, least).otherwise(0.0))
        carried = leaving.select("_k", "_p", F.coalesce(F.lag("_out").over(along), F.lit(0.0)).alias("_in"))
        made = local.join(carried, ["_k", "_p"]).withColumn(name, F.when(F.col("_g") > 0, F.least("_m", F.lit(1.0))).otherwise(F.least("_in", "_m")))
        return made.drop("_g", "_m", "_in")

    both = sweep(sweep(parts, "scan_w", "scan_f", False), "scan_next", "scan_b", True)
    return _bare(both.withColumn(out, F.greatest("scan_f", "scan_b"))).drop("scan_w", "scan_next", "scan_f", "scan_b")
