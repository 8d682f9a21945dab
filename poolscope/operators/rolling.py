"""Row-exact time windows: rows up to the current one in ledger order with ``ts > t - w``.

Spark's RANGE frame is not this window (it takes in later rows of the same second) and re-aggregates a
sliding frame per row. Here every window is a merge of partial aggregates, in linear time:

    window of a row  =  rows of its cell up to it                       (one running window on the rows)
                     +  earlier cells of its time block                 (head)
                     +  cells of the block one width back, ts > t - w   (tail)
                     +  whole blocks in between, if the window spans several

A cell is (market, block, log_index div 16777216), so a cell is bounded and the rows shuffle once however
many windows are asked for. Head and tail run over cells, not rows: cells are copied once as query and
once as carried one width ahead, so both meet in one group, and the two frames start unbounded. A time
block is at most a day wide; a longer window is a whole number of blocks, whose totals go through the
same two-block step. No group holds a whole market at row level. Cells travel by (market, day), once for all
windows up to a day and once for each longer one, and are copied where they then lie; only windows whose
blocks don't divide the day are copied before they travel.

Two kinds of column need a variance. Levels (utilization, APR) sit far from zero, so they travel as
(count, mean, second moment), merge by the pairwise formula, and runs of cells are centred on a member
of the run: constant series give exactly zero and long ones do not cancel. A pair of levels carries its joint
deviation, the sum of products of both distances from the means, which merges in the same way. Changes (steps,
shares) scatter around zero, so their plain sums of powers and products are enough and merge by adding.
Nulls are skipped, as is the usual rule for rolling statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.operators.ordered import CELL, LOGS_PER_CELL, cell_of

DAY = WIDEST_BLOCK = 86_400
EXPANDING = "expanding"

Output = tuple[str, str]  # column name, SQL expression


@dataclass(frozen=True)
class Measures:
    """Columns to aggregate.

    ``levels`` get mean and variance, ``changes`` sum, mean and variance, ``pairs`` of two levels or two changes
    a covariance, ``sums`` a sum and mean, ``highs`` and ``lows`` the extremes. Columns not listed in
    ``nullable`` must be free of nulls, and so must all changes and pairs.
    """

    levels: tuple[str, ...] = ()
    changes: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    sums: tuple[str, ...] = ()
    highs: tuple[str, ...] = ()
    lows: tuple[str, ...] = ()
    nullable: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        paired = {c for pair in self.pairs for c in pair}
        if bad := self.nullable & {*self.changes, *paired}:
            raise ValueError(f"variance of changes needs columns without nulls, not {sorted(bad)}")
        if mixed := [pair for pair in self.pairs if len({c in self.levels for c in pair}) > 1]:
            raise ValueError(f"a pair needs two levels or two changes, not {mixed}")

    @property
    def joint(self) -> list[tuple[str, str]]:
        """Pairs of levels: they carry a joint deviation, the others a sum of products."""
        return [pair for pair in self.pairs if pair[0] in self.levels]

    @property
    def counted(self) -> list[str]:
        return sorted({*self.levels, *self.sums} & self.nullable)

    @property
    def summed(self) -> list[str]:
        plain = [c for pair in self.pairs if pair not in self.joint for c in pair]
        return list(dict.fromkeys([*self.sums, *self.changes, *plain]))

    def count(self, column: str) -> str:
        return f"n_{column}" if column in self.counted else "n"

    @property
    def counts(self) -> list[str]:
        return ["n", *[f"n_{c}" for c in self.counted]]

    @property
    def added(self) -> dict[str, str]:
        """Parts that merge by adding, with the row expression they sum."""
        return {
            **{f"s_{c}": c for c in self.summed},
            **{f"q_{c}": f"{c} * {c}" for c in self.changes},
            **{f"x_{x}_{y}": f"{x} * {y}" for x, y in self.pairs if (x, y) not in self.joint},
        }

    @property
    def extremes(self) -> dict[str, tuple[str, str]]:
        return {
            **{f"h_{c}": ("max", "greatest") for c in self.highs},
            **{f"l_{c}": ("min", "least") for c in self.lows},
        }

    def parts(self) -> list[str]:
        """Names of the partial aggregates, in a fixed order."""
        moments = [f"{k}_{c}" for c in self.levels for k in ("m", "v")]
        return [*self.counts, *self.added, *self.extremes, *moments, *[f"c_{x}_{y}" for x, y in self.joint]]

    def from_rows(self, over: str = "", prefix: str = "") -> list[str]:
        """Partial aggregates of plain rows, as aggregates or (with ``over``) as window functions."""
        out = {"n": f"count(1){over}"}
        out |= {f"n_{c}": f"count({c}){over}" for c in self.counted}
        out |= {part: f"sum({expr}){over}" for part, expr in self.added.items()}
        out |= {part: f"{agg}({part[2:]}){over}" for part, (agg, _) in self.extremes.items()}
        for c in self.levels:
            counted = c if c in self.counted else 1
            out[f"m_{c}"] = f"avg({c}){over}"
            out[f"v_{c}"] = f"var_pop({c}){over} * count({counted}){over}"
        out |= {f"c_{x}_{y}": f"covar_pop({x}, {y}){over} * count(1){over}" for x, y in self.joint}
        return [f"{expr} AS {prefix}{name}" for name, expr in out.items()]

    def merged(self, a: str, b: str, prefix: str = "") -> list[str]:
        """Partial aggregates of the rows behind ``a`` and ``b`` together (either may be absent)."""
        out = {k: f"coalesce({a}{k}, 0) + coalesce({b}{k}, 0)" for k in self.counts}
        for part in self.added:
            if part[2:] in self.nullable:
                out[part] = f"coalesce({a}{part} + {b}{part}, {a}{part}, {b}{part})"
            else:
                out[part] = f"coalesce({a}{part}, 0D) + coalesce({b}{part}, 0D)"
        for part, (_, pick) in self.extremes.items():
            out[part] = f"{pick}({a}{part}, {b}{part})"
        for c in self.levels:
            k = self.count(c)
            gap = f"({b}m_{c} - {a}m_{c})"
            weight = f"({b}{k} / nullif({a}{k} + {b}{k}, 0))"
            # coalesce: with one side absent (its mean is null) the other side stands alone.
            out[f"m_{c}"] = f"coalesce({a}m_{c} + {gap} * {weight}, {a}m_{c}, {b}m_{c})"
            out[f"v_{c}"] = (
                f"coalesce({a}v_{c} + {b}v_{c} + {gap} * {gap} * ({a}{k} * {weight}), {a}v_{c}, {b}v_{c})"
            )
        for x, y in self.joint:
            c = f"c_{x}_{y}"
            gaps = f"({b}m_{x} - {a}m_{x}) * ({b}m_{y} - {a}m_{y})"
            weight = f"({a}n * ({b}n / nullif({a}n + {b}n, 0)))"
            out[c] = f"coalesce({a}{c} + {b}{c} + {gaps} * {weight}, {a}{c}, {b}{c})"
        return [f"{expr} AS {prefix}{name}" for name, expr in out.items()]

    def centres(self, mask: str, over: str, prefix: str) -> list[str]:
        """For each level, the first member of the run seen so far: the constant the run is centred on."""
        return [
            f"first_value(CASE WHEN {mask} THEN m_{c} END) IGNORE NULLS {over} AS {prefix}{c}"
            for c in self.levels
        ]

    def run(self, mask: str, over: str, centre: str, prefix: str) -> list[str]:
        """Running sums over masked partial aggregates; :meth:`settled` turns them into parts."""
        pick = lambda expr: f"CASE WHEN {mask} THEN {expr} END"
        out = {k: f"sum({pick(k)}) {over}" for k in [*self.counts, *self.added]}
        out |= {k: f"{agg}({pick(k)}) {over}" for k, (agg, _) in self.extremes.items()}
        for c in self.levels:
            n, dev = self.count(c), f"(m_{c} - {centre}{c})"
            out[f"m_{c}"] = f"sum({pick(f'{n} * {dev}')}) {over}"
            out[f"v_{c}"] = f"sum({pick(f'v_{c} + {n} * {dev} * {dev}')}) {over}"
        for x, y in self.joint:
            devs = f"(m_{x} - {centre}{x}) * (m_{y} - {centre}{y})"
            out[f"c_{x}_{y}"] = f"sum({pick(f'c_{x}_{y} + n * {devs}')}) {over}"
        return [f"{expr} AS {prefix}{name}" for name, expr in out.items()]

    def settled(self, run: str, centre: str, prefix: str) -> list[str]:
        out = {k: f"{run}{k}" for k in [*self.counts, *self.added, *self.extremes]}
        for c in self.levels:
            n = f"nullif({run}{self.count(c)}, 0)"
            out[f"m_{c}"] = f"{centre}{c} + {run}m_{c} / {n}"
            out[f"v_{c}"] = f"CASE WHEN {n} > 0 THEN greatest({run}v_{c} - {run}m_{c} * ({run}m_{c} / {n}), 0D) END"
        for x, y in self.joint:
            n = f"nullif({run}n, 0)"
            out[f"c_{x}_{y}"] = f"CASE WHEN {n} > 0 THEN {run}c_{x}_{y} - {run}m_{x} * ({run}m_{y} / {n}) END"
        return [f"{expr} AS {prefix}{name}" for name, expr in out.items()]


@dataclass(frozen=True)
class Window:
    """SQL for the statistics of one window, for use in an output expression."""

    label: str
    seconds: int | None
    measures: Measures
    prefix: str

    def _n(self, c: str) -> str:
        return self.prefix + self.measures.count(c)

    def sum(self, c: str) -> str:
        return f"{self.prefix}s_{c}"

    def mean(self, c: str) -> str:
        if c in self.measures.levels:
            return f"{self.prefix}m_{c}"
        return f"({self.prefix}s_{c} / nullif({self._n(c)}, 0))"

    def max(self, c: str) -> str:
        return f"{self.prefix}h_{c}"

    def min(self, c: str) -> str:
        return f"{self.prefix}l_{c}"

    def var(self, c: str) -> str:
        """Sample variance, 0 for fewer than two values."""
        n = self._n(c)
        spread = f"{self.prefix}v_{c}"
        if c not in self.measures.levels:
            s = self.sum(c)
            spread = f"greatest({self.prefix}q_{c} - {s} * ({s} / {n}), 0D)"
        return f"CASE WHEN {n} > 1 THEN {spread} / ({n} - 1) ELSE 0D END"

    def std(self, c: str) -> str:
        return f"sqrt({self.var(c)})"

    def cov(self, x: str, y: str) -> str:
        """Sample covariance, 0 for fewer than two rows."""
        n = f"{self.prefix}n"
        if (x, y) in self.measures.joint:
            return f"CASE WHEN {n} > 1 THEN {self.prefix}c_{x}_{y} / ({n} - 1) ELSE 0D END"
        joint = f"{self.prefix}x_{x}_{y} - {self.sum(x)} * ({self.sum(y)} / {n})"
        return f"CASE WHEN {n} > 1 THEN ({joint}) / ({n} - 1) ELSE 0D END"


def block_width(seconds: int, widest: int = WIDEST_BLOCK) -> int:
    """Width of the time blocks for a window: the window itself, or its largest divisor up to ``widest``."""
    if seconds <= 0:
        raise ValueError("a window must be at least one second wide")
    return next(d for d in range(min(seconds, widest), 0, -1) if seconds % d == 0)


def _two_block(
    cells: DataFrame,
    measures: Measures,
    part: Sequence[str],
    key: str,
    ties: Sequence[str],
    sizes: dict[int, tuple[int | None, int]],
    by_day: bool = False,
) -> DataFrame:
    """Head (``h_``) and tail (``t_``) of every cell for every window in ``sizes``: id -> (width, block).

    A window without width has a head only. If the cells carry a window id, a cell serves that one. With
    ``by_day`` the cells come as :func:`_sent_by_day` leaves them, and all copies are made where they lie.
    """
    roles = []
    for wid, (width, block) in sizes.items():
        here = "_tag = 0" if by_day else "true"
        roles.append(f"named_struct('wid', {wid}, 'q', {key} div {block}, 'k', {key}, 'asks', true, 'here', {here})")
        if width is not None:
            ahead = f"({key} + {width})"
            if by_day:
                here = f"_tag = {wid + 2}" if width > DAY else f"_tag < 2 AND {ahead} div {DAY} = _day"
            roles.append(f"named_struct('wid', {wid}, 'q', {ahead} div {block}, 'k', {ahead}, 'asks', false, 'here', {here})")
    kept = [c for c in cells.columns if c not in ("wid", "_tag")]
    array = f"filter(array({', '.join(roles)}), r -> r.here)"
    if "wid" in cells.columns:
        cells = cells.selectExpr(*kept, "wid AS _own")
        array = f"filter(array({', '.join(roles)}), r -> r.wid = _own)"
    copies = cells.selectExpr(*kept, f"inline({array})").drop("here")

    group = f"PARTITION BY {', '.join(part)}, {'_day, ' if by_day else ''}wid, q"
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    up = f"ORDER BY {', '.join(['k', *ties])}"
    down = f"ORDER BY {', '.join(f'{c} DESC' for c in ['k', *ties])}"
    head = f"OVER ({group} {up} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    tail = f"OVER ({group} ORDER BY k DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    out = copies.selectExpr("*", *measures.centres("asks", f"OVER ({group} {up} {so_far})", "kh_"))
    out = out.selectExpr("*", *measures.run("asks", head, "kh_", "rh_"))
    has_tail = any(width is not None for width, _ in sizes.values())
    settled = measures.settled("rh_", "kh_", "h_")
    if has_tail:
        out = out.selectExpr("*", *measures.centres("NOT asks", f"OVER ({group} {down} {so_far})", "kt_"))
        out = out.selectExpr("*", *measures.run("NOT asks", tail, "kt_", "rt_"))
        settled += measures.settled("rt_", "kt_", "t_")
    return out.where("asks").selectExpr("wid", "q", *kept, *settled)


def _carries(
    cells: DataFrame,
    measures: Measures,
    part: Sequence[str],
    ties: Sequence[str],
    windows: dict[int, int | None],
    widest: int,
) -> DataFrame:
    """Per cell and window id, the partial aggregates (``e_``) of the window's rows before the cell."""
    sizes = {
        wid: (width, widest if width is None else block_width(width, widest))
        for wid, width in windows.items()
    }
    blocks = _two_block(cells, measures, part, "_time", ties, sizes)
    has_tail = any(width is not None for width in windows.values())
    if has_tail:
        blocks = blocks.selectExpr("*", *measures.merged("t_", "h_", "b_"))
    else:
        blocks = blocks.selectExpr("*", *[f"h_{p} AS b_{p}" for p in measures.parts()])

    # Windows that span several blocks: the whole blocks in between, from block totals.
    several = {
        wid: (None if width is None else width // block, block)
        for wid, (width, block) in sizes.items()
        if width != block
    }
    ids = [*part, "_time", *ties]
    if not several:
        return blocks.selectExpr("wid", *ids, *[f"b_{p} AS e_{p}" for p in measures.parts()])

    wanted = blocks.where(f"wid IN ({', '.join(map(str, several))})")
    whole = wanted.selectExpr("wid", "q", *part, "_time", *ties, *measures.merged("h_", "", "w_"))
    named = ", ".join(f"'{p}', w_{p}" for p in measures.parts())
    last = f"max_by(named_struct({named}), struct({', '.join(['_time', *ties])}))"
    totals = whole.groupBy("wid", *part, "q").agg(F.expr(last).alias("_w")).selectExpr("wid", *part, "q AS _b", "_w.*")
    # Block numbers are small integers; a window without width reads all blocks before, in one group.
    steps = {wid: (blocks_wide, blocks_wide or 1 << 40) for wid, (blocks_wide, _) in several.items()}
    between = _two_block(totals, measures, part, "_b", [], steps)
    if any(n is not None for n, _ in steps.values()):
        between = between.selectExpr("*", *measures.merged("t_", "h_", "g_"))
    else:
        between = between.selectExpr("*", *[f"h_{p} AS g_{p}" for p in measures.parts()])
    between = between.selectExpr("wid", *part, "_b AS q", *[f"g_{p}" for p in measures.parts()])
    joined = blocks.join(between, ["wid", *part, "q"], "left")
    return joined.selectExpr("wid", *ids, *measures.merged("b_", "g_", "e_"))


def _sent_by_day(cells: DataFrame, part: Sequence[str], windows: dict[int, int | None]) -> DataFrame:
    """The cells dealt out by day: to their own (_tag 0), the next (1), and where each window above a day ends (id + 2).

    All that a day's cells need lies in the day's group then, so a cell travels once for all windows up to a day.
    """
    sent = [f"named_struct('_day', _time div {DAY}, '_tag', 0)", f"named_struct('_day', _time div {DAY} + 1, '_tag', 1)"]
    sent += [
        f"named_struct('_day', (_time + {width}) div {DAY}, '_tag', {wid + 2})"
        for wid, width in windows.items()
        if width is not None and width > DAY
    ]
    return cells.selectExpr("*", f"inline(array({', '.join(sent)}))").repartition(*part, "_day")


def _by_day(cells: DataFrame, measures: Measures, part: Sequence[str], ties: Sequence[str], windows: dict[int, int | None]) -> DataFrame:
    """Per cell, the partial aggregates of each window's rows before it, as a struct ``_e<id>`` a window.

    For windows whose blocks divide the day. One shuffle of the cells by day serves all of them: copies, windows and the
    table of one row a cell are made inside the day's group. Whole days in between come from one table of day totals
    for all windows, a small one.
    """
    sizes = {w: (width, DAY if width is None else block_width(width)) for w, width in windows.items()}
    parts = measures.parts()
    blocks = _two_block(_sent_by_day(cells, part, windows), measures, part, "_time", ties, sizes, by_day=True)
    before = measures.merged("t_", "h_", "b_") if any(w is not None for w in windows.values()) else [f"h_{p} AS b_{p}" for p in parts]
    named = lambda prefix: ", ".join(f"'{p}', {prefix}{p}" for p in parts)
    picked = [F.expr(f"any_value(named_struct({named('b_')})) FILTER (WHERE wid = {w})").alias(f"_b{w}") for w in windows]
    several = {w: width // block if width else None for w, (width, block) in sizes.items() if width != block}
    key = [*part, "_day", "_time", *ties]
    if several:
        # Windows of whole days share their head: one of them gives the totals of days.
        first = next(iter(several))
        blocks = blocks.selectExpr("wid", *key, *before, f"CASE WHEN wid = {first} THEN named_struct({named('h_')}) END AS _h", f"named_struct({named('')}) AS _own")
        picked += [F.expr("any_value(_h) FILTER (WHERE _h IS NOT NULL)").alias("_h"), F.expr("any_value(_own)").alias("_own")]
    else:
        blocks = blocks.selectExpr("wid", *key, *before)
    wide = blocks.groupBy(*key).agg(*picked)
    if not several:
        return wide.selectExpr(*part, "_time", *ties, *[f"_b{w} AS _e{w}" for w in windows])

    whole = wide.selectExpr(*part, "_day", "_time", *ties, *measures.merged("_h.", "_own.", "w_"))
    last = f"max_by(named_struct({named('w_')}), struct({', '.join(['_time', *ties])}))"
    days = whole.groupBy(*part, "_day").agg(F.expr(last).alias("_w")).selectExpr(*part, "_day AS _b", "_w.*")
    steps = {w: (n, n or 1 << 40) for w, n in several.items()}
    between = _two_block(days, measures, part, "_b", [], steps)
    if any(several.values()):
        between = between.selectExpr("*", *measures.merged("t_", "h_", "g_"))
    else:
        between = between.selectExpr("*", *[f"h_{p} AS g_{p}" for p in parts])
    between = between.groupBy(*part, F.col("_b").alias("_day")).agg(
        *[F.expr(f"any_value(named_struct({named('g_')})) FILTER (WHERE wid = {w})").alias(f"_g{w}") for w in several]
    )
    joined = wide.join(between, [*part, "_day"], "left")
    for_window = lambda w: ", ".join(f"'{x.rsplit(' AS ', 1)[1]}', {x.rsplit(' AS ', 1)[0]}" for x in measures.merged(f"_b{w}.", f"_g{w}."))
    return joined.selectExpr(
        *part, "_time", *ties, *[f"named_struct({for_window(w)}) AS _e{w}" if w in several else f"_b{w} AS _e{w}" for w in windows]
    )


def rolling(
    df: DataFrame,
    measures: Measures,
    windows: dict[str, int | None],
    outputs: Callable[[Window], list[Output]],
    *,
    part: Sequence[str] = ("market_id",),
    repeats: bool = True,
    widest_block: int = WIDEST_BLOCK,
    logs_per_cell: int = LOGS_PER_CELL,
) -> DataFrame:
    """Append window statistics to a ledger.

    ``windows`` maps a label to a width in seconds, or to None for all rows so far. ``outputs`` turns a
    :class:`Window` into (column name, SQL) pairs. Timestamps must not decrease along the ledger order.
    With ``repeats`` a (block, log) pair may come again at another second, as in filled ticks; without
    it, rows that come with their cell (as the state operators leave them) are not shuffled again.
    """
    if not windows:
        return df.drop(CELL)
    part = list(part)
    base = [c for c in df.columns if c != CELL]
    ids = dict(enumerate(windows))
    ties = ["block_number", CELL]
    stamp = ["block_timestamp"] if repeats else []
    cell = [*part, *stamp, *ties]

    cut = df if CELL in df.columns else df.withColumn(CELL, cell_of(logs_per_cell))
    totals = [F.expr(e) for e in measures.from_rows()]
    time = [] if repeats else [F.expr("max(block_timestamp) AS _time")]
    cells = cut.groupBy(*cell).agg(*time, *totals)
    if repeats:
        cells = cells.withColumnRenamed("block_timestamp", "_time")
    widths = {w: windows[label] for w, label in ids.items()}
    daily = {w: width for w, width in widths.items() if widest_block == DAY and (width is None or DAY % block_width(width) == 0)}
    others = {w: width for w, width in widths.items() if w not in daily}
    tables = [_by_day(cells, measures, part, ties, daily)] if daily else []
    if others:
        carries = _carries(cells, measures, part, ties, others, widest_block)
        named = ", ".join(f"'{p}', e_{p}" for p in measures.parts())
        tables.append(carries.groupBy(*part, "_time", *ties).agg(
            *[F.expr(f"any_value(named_struct({named})) FILTER (WHERE wid = {w})").alias(f"_e{w}") for w in others]
        ))
    wide = reduce(lambda a, b: a.join(b, [*part, "_time", *ties]), tables)
    wide = wide.withColumnRenamed("_time", "block_timestamp") if repeats else wide.drop("_time")

    over = f" OVER (PARTITION BY {', '.join(cell)} ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = cut.selectExpr("*", *measures.from_rows(over, "p_"))
    joined = rows.join(wide, cell, "left")
    merged = [e for w in ids for e in measures.merged(f"_e{w}.", "p_", f"_w{w}_")]
    results = [
        f"{sql} AS `{name}`"
        for w, label in ids.items()
        for name, sql in outputs(Window(label, windows[label], measures, f"_w{w}_"))
    ]
    return joined.selectExpr(*base, *merged).selectExpr(*base, *results)
