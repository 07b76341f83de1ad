"""Running values along an ordered history, safe for keys that hold a large share of all rows.

``Whole`` evaluates them as ordinary window functions: one exchange on the key, one task per
key. ``Blocks`` cuts the histories of hot keys into ranges of the order, evaluates inside each
range, and adds what the earlier ranges contribute. Both give the same values. ``by_history``
picks between them from a count per key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sessionlore.session import materialize

HOT_ROWS_SETTING = "spark.sessionlore.hotRows"
HOT_ROWS = 4_000_000
#: Rows of a block where a caller names no number of blocks.
ROWS_PER_BLOCK = 2_000_000

CURRENT, PREVIOUS = 0, -1


def _frame(order: WindowSpec, through: int) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, through)


class Running:
    """A value per row computed from the rows up to it.

    ``plain`` is the value over an undivided window. The other methods split it: ``local`` inside
    a block, ``state`` as an aggregate of one block, ``carry`` from the states of earlier blocks,
    and ``finish`` putting local and carried parts together.
    """

    def plain(self, order: WindowSpec) -> Column:
        raise NotImplementedError

    def local(self, order: WindowSpec) -> dict[str, Column]:
        return {"value": self.plain(order)}

    def state(self, position: Column) -> dict[str, Column]:
        raise NotImplementedError

    def overall(self, state: dict[str, Column], blocks: WindowSpec) -> dict[str, Column]:
        """Values of the whole key that ``carry`` needs, added to its states."""
        return {}

    def carry(self, state: dict[str, Column], blocks: WindowSpec) -> dict[str, Column]:
        raise NotImplementedError

    def finish(self, local: dict[str, Column], carry: dict[str, Column]) -> Column:
        raise NotImplementedError


@dataclass
class Total(Running):
    """Running sum; 0 where no row contributes."""

    value: Column
    through: int = CURRENT

    def plain(self, order):
        return F.coalesce(F.sum(self.value).over(_frame(order, self.through)), F.lit(0))

    def state(self, position):
        return {"sum": F.coalesce(F.sum(self.value), F.lit(0))}

    def carry(self, state, blocks):
        return {"sum": F.coalesce(F.sum(state["sum"]).over(_frame(blocks, PREVIOUS)), F.lit(0))}

    def finish(self, local, carry):
        return local["value"] + carry["sum"]


@dataclass
class Position(Running):
    """1-based number of the row."""

    def plain(self, order):
        return F.row_number().over(order)

    def state(self, position):
        return {"rows": F.count(F.lit(1))}

    def carry(self, state, blocks):
        return {"rows": F.coalesce(F.sum(state["rows"]).over(_frame(blocks, PREVIOUS)), F.lit(0))}

    def finish(self, local, carry):
        return local["value"] + carry["rows"]


@dataclass
class Peak(Running):
    """Running maximum; ``empty`` where no row contributes."""

    value: Column
    empty: int = 0
    through: int = CURRENT

    def plain(self, order):
        return F.coalesce(F.max(self.value).over(_frame(order, self.through)), F.lit(self.empty))

    def local(self, order):
        return {"value": F.max(self.value).over(_frame(order, self.through))}

    def state(self, position):
        return {"max": F.max(self.value)}

    def carry(self, state, blocks):
        return {"max": F.max(state["max"]).over(_frame(blocks, PREVIOUS))}

    def finish(self, local, carry):
        return F.coalesce(F.greatest(local["value"], carry["max"]), F.lit(self.empty))


@dataclass
class Mean(Running):
    """Running mean of the non-null values; 0 where there is none."""

    value: Column
    through: int = CURRENT

    def plain(self, order):
        return F.coalesce(F.avg(self.value).over(_frame(order, self.through)), F.lit(0.0))

    def local(self, order):
        frame = _frame(order, self.through)
        return {"sum": F.sum(self.value.cast("double")).over(frame), "rows": F.count(self.value).over(frame)}

    def state(self, position):
        return {"sum": F.sum(self.value.cast("double")), "rows": F.count(self.value)}

    def carry(self, state, blocks):
        frame = _frame(blocks, PREVIOUS)
        return {"sum": F.sum(state["sum"]).over(frame), "rows": F.sum(state["rows"]).over(frame)}

    def finish(self, local, carry):
        total = F.coalesce(local["sum"], F.lit(0.0)) + F.coalesce(carry["sum"], F.lit(0.0))
        rows = F.coalesce(local["rows"], F.lit(0)) + F.coalesce(carry["rows"], F.lit(0))
        return F.coalesce(F.try_divide(total, rows.cast("double")), F.lit(0.0))


@dataclass
class Spread(Running):
    """Running sample standard deviation; 0 below two values.

    Blocks are merged through their squared deviations, centred on the mean of the key so that
    large values keep their digits.
    """

    value: Column
    through: int = CURRENT

    def plain(self, order):
        return F.coalesce(F.stddev_samp(self.value).over(_frame(order, self.through)), F.lit(0.0))

    def local(self, order):
        frame = _frame(order, self.through)
        return {
            "rows": F.count(self.value).over(frame).cast("double"),
            "mean": F.avg(self.value).over(frame),
            "var": F.var_pop(self.value).over(frame),
        }

    def state(self, position):
        return {
            "rows": F.count(self.value).cast("double"),
            "mean": F.avg(self.value),
            "var": F.var_pop(self.value),
        }

    def overall(self, state, blocks):
        every = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows, mean = state["rows"], state["mean"]
        return {"centre": F.coalesce(
            F.try_divide(F.sum(rows * mean).over(every), F.sum(rows).over(every)), F.lit(0.0)
        )}

    def carry(self, state, blocks):
        frame = _frame(blocks, PREVIOUS)
        rows = state["rows"]
        off = F.coalesce(state["mean"] - state["centre"], F.lit(0.0))
        squares = rows * (F.coalesce(state["var"], F.lit(0.0)) + off * off)
        return {
            "rows": F.coalesce(F.sum(rows).over(frame), F.lit(0.0)),
            "off": F.coalesce(F.sum(rows * off).over(frame), F.lit(0.0)),
            "squares": F.coalesce(F.sum(squares).over(frame), F.lit(0.0)),
            "centre": state["centre"],
        }

    def finish(self, local, carry):
        zero = F.lit(0.0)
        n1, n2 = carry["rows"], F.coalesce(local["rows"], zero)
        off1 = F.coalesce(F.try_divide(carry["off"], n1), zero)
        off2 = F.coalesce(local["mean"] - carry["centre"], zero)
        n = n1 + n2
        squares = (
            carry["squares"] - n1 * off1 * off1
            + n2 * F.coalesce(local["var"], zero)
            + F.coalesce(F.try_divide(n1 * n2, n), zero) * (off2 - off1) * (off2 - off1)
        )
        return F.when(n > 1, F.sqrt(F.greatest(F.try_divide(squares, n - 1), zero))).otherwise(zero)


@dataclass
class Before(Running):
    """Value of the row before; ``default`` on the first row."""

    value: Column
    default: object = 0

    def plain(self, order):
        return F.lag(self.value, 1, self.default).over(order)

    def local(self, order):
        return {"value": F.lag(self.value, 1).over(order), "first": F.row_number().over(order) == 1}

    def state(self, position):
        return {"last": F.max_by(F.struct(self.value.alias("v")), position)}

    def carry(self, state, blocks):
        return {"last": F.lag(state["last"]).over(blocks)}

    def finish(self, local, carry):
        earlier = F.when(carry["last"].isNull(), F.lit(self.default)).otherwise(carry["last"]["v"])
        return F.when(local["first"], earlier).otherwise(local["value"])


@dataclass
class Latest(Running):
    """Most recent non-null value (forward fill)."""

    value: Column
    through: int = CURRENT

    def plain(self, order):
        return F.last(self.value, ignorenulls=True).over(_frame(order, self.through))

    def state(self, position):
        return {"last": F.max_by(self.value, F.when(self.value.isNotNull(), position))}

    def carry(self, state, blocks):
        return {"last": F.last(state["last"], ignorenulls=True).over(_frame(blocks, PREVIOUS))}

    def finish(self, local, carry):
        return F.coalesce(local["value"], carry["last"])


class Whole:
    """Histories that each fit one task."""

    def over(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
             values: dict[str, Running]) -> DataFrame:
        if not values:
            return df
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: running.plain(window) for name, running in values.items()})

    def attach(self, df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
        """Aggregates of the whole history, on every row of it."""
        window = Window.partitionBy(*keys)
        return df.withColumns({name: value.over(window) for name, value in values.items()})


class Blocks:
    """Histories cut into ranges of their order.

    Range partitioning on (key, order) puts at most about ``1/parts`` of the rows in one block,
    however they are spread over keys. Without a number of parts the rows are written and counted
    first. The states are one row per (key, block), joined back in the way their size allows.
    """

    def __init__(self, parts: int | None = None):
        self.parts = parts

    def over(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
             values: dict[str, Running]) -> DataFrame:
        if not values:
            return df
        parts = self.parts
        if parts is None:
            df = materialize(df)
            parts = max(1, math.ceil(df.count() / ROWS_PER_BLOCK))
        keys, order = list(keys), list(order)
        cut = materialize(
            df.repartitionByRange(parts, *keys, *order).withColumn("_block", F.spark_partition_id())
        )
        inside = Window.partitionBy(*keys, "_block").orderBy(*order)
        blocks = Window.partitionBy(*keys).orderBy("_block")
        position = F.struct(*order)
        locals_, states, overalls, carries, results = {}, [], {}, [], {}
        for i, (name, running) in enumerate(values.items()):
            local_names, carry_names = {}, {}
            for part, column in running.local(inside).items():
                local_names[part] = f"_l{i}_{part}"
                locals_[local_names[part]] = column
            state = running.state(position)
            for part, column in state.items():
                states.append(column.alias(f"_s{i}_{part}"))
            state_columns = {part: F.col(f"_s{i}_{part}") for part in state}
            for part, column in running.overall(state_columns, blocks).items():
                overalls[f"_o{i}_{part}"] = column
                state_columns[part] = F.col(f"_o{i}_{part}")
            for part, column in running.carry(state_columns, blocks).items():
                carry_names[part] = f"_c{i}_{part}"
                carries.append(column.alias(carry_names[part]))
            results[name] = running.finish(
                {part: F.col(n) for part, n in local_names.items()},
                {part: F.col(n) for part, n in carry_names.items()},
            )
        states_of = cut.groupBy(*keys, "_block").agg(*states).withColumns(overalls)
        earlier = states_of.select(*keys, "_block", *carries)
        joined = _join_keys(cut.withColumns(locals_), earlier, [*keys, "_block"])
        kept = [c for c in df.columns if c not in results]
        return joined.select(*kept, *[column.alias(name) for name, column in results.items()])

    def attach(self, df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
        totals = df.groupBy(*keys).agg(*[value.alias(name) for name, value in values.items()])
        return _join_keys(df, totals, list(keys))


def _join_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, null being equal to null."""
    other = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(other, same or F.lit(True)).drop(*[f"_k{i}" for i in range(len(keys))])


History = Whole | Blocks


@dataclass(frozen=True)
class HotKeys:
    """The hot keys as a table with the column ``_hot``, and the rows that they have."""

    table: DataFrame | None = None
    rows: int = 0
    limit: int = HOT_ROWS

    @property
    def parts(self) -> int:
        return max(2, math.ceil(2 * self.rows / self.limit))

    @property
    def values(self) -> tuple:
        return tuple(r[0] for r in self.table.collect()) if self.table else ()


def hot_keys(df: DataFrame, key: str, weight: Column | None = None) -> HotKeys:
    """Keys with more rows than one task should hold, null among them.

    ``weight`` is the number of rows a row of ``df`` stands for.
    """
    limit = int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    found = df.groupBy(F.col(key).alias("_hot")).agg(rows.alias("rows")).where(F.col("rows") > limit)
    total = found.agg(F.sum("rows")).first()[0]
    return HotKeys(materialize(found).select("_hot"), total, limit) if total else HotKeys(limit=limit)


def by_history(tables: DataFrame | Sequence[DataFrame], key: str,
               build: Callable[..., DataFrame], hot: HotKeys | None = None) -> DataFrame:
    """``build(*tables, history)`` over the ordinary keys in whole windows and over the hot ones
    in blocks. All tables carry ``key``; the hot keys are looked for in the first."""
    tables = [tables] if isinstance(tables, DataFrame) else list(tables)
    hot = hot_keys(tables[0], key) if hot is None else hot
    if hot.table is None:
        return build(*tables, Whole())
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))
    cold = build(*[t.join(hot.table, is_hot, "left_anti") for t in tables], Whole())
    return cold.unionByName(build(*[t.join(hot.table, is_hot, "left_semi") for t in tables], Blocks(hot.parts)))
