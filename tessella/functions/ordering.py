"""The explicit order every operator takes: partition keys, and order keys that must be unique inside a partition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Series:
    """Rows of one series share `keys` and follow each other by `order`; add a tie-break where stamps repeat."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def trail(self, n: int) -> WindowSpec:
        """The last n rows with the current one."""
        return self.window().rowsBetween(-(n - 1), 0)

    def prev(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.window().rowsBetween(-n, -1)

    def following(self, n: int) -> WindowSpec:
        """The n rows after the current one."""
        return self.window().rowsBetween(1, n)

    def upto(self) -> WindowSpec:
        """All rows to the current one."""
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        """All rows before the current one."""
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(x, n).over(self.window())

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(x, n).over(self.window())


def at_least(value: Column, x: Column, frame: WindowSpec, rows: int) -> Column:
    """value where the frame holds that many values of x that are not null, else null."""
    return F.when(F.count(x).over(frame) >= rows, value)


def finite(x: Column | str) -> Column:
    """x with NaN and both infinities as null: aggregates skip null, not NaN."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
