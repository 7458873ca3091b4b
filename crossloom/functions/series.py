"""Factor functions as Spark columns over a series of bars, and the text form of factors.

`factor("$close / Ref($close, 5) - 1", panel)` reads the formula with Python's
own expression grammar and maps it to window columns; all windows share one
specification, so a panel is shuffled and sorted once however many factors it has.
Windows at the start of a series use the rows there are (at least `least`).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .numeric import corr, div


def series(instrument: str = "instrument", at: str = "datetime") -> WindowSpec:
    return Window.partitionBy(instrument).orderBy(at)


def number(c: Column) -> Column:
    return c.cast("double")


def both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


class Functions:
    """The functions that a formula may call, over one series window."""

    def __init__(self, over: WindowSpec, least: int = 1):
        self.over, self.least = over, least

    def rolling(self, make: Callable[[Column], Column], x: Column, n: int) -> Column:
        w = self.over.rowsBetween(-(n - 1), 0)
        made = make(number(x)).over(w)
        return made if self.least <= 1 else F.when(F.count(number(x)).over(w) >= self.least, made)

    def Ref(self, x, n):
        return F.lag(x, n).over(self.over)

    def Mean(self, x, n):
        return self.rolling(F.avg, x, n)

    def Sum(self, x, n):
        return self.rolling(F.sum, x, n)

    def Std(self, x, n):
        return self.rolling(F.stddev_samp, x, n)

    def Max(self, x, n):
        return self.rolling(F.max, x, n)

    def Min(self, x, n):
        return self.rolling(F.min, x, n)

    def Corr(self, x, y, n):
        return corr(number(x), number(y), self.over.rowsBetween(-(n - 1), 0))

    def Abs(self, x):
        return F.abs(number(x))

    def Greater(self, a, b):
        return both(a, b, F.greatest(number(a), number(b)))

    def Less(self, a, b):
        return both(a, b, F.least(number(a), number(b)))

    def Gt(self, a, b):
        return F.coalesce(a > b, F.lit(False))

    def Ge(self, a, b):
        return F.coalesce(a >= b, F.lit(False))

    def Lt(self, a, b):
        return F.coalesce(a < b, F.lit(False))

    def Le(self, a, b):
        return F.coalesce(a <= b, F.lit(False))

    def And(self, a, b):
        return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))

    def If(self, c, a, b):
        return F.when(F.coalesce(c, F.lit(False)), number(a)).otherwise(number(b))


WINDOWED = {"Ref", "Mean", "Sum", "Std", "Max", "Min", "Corr"}
NAMES = {n for n in vars(Functions) if n[0].isupper()}
FIELD = re.compile(r"\$([A-Za-z_]\w*)")


def parse(formula: str) -> ast.expr:
    return ast.parse(FIELD.sub(r"_field_\1", formula.strip()), mode="eval").body


def fields(formula: str) -> list[str]:
    return sorted(set(FIELD.findall(formula)))


def calls(formula: str) -> list[tuple[str, list[int]]]:
    """Every function call with the whole numbers among its last arguments (the windows)."""
    return [(x.func.id, [a.value for a in x.args[-1:] if isinstance(a, ast.Constant)]) for x in ast.walk(parse(formula)) if isinstance(x, ast.Call)]


def depth(formula: str) -> int:
    """How deep windows nest."""

    def of(x: ast.AST) -> int:
        inner = max((of(c) for c in ast.iter_child_nodes(x)), default=0)
        return inner + (isinstance(x, ast.Call) and x.func.id in WINDOWED)

    return of(parse(formula))


def factor(formula: str, over: WindowSpec | None = None, least: int = 1) -> Column:
    """The column of a formula. Unknown functions and anything but arithmetic raise ValueError."""
    known = Functions(over if over is not None else series(), least)

    def of(x: ast.AST):
        match x:
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name) if name.startswith("_field_"):
                return F.col(name.removeprefix("_field_"))
            case ast.UnaryOp(op=ast.USub(), operand=y):
                return -of(y)
            case ast.BinOp(left=a, op=op, right=b):
                p, q = of(a), of(b)
                match op:
                    case ast.Add():
                        return p + q
                    case ast.Sub():
                        return p - q
                    case ast.Mult():
                        return p * q
                    case ast.Div():
                        return div(p, q)
            case ast.Call(func=ast.Name(id=name), args=args) if name in NAMES:
                if name in WINDOWED:
                    if not isinstance(args[-1], ast.Constant) or not isinstance(args[-1].value, int) or args[-1].value < 1:
                        raise ValueError(f"{name}: its window is not a positive whole number")
                    return getattr(known, name)(*map(of, args[:-1]), args[-1].value)
                return getattr(known, name)(*map(of, args))
        raise ValueError(f"not part of a factor: {ast.unparse(x)}")

    return of(parse(formula))


def with_factors(panel: DataFrame, formulas: dict[str, str], over: WindowSpec | None = None, least: int = 1) -> DataFrame:
    """panel and a column for each formula, in one pass over the series."""
    return panel.withColumns({name: factor(text, over, least) for name, text in formulas.items()})
