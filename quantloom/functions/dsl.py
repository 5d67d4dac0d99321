"""Column expressions over a (time, asset) panel with nested windows, compiled to staged selects.

Spark does not nest window functions, so an expression tree is cut at its window
nodes: all windows of one depth become columns of one stage, equal subtrees
become one column, however many factors share them. The same stages render as
DataFrame selects or as a chain of SQL common table expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

EPS = 1e-12

_BINARY = {"add": "+", "sub": "-", "mul": "*", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "and": "and", "or": "or"}
_WINDOWS = {"lag", "lead", "roll", "cum", "cumby", "cs", "fwd"}


class E:
    """A node: an operation on nodes and constants. Compare with methods gt, ge, lt, le, eq."""

    __slots__ = ("args", "key", "op")

    def __init__(self, op: str, *args):
        self.op, self.args = op, args
        self.key = f"{op}({','.join(a.key if isinstance(a, E) else repr(a) for a in args)})"

    def __add__(self, o):
        return E("add", self, wrap(o))

    def __radd__(self, o):
        return E("add", wrap(o), self)

    def __sub__(self, o):
        return E("sub", self, wrap(o))

    def __rsub__(self, o):
        return E("sub", wrap(o), self)

    def __mul__(self, o):
        return E("mul", self, wrap(o))

    def __rmul__(self, o):
        return E("mul", wrap(o), self)

    def __truediv__(self, o):
        return E("div", self, wrap(o))

    def __rtruediv__(self, o):
        return E("div", wrap(o), self)

    def __neg__(self):
        return E("neg", self)

    def gt(self, o):
        return E("gt", self, wrap(o))

    def ge(self, o):
        return E("ge", self, wrap(o))

    def lt(self, o):
        return E("lt", self, wrap(o))

    def le(self, o):
        return E("le", self, wrap(o))

    def eq(self, o):
        return E("eq", self, wrap(o))

    def __and__(self, o):
        return E("and", self, o)

    def __or__(self, o):
        return E("or", self, o)


def wrap(x) -> E:
    return x if isinstance(x, E) else E("lit", float(x))


def col(name: str) -> E:
    return E("col", name)


def fn(name: str, *args) -> E:
    return E("fn", name, *map(wrap, args))


def when(cond: E, a, b=None) -> E:
    return E("when", cond, wrap(a)) if b is None else E("when", cond, wrap(a), wrap(b))


def nz(x: E, value: float = 0.0) -> E:
    """Missing values as ``value``."""
    return fn("coalesce", x, value)


def clip(x: E, lo: float, hi: float) -> E:
    return when(x.lt(lo), lo, when(x.gt(hi), hi, x))


def lag(x: E, k: int = 1) -> E:
    return E("lag", x, k)


def lead(x: E, k: int = 1) -> E:
    return E("lead", x, k)


def roll(agg: str, n: int, *args, mp: int | None = None, skip: int = 0) -> E:
    """``agg`` over the last ``n`` rows of the asset, null before ``mp`` values (default ``n``); ``skip`` leaves out that many latest rows."""
    return E("roll", agg, n, n if mp is None else mp, skip, *args)


def fwd(agg: str, h: int, x: E) -> E:
    """``agg`` over the next ``h`` rows, null where fewer are left."""
    return E("fwd", agg, h, x)


def cum(agg: str, x: E) -> E:
    return E("cum", agg, x)


def cs(agg: str, x: E) -> E:
    """``agg`` across the assets of a date."""
    return E("cs", agg, x)


def decayed(x: E, keep: float) -> E:
    """s = keep s + x from 0 (0 < keep < 1), by scaled running sums that start anew every ``block`` rows.

    Within a block the scale keep ** -row stays finite. A block carries the end of
    the one before into the next; what lies further back has lost 280 bits by then,
    more than a double resolves. Needs the row number ``t`` of the asset.
    """
    block = max(2, int(280 / -math.log2(keep)))
    row, number = fn("mod", col("t"), block), fn("floor", col("t") / block)
    inner = fn("pow", keep, row) * E("cumby", "sum", x * fn("pow", keep, -row), number)
    carried = cum("last", when(row.eq(0), lag(inner)))
    return inner + nz(carried) * fn("pow", keep, row + 1)


def ema(x: E, alpha: float, mp: int = 1) -> E:
    """Recursive mean s = (1 - alpha) s + alpha x, seeded with the first value. Needs the row number ``t`` of the asset."""
    share = when(col("t").eq(0), 1.0, alpha)
    return when(col("t").ge(mp - 1), decayed(nz(x) * share, 1 - alpha), 0.0)


def ewma(x: E, lam: float) -> E:
    """Bias-corrected recursion s = lam s + (1 - lam) x over s / w, missing values skipped, 0 before the first."""
    s = decayed(nz(x) * (1 - lam), lam)
    w = decayed(when(E("isnull", x), 0.0, 1.0) * (1 - lam), lam)
    return nz(s / (w + EPS))


def robust_z(x: E, limit: float = 5.0) -> E:
    """(x - median) / (1.4826 MAD + eps) across assets, missing as 0, clipped. Inputs are rounded so that equal values stay equal whatever the order of their sums."""
    y = fn("round", nz(x), 10)
    med = cs("median", y)
    mad = cs("median", fn("abs", y - med))
    return clip(nz((y - med) / (1.4826 * mad + EPS)), -limit, limit)


class Dialect:
    """How an engine writes what differs."""

    def __init__(self, name: str, folder: str = ""):
        self.spark, self.folder = name == "spark", folder.rstrip("/")

    def table(self, name: str) -> str:
        """A stored table: by its path in Spark, by its view in the other engine."""
        return f"parquet.`{self.folder}/{name}.parquet`" if self.spark else name

    def fun(self, name: str) -> str:
        """A function whose name differs."""
        return name if self.spark else {"min_by": "arg_min", "max_by": "arg_max", "struct": "row", "collect_list": "list", "last_day": "last_day", "size": "len", "array_contains": "list_contains", "array": "list_value", "count_if": "count_if", "bool_or": "bool_or"}.get(name, name)

    def div(self, a: str, b: str) -> str:
        return f"try_divide({a}, {b})" if self.spark else f"({a} / nullif({b}, 0))"

    def agg(self, name: str, args: list[str], over: str) -> str:
        a = ", ".join(args)
        if name.startswith("q"):
            p = float(name[1:])
            return f"percentile({a}, {p}) over {over}" if self.spark else f"quantile_cont({a}, {p}) over {over}"
        if name == "corr":  # of the complete pairs; null where a side hardly varies
            x, y = (f"case when {args[1 - i]} is not null then {args[i]} end" for i in (0, 1))
            size = f"((stddev_pop({x}) over {over}) * (stddev_pop({y}) over {over}))"
            return f"(case when {size} > 1e-12 then {self.div(f'(covar_pop({a}) over {over})', size)} end)"
        if name in ("skew", "kurt") and self.spark:
            n = f"(count({a}) over {over})"
            if name == "skew":
                return f"(case when {n} > 2 then skewness({a}) over {over} * sqrt({n} * ({n} - 1.0)) / ({n} - 2.0) end)"
            return f"(case when {n} > 3 then (({n} + 1.0) * (kurtosis({a}) over {over}) + 6.0) * ({n} - 1.0) / (({n} - 2.0) * ({n} - 3.0)) end)"
        real = {"skew": "skewness", "kurt": "kurtosis", "std": "stddev_pop", "std1": "stddev_samp", "last": "last" if self.spark else "last_value"}.get(name, name)
        if name == "last":
            return f"last({a}, true) over {over}" if self.spark else f"last_value({a} ignore nulls) over {over}"
        if name in ("rank", "dense_rank", "row_number"):
            return f"cast({name}() over {over} as double)"
        return f"{real}({a}) over {over}"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def render(e: E, d: Dialect, known: dict[str, str]) -> str:
    if e.key in known:
        return known[e.key]
    r = lambda x: render(x, d, known)
    op, a = e.op, e.args
    if op == "col":
        return a[0]
    if op == "lit":
        return f"cast({a[0]!r} as double)"
    if op in _BINARY:
        return f"({r(a[0])} {_BINARY[op]} {r(a[1])})"
    if op == "div":
        return d.div(r(a[0]), r(a[1]))
    if op == "neg":
        return f"(-{r(a[0])})"
    if op == "isnull":
        return f"({r(a[0])} is null)"
    if op == "isin":
        return f"({r(a[0])} in ({', '.join(map(repr, a[1]))}))"
    if op == "when":
        tail = f" else {r(a[2])}" if len(a) > 2 else ""
        return f"(case when {r(a[0])} then {r(a[1])}{tail} end)"
    if op == "fn":
        if a[0] == "round":
            return f"round({r(a[1])}, {int(a[2].args[0])})"
        name = {"sign": "sign"}.get(a[0], a[0])
        return f"{name}({', '.join(map(r, a[1:]))})"
    if op in ("lag", "lead"):
        return f"{op}({r(a[0])}, {a[1]}) over (partition by asset order by time)"
    if op == "roll":
        agg, n, mp, skip = a[:4]
        args = [r(x) for x in a[4:]]
        end = f"{skip} preceding" if skip else "current row"
        over = f"(partition by asset order by time rows between {n - 1 + skip} preceding and {end})"
        full = " and ".join(f"{x} is not null" for x in args)
        return f"(case when count(case when {full} then 1 end) over {over} >= {mp} then {d.agg(agg, args, over)} end)"
    if op == "fwd":
        over = f"(partition by asset order by time rows between 1 following and {a[1]} following)"
        return f"(case when count({r(a[2])}) over {over} >= {a[1]} then {d.agg(a[0], [r(a[2])], over)} end)"
    if op == "cum":
        return d.agg(a[0], [r(a[1])], "(partition by asset order by time rows between unbounded preceding and current row)")
    if op == "cumby":
        return d.agg(a[0], [r(a[1])], f"(partition by asset, {r(a[2])} order by time rows between unbounded preceding and current row)")
    if op == "cs":
        if a[0] in ("rank", "dense_rank", "row_number"):
            return d.agg(a[0], [], f"(partition by time order by {r(a[1])})")
        return d.agg(a[0], [r(a[1])], "(partition by time)")
    raise ValueError(op)


def _depth(e: E, memo: dict[str, int]) -> int:
    if e.key not in memo:
        inner = max((_depth(x, memo) for x in e.args if isinstance(x, E)), default=0)
        memo[e.key] = inner + (e.op in _WINDOWS)
    return memo[e.key]


def staged(outputs: dict[str, E], d: Dialect) -> tuple[list[dict[str, str]], dict[str, str]]:
    """Window columns by stage, and the final columns. A long plain part that several windows read is a column of its own too."""
    memo: dict[str, int] = {}
    nodes: dict[str, E] = {}

    def visit(e: E) -> None:
        if e.key in nodes:
            return
        nodes[e.key] = e
        for x in e.args:
            if isinstance(x, E):
                visit(x)

    for e in outputs.values():
        visit(e)
        _depth(e, memo)
    known: dict[str, str] = {}
    stages: list[dict[str, str]] = []
    windows = sorted((k for k, e in nodes.items() if e.op in _WINDOWS), key=lambda k: memo[k])
    for depth in sorted({memo[k] for k in windows}):
        here = [k for k in windows if memo[k] == depth]
        inputs = {x.key: x for k in here for x in nodes[k].args if isinstance(x, E) and x.op not in ("col", "lit") and x.key not in known}
        plain = {f"x{len(known) + i}": key for i, key in enumerate(sorted(inputs))}
        if plain:
            stages.append({name: render(inputs[key], d, known) for name, key in plain.items()})
            known |= {key: name for name, key in plain.items()}
        names = {f"w{len(known) + i}": key for i, key in enumerate(sorted(here))}
        stages.append({name: render(nodes[key], d, known) for name, key in names.items()})
        known |= {key: name for name, key in names.items()}
    return stages, {name: render(e, d, known) for name, e in outputs.items()}


def compute(panel: DataFrame, outputs: dict[str, E], keys: tuple[str, ...] = ("time", "asset"), decimals: int | None = None) -> DataFrame:
    """``keys`` and the expressions of ``outputs`` over ``panel``; each stage is one select."""
    stages, final = staged(outputs, SPARK)
    for stage in stages:
        panel = panel.selectExpr("*", *(f"{x} as {name}" for name, x in stage.items()))
    return panel.selectExpr(*keys, *(f"{_rounded(x, decimals)} as {name}" for name, x in final.items()))


def _rounded(x: str, decimals: int | None) -> str:
    return x if decimals is None else f"round({x}, {decimals}) + 0.0"


def sql(source: str, outputs: dict[str, E], keys: tuple[str, ...] = ("time", "asset"), decimals: int | None = None, where: str = "", d: Dialect = DUCK) -> str:
    """The same as a query over the named relation or (sub)query."""
    stages, final = staged(outputs, d)
    parts, last = [], source
    for i, stage in enumerate(stages):
        parts.append(f"s{i} as (select *, {', '.join(f'{x} as {name}' for name, x in stage.items())} from {last})")
        last = f"s{i}"
    head = ("with " + ", ".join(parts) + " ") if parts else ""
    return f"{head}select {', '.join(keys)}, {', '.join(f'{_rounded(x, decimals)} as {name}' for name, x in final.items())} from {last}{where}"
