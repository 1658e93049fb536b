"""Filters with attribution: every row is named after the first filter it fails.

A predicate is a name, plan-time arguments and a boolean Column. Missing text is
the empty string. Force-includes override all filters and sampling.
"""

from __future__ import annotations

import ast
import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import dates

NUCLEOTIDES = ("A", "C", "G", "T")
AMINO_ACIDS = tuple("ACDEFGHIKLMNPQRSTVWY")
#: Words for a missing value: fixed values.
MISSING = ("undefined", "unknown", "?", "nan", "na", "n/a", "none", "", "not known")


@dataclass(frozen=True)
class Predicate:
    """``passes`` is true for rows that a filter keeps (or an include forces)."""

    name: str
    passes: Column
    arguments: dict = field(default_factory=dict)

    def kwargs(self) -> str:
        """Arguments as JSON with sorted keys and floats of two digits."""
        plain = {k: round(v, 2) if isinstance(v, float) else v for k, v in self.arguments.items() if isinstance(v, str | int | float | bool | list | tuple)}
        return json.dumps(plain, sort_keys=True)


def exclude_all() -> Predicate:
    return Predicate("filter_by_exclude_all", F.lit(False))


def parse_where(text: str) -> tuple[str, str, str]:
    """``column=value`` or ``column!=value`` as (column, operator, value)."""
    match = re.match(r"\s*(.*?)\s*(!=|=)\s*(.*?)\s*$", text)
    if not match:
        raise ValueError(f"not a condition: {text!r}")
    return match[1], match[2], match[3]


def _where(df: DataFrame, text: str, missing: bool) -> Column:
    column, operator, value = parse_where(text)
    if column not in df.columns:
        return F.lit(missing)
    equal = F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))) == value.lower()
    return equal if operator == "=" else ~equal


def exclude_where(df: DataFrame, text: str) -> Predicate:
    """Rows that meet the condition fail; both sides are lower-cased; no such column, no effect."""
    return Predicate("filter_by_exclude_where", ~_where(df, text, False), {"exclude_where": text})


def include_where(df: DataFrame, text: str) -> Predicate:
    """Rows that meet the condition are forced in."""
    return Predicate("force_include_where", _where(df, text, False), {"include_where": text})


def ambiguous_date(df: DataFrame, column: str = "date", by: str = "any", today: dt.date = dt.date(2100, 1, 1), name: str = "filter_by_ambiguous_date") -> Predicate:
    passes = ~dates.is_ambiguous(F.col(column), by, today) if column in df.columns else F.lit(True)
    return Predicate(name, passes, {"ambiguity": by, "date_column": column})


def min_date(limit: str | float, column: str = "date", today: dt.date = dt.date(2100, 1, 1)) -> Predicate:
    """The latest possible date is not before the limit; unknown dates fail."""
    value = dates.bound(limit, today)
    return Predicate("filter_by_min_date", F.coalesce(dates.numeric_range(F.col(column), today)["hi"] >= value, F.lit(False)), {"date_column": column, "min_date": value})


def max_date(limit: str | float, column: str = "date", today: dt.date = dt.date(2100, 1, 1)) -> Predicate:
    """The earliest possible date is not after the limit; unknown dates fail."""
    value = dates.bound(limit, today)
    return Predicate("filter_by_max_date", F.coalesce(dates.numeric_range(F.col(column), today)["lo"] <= value, F.lit(False)), {"date_column": column, "max_date": value})


def _valid_length(letters: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(letter) for letter in letters])


def min_length(least: int, letters: tuple[str, ...] = NUCLEOTIDES) -> Predicate:
    """Counts unambiguous letters of a joined sequence index; rows without one fail."""
    return Predicate("filter_by_min_length", F.coalesce(_valid_length(letters) >= least, F.lit(False)), {"min_length": least})


def max_length(most: int, letters: tuple[str, ...] = NUCLEOTIDES) -> Predicate:
    return Predicate("filter_by_max_length", F.coalesce(_valid_length(letters) <= most, F.lit(False)), {"max_length": most})


def no_invalid(column: str = "invalid_nucleotides") -> Predicate:
    return Predicate("filter_by_non_nucleotide", F.coalesce(F.col(column) == 0, F.lit(False)))


def is_present(value: Column) -> Column:
    """Not one of the words for a missing value, quotes and blanks aside."""
    return ~F.lower(F.trim(F.regexp_replace(value, "^['\"\\s]+|['\"\\s]+$", ""))).isin(*MISSING)


def with_membership(df: DataFrame, ids: DataFrame, id_column: str, flag: str) -> DataFrame:
    """``df`` with a flag for ids in a list; the list's first column holds the ids."""
    listed = ids.select(F.col(ids.columns[0]).alias(id_column)).distinct().withColumn(flag, F.lit(True))
    return df.join(listed, id_column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def excluded_ids(flag: str, source: str = "") -> Predicate:
    """Fails rows whose membership flag is set."""
    return Predicate("filter_by_exclude", ~F.col(flag), {"exclude_file": source})


def has_sequence(flag: str) -> Predicate:
    return Predicate("filter_by_sequence_ids", F.col(flag))


def included_ids(flag: str, source: str = "") -> Predicate:
    """Forces rows whose membership flag is set."""
    return Predicate("force_include_strains", F.col(flag), {"include_file": source})


def attributed(df: DataFrame, filters: list[Predicate], includes: list[Predicate] = ()) -> DataFrame:
    """``df`` with filter and kwargs (of the first filter failed, else null),
    passed, and included (names of the includes that force the row)."""
    name, kwargs = F.lit(None).cast("string"), F.lit(None).cast("string")
    for predicate in reversed(filters):
        fails = ~F.coalesce(predicate.passes, F.lit(False))
        name = F.when(fails, predicate.name).otherwise(name)
        kwargs = F.when(fails, predicate.kwargs()).otherwise(kwargs)
    forced = F.array_compact(F.array(*[F.when(F.coalesce(p.passes, F.lit(False)), p.name) for p in includes])) if includes else F.array().cast("array<string>")
    return df.withColumns({"filter": name, "kwargs": kwargs, "included": forced}).withColumn("passed", F.col("filter").isNull())


def kept(attributed_rows: DataFrame) -> DataFrame:
    """Rows that pass or are forced in."""
    return attributed_rows.where(F.col("passed") | (F.size("included") > 0))


def filter_log(attributed_rows: DataFrame, id_column: str) -> DataFrame:
    """(id, filter, kwargs) of every row dropped or forced."""
    dropped = attributed_rows.where("not passed").select(id_column, "filter", "kwargs")
    forced = attributed_rows.select(id_column, F.explode("included").alias("filter"), F.lit("{}").alias("kwargs"))
    return dropped.unionByName(forced)


def check_ids(df: DataFrame, id_column: str) -> None:
    """Raise on an empty or repeated id."""
    repeated = df.groupBy(id_column).count().where(f"count > 1 or `{id_column}` is null or `{id_column}` = ''").limit(1).collect()
    if repeated:
        raise ValueError(f"empty or repeated id {repeated[0][0]!r} in column {id_column!r}")


def check_not_empty(df: DataFrame, policy: str = "error") -> DataFrame:
    """Apply a policy (error, warn, silent) to an empty result."""
    if policy != "silent" and df.isEmpty():
        if policy == "error":
            raise ValueError("all rows have been dropped")
        print("WARNING: all rows have been dropped")
    return df


def check_arguments(group_by: list[str], group_size: int | None, total: int | None, priority: bool) -> None:
    """Combinations that have no meaning."""
    if group_size is not None and total is not None:
        raise ValueError("give a size per group or a total, not both")
    if group_size is not None and not group_by:
        raise ValueError("a size per group needs groups")
    if priority and group_size is None and total is None:
        raise ValueError("priorities need a size to sample")


_COMPARE: dict[type, Callable] = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}
_TEXT_METHODS: dict[str, Callable] = {
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
    "contains": lambda c, v: c.rlike(v),
    "match": lambda c, v: c.rlike(f"^(?:{v})"),
    "fullmatch": lambda c, v: c.rlike(f"^(?:{v})$"),
}


class Query:
    """A boolean expression over columns: comparisons, chains, and/or/not, &, |, ~,
    in and not in lists, text methods through ``.str``, and backquoted names."""

    def __init__(self, text: str, types: dict[str, str] | None = None):
        self.names: dict[str, str] = {}
        self.types = types or {}

        def plain(match: re.Match) -> str:
            name = f"_q{len(self.names)}_"
            self.names[name] = match[1]
            return name

        self.tree = ast.parse(re.sub(r"`([^`]+)`", plain, text.strip()), mode="eval").body
        self.columns = sorted({self.names.get(n.id, n.id) for n in ast.walk(self.tree) if isinstance(n, ast.Name)})

    def column(self, df: DataFrame) -> Column:
        """The expression; untyped text columns meet numbers through try_cast, so a
        blank cell compares false."""
        missing = [name for name in self.columns if name not in df.columns]
        if missing:
            raise ValueError(f"query refers to columns that do not exist: {', '.join(missing)}")
        self.kinds = dict(df.dtypes)
        return F.coalesce(self._visit(self.tree), F.lit(False))

    def _name(self, node: ast.AST) -> str | None:
        return self.names.get(node.id, node.id) if isinstance(node, ast.Name) else None

    def _operand(self, node: ast.AST, numeric: bool) -> Column:
        name = self._name(node)
        if name is None:
            return self._visit(node)
        column = F.col(f"`{name}`")
        kind = self.types.get(name)
        if kind == "bool":
            return F.when(F.lower(column) == "true", True).when(F.lower(column) == "false", False)
        if self.kinds[name] == "string" and (kind in ("int", "float") or (kind is None and numeric)):
            return column.try_cast("double")
        return column

    def _is_number(self, node: ast.AST) -> bool:
        if isinstance(node, ast.UnaryOp):
            return self._is_number(node.operand)
        if isinstance(node, ast.List | ast.Tuple):
            return bool(node.elts) and all(map(self._is_number, node.elts))
        if isinstance(node, ast.Name):
            return self.types.get(self._name(node)) in ("int", "float")
        return isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool)

    def _visit(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return self._operand(node, False)
        if isinstance(node, ast.BoolOp):
            parts = [self._visit(v) for v in node.values]
            return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), parts)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitAnd | ast.BitOr):
            a, b = self._visit(node.left), self._visit(node.right)
            return a & b if isinstance(node.op, ast.BitAnd) else a | b
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.USub):
                return -self._visit(node.operand)
            return ~F.coalesce(self._visit(node.operand), F.lit(False))
        if isinstance(node, ast.Compare):
            return self._compare(node)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            return self._call(node)
        raise ValueError(f"unsupported in a query: {ast.unparse(node)}")

    def _compare(self, node: ast.Compare) -> Column:
        terms = [node.left, *node.comparators]
        out = None
        for left, operator, right in zip(terms, node.ops, terms[1:], strict=False):
            numeric = self._is_number(left) or self._is_number(right)
            if isinstance(operator, ast.In | ast.NotIn):
                values = [ast.literal_eval(v) for v in right.elts]
                part = self._operand(left, numeric).isin(*values)
                part = ~part if isinstance(operator, ast.NotIn) else part
            else:
                part = _COMPARE[type(operator)](self._operand(left, numeric), self._operand(right, numeric))
            out = part if out is None else out & part
        return out

    def _call(self, node: ast.Call) -> Column:
        method, owner = node.func.attr, node.func.value
        is_text = isinstance(owner, ast.Attribute) and owner.attr == "str"
        base = self._visit(owner.value if is_text else owner)
        values = [ast.literal_eval(a) for a in node.args]
        if is_text and method in _TEXT_METHODS:
            return _TEXT_METHODS[method](base.cast("string"), values[0])
        if is_text and method in ("lower", "upper"):
            return F.lower(base) if method == "lower" else F.upper(base)
        if is_text and method == "len":
            return F.length(base)
        if not is_text and method == "isin":
            return base.isin(*values[0])
        if not is_text and method in ("isnull", "isna", "notnull", "notna"):
            blank = base.isNull() | (base.cast("string") == "")
            return ~blank if method.startswith("not") else blank
        raise ValueError(f"unsupported method in a query: {method}")


def by_query(df: DataFrame, text: str, types: dict[str, str] | None = None) -> Predicate:
    """A user expression as a filter; ``types`` casts columns to int, float, bool or str."""
    return Predicate("filter_by_query", Query(text, types).column(df), {"query": text})
