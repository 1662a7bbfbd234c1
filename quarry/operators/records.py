"""Record transforms: keys, filters, lists, routing, assignment, updates and deletions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def select_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[k for k in keys if k in df.columns])


def remove_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.drop(*keys)


def rename_keys(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """In order; a column in the way of a new name goes; blank, equal and unknown names are skipped."""
    for old, new in pairs:
        if old.strip() and new.strip() and old != new and old in df.columns:
            df = df.drop(new).withColumnRenamed(old, new)
    return df


def append_or_update(df: DataFrame, updates: dict[str, Column]) -> DataFrame:
    return df.withColumns(updates)


def _compare(value: Column, op: str, target: str) -> Column:
    tests = {"=": lambda: value == target, "≠": lambda: value != target, "contains": lambda: value.contains(target), "start with": lambda: value.startswith(target), "end with": lambda: value.endswith(target)}
    return tests[op]() if op in tests else F.lit(False)


def filter_values(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows for which all (key, operator, value) hold; values compare as text, null as empty; else false."""
    tests = [_compare(F.coalesce(F.col(k).cast("string"), F.lit("")), op, v) if k in df.columns else F.lit(False) for k, op, v in rules]
    return df.filter(reduce(and_, tests, F.lit(True)))


def combine(df: DataFrame, group: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Per group an array of each column's values in order; arrays are flattened."""
    rows = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in cols]))).alias("_rows"))
    kinds = dict(df.dtypes)
    out = [(F.flatten(F.col(f"_rows._v_{c}")) if kinds[c].startswith("array") else F.col(f"_rows._v_{c}")).alias(c) for c in cols]
    return rows.select(*group, *out)


def literal_eval(c: Column) -> Column:
    """(kind, number, truth) of text that looks like a literal; other text stays text."""
    low = F.lower(F.btrim(c))
    number = c.try_cast("double")
    kind = F.when(low.isin("true", "false"), "boolean").when(low.isin("none", "null"), "null").when(number.isNotNull(), "number").when(low.rlike(r"^\[.*\]$"), "list").when(low.rlike(r"^\{.*\}$"), "object").otherwise("text")
    return F.struct(kind.alias("kind"), number.alias("number"), F.when(low.isin("true", "false"), low == "true").alias("truth"))


def _place(df: DataFrame, group: list[str], order: list[str], descending: bool) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w))


def list_top(df: DataFrame, n: int, group: list[str], order: list[str]) -> DataFrame:
    return _place(df, group, order, False).filter(F.col("_n") <= n).drop("_n")


def list_head(df: DataFrame, n: int, group: list[str], order: list[str]) -> DataFrame:
    return _place(df, group, order, False).filter(F.col("_n") == n).drop("_n")


def list_tail(df: DataFrame, n: int, group: list[str], order: list[str]) -> DataFrame:
    return _place(df, group, order, True).filter(F.col("_n") == n).drop("_n")


def list_filter(df: DataFrame, col: str, op: str, value: str) -> DataFrame:
    return df.filter(_compare(F.coalesce(F.col(col).cast("string"), F.lit("")), op, value))


def list_sort(df: DataFrame, descending: bool = False) -> DataFrame:
    cols = [F.col(c) for c in sorted(df.columns)]
    return df.orderBy(*[c.desc() if descending else c.asc() for c in cols])


def drop_duplicates(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """The first row of those equal in ``cols``; nulls are equal."""
    rest = [c for c in df.columns if c not in cols]
    first = df.groupBy(*cols).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def condition(item: tuple[str, str, str]) -> Column:
    """One (column, operator, value) test of route(): text without case, order as numbers where both are, else as text."""
    name, op, v = item
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    low, target = F.lower(text), v.lower()
    tests = {
        "contains": low.contains(target), "not contains": ~low.contains(target), "start with": low.startswith(target), "end with": low.endswith(target),
        "empty": text == "", "not empty": text != "", "=": text == v, "≠": text != v,
    }
    if op in tests:
        return tests[op]
    orders = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "≥": lambda a, b: a >= b, "≤": lambda a, b: a <= b}
    if op not in orders:
        return F.lit(False)
    number, aim = text.try_cast("double"), F.lit(v).try_cast("double")
    return F.when(number.isNotNull() & aim.isNotNull(), orders[op](number, aim)).otherwise(orders[op](text, F.lit(v)))


def route(df: DataFrame, cases: list[tuple[str, str, list[tuple[str, str, str]]]], default: str) -> DataFrame:
    """``route``: the target of the first (target, and/or, tests) that holds; no tests always hold."""
    out = None
    for target, how, items in cases:
        test = reduce(and_ if how == "and" else or_, [condition(i) for i in items]) if items else F.lit(True)
        out = F.when(test, target) if out is None else out.when(test, target)
    return df.withColumn("route", F.lit(default) if out is None else out.otherwise(default))


def first_available(groups: dict[str, list[Column]]) -> dict[str, Column]:
    """For each name the first candidate that is neither null nor empty text nor zero."""
    truthy = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), None).otherwise(c)
    return {k: F.coalesce(*[truthy(c) for c in v]) for k, v in groups.items()}


def assign(df: DataFrame, ops: list[tuple[str, str, Column | None]]) -> DataFrame:
    """Changes in place, in order; ``_error`` says where a division by zero was left out."""
    error = F.lit(None).cast("string")
    for name, op, v in ops:
        c = F.col(name)
        if op == "/=":
            error = F.coalesce(error, F.when(v == 0, F.lit(f"division by zero: {name}")))
        new = {
            "+=": lambda: c + v, "-=": lambda: c - v, "*=": lambda: c * v, "/=": lambda: F.when(v != 0, c / v).otherwise(c), "set": lambda: v, "clear": lambda: F.lit(None),
            "append": lambda: F.array_append(c, v), "extend": lambda: F.concat(c, v), "remove_first": lambda: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), "remove_last": lambda: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))),
        }[op]()
        df = df.withColumn("_error", error).withColumn(name, new.cast(dict(df.dtypes)[name]) if op != "set" else new)
        error = F.col("_error")
    return df.withColumn("_error", error)


def filter_chunks(df: DataFrame, wanted: dict) -> DataFrame:
    """Equality or membership; empty values are no condition; ``available_int`` null counts as available."""
    for k, v in wanted.items():
        if k == "available_int":
            hidden = F.coalesce(F.col(k) < 1, F.lit(False))
            df = df.filter(hidden if v == 0 else ~hidden)
        elif v not in (None, "", []):
            df = df.filter(F.col(k).isin(v) if isinstance(v, list) else F.col(k) == v)
    return df


def update_where(df: DataFrame, where: Column, sets: dict[str, Column], adds: dict[str, str] = {}, removes: dict[str, str] = {}, drops: list[str] = []) -> DataFrame:  # noqa: B006
    where = F.coalesce(where, F.lit(False))
    new = {k: F.when(where, v).otherwise(F.col(k)) for k, v in sets.items()}
    new |= {k: F.when(where, F.array_append(F.coalesce(F.col(k), F.array().cast("array<string>")), F.lit(v))).otherwise(F.col(k)) for k, v in adds.items()}
    for k, v in removes.items():  # the first match alone
        at = F.array_position(k, v).cast("int")
        cut = F.when(at > 0, F.concat(F.slice(k, 1, at - 1), F.slice(k, at + 1, F.size(k)))).otherwise(F.col(k))
        new[k] = F.when(where, cut).otherwise(F.col(k))
    new |= {k: F.when(~where, F.col(k)) for k in drops}
    return df.withColumns(new)


def delete_where(df: DataFrame, equal: dict, exists: list[str] = [], missing: list[str] = []) -> DataFrame:  # noqa: B006
    """Without rows for which all parts hold; an empty list of ids is no part."""
    tests = [F.col(k).isin(v) if isinstance(v, list) else F.col(k) == v for k, v in equal.items() if v != []]
    tests += [F.col(k).isNotNull() for k in exists] + [F.col(k).isNull() for k in missing]
    return df.filter(~F.coalesce(reduce(and_, tests, F.lit(True)), F.lit(False))) if tests else df


def to_fixed_schema(df: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """{name: (type, default)}: arrays as JSON text, a list kb_id as its first, unknown columns in ``extra`` JSON."""
    kinds, out = dict(df.dtypes), []
    for name, (kind, default) in schema.items():
        c = F.col(name) if name in kinds else F.lit(None)
        if kinds.get(name, "").startswith(("array", "map", "struct")):
            c = F.get(c, F.lit(0)) if name == "kb_id" and kinds[name].startswith("array") else F.to_json(c)
        out.append(F.coalesce(c.try_cast(kind) if name in kinds else c.cast(kind), F.lit(default).cast(kind)).alias(name))
    others = [c for c in df.columns if c not in schema]
    extra = F.to_json(F.struct(*others)) if others else F.lit(None).cast("string")
    return df.select(*out, extra.alias("extra"))
