"""Grouping, facets, metadata and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def terms_agg(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of a scalar or list column, trimmed, blanks skipped."""
    values = F.explode(col) if dict(df.dtypes)[col].startswith("array") else F.col(col)
    return df.select(F.btrim(values.cast("string")).alias("value") if not dict(df.dtypes)[col].startswith("array") else values.alias("value")).select(F.btrim("value").alias("value")).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def usage_stats(usage: DataFrame, dialogs: DataFrame, start: str, end: str, source: str | None) -> DataFrame:
    """Daily count, users, tokens, mean value and thumbs of one tenant's dialogs; both days included."""
    inside = usage.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY")))
    inside = inside.filter(F.col("source") == source if source is not None else F.col("source").isNull())
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")
    return inside.join(dialogs, "user_id").groupBy(day).agg(F.count(F.lit(1)).alias("pv"), F.countDistinct("user_id").alias("uv"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.avg("tokens"), 6).alias("round"), F.sum("thumb_up").alias("thumbs"))


def status_pivot(df: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    return df.groupBy(by).pivot(status, values).agg(F.count(F.lit(1))).na.fill(0)


def conditional_counts(df: DataFrame, by: str, tests: dict[str, Column]) -> DataFrame:
    return df.groupBy(by).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in tests.items()])


def doc_facets(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """(facet, key, value, count): suffixes, states, metadata values, and how many documents have none."""
    suffix = docs.groupBy(F.col("suffix").alias("value")).agg(F.count(F.lit(1)).alias("count")).select(F.lit("suffix").alias("facet"), F.lit("").alias("key"), "value", "count")
    run = docs.groupBy(F.col("run").alias("value")).agg(F.count(F.lit(1)).alias("count")).select(F.lit("run").alias("facet"), F.lit("").alias("key"), "value", "count")
    own = meta.join(docs.select("doc_id"), "doc_id", "left_semi")
    values = own.groupBy("key", "value").agg(F.count(F.lit(1)).alias("count")).select(F.lit("metadata").alias("facet"), "key", "value", "count")
    none = docs.join(meta, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("count")).select(F.lit("empty_metadata").alias("facet"), F.lit("").alias("key"), F.lit("").alias("value"), "count")
    return suffix.union(run).union(values).union(none)


def metadata_summary(meta: DataFrame) -> DataFrame:
    """(key, value, count, type): counts of values, and each key's most frequent kind."""
    kind = F.when(F.col("is_list"), "list").when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(F.col("value").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "time").otherwise("string")
    kinds = meta.groupBy("key", kind.alias("type")).agg(F.count(F.lit(1)).alias("_n")).groupBy("key").agg(F.max_by("type", F.struct("_n", "type")).alias("type"))
    return meta.groupBy("key", "value").agg(F.count(F.lit(1)).alias("count")).join(kinds, "key")


def invert_metadata(meta: DataFrame) -> DataFrame:
    """(key, value, doc_id) rows; ids are not gathered, since a common value may have any number."""
    return meta.select("key", "value", "doc_id").distinct()


def infer_types(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Each text column's majority kind: int, float, bool, datetime or text, in that order on ties. One pass."""
    tests = {}
    for c in cols:
        v = F.btrim(F.col(c))
        whole = v.rlike(r"^-?[1-9][0-9]*$")
        tests[c, "int"] = whole & v.try_cast("long").isNotNull()
        tests[c, "float"] = v.rlike(r"^-?[1-9][0-9]*\.[0-9]+$") | (whole & v.try_cast("long").isNull())
        tests[c, "bool"] = F.lower(v).isin("true", "false", "yes", "no")
        tests[c, "datetime"] = v.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}") & v.try_cast("timestamp").isNotNull()
    counts = df.agg(*[F.sum(F.when(t, 1).otherwise(0)).alias(f"{c}__{k}") for (c, k), t in tests.items()], *[F.count(F.nullif(F.btrim(c), F.lit(""))).alias(f"{c}__all") for c in cols]).first()
    out = {}
    for c in cols:
        by = {k: counts[f"{c}__{k}"] or 0 for k in ("int", "float", "bool", "datetime")}
        by["text"] = (counts[f"{c}__all"] or 0) - sum(by.values())
        out[c] = max(by, key=by.get)
    return out


def convert_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Values that don't convert become null."""
    how = {"int": "long", "float": "double", "datetime": "timestamp"}
    new = {}
    for c, k in types.items():
        v = F.btrim(F.col(c))
        new[c] = F.when(F.lower(v).isin("true", "yes"), True).when(F.lower(v).isin("false", "no"), False) if k == "bool" else v.try_cast(how[k]) if k in how else F.col(c)
    return df.withColumns(new)


def tag_portions(samples: DataFrame) -> DataFrame:
    """(tag, count, share): (count + 1) over (all + 1000)."""
    counts = samples.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    total = samples.agg(F.coalesce(F.sum(F.size("tags")), F.lit(0))).first()[0]
    return counts.select("tag", "count", ((F.col("count") + 1) / F.lit(total + 1000)).alias("share"))


def tag_scores(matches: DataFrame, portions: DataFrame, by: str, keep: int) -> DataFrame:
    """(by, tag, score) of the ``keep`` best tags among ``matches`` (by, tags of a matching sample): a tag's part of all tags
    found, smoothed, over its share in all samples; rounded half to even, ties by name."""
    c = matches.select(by, F.explode("tags").alias("tag")).groupBy(by, "tag").agg(F.count(F.lit(1)).alias("_c"))
    raw = c.join(c.groupBy(by).agg(F.sum("_c").alias("_cnt")), by).join(portions.select("tag", "share"), "tag", "left")
    share = F.greatest(F.lit(1e-6), F.coalesce("share", F.lit(1e-4)))
    scored = raw.withColumn("score", F.bround(0.1 * (F.col("_c") + 1) / (F.col("_cnt") + 1000) / share).cast("long"))
    ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "tag")))
    return ranked.filter(F.col("_n") <= keep).select(by, "tag", "score")


def tag_chunks(matches: DataFrame, portions: DataFrame, keep: int = 3) -> DataFrame:
    """(chunk_id, tag, score): of the best tags those above 0."""
    return tag_scores(matches, portions, "chunk_id", keep).filter("score > 0")


def tag_queries(matches: DataFrame, portions: DataFrame, keep: int = 3) -> DataFrame:
    """(query_id, tag, score): the best tags, each at 1 or more."""
    return tag_scores(matches, portions, "query_id", keep).withColumn("score", F.greatest("score", F.lit(1).cast("long")))


def merge_metadata(chunk_meta: DataFrame) -> DataFrame:
    """(doc_id, key, values) of (doc_id, chunk_no, key, value, is_list): lists united in order, scalars last wins."""
    lists = chunk_meta.filter("is_list").groupBy("doc_id", "key").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("chunk_no", "value")))["value"]).alias("values"))
    scalars = chunk_meta.filter("NOT is_list").groupBy("doc_id", "key").agg(F.array(F.max_by("value", F.struct("chunk_no", "value"))).alias("values"))
    return lists.union(scalars)


def _replaced(values: Column, old: str, new: str) -> Column:
    return F.transform(values, lambda v: F.when(v == old, new).otherwise(v))


def update_metadata(meta: DataFrame, ids: DataFrame, sets: dict[str, str], appends: dict[str, str], replaces: list[tuple[str, str, str]], drop_keys: list[str], drop_values: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, key, values) after a batch of changes to the documents of ``ids``; emptied keys go."""
    chosen = ids.select("doc_id").distinct()
    own, others = meta.join(chosen, "doc_id", "left_semi"), meta.join(chosen, "doc_id", "left_anti")
    values = F.col("values")
    for k, old, new in replaces:
        values = F.when(F.col("key") == k, _replaced(values, old, new)).otherwise(values)
    for k, v in appends.items():
        values = F.when((F.col("key") == k) & ~F.array_contains(values, v), F.array_append(values, F.lit(v))).otherwise(values)
    for k, v in drop_values:
        values = F.when(F.col("key") == k, F.array_remove(values, v)).otherwise(values)
    own = own.filter(~F.col("key").isin(*drop_keys, *sets)).withColumn("values", values) if drop_keys or sets else own.withColumn("values", values)
    frames = [others, own]
    for k, v in sets.items():
        frames.append(chosen.select("doc_id", F.lit(k).alias("key"), F.array(F.lit(v)).alias("values")))
    for k, v in appends.items():
        missing = chosen.join(meta.filter(F.col("key") == k), "doc_id", "left_anti")
        frames.append(missing.select("doc_id", F.lit(k).alias("key"), F.array(F.lit(v)).alias("values")))
    return reduce(DataFrame.unionByName, frames).filter(F.size("values") > 0)


def graph_preview(nodes: DataFrame, edges: DataFrame, n_nodes: int = 256, n_edges: int = 128) -> DataFrame:
    top = nodes.orderBy(F.desc("pagerank"), "name").limit(n_nodes).select("name")
    inside = edges.filter("src <> dst").join(top.withColumnRenamed("name", "src"), "src", "left_semi").join(top.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return inside.orderBy(F.desc("weight"), "src", "dst").limit(n_edges)


def list_documents(docs: DataFrame, owners: DataFrame, name_has: str, types: list[str], start: str, end: str, offset: int, limit: int) -> DataFrame:
    kept = docs.filter(F.lower("name").contains(name_has.lower()) & F.col("type").isin(types) & F.col("created").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return kept.join(owners, "owner_id", "left").orderBy(F.desc("created"), "id").offset(offset).limit(limit)


def rename_tag(df: DataFrame, col: str, old: str, new: str) -> DataFrame:
    changed = F.array_append(F.array_remove(col, old), F.lit(new))
    return df.withColumn(col, F.when(F.array_contains(col, old), changed).otherwise(F.col(col)))


def remove_tags(df: DataFrame, col: str, tags: list[str]) -> DataFrame:
    return df.withColumn(col, F.filter(col, lambda v: ~v.isin(tags)))


#: Other ways to write a metadata operator.
ALIASES = {"is": "=", "not is": "≠", "==": "=", "!=": "≠", ">=": "≥", "<=": "≤"}


def normalize_conditions(conditions: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return [(k, ALIASES.get(op.strip().lower(), op.strip().lower()), v) for k, op, v in conditions]


def _meta_test(op: str, value: str) -> Column:
    """A test of one metadata value: dates with dates, numbers with numbers, else text without case."""
    v = F.col("value")
    low, aim = F.lower(v), value.lower()
    dated = F.lit(value).rlike(r"^\d{4}-\d{2}-\d{2}$")
    number, goal = v.try_cast("double"), F.lit(value).try_cast("double")
    orders = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "≥": lambda a, b: a >= b, "≤": lambda a, b: a <= b, "=": lambda a, b: a == b, "≠": lambda a, b: a != b}
    if op in orders:
        test = orders[op]
        plain = F.when(number.isNotNull() & goal.isNotNull(), test(number, goal)).otherwise(test(low, F.lit(aim)))
        return F.when(dated, v.rlike(r"^\d{4}-\d{2}-\d{2}$") & test(v, F.lit(value))).otherwise(plain)
    return {
        "contains": lambda: low.contains(aim), "not contains": lambda: ~low.contains(aim), "in": lambda: low.isin([x.strip() for x in aim.split(",")]), "not in": lambda: ~low.isin([x.strip() for x in aim.split(",")]),
        "start with": lambda: low.startswith(aim), "end with": lambda: low.endswith(aim), "empty": lambda: v == "", "not empty": lambda: v != "",
    }[op]()


def meta_filter(meta: DataFrame, conditions: list[tuple[str, str, str]], logic: str = "and", reseed_empty: bool = False) -> DataFrame:
    """doc_ids whose metadata (doc_id, key, value) meet the conditions. Of a list's values ``contains`` and orders need
    one, the negative tests and ``in`` all. ``reseed_empty``: an empty result so far starts anew at the next condition."""
    found = None
    for key, op, value in normalize_conditions(conditions):
        rows = meta.filter(F.col("key") == key).withColumn("_ok", F.coalesce(_meta_test(op, value), F.lit(False)))
        every = F.bool_and("_ok") if op in ("not contains", "in", "not in", "≠") else F.bool_or("_ok")
        ids = rows.groupBy("doc_id").agg(every.alias("_ok")).filter("_ok").select("doc_id")
        if found is None or reseed_empty and logic == "and" and found.isEmpty():
            found = ids
        else:
            found = found.intersect(ids) if logic == "and" else found.union(ids).distinct()
    return meta.select("doc_id").distinct() if found is None else found
