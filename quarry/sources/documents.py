"""Rows, listings, feeds and files to documents; unions, joins and SQL over tables; upserts and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rows_to_documents(df: DataFrame, content_cols: list[str], metadata_cols: list[str], id_col: str | None, ts_col: str | None, source: str, database: str) -> DataFrame:
    """A document per row: labelled non-null columns as content, other columns as metadata text."""
    content = F.concat_ws("\n\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"【{c}】:\n"), F.col(c).cast("string"))) for c in content_cols])
    key = F.col(id_col).cast("string") if id_col else F.md5(content)
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in metadata_cols])
    metadata = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    title = F.substring(F.regexp_replace(F.coalesce(F.col(content_cols[0]).cast("string"), F.lit("")), "[\\r\\n]", " "), 1, 100)
    at = F.col(ts_col).cast("timestamp") if ts_col else F.lit(None).cast("timestamp")
    return df.select(F.concat(F.lit(f"{source}:{database}:"), key).alias("id"), F.lit(source).alias("source"), title.alias("semantic_identifier"), content.alias("text"), at.alias("doc_updated_at"), F.octet_length(content).cast("long").alias("size_bytes"), metadata.alias("metadata"))


def files_to_documents(listing: DataFrame, prefix: str, max_bytes: int) -> DataFrame:
    """(path, size) of a listing to (id, name, size): folders and over-size files go; a base name held by several
    paths becomes the path below ``prefix`` with `` / `` between its parts."""
    files = listing.filter(~F.col("path").endswith("/") & (F.col("size") <= max_bytes)).withColumn("base", F.element_at(F.split("path", "/"), -1))
    below = F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 1 << 20)).otherwise(F.col("path"))
    names = files.groupBy(F.col("base").alias("_base")).agg(F.count(F.lit(1)).alias("_n"))
    named = files.join(names, F.col("base") == F.col("_base"))
    return named.select(F.col("path").alias("id"), F.when(F.col("_n") > 1, F.array_join(F.split(below, "/"), " / ")).otherwise(F.col("base")).alias("name"), "size")


def feed_entries_to_documents(entries: DataFrame) -> DataFrame:
    """Key: id, else link, else title; body: title and content blocks, else the summary; tags and author kept."""
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("id", "link", "title")])
    blocks = F.filter(F.coalesce("content", F.array().cast("array<string>")), lambda b: F.btrim(b) != "")
    body = F.concat_ws("\n\n", F.nullif("title", F.lit("")), F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(F.nullif("summary", F.lit(""))))
    return entries.select(F.md5(key).alias("id"), F.coalesce("title", "link").alias("semantic_identifier"), body.alias("text"), F.col("tags").alias("categories"), "author", F.to_timestamp("updated").alias("doc_updated_at"))


def read_delimited(lines: DataFrame, header: str, sep: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of text lines (column ``value``): fields must be as many as the header's; names must differ."""
    names = header.split(sep)
    if len(set(names)) != len(names):
        raise ValueError(f"the header repeats a name: {header}")
    cut = lines.filter("value <> ''").withColumn("_f", F.split("value", f"\\Q{sep}\\E", -1))
    good, bad = cut.filter(F.size("_f") == len(names)), cut.filter(F.size("_f") != len(names))
    keep = [(i, n) for i, n in enumerate(names) if n.strip().lower() not in ("", "id", "index", "_id")]
    return good.select(*[F.get("_f", F.lit(i)).alias(n) for i, n in keep]), bad.select("value")


def rows_to_chunks(df: DataFrame, cols: list[str]) -> Column:
    """``- column: value`` lines of the columns that hold something."""
    parts = [F.when(F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) != "", F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))) for c in cols]
    return F.concat_ws("\n", *parts)


def explode_passages(df: DataFrame, query_col: str, flags: str, passages: str) -> DataFrame:
    return df.select(query_col, F.explode(F.arrays_zip(F.col(flags).alias("rel"), F.col(passages).alias("passage"))).alias("_p")).select(query_col, F.col("_p.passage").alias("passage"), F.col("_p.rel").alias("rel"))


def join_qrels(qrels: DataFrame, topics: DataFrame, corpus: DataFrame) -> DataFrame:
    return qrels.join(topics, "qid").join(corpus, "docid").select("qid", "query", "docid", "text", "relevance")


def concat_tables(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_tables(frames: list[DataFrame], on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "outer"), frames)


def run_sql(spark: SparkSession, views: dict[str, DataFrame], sql: str, max_records: int = 1024) -> list[DataFrame]:
    """One frame for each statement, of ``max_records`` rows at most; decimals as doubles, NaN and infinities as null."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = []
    for statement in (x.strip() for x in sql.split(";")):
        if statement:
            df = spark.sql(statement).limit(max_records)
            cols = []
            for name, kind in df.dtypes:
                c = F.col(f"`{name}`")
                if kind.startswith("decimal"):
                    c = c.cast("double")
                elif kind in ("double", "float"):
                    c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
                cols.append(c.alias(name))
            out.append(df.select(*cols))
    return out


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both by key, the latest write of each: incoming before existing, then by ``order``."""
    both = existing.withColumn("_w", F.lit(0)).unionByName(incoming.withColumn("_w", F.lit(1)))
    rest = [c for c in existing.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_w", order)).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*existing.columns)


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    df.write.mode("overwrite").options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)


def row_number(df: DataFrame, partition: list[str], order: list, out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
