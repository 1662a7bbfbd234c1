"""Texts to chunks: (doc_id, chunk_order, text), in built-in expressions.

Runs of sections are cut by array folds within a row; what depends on the lines before (headings, fences, blocks) are
windows over a document's lines, so that rows move once, by document. Defined results: a null text gives no rows.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.runs import run_starts, run_texts
from ..functions.text import is_english, num_tokens

WHITE = " \t\n\r\f\v"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def numbered(df: DataFrame, pieces: Column, *keep: str) -> DataFrame:
    """A row for each of ``pieces``. The outer form, as the filter on array sizes that Spark infers from the plain one would
    work out the pieces once more, and their runs for each of them."""
    return df.select("doc_id", F.posexplode_outer(pieces).alias("chunk_order", "text"), *keep).filter("chunk_order IS NOT NULL")


def merge_by_tokens(df: DataFrame, size: int = 128, overlap: int = 0, pre_split: bool = True) -> DataFrame:
    """Greedy token chunks: a section joins the open chunk unless that already holds more than its share of ``size``
    tokens; a new one begins with the last ``overlap`` percent of the characters before it, which don't count."""
    lines = F.split("text", "\n", -1) if pre_split else F.array("text")
    cut = df.filter("text IS NOT NULL").select("doc_id", lines.alias("lines")).withColumn("starts", run_starts(F.transform("lines", num_tokens), size * (100 - overlap) / 100, after=True))
    bodies = cut.select("doc_id", F.transform(run_texts("lines", "starts", "\n"), lambda b: F.concat(F.lit("\n"), b)).alias("bodies"))
    if not overlap:
        return numbered(bodies, F.col("bodies"))

    def grow(done: Column, body: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))
        tail = F.substring(last, F.floor(F.length(last) * (100 - overlap) / 100).cast("int") + 1, F.length(last))
        return F.concat(done, F.array(F.concat(tail, body)))

    return numbered(bodies, F.aggregate("bodies", F.array().cast("array<string>"), grow))


def delimiter_chunks(df: DataFrame, delimiters: list[str]) -> DataFrame:
    """Split at whole delimiters only, longest first, and never merged."""
    pattern = "|".join(f"\\Q{d}\\E" for d in sorted(delimiters, key=len, reverse=True))
    return numbered(df, F.filter(F.split("text", pattern, -1), lambda p: F.btrim(p) != ""))


def split_keep_delimiter(df: DataFrame, marks: str) -> DataFrame:
    """Pieces with the mark they end in; blank pieces go."""
    pattern = f"[^{marks}]*[{marks}]|[^{marks}]+"
    return numbered(df, F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda p: F.btrim(p, F.lit(" \n\t")) != ""))


def token_chunk(df: DataFrame, mode: str, size: int = 512, overlap: float = 0, marks: str = "\n") -> DataFrame:
    share = int(overlap * 100) if 0 < overlap < 1 else int(overlap)
    if mode == "token_size":
        return merge_by_tokens(df, size, max(0, min(90, share)))
    return split_keep_delimiter(df, marks) if mode == "delimiter" else one_chunk(df.withColumn("n", F.lit(0)), "n")


def one_chunk(sections: DataFrame, order: str) -> DataFrame:
    """All sections of a document joined by line feeds."""
    out = sections.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct(order, "text")))["text"], "\n").alias("text"))
    return out.select("doc_id", F.lit(0).alias("chunk_order"), "text")


def merge_typed_items(items: DataFrame, size: int = 512) -> DataFrame:
    """Items (doc_id, n, kind, text): neighbouring texts merge until a chunk holds more than ``size`` tokens; tables and
    images stand alone and break the run. Returns (doc_id, chunk_order, kind, text)."""
    whole = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "kind", "text"))).alias("r")).select("doc_id", F.col("r.kind").alias("kinds"), F.col("r.text").alias("texts"))
    alone = F.transform("kinds", lambda k, i: (k != "text") | (F.coalesce(F.get("kinds", i - 1), F.lit("")) != "text"))
    cut = whole.withColumn("starts", run_starts(F.transform("texts", num_tokens), size, True, alone))
    return numbered(cut.select("doc_id", "kinds", "starts", run_texts("texts", "starts", "\n").alias("merged")), F.col("merged"), "kinds", "starts").select("doc_id", "chunk_order", F.get("kinds", F.get("starts", F.col("chunk_order"))).alias("kind"), "text")


def attach_media_context(items: DataFrame, budget: int) -> DataFrame:
    """Tables and images with sentences of the texts right before and after them, nearest first, as long as a side holds
    at most ``budget`` tokens."""
    doc = Window.partitionBy("doc_id").orderBy("n")
    marked = items.withColumn("_block", F.coalesce(F.sum((F.col("kind") != "text").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marked = marked.withColumn("_order", F.row_number().over(doc) - 1)
    sentences = marked.filter("kind = 'text'").select("doc_id", "_block", "n", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?。！？\n]*[.!?。！？\n]+|[^.!?。！？\n]+"), F.lit(0))).alias("j", "s")).withColumn("c", num_tokens(F.col("s")))
    sides = []
    for name, order in (("_before", (F.desc("n"), F.desc("j"))), ("_after", (F.asc("n"), F.asc("j")))):
        near = Window.partitionBy("doc_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        fits = sentences.withColumn("_sum", F.sum("c").over(near)).filter(F.col("_sum") <= budget)
        sides.append(fits.groupBy("doc_id", "_block").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", "j", "s")))["s"], "").alias(name)))
    media = F.col("kind") != "text"
    joined = marked.join(sides[0], ["doc_id", "_block"], "left").join(sides[1].withColumn("_block", F.col("_block") - 1), ["doc_id", "_block"], "left")
    text = F.when(media, F.concat(F.coalesce("_before", F.lit("")), "text", F.coalesce("_after", F.lit("")))).otherwise(F.col("text"))
    return joined.select("doc_id", F.col("_order").alias("chunk_order"), "kind", text.alias("text"))


def split_children(chunks: DataFrame, marks: str) -> tuple[DataFrame, DataFrame]:
    """(children, parents): each chunk split again; a parent text is kept once, hidden, under the hash of its text."""
    mom = F.md5("text")
    pieces = F.filter(F.regexp_extract_all("text", F.lit(f"[^{marks}]*[{marks}]|[^{marks}]+"), F.lit(0)), lambda p: F.btrim(p, F.lit(" \n\t")) != "")
    children = chunks.select("doc_id", mom.alias("mom_id"), F.posexplode(pieces).alias("chunk_order", "text"))
    parents = chunks.groupBy(mom.alias("id"), "text").agg(F.min("doc_id").alias("doc_id")).withColumn("available_int", F.lit(0))
    return children, parents


def split_text(df: DataFrame, size: int = 128, delimiters: str = "\n!?;。；！？") -> DataFrame:
    """Parts between delimiters, without blank ones, joined by line feeds until a chunk holds more than ``size`` tokens."""
    parts = F.filter(F.split("text", f"[{delimiters}]", -1), lambda p: trim(p) != "")
    cut = df.filter("text IS NOT NULL").select("doc_id", parts.alias("parts")).withColumn("starts", run_starts(F.transform("parts", num_tokens), size, after=True))
    return numbered(cut, run_texts("parts", "starts", "\n"))


#: Families of heading patterns, each from the highest level down; a line fits from its start.
HEADINGS = (
    (r"第[零一二三四五六七八九十百0-9]+(分?编|部分)", r"第[零一二三四五六七八九十百0-9]+章", r"第[零一二三四五六七八九十百0-9]+节", r"第[零一二三四五六七八九十百0-9]+条", r"[\(（][零一二三四五六七八九十百]+[\)）]"),
    (r"第[0-9]+章", r"第[0-9]+节", r"[0-9]{0,2}[\. 、]", r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}"),
    (r"第[零一二三四五六七八九十百0-9]+章", r"第[零一二三四五六七八九十百0-9]+节", r"[零一二三四五六七八九十百]+[ 、]", r"[\(（][零一二三四五六七八九十百]+[\)）]", r"[\(（][0-9]{0,2}[\)）]"),
    (r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", r"Chapter (I+V?|VI*|XI|IX|X)", r"Section [0-9]+", r"Article [0-9]+"),
    (r"#[^#]", r"##[^#]", r"###.*", r"####.*", r"#####.*", r"######.*"),
)
#: What begins like this is no heading.
NO_HEADING = (r"0", r"[0-9]+ +[0-9~个只-]", r"[0-9]+\.{2,}")


def fits(line: Column, patterns: tuple[str, ...]) -> Column:
    return line.rlike("^(?:" + "|".join(patterns) + ")")


def fitting(patterns: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda line: fits(line, patterns)


def with_family(df: DataFrame) -> DataFrame:
    """(doc_id, lines, family): the family whose patterns fit the most lines, the first on ties, -1 if none fits."""
    lines = df.filter("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    plain = lines.withColumn("_plain", F.filter(F.transform("lines", trim), lambda x: ~fits(x, NO_HEADING)))
    hits = plain.select("doc_id", "lines", F.array(*[F.size(F.filter("_plain", fitting(f))) for f in HEADINGS]).alias("_hits"))
    most = F.array_max("_hits")
    return hits.select("doc_id", "lines", F.when(most > 0, F.array_position("_hits", most).cast("int") - 1).otherwise(-1).alias("family"))


def heading_family(df: DataFrame) -> DataFrame:
    return with_family(df).select("doc_id", "family")


def heading_level(family: Column, line: Column) -> Column:
    """The place in the family of the first pattern that fits, 0 if none does."""
    return F.coalesce(*[F.when((family == k) & fits(line, (p,)), n) for k, f in enumerate(HEADINGS) for n, p in enumerate(f, 1)], F.lit(0))


def heading_levels(df: DataFrame) -> DataFrame:
    """(doc_id, i, line, level): the level of a heading of the document's family (1 is the highest), 0 for other lines."""
    rows = with_family(df).select("doc_id", "family", F.posexplode("lines").alias("i", "line")).withColumn("_x", trim(F.col("line")))
    return rows.select("doc_id", "i", "line", F.when(fits(F.col("_x"), NO_HEADING), 0).otherwise(heading_level(F.col("family"), F.col("_x"))).alias("level"))


def outline(lines: DataFrame, depth: int, title: Column) -> DataFrame:
    """Lines (doc_id, i, level, ...) with ``part``, the number of headings so far, and ``path``: the ``title`` of each heading
    that stands open at the line, from the highest level down. Levels are 0 (no heading) to ``depth``."""
    sofar = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    columns = {"part": F.sum((F.col("level") > 0).cast("int")).over(sofar)}
    for k in range(1, depth + 1):
        columns |= {f"_h{k}": F.last(F.when(F.col("level") == k, F.struct("i", title.alias("t"))), ignorenulls=True).over(sofar)}
    marked = lines.withColumns(columns)
    open_ = []
    for k in range(1, depth + 1):  # a heading stands while none of a higher level came after it
        above = [F.coalesce(F.col(f"_h{j}.i"), F.lit(-1)) for j in range(1, k)]
        open_.append(F.when(F.col(f"_h{k}.i") > F.greatest(F.lit(-1), *above) if above else F.col(f"_h{k}").isNotNull(), F.col(f"_h{k}.t")))
    return marked.withColumn("path", F.array_compact(F.array(*open_))).drop(*[f"_h{k}" for k in range(1, depth + 1)])


def outline_chunks(df: DataFrame, depth: int) -> DataFrame:
    """Bodies under the headings above them, down to ``depth`` levels; a heading without a body, and without a deeper
    heading next, gives its own path."""
    lines = heading_levels(df).withColumn("level", F.when(F.col("level") <= depth, F.col("level")).otherwise(0))
    parts = outline(lines, depth, F.col("line")).groupBy("doc_id", "part").agg(
        F.max("level").alias("level"), F.max("path").alias("path"),
        F.sort_array(F.collect_list(F.when((F.col("level") == 0) & (trim(F.col("line")) != ""), F.struct("i", "line"))))["line"].alias("body"),
    )
    next_level = F.lead("level").over(Window.partitionBy("doc_id").orderBy("part"))
    kept = parts.withColumn("_next", next_level).filter((F.size("body") > 0) | ((F.col("part") > 0) & (F.col("_next").isNull() | (F.col("_next") <= F.col("level")))))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return kept.select("doc_id", order.alias("chunk_order"), F.array_join(F.concat("path", "body"), "\n").alias("text"))


def tree_chunks(df: DataFrame, depth: int) -> DataFrame:
    """A chunk for each heading, of the ``depth`` highest levels that the document has, with none below it: the headings
    above with their bodies, then its own. Lines before the first heading are a chunk. Lines are trimmed; those of one
    character, of digits alone or with nothing else before an @ go. Documents without headings give their lines."""
    rows = with_family(df).select("doc_id", "family", F.posexplode("lines").alias("i", "line"))
    plain = rows.filter("family < 0").filter(trim(F.col("line")) != "").select("doc_id", F.col("i").alias("part"), F.col("line").alias("text"))
    z = rows.filter("family >= 0").withColumn("line", trim(F.translate("line", "　", " ")))
    said = trim(F.substring_index("line", "@", 1))
    z = z.filter((F.length(said) > 1) & ~said.rlike("^[0-9]+$")).withColumn("_level", heading_level(F.col("family"), F.col("line")))
    present = F.array_sort(F.collect_set(F.when(F.col("_level") > 0, F.col("_level"))).over(Window.partitionBy("doc_id")))
    rank = F.array_position(present, F.col("_level")).cast("int")
    sofar = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ranked = z.withColumn("level", F.when(rank <= depth, rank).otherwise(0)).withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(sofar))
    body = F.array_join(F.sort_array(F.collect_list(F.struct("i", "line")))["line"], "\n")
    parts = ranked.groupBy("doc_id", "part").agg(F.max("level").alias("level"), body.alias("text")).withColumnRenamed("part", "i")
    below = F.lead("level").over(Window.partitionBy("doc_id").orderBy("i"))
    most = min(depth, max(len(f) for f in HEADINGS))
    leaves = outline(parts.withColumn("_below", below), most, F.col("text")).filter((F.col("level") == 0) | F.col("_below").isNull() | (F.col("_below") <= F.col("level")))
    found = leaves.select("doc_id", F.col("i").alias("part"), F.when(F.col("level") == 0, F.col("text")).otherwise(F.array_join("path", "\n")).alias("text"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return found.unionByName(plain).select("doc_id", order.alias("chunk_order"), "text")


def gathered(chunks: DataFrame) -> DataFrame:
    """(doc_id, texts): the chunks of each document in order."""
    return chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_order", "text")))["text"].alias("texts"))


def hierarchical_chunks(df: DataFrame, depth: int, small: int = 218) -> DataFrame:
    """Outline chunks; neighbours of one line are packed below ``small`` tokens."""
    whole = gathered(outline_chunks(df, depth))
    long = lambda t: t.contains("\n")
    counts = F.transform("texts", lambda t: F.when(long(t), small).otherwise(num_tokens(t)))
    cut = whole.withColumn("starts", run_starts(counts, small, False, F.transform("texts", long)))
    return numbered(cut, run_texts("texts", "starts", "\n"))


def pack_chunks(chunks: DataFrame, most: int = 4096) -> DataFrame:
    """Chunks of a document in order, joined while their tokens stay below ``most``."""
    cut = gathered(chunks).withColumn("starts", run_starts(F.transform("texts", num_tokens), most, after=False))
    return numbered(cut, run_texts("texts", "starts", ""))


#: What stands over a table of contents, without blanks.
CONTENTS = ("contents", "目录", "目次", "tableofcontents", "致谢", "acknowledge", "acknowledgements")


def drop_contents(df: DataFrame, reach: int = 128) -> DataFrame:
    """Without tables of contents: the heading, blank lines below it and the first entry go, and what comes between that
    and the next line, of ``reach`` at most, that starts as the entry does, if there is one: with its first two words in
    English texts, its first three characters in others. Each heading that is left is treated so, in order."""
    headings = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(F.lower(F.regexp_replace(x, "[ 　\t\r]+", "")).isin(*CONTENTS), i)), lambda i: i.isNotNull())
    lines = df.filter("text IS NOT NULL").select("doc_id", is_english(F.col("text")).alias("_eng"), F.split("text", "\n", -1).alias("lines"))
    marked = lines.withColumn("_at", headings(F.col("lines"))).withColumn("n", F.size("lines"))

    def cut(state: Column, at: Column) -> Column:
        """``state``: the lines dropped so far, as (first, next) pairs, and the line to go on at."""
        below = F.slice("lines", at + 2, F.col("n"))
        entry_at = at + F.array_position(F.transform(below, lambda x: trim(x) != ""), True).cast("int")
        entry = trim(F.get("lines", entry_at))
        start = F.when(F.col("_eng"), F.array_join(F.slice(F.split(entry, "[ \t]+"), 1, 2), " ")).otherwise(F.left(entry, F.lit(3)))
        again = F.array_position(F.transform(F.slice("lines", entry_at + 2, F.lit(reach)), lambda x: F.startswith(trim(x), start)), True).cast("int")
        to = F.when(entry_at == at, F.col("n")).otherwise(entry_at + F.greatest(again, F.lit(1)))
        return F.when(at < state.next, state).otherwise(F.struct(F.array_append(state.gone, F.struct(at.alias("first"), to.alias("next"))).alias("gone"), to.alias("next")))

    none = F.struct(F.array().cast("array<struct<first:int,next:int>>").alias("gone"), F.lit(0).alias("next"))
    gone = F.aggregate("_at", none, cut).gone
    left = F.filter("lines", lambda x, i: ~F.exists("_gone", lambda g: (i >= g["first"]) & (i < g["next"])))
    kept = F.when(F.size("_gone") == 0, F.col("lines")).otherwise(left)
    return marked.withColumn("_gone", F.when(F.size("_at") > 0, gone).otherwise(none.gone)).select("doc_id", F.lit(0).alias("chunk_order"), F.array_join(kept, "\n").alias("text"))


FENCE = r"^[ \t]*```"


def fenced_lines(df: DataFrame) -> DataFrame:
    """(doc_id, i, line, fence, inside): ``fence``: the line opens or closes code; ``inside``: it is code or a fence."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("fence", F.col("line").rlike(FENCE))
    fences = F.sum(F.col("fence").cast("int")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_fences", fences).withColumn("inside", F.col("fence") | (F.col("_fences") % 2 == 1))


def markdown_blocks(df: DataFrame) -> DataFrame:
    """(doc_id, n, kind, first, last, text): headers, code, lists, quotes and paragraphs with their lines. Blocks end at
    blank lines, fences and lines of another kind; indented lines go on with a list."""
    x = F.col("line")
    kind = F.when(F.col("inside"), "code").when(trim(x) == "", "blank").when(x.rlike("^#{1,6} "), "header").when(x.rlike("^[ \t]*([-*+]|[0-9]+\\.) "), "list").when(x.rlike("^[ \t]*>"), "quote").otherwise("paragraph")
    lines = fenced_lines(df).withColumn("kind", kind).withColumn("_in", x.rlike("^[ \t]") & ~F.col("kind").isin("code", "blank"))
    doc = Window.partitionBy("doc_id").orderBy("i")
    sofar = doc.rowsBetween(Window.unboundedPreceding, 0)
    # an indented line is of a list if that line, or one since the last that isn't indented, is
    lines = lines.withColumn("_anchor", F.sum((~F.col("_in")).cast("int")).over(sofar))
    listed = F.max((F.col("kind") == "list").cast("int")).over(Window.partitionBy("doc_id", "_anchor").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("kind", F.when(F.col("_in") & (listed == 1), "list").otherwise(F.col("kind")))
    opening = F.when(F.col("kind") == "code", F.col("fence") & (F.col("_fences") % 2 == 1)).otherwise((F.col("kind") == "header") | F.coalesce(F.lag("kind").over(doc) != F.col("kind"), F.lit(True)))
    lines = lines.withColumn("_block", F.sum(opening.cast("int")).over(sofar)).filter("kind <> 'blank'")
    blocks = lines.groupBy("doc_id", "_block").agg(F.min("kind").alias("kind"), F.min("i").alias("first"), F.max("i").alias("last"), F.array_join(F.sort_array(F.collect_list(F.struct("i", "line")))["line"], "\n").alias("text"))
    return blocks.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).alias("n"), "kind", "first", "last", "text")


def markdown_qa(df: DataFrame) -> DataFrame:
    """(doc_id, n, question, answer): the headings that stand open, and the body below them; fenced lines are body."""
    heading = "^(#{1,6}) +(.*)"
    lines = fenced_lines(df).withColumn("level", F.when(~F.col("inside"), F.length(F.regexp_extract("line", heading, 1))).otherwise(0))
    parts = outline(lines, 6, trim(F.regexp_extract("line", heading, 2))).filter("part > 0").groupBy("doc_id", "part").agg(
        F.max("path").alias("path"), F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("i", "line"))))["line"].alias("body")
    )
    rows = parts.select("doc_id", "part", F.array_join("path", "\n").alias("question"), trim(F.array_join("body", "\n")).alias("answer")).filter("answer <> ''")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1).alias("n"), "question", "answer")


#: Tables stand on lines of their own: a head, a line of dashes, rows. Rows repeat possessively, so that long tables need no
#: deep recursion. Bordered lines hold three bars or more and begin with one; others begin without a blank and hold one.
BORDERED = r"(?:\n|^)(?:\|(?:[^\n|]*\|){2}[^\n]*\n)\|\s*[:-]+[-| :]*\s*\|[^\n]*\n(?:\|(?:[^\n|]*\|){2}[^\n]*\n)++"
BORDERLESS = r"(?:\n|^)\S[^\n]*?\|[^\n]*\n\s*[:-]+[-| :]*\s*[^\n]*\n(?:\S[^\n]*?\|[^\n]*\n)++"
WRAPPED = r"<html[^>]*>\s*<body[^>]*>\s*<table[^>]*>.*?</table>\s*</body>\s*</html>|<body[^>]*>\s*<table[^>]*>.*?</table>\s*</body>|<table[^>]*>.*?</table>"
HTML_TABLE = rf"(?is)(?:\n|^)\s*(?:{WRAPPED})\s*(?=\n|$)"
TABLE_ATTRIBUTES = r"(?i)<((?:table|td|tr|th|tbody|thead|div)\w*)[^>]*>"


def markdown_tables(df: DataFrame) -> DataFrame:
    """(doc_id, tables, text): bordered, then borderless, then HTML tables, and the text with a blank line for each; tags of
    HTML tables lose their attributes. A table's last row ends with a line feed; a line between bars alone is none."""
    out = df.select("doc_id", "text", F.array().cast("array<string>").alias("tables"))
    for pattern in (BORDERED, BORDERLESS, HTML_TABLE):
        if pattern is HTML_TABLE:
            out = out.withColumn("text", F.regexp_replace("text", TABLE_ATTRIBUTES, "<$1>"))
        found = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda t: F.btrim(t, F.lit("\n")))
        out = out.select("doc_id", F.regexp_replace("text", pattern, "\n\n").alias("text"), F.concat("tables", found).alias("tables"))
    return out.select("doc_id", "tables", "text")


#: HTML elements.
BLOCKS = ("p", "div", "article", "section", "header", "footer", "main", "aside", "nav", "li", "ul", "ol", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "body", "dl", "dt", "dd", "form", "figure")
SKIPPED = ("script", "style", "noscript", "template", "iframe", "svg", "head")
HTML_PIECE = r"</?[a-zA-Z][^>]*>|<![^>]*>|[^<]+|<"
HTML_SKIP = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in SKIPPED)
HTML_TITLE = r"(?is)<title[^>]*>(.*?)</title"


def resolve_entities(c: Column) -> Column:
    """Named (Latin-1, symbols and Greek) and numbered character references to what they stand for; others stay."""
    names = F.create_map(*[F.lit(x) for name, code in html.entities.name2codepoint.items() for x in (f"&{name};", chr(code))])
    pieces = F.regexp_extract_all(c, F.lit("&[a-zA-Z0-9]+;|&#[0-9]{1,7};|[^&]+|&"), F.lit(0))

    def resolved(x: Column) -> Column:
        number = F.regexp_extract(x, "^&#([0-9]+);$", 1).try_cast("int")
        real = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        by_number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"))
        return F.when(~x.startswith("&"), x).otherwise(F.coalesce(F.element_at(names, x), by_number, x))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, resolved), "")).otherwise(c)


def collapsed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[ \t\n\r\f\x0b]+", " "))


def html_blocks(pages: DataFrame, item_sign: str = "") -> DataFrame:
    """(doc_id, b, kind, text) of pages (doc_id, html): texts of blocks, headings behind their signs (and list items behind
    ``item_sign``), and tables whole with bare tags. Scripts, styles and the like are left out; texts in one block are
    joined by spaces; blocks without text give no row."""
    tokens = pages.select("doc_id", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", HTML_SKIP, ""), F.lit(HTML_PIECE), F.lit(0))).alias("i", "x"))
    tag = F.lower(F.regexp_extract("x", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    tokens = tokens.filter("x NOT LIKE '<!%'").withColumn("tag", tag).withColumn("closes", F.col("x").startswith("</"))
    doc = Window.partitionBy("doc_id").orderBy("i")
    sofar = doc.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("tag") == "table", F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    tokens = tokens.withColumn("_turn", turn).withColumn("_depth", F.sum("_turn").over(sofar))
    inside = (F.col("_depth") > 0) | ((F.col("_turn") == -1) & (F.col("_depth") == 0))
    tokens = tokens.withColumn("inside", inside)
    starts = F.when(F.col("inside"), (F.col("_turn") == 1) & (F.col("_depth") == 1)).otherwise(F.col("tag").isin(*BLOCKS) | F.coalesce(F.lag("inside").over(doc), F.lit(False)))
    tokens = tokens.withColumn("b", F.sum(starts.cast("int")).over(sofar))
    sign = F.when(~F.col("inside") & starts & ~F.col("closes"), F.when(F.col("tag").rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "))).when(F.col("tag") == "li", item_sign))
    raw = F.when(F.col("tag") == "", trim(F.col("x"))).when(F.col("closes"), F.concat(F.lit("</"), "tag", F.lit(">"))).otherwise(F.concat(F.lit("<"), "tag", F.lit(">")))
    parts = F.when(F.col("inside"), raw).when(F.col("tag") == "", F.col("x"))
    blocks = tokens.withColumns({"_sign": sign, "_part": parts}).groupBy("doc_id", "b").agg(
        F.max("inside").alias("inside"), F.max("_sign").alias("sign"), F.sort_array(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("i", "_part"))))["_part"].alias("parts")
    )
    text = resolve_entities(F.when(F.col("inside"), F.array_join("parts", "")).otherwise(collapsed(F.array_join("parts", " "))))
    named = blocks.select("doc_id", "b", F.when(F.col("inside"), "table").otherwise("text").alias("kind"), "sign", text.alias("text")).filter("text <> ''")
    return named.select("doc_id", "b", "kind", F.concat(F.coalesce("sign", F.lit("")), "text").alias("text"))


TOKEN = "[一-龥]|[A-Za-z0-9À-ɏ]+|[^A-Za-z0-9À-ɏ一-龥 \\t\\n\\r]"


def html_chunks(pages: DataFrame, size: int = 512) -> DataFrame:
    """Blocks packed up to ``size`` tokens; tables whole; a block of more is cut every ``size`` tokens."""
    blocks = html_blocks(pages.select(F.col("page_id").alias("doc_id"), "html")).withColumn("c", num_tokens(F.col("text")))
    long = (F.col("kind") == "text") & (F.col("c") > size)
    cut = F.when(long, F.regexp_extract_all("text", F.lit(f"(?:(?:{TOKEN})[ \\t\\n\\r]*){{1,{size}}}"), F.lit(0))).otherwise(F.array("text"))
    pieces = blocks.select("doc_id", "b", (long | (F.col("kind") == "table")).alias("alone"), "c", F.posexplode(cut).alias("j", "text"))
    whole = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("b", "j", "text", "alone", "c"))).alias("r")).select("doc_id", F.col("r.text").alias("texts"), F.col("r.alone").alias("alone"), F.col("r.c").alias("counts"))
    # what stands alone fills its run
    counts = F.zip_with("counts", "alone", lambda c, f: F.when(f, size + 1).otherwise(c))
    starts = run_starts(counts, size + 1, False, F.col("alone"))
    return numbered(whole.withColumn("starts", starts), run_texts("texts", "starts", "\n"))


def html_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, title, text): list items behind dashes, cells behind tabs, rows and blocks on lines of their own."""
    plain = pages.select(F.col("page_id").alias("doc_id"), F.coalesce("html", F.lit("")).alias("html"))
    table = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "</tr>", "\n"), "</t[dh]>", "\t"), "<[^>]+>", "")
    line = trim(F.regexp_replace(F.when(F.col("kind") == "table", table).otherwise(F.col("text")), "[\u200b\u200c\u200d\ufeff]", ""))
    lines = html_blocks(plain, "- ").select("doc_id", "b", line.alias("line"))
    joined = lines.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("b", "line")))["line"], "\n").alias("t"))
    text = trim(F.regexp_replace(F.regexp_replace("t", "[ \u00a0]+", " "), "\n{3,}", "\n\n"))
    titles = plain.select("doc_id", resolve_entities(collapsed(F.regexp_extract("html", HTML_TITLE, 1))).alias("title"))
    return titles.join(joined, "doc_id", "left").select(F.col("doc_id").alias("page_id"), "title", F.coalesce(text, F.lit("")).alias("text"))


def json_pieces(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters where values allow, each with the path to what it holds; lists count as
    objects keyed by index. Lines of JSON are taken line by line if the whole isn't JSON and 80 % of ten lines are."""
    def parsed(x: str) -> object:
        try:
            return json.loads(x)
        except ValueError:
            return None

    whole = parsed(text)
    if whole is None:
        lines = [x for x in text.splitlines() if x.strip()]
        good = sum(parsed(x) is not None for x in lines[:10])
        if not lines or good < 0.8 * min(10, len(lines)):
            return []
        return [c for x in lines if (v := parsed(x)) is not None for c in json_pieces(json.dumps(v, ensure_ascii=False), most)]
    out: list[dict] = [{}]

    def put(path: list[str], value: object) -> None:
        spot = out[-1]
        for k in path[:-1]:
            spot = spot.setdefault(k, {})
        spot[path[-1]] = value

    def walk(value: object, path: list[str]) -> None:
        if isinstance(value, list):
            value = {str(i): v for i, v in enumerate(value)}
        size = len(json.dumps(value, ensure_ascii=False))
        room = most - len(json.dumps(out[-1], ensure_ascii=False))
        if path and (size < room or not isinstance(value, dict) or not value):
            if size >= room and out[-1]:
                out.append({})
            put(path, value)
        elif isinstance(value, dict):
            for k, v in value.items():
                walk(v, [*path, k])
        else:
            put([""], value)

    walk(whole, [])
    return [json.dumps(x, ensure_ascii=False) for x in out if x]


def json_chunks(df: DataFrame, most: int = 2000) -> DataFrame:
    @F.pandas_udf("array<string>")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: [] if x is None else json_pieces(x, most))

    return numbered(df, run(F.col("text")))


def qa_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, question, answer) of lines (doc_id, line_no, line): two fields start a pair, other lines go on with its
    answer, lines before any pair are left out. Fields part at tabs, unless more of the lines have one comma."""
    cut = lines.groupBy("doc_id").agg(F.sum((F.size(F.split("line", "\t")) == 2).cast("int")).alias("_tabs"), F.sum((F.size(F.split("line", ",")) == 2).cast("int")).alias("_commas"))
    marked = lines.join(cut, "doc_id").withColumn("f", F.when(F.col("_commas") > F.col("_tabs"), F.split("line", ",")).otherwise(F.split("line", "\t")))
    two = F.size("f") == 2
    numbered = marked.withColumn("_pair", F.sum(two.cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no"))).filter("_pair > 0")
    rows = numbered.groupBy("doc_id", "_pair").agg(F.sort_array(F.collect_list(F.struct("line_no", F.when(two, F.get("f", F.lit(0))).alias("q"), F.when(two, F.get("f", F.lit(1))).otherwise(F.col("line")).alias("a")))).alias("r"))
    return rows.select("doc_id", F.col("r")[0]["q"].alias("question"), F.array_join(F.col("r.a"), "\n").alias("answer"))


def tag_samples(lines: DataFrame) -> DataFrame:
    """(doc_id, text, tags) of lines: a line without tags comes before the next one that has them."""
    f = F.split("line", "\t")
    two = F.size(f) == 2
    later = Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    numbered = lines.withColumn("_pair", F.sum(two.cast("int")).over(later)).filter("_pair > 0")
    rows = numbered.groupBy("doc_id", "_pair").agg(F.sort_array(F.collect_list(F.struct("line_no", F.when(two, F.get(f, F.lit(0))).otherwise(F.col("line")).alias("t"), F.when(two, F.get(f, F.lit(1))).alias("tags")))).alias("r"))
    tags = F.transform(F.split(F.element_at("r", -1)["tags"], ","), lambda x: F.regexp_replace(F.btrim(x), "\\.", "_"))
    return rows.select("doc_id", F.array_join(F.col("r.t"), "\n").alias("text"), F.filter(tags, lambda x: x != "").alias("tags"))
