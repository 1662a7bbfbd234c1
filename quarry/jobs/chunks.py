"""Queries over chunking (C rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..registry import Tables, query
from .text import COUNT_SQL


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "chunk_order", F.md5("text").alias("h"))


#: A table of runs: ``src`` has (doc_id, i from 1, c, x, alone); g numbers the runs of ``full``.
def runs_sql(src: str, full: str) -> str:
    opens = f"(l.alone OR {full})"
    return f"""WITH RECURSIVE l AS ({src}),
r(doc_id, i, n, g) AS (SELECT doc_id, i, c, 0 FROM l WHERE i = 1
  UNION ALL SELECT r.doc_id, l.i, CASE WHEN {opens} THEN l.c ELSE r.n + l.c END, r.g + {opens}::INT FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)"""


_COUNT = COUNT_SQL.replace("text", "x")


def lines_sql(of: str) -> str:
    """(doc_id, i, x, c, alone) of the elements of ``of``, a list made of documents."""
    return f"SELECT doc_id, i, x, {_COUNT} AS c, false AS alone FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {of} AS p FROM documents))"


def merged_sql(size: int, overlap: int, of: str = "string_split(text, chr(10))") -> str:
    """(doc_id, k, x): greedy token chunks."""
    return (
        runs_sql(lines_sql(of), f"r.n > {size * (100 - overlap) / 100}")
        + f""", b AS (SELECT r.doc_id, r.g, chr(10) || string_agg(l.x, chr(10) ORDER BY l.i) AS body FROM r JOIN l ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY 1, 2),
chunks(doc_id, k, x) AS (SELECT doc_id, g, body FROM b WHERE g = 0
  UNION ALL SELECT b.doc_id, b.g, substr(c.x, floor(length(c.x) * {100 - overlap} / 100.0)::INT + 1) || b.body FROM chunks c JOIN b ON b.doc_id = c.doc_id AND b.g = c.k + 1)"""
    )


_DIGEST = " SELECT doc_id, k AS chunk_order, md5(x) AS h FROM chunks"


@query("c1_merge_by_tokens", merged_sql(128, 10) + _DIGEST)
def merge_by_tokens(t: Tables) -> DataFrame:
    return digest(C.merge_by_tokens(t.documents, 128, 10))


@query("c1_merge_no_overlap", merged_sql(64, 0) + _DIGEST)
def merge_no_overlap(t: Tables) -> DataFrame:
    return digest(C.merge_by_tokens(t.documents, 64))


_PARTS = "SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS chunk_order FROM ({})"


@query("c2_delimiter_chunks", "SELECT doc_id, chunk_order, md5(p) AS h FROM (" + _PARTS.format("SELECT doc_id, list_filter(string_split_regex(text, '\\.\\n|the '), lambda x: trim(x) <> '') AS parts FROM documents") + ")")
def delimiter_chunks(t: Tables) -> DataFrame:
    return digest(C.delimiter_chunks(t.documents, ["the ", ".\n"]))


@query("c3_split_keep_delimiter", "SELECT doc_id, chunk_order, md5(p) AS h FROM (" + _PARTS.format("SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!\\n]*[.!\\n]|[^.!\\n]+'), lambda x: trim(x, ' ' || chr(10) || chr(9)) <> '') AS parts FROM documents") + ")")
def split_keep_delimiter(t: Tables) -> DataFrame:
    return digest(C.split_keep_delimiter(t.documents, ".!\\n"))


@query("c4_token_chunk", merged_sql(256, 10) + _DIGEST)
def token_chunk(t: Tables) -> DataFrame:
    return digest(C.token_chunk(t.documents, "token_size", 256, 0.1))


def items(t: Tables) -> DataFrame:
    """A document's lines; every fifth stands for a table."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.withColumn("kind", F.when(F.col("n") % 5 == 4, "table").otherwise("text"))


#: Items as documents' lines, every fifth a table.
_ITEMS = f"SELECT doc_id, i - 1 AS n, x, {_COUNT} AS c, CASE WHEN (i - 1) % 5 = 4 THEN 'table' ELSE 'text' END AS kind FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@query("c5_merge_typed_items", runs_sql(f"SELECT doc_id, n + 1 AS i, x, c, kind, kind <> 'text' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n), '') <> 'text' AS alone FROM ({_ITEMS})", "r.n > 100")
    + " SELECT r.doc_id, r.g AS chunk_order, min(l.kind) AS kind, md5(string_agg(l.x, chr(10) ORDER BY l.i)) AS h FROM r JOIN l ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY 1, 2")
def merge_typed_items(t: Tables) -> DataFrame:
    return C.merge_typed_items(items(t), 100).select("doc_id", "chunk_order", "kind", F.md5("text").alias("h"))


@query("c6_attach_media_context", f"""
WITH it AS ({_ITEMS}),
m AS (SELECT *, coalesce(sum((kind <> 'text')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM it),
s AS (SELECT doc_id, b, n, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM (SELECT doc_id, b, n, regexp_extract_all(x, '[^.!?。！？\\n]*[.!?。！？\\n]+|[^.!?。！？\\n]+') AS p FROM m WHERE kind = 'text')),
c AS (SELECT *, {_COUNT} AS c FROM s),
w AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, b ORDER BY n DESC, j DESC ROWS UNBOUNDED PRECEDING) AS up, sum(c) OVER (PARTITION BY doc_id, b ORDER BY n, j ROWS UNBOUNDED PRECEDING) AS down FROM c),
e AS (SELECT doc_id, b, coalesce(string_agg(x, '' ORDER BY n, j) FILTER (WHERE up <= 40), '') AS before, coalesce(string_agg(x, '' ORDER BY n, j) FILTER (WHERE down <= 40), '') AS after FROM w GROUP BY 1, 2)
SELECT m.doc_id, m.n AS chunk_order, md5(CASE WHEN kind = 'text' THEN m.x ELSE coalesce(e.before, '') || m.x || coalesce(f.after, '') END) AS h
FROM m LEFT JOIN e ON m.doc_id = e.doc_id AND m.b = e.b LEFT JOIN e f ON m.doc_id = f.doc_id AND m.b + 1 = f.b""")
def attach_media_context(t: Tables) -> DataFrame:
    return digest(C.attach_media_context(items(t), 40))


@query("c7_children", "SELECT doc_id, mom_id, chunk_order, md5(p) AS h FROM (SELECT doc_id, mom_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS chunk_order FROM (SELECT doc_id, md5(text) AS mom_id, list_filter(regexp_extract_all(text, '[^\\n]*[\\n]|[^\\n]+'), lambda x: trim(x, ' ' || chr(10) || chr(9)) <> '') AS parts FROM documents))")
def children(t: Tables) -> DataFrame:
    return C.split_children(t.documents, "\\n")[0].select("doc_id", "mom_id", "chunk_order", F.md5("text").alias("h"))


@query("c7_parents", "SELECT md5(text) AS id, min(doc_id) AS doc_id, 0 AS available_int FROM documents GROUP BY text")
def parents(t: Tables) -> DataFrame:
    return C.split_children(t.documents, "\\n")[1].select("id", "doc_id", "available_int")


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_JOINED = " SELECT r.doc_id, r.g AS chunk_order, md5(string_agg(l.x, {} ORDER BY l.i)) AS h FROM r JOIN l ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY 1, 2"


@query("c8_split_text", runs_sql(lines_sql(f"list_filter(string_split_regex(text, '[\\n!?;。；！？]'), lambda p: trim(p, {_WHITE}) <> '')"), "r.n > 128") + _JOINED.format("chr(10)"))
def split_text(t: Tables) -> DataFrame:
    return digest(C.split_text(t.documents))


#: For each family of headings a higher and a lower one; documents take turns, every sixth has none.
MARKS = (("第一章 ", "（二）"), ("第3节", "4.2 "), ("五、", "(6)"), ("PART TWO ", "Section 8 "), ("# Part ", "## Sub "), ("01 ", "12 34 "))


def outlined(t: Tables) -> DataFrame:
    """Documents with a heading before every line, every third one a higher one, in a family that goes by the id."""
    high, low = (F.coalesce(*[F.when(F.pmod("doc_id", F.lit(6)) == k, m[j]) for k, m in enumerate(MARKS)]) for j in (0, 1))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, F.concat(high, i.cast("string"), F.lit("\n"))).when(i % 3 == 1, F.concat(low, F.lit("\n"))).otherwise(""), x))
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))


def _mark(j: int) -> str:
    return "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{m[j]}'" for k, m in enumerate(MARKS)) + " END"


_OUTLINED = f"SELECT doc_id, string_agg(CASE i % 3 WHEN 1 THEN {_mark(0)} || (i - 1) || chr(10) WHEN 2 THEN {_mark(1)} || chr(10) ELSE '' END || x, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1"


def _fits(patterns: tuple[str, ...]) -> str:
    return "regexp_matches(y, '^(?:" + "|".join(patterns) + ")')"


def _levels(family: str = "family") -> str:
    return "CASE " + f"WHEN {_fits(C.NO_HEADING)} THEN 0 " + " ".join(f"WHEN {family} = {k} AND {_fits((p,))} THEN {n}" for k, f in enumerate(C.HEADINGS) for n, p in enumerate(f, 1)) + " ELSE 0 END"


#: (doc_id, i, x, level): the lines of outlined documents with the levels of their headings.
_LEVELS = f"""WITH o AS ({_OUTLINED}), l AS (SELECT doc_id, i, x, trim(x, {_WHITE}) AS y FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM o)),
hits AS (SELECT doc_id, [{", ".join(f"sum((NOT {_fits(C.NO_HEADING)} AND {_fits(f)})::INT)" for f in C.HEADINGS)}] AS h FROM l GROUP BY 1),
fam AS (SELECT doc_id, CASE WHEN list_max(h) > 0 THEN list_position(h, list_max(h)) - 1 ELSE -1 END AS family FROM hits),
lv AS (SELECT doc_id, i, x, y, {_levels()} AS level FROM l JOIN fam USING (doc_id))"""


@query("c9_heading_family", _LEVELS + " SELECT doc_id, family FROM fam")
def heading_family(t: Tables) -> DataFrame:
    return C.heading_family(outlined(t))


def _tree(depth: int) -> str:
    """(doc_id, k, x): bodies under their headings; a heading's own path is found by looking back for each level."""
    stack = "".join(f", max(CASE WHEN level = {k} THEN i END) OVER w AS p{k}" for k in range(1, depth + 1))
    above = {k: "greatest(0" + "".join(f", coalesce(p{j}, 0)" for j in range(1, k)) + ")" for k in range(1, depth + 1)}
    path = ", ".join(f"CASE WHEN p{k} > {above[k]} THEN p{k} END" for k in range(1, depth + 1))
    return f"""{_LEVELS}, d AS (SELECT doc_id, i, x, y, CASE WHEN level <= {depth} THEN level ELSE 0 END AS level FROM lv),
st AS (SELECT *, sum((level > 0)::INT) OVER w AS part{stack} FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT doc_id, part, max(level) AS level, max(list_filter([{path}], lambda v: v IS NOT NULL)) AS opened, coalesce(list(x ORDER BY i) FILTER (WHERE level = 0 AND y <> ''), []) AS body FROM st GROUP BY 1, 2),
nx AS (SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY part) AS nxt FROM pt),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS k FROM nx WHERE len(body) > 0 OR part > 0 AND (nxt IS NULL OR nxt <= level)),
heads AS (SELECT doc_id, k, list(d.x ORDER BY d.i) AS p FROM (SELECT doc_id, k, unnest(opened) AS i FROM kept) u JOIN d USING (doc_id, i) GROUP BY 1, 2),
chunks AS (SELECT kept.doc_id, k, array_to_string(list_concat(coalesce(p, []), body), chr(10)) AS x FROM kept LEFT JOIN heads USING (doc_id, k))"""


_RAW = "CASE " + " ".join(f"WHEN family = {k} AND regexp_matches(z, '^(?:{p})') THEN {n}" for k, f in enumerate(C.HEADINGS) for n, p in enumerate(f, 1)) + " ELSE 0 END"


@query("c10_tree_chunks", f"""{_LEVELS},
z AS (SELECT doc_id, i, family, trim(replace(x, '　', ' '), {_WHITE}) AS z FROM l JOIN fam USING (doc_id) WHERE family >= 0),
v AS (SELECT doc_id, i, z, {_RAW} AS level FROM z WHERE length(trim(split_part(z, '@', 1), {_WHITE})) > 1 AND NOT regexp_full_match(trim(split_part(z, '@', 1), {_WHITE}), '[0-9]+')),
k AS (SELECT doc_id, i, z, CASE WHEN level > 0 AND rank <= 2 THEN rank ELSE 0 END AS level FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, level > 0 ORDER BY level) AS rank FROM v)),
p AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM k),
t AS (SELECT doc_id, part, max(level) AS level, string_agg(z, chr(10) ORDER BY i) AS x FROM p GROUP BY 1, 2),
u AS (SELECT *, lead(level) OVER w AS below, last_value(CASE WHEN level = 1 THEN x END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS above FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY part)),
c AS (SELECT doc_id, part, CASE WHEN level = 2 THEN coalesce(above || chr(10), '') ELSE '' END || x AS x FROM u WHERE level = 0 OR below IS NULL OR below <= level
  UNION ALL SELECT doc_id, i, x FROM l JOIN fam USING (doc_id) WHERE family < 0 AND y <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS chunk_order, md5(x) AS h FROM c""")
def tree_chunks(t: Tables) -> DataFrame:
    return digest(C.tree_chunks(outlined(t), 2))


@query("c11_hierarchical_chunks", _tree(2).replace("WITH o", "WITH RECURSIVE o", 1) + f""", l2 AS (SELECT doc_id, k + 1 AS i, x, contains(x, chr(10)) AS alone, CASE WHEN contains(x, chr(10)) THEN 218 ELSE {_COUNT} END AS c FROM chunks),
r(doc_id, i, n, g) AS (SELECT doc_id, i, c, 0 FROM l2 WHERE i = 1 UNION ALL SELECT r.doc_id, b.i, CASE WHEN b.alone OR r.n + b.c >= 218 THEN b.c ELSE r.n + b.c END, r.g + (b.alone OR r.n + b.c >= 218)::INT FROM r JOIN l2 b ON b.doc_id = r.doc_id AND b.i = r.i + 1)
SELECT r.doc_id, r.g AS chunk_order, md5(string_agg(b.x, chr(10) ORDER BY b.i)) AS h FROM r JOIN l2 b ON r.doc_id = b.doc_id AND r.i = b.i GROUP BY 1, 2""")  # fmt: skip
def hierarchical_chunks(t: Tables) -> DataFrame:
    return digest(C.hierarchical_chunks(outlined(t), 2))


@query("c12_drop_contents", rf"""
WITH o AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat_ws(chr(10), 'Contents', l[1], l[2], text) WHEN 1 THEN concat_ws(chr(10), l[1], '目 录', ' ', 'Xyz', text) ELSE text END AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
a AS (SELECT doc_id, string_split(text, chr(10)) AS l, coalesce(len(regexp_extract_all(text, '[`a-zA-Z0-9\s.,'':;/"?<>!\(\)\-]'))::DOUBLE / nullif(length(text), 0) > 0.8, false) AS english FROM o),
b AS (SELECT *, list_filter(range(1, len(l) + 1), lambda k: list_contains(['contents', '目录'], lower(replace(l[k], ' ', ''))))[1] AS top FROM a),
c AS (SELECT *, list_filter(range(top + 1, len(l) + 1), lambda k: trim(l[k], {_WHITE}) <> '')[1] AS entry FROM b),
d AS (SELECT *, CASE WHEN english THEN array_to_string(string_split_regex(trim(l[entry], {_WHITE}), '[ \t]+')[1:2], ' ') ELSE trim(l[entry], {_WHITE})[1:3] END AS head FROM c),
e AS (SELECT *, coalesce(list_filter(range(entry + 1, least(entry + 128, len(l)) + 1), lambda k: starts_with(trim(l[k], {_WHITE}), head))[1], entry + 1) AS again FROM d)
SELECT doc_id, 0 AS chunk_order, md5(array_to_string(CASE WHEN top IS NULL THEN l WHEN entry IS NULL THEN l[1:top - 1] ELSE list_concat(l[1:top - 1], l[again:]) END, chr(10))) AS h FROM e""")
def drop_contents(t: Tables) -> DataFrame:
    """A third with a table of its own first lines, a third with one whose entry hardly comes again, a third without."""
    first = lambda k: F.get(F.split("text", "\n"), F.lit(k))
    own = F.concat_ws("\n", F.lit("Contents"), first(0), first(1), "text")
    other = F.concat_ws("\n", first(0), F.lit("目 录\n \nXyz"), "text")
    text = F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, other).otherwise(F.col("text"))
    return digest(C.drop_contents(t.documents.filter("text IS NOT NULL").select("doc_id", text.alias("text"))))


#: Documents as Markdown: fences, lists, quotes and blank lines put among their lines.
_MARKDOWN = {0: "# ", 1: "", 2: "- ", 3: "  ", 4: "> ", 5: "```", 6: "", 7: "```", 8: "## ", 9: "### "}


def markdown(t: Tables) -> DataFrame:
    mark = lambda i: F.coalesce(*[F.when(i % 10 == k, m) for k, m in _MARKDOWN.items()])
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(mark(i), x, F.when(i % 7 == 6, F.lit("\n")).otherwise("")))
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))


_FENCED = f"""WITH o AS (SELECT doc_id, string_agg(CASE (i - 1) % 10 {" ".join(f"WHEN {k} THEN '{m}'" for k, m in _MARKDOWN.items())} END || x || CASE WHEN (i - 1) % 7 = 6 THEN chr(10) ELSE '' END, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1),
l AS (SELECT doc_id, i - 1 AS i, x, regexp_matches(x, '^[ \\t]*```') AS fence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM o)),
f AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS nf FROM l), c AS (SELECT *, fence OR nf % 2 = 1 AS code FROM f)"""


@query("c13_markdown_blocks", _FENCED + rf""",
k AS (SELECT *, CASE WHEN code THEN 'code' WHEN trim(x, {_WHITE}) = '' THEN 'blank' WHEN regexp_matches(x, '^#{{1,6}} ') THEN 'header' WHEN regexp_matches(x, '^[ 	]*([-*+]|[0-9]+\.) ') THEN 'list' WHEN regexp_matches(x, '^[ 	]*>') THEN 'quote' ELSE 'paragraph' END AS kind FROM c),
a AS (SELECT *, regexp_matches(x, '^[ 	]') AND kind NOT IN ('code', 'blank') AS deep FROM k),
g AS (SELECT *, sum((NOT deep)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS anchor FROM a),
h AS (SELECT doc_id, i, x, fence, nf, CASE WHEN deep AND max((kind = 'list')::INT) OVER (PARTITION BY doc_id, anchor ORDER BY i ROWS UNBOUNDED PRECEDING) = 1 THEN 'list' ELSE kind END AS kind FROM g),
p AS (SELECT *, CASE WHEN kind = 'code' THEN fence AND nf % 2 = 1 ELSE kind = 'header' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i) <> kind, true) END AS opens FROM h),
b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM p),
e AS (SELECT doc_id, min(kind) AS kind, min(i) AS first, max(i) AS last, md5(string_agg(x, chr(10) ORDER BY i)) AS h FROM b WHERE kind <> 'blank' GROUP BY doc_id, block)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS n, kind, first, last, h FROM e""")
def markdown_blocks(t: Tables) -> DataFrame:
    return C.markdown_blocks(markdown(t)).select("doc_id", "n", "kind", "first", "last", F.md5("text").alias("h"))


#: Documents as tables, bordered, borderless, HTML or (a line between bars) none, with a line before and one after.
_TABLES = "'before' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || replace(text, chr(10), ' | x |' || chr(10) || '| ') || ' | y |' WHEN 1 THEN 'a | b' || chr(10) || '--- | ---' || chr(10) || replace(text, chr(10), ' | x' || chr(10)) || ' | y' WHEN 2 THEN '<table class=x><tr><td>' || replace(text, chr(10), '</td></tr>' || chr(10) || '<tr><td>') || '</td></tr></table>' ELSE '| ' || text || ' |' END || chr(10) || 'after'"
_BORDERED = r"(?:\n|^)(?:\|.*?\|.*?\|.*?\n)(?:\|(?:\s*[:-]+[-| :]*\s*)\|.*?\n)(?:\|.*?\|.*?\|.*?\n)+"
_BORDERLESS = r"(?:\n|^)(?:\S.*?\|.*?\n)(?:(?:\s*[:-]+[-| :]*\s*).*?\n)(?:\S.*?\|.*?\n)+"


@query("c14_markdown_tables", rf"""
WITH a AS (SELECT doc_id, {_TABLES} AS x FROM documents), b AS (SELECT doc_id, regexp_extract_all(x, '{_BORDERED}') AS t1, regexp_replace(x, '{_BORDERED}', chr(10) || chr(10), 'g') AS x FROM a),
c AS (SELECT doc_id, t1, regexp_extract_all(x, '{_BORDERLESS}') AS t2, regexp_replace(regexp_replace(x, '{_BORDERLESS}', chr(10) || chr(10), 'g'), '<(table|td|tr)[^>]*>', '<\1>', 'g') AS x FROM b),
d AS (SELECT doc_id, t1, t2, regexp_extract_all(x, '(?s:(?:\n|^)\s*<table>.*?</table>)') AS t3, regexp_replace(x, '(?s:(?:\n|^)\s*<table>.*?</table>)', chr(10) || chr(10), 'g') AS x FROM c)
SELECT doc_id, len(t1) + len(t2) + len(t3) AS n, md5(array_to_string(list_transform(list_concat(t1, t2, t3), lambda v: trim(v, chr(10))), '#')) AS t, md5(x) AS h FROM d""")
def markdown_tables(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    bordered = F.concat(F.lit("| a | b |\n|---|:-:|\n| "), F.replace("text", F.lit("\n"), F.lit(" | x |\n| ")), F.lit(" | y |"))
    borderless = F.concat(F.lit("a | b\n--- | ---\n"), F.replace("text", F.lit("\n"), F.lit(" | x\n")), F.lit(" | y"))
    tagged = F.concat(F.lit("<table class=x><tr><td>"), F.replace("text", F.lit("\n"), F.lit("</td></tr>\n<tr><td>")), F.lit("</td></tr></table>"))
    text = F.when(k == 0, bordered).when(k == 1, borderless).when(k == 2, tagged).otherwise(F.concat(F.lit("| "), "text", F.lit(" |")))
    out = C.markdown_tables(t.documents.select("doc_id", F.concat(F.lit("before\n"), text, F.lit("\nafter")).alias("text")))
    return out.select("doc_id", F.size("tables").alias("n"), F.md5(F.array_join("tables", "#")).alias("t"), F.md5("text").alias("h"))


_MATCH = lambda t: f"<{t}[ \\t\\n>/][^>]*>.*?</{t}[ ]*>|<{t}>.*?</{t}[ ]*>"
_ENTITIES = "replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
_SPACED = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def _blocks(item_sign: str) -> str:
    """(page_id, b, x, c): block texts of the pages, which have no tables."""
    skip = "(?is)<!--.*?-->|" + "|".join(_MATCH(t) for t in C.SKIPPED)
    tags = ", ".join(f"'{t}'" for t in C.BLOCKS)
    return f"""WITH RECURSIVE tk AS (SELECT page_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '{skip}', '', 'g'), '</?[a-zA-Z][^>]*>|<![^>]*>|[^<]+|<') AS p FROM pages)),
tg AS (SELECT page_id, i, x, lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, starts_with(x, '</') AS closes FROM tk WHERE NOT starts_with(x, '<!')),
bl AS (SELECT *, sum((tag IN ({tags}))::INT) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM tg),
tx AS (SELECT page_id, b, {_ENTITIES.format(_SPACED.format("string_agg(x, ' ' ORDER BY i) FILTER (WHERE tag = '')"))} AS x,
  coalesce(max(CASE WHEN closes THEN '' WHEN regexp_matches(tag, '^h[1-6]$') THEN repeat('#', tag[2:2]::INT) || ' ' WHEN tag = 'li' THEN '{item_sign}' ELSE '' END) FILTER (WHERE tag IN ({tags})), '') AS sign FROM bl GROUP BY 1, 2),
blk AS (SELECT page_id, b, sign || x AS x FROM tx WHERE x <> '')"""


@query("c15_html_chunks", _blocks("") + f""", cn AS (SELECT page_id, b, x, {_COUNT} AS c FROM blk),
pc AS (SELECT page_id, b, c > 256 AS alone, unnest(p) AS x, generate_subscripts(p, 1) AS j, c FROM (SELECT *, CASE WHEN c > 256 THEN regexp_extract_all(x, '(?:(?:[一-龥]|[A-Za-z0-9À-ɏ]+|[^A-Za-z0-9À-ɏ一-龥 \\t\\n\\r])[ \\t\\n\\r]*){{1,256}}') ELSE [x] END AS p FROM cn)),
l AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY b, j) AS i, x, alone, CASE WHEN alone THEN 257 ELSE c END AS c FROM pc),
r(page_id, i, n, g) AS (SELECT page_id, i, c, 0 FROM l WHERE i = 1 UNION ALL SELECT r.page_id, l.i, CASE WHEN l.alone OR r.n + l.c >= 257 THEN l.c ELSE r.n + l.c END, r.g + (l.alone OR r.n + l.c >= 257)::INT FROM r JOIN l ON l.page_id = r.page_id AND l.i = r.i + 1)
SELECT r.page_id AS doc_id, r.g AS chunk_order, md5(string_agg(l.x, chr(10) ORDER BY l.i)) AS h FROM r JOIN l ON r.page_id = l.page_id AND r.i = l.i GROUP BY 1, 2""")  # fmt: skip
def html_chunks(t: Tables) -> DataFrame:
    return digest(C.html_chunks(t.pages, 256))


@query("c16_html_to_text", _blocks("- ") + f""", j AS (SELECT page_id, string_agg(trim(x, {_WHITE}), chr(10) ORDER BY b) AS x FROM blk GROUP BY 1)
SELECT p.page_id, {_ENTITIES.format(_SPACED.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS title,
  md5(coalesce(trim(regexp_replace(j.x, '[ \xa0]+', ' ', 'g'), {_WHITE}), '')) AS h FROM pages p LEFT JOIN j USING (page_id)""")
def html_to_text(t: Tables) -> DataFrame:
    return C.html_to_text(t.pages).select("page_id", "title", F.md5("text").alias("h"))


@query("c17_json_chunks")
def json_chunks(t: Tables) -> DataFrame:
    """A day's events of a user; one text for each, so that none grows with the table."""
    texts = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list("props")).alias("p"))
    named = texts.select(F.concat_ws("/", "user_id", "day").alias("doc_id"), F.concat(F.lit("["), F.array_join("p", ","), F.lit("]")).alias("text"))
    return digest(C.json_chunks(named, 40))


def two_fields(t: Tables) -> DataFrame:
    line = F.when(F.col("l_linenumber") % 2 == 1, F.concat_ws("\t", F.concat(F.lit("q"), F.col("l_linenumber").cast("string")), F.concat(F.lit("a."), "l_returnflag"))).otherwise(F.concat(F.lit("more "), "l_linestatus"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no")).agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus")).withColumn("l_linenumber", F.col("line_no")).withColumn("line", line).select("doc_id", "line_no", "line")


_LINES = "WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY 1, 2)"


@query("c18_qa_pairs", _LINES + ", m AS (SELECT *, sum((n % 2 = 1)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l) SELECT doc_id, 'q' || min(n) FILTER (WHERE n % 2 = 1) AS question, string_agg(CASE WHEN n % 2 = 1 THEN 'a.' || f ELSE 'more ' || s END, chr(10) ORDER BY n) AS answer FROM m WHERE g > 0 GROUP BY doc_id, g")
def qa_pairs(t: Tables) -> DataFrame:
    return C.qa_pairs(two_fields(t))


@query("c19_tag_samples", _LINES + ", m AS (SELECT *, sum((n % 2 = 1)::INT) OVER (PARTITION BY doc_id ORDER BY n DESC) AS g FROM l) SELECT doc_id, string_agg(CASE WHEN n % 2 = 1 THEN 'q' || n ELSE 'more ' || s END, chr(10) ORDER BY n) AS text, 'a_' || arg_max(f, n) AS tags FROM m WHERE g > 0 GROUP BY doc_id, g")
def tag_samples(t: Tables) -> DataFrame:
    out = C.tag_samples(two_fields(t))
    return out.select("doc_id", "text", F.array_join("tags", ",").alias("tags"))


_STACK = [f"CASE WHEN p{k} > greatest(-1{''.join(f', coalesce(p{j}, -1)' for j in range(1, k))}) THEN t{k} END" for k in range(1, 7)]


@query("c20_markdown_qa", _FENCED + rf""",
v AS (SELECT doc_id, i, x, CASE WHEN code THEN 0 ELSE length(regexp_extract(x, '^(#{{1,6}}) +(.*)', 1)) END AS level, trim(regexp_extract(x, '^(#{{1,6}}) +(.*)', 2), {_WHITE}) AS t FROM c),
s AS (SELECT doc_id, i, x, level, sum((level > 0)::INT) OVER w AS part{"".join(f", max(i) FILTER (WHERE level = {k}) OVER w AS p{k}, arg_max(t, i) FILTER (WHERE level = {k}) OVER w AS t{k}" for k in range(1, 7))} FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT doc_id, part, max(array_to_string(list_filter([{", ".join(_STACK)}], lambda y: y IS NOT NULL), chr(10))) AS question, trim(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), {_WHITE}) AS answer FROM s WHERE part > 0 GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS n, md5(question) AS q, md5(answer) AS a FROM p WHERE answer <> ''""")
def markdown_qa(t: Tables) -> DataFrame:
    return C.markdown_qa(markdown(t)).select("doc_id", "n", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@query("c21_one_chunk", "SELECT conv_id AS doc_id, 0 AS chunk_order, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS h FROM conversations GROUP BY 1")
def one_chunk(t: Tables) -> DataFrame:
    return digest(C.one_chunk(t.conversations.select(F.col("conv_id").alias("doc_id"), "turn", "text"), "turn"))


@query("c22_pack_chunks", merged_sql(64, 0) + f""", l2 AS (SELECT doc_id, k + 1 AS i, x, {_COUNT} AS c FROM chunks),
r2(doc_id, i, n, g) AS (SELECT doc_id, i, c, 0 FROM l2 WHERE i = 1 UNION ALL SELECT r2.doc_id, b.i, CASE WHEN r2.n + b.c >= 512 THEN b.c ELSE r2.n + b.c END, r2.g + (r2.n + b.c >= 512)::INT FROM r2 JOIN l2 b ON b.doc_id = r2.doc_id AND b.i = r2.i + 1)
SELECT r2.doc_id, r2.g AS chunk_order, md5(string_agg(b.x, '' ORDER BY b.i)) AS h FROM r2 JOIN l2 b ON r2.doc_id = b.doc_id AND r2.i = b.i GROUP BY 1, 2""")
def pack_chunks(t: Tables) -> DataFrame:
    return digest(C.pack_chunks(C.merge_by_tokens(t.documents, 64), 512))
