"""Queries over scalar text functions (T rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import Tables, query

#: The SQL for tokens, on a column ``text``.
TOKENS_SQL = "list_filter(string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([一-龥])', ' \\1 ', 'g'), '[^a-zA-Z0-9À-ɏ一-龥]+', ' ', 'g')), ' '), lambda w: w <> '')"
COUNT_SQL = "len(regexp_extract_all(coalesce(text, ''), '[一-龥]|[A-Za-z0-9À-ɏ]+|[^A-Za-z0-9À-ɏ一-龥 \\t\\n\\r]'))"


@query("t1_tokenize", f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS h FROM (SELECT doc_id, {TOKENS_SQL} AS k FROM documents)")
def tokenize(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", X.tokenize(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("h"))


@query("t2_fine_tokens", "SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), ' ') AS fine FROM pages")
def fine_tokens(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(X.fine_tokens(F.array("url")), " ").alias("fine"))


@query("t3_num_tokens", f"SELECT doc_id, {COUNT_SQL} AS n, array_to_string(string_split_regex(trim(text), '[ \\t\\n\\r\\f\\v]+')[1:8], ' ') AS first FROM documents")
def num_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.num_tokens(F.col("text")).alias("n"), X.truncate_tokens(F.col("text"), 8).alias("first"))


#: Documents, some with Chinese characters put for some or all of their blanks.
_MIXED = "CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '中') WHEN 1 THEN '是中文的文章' || substr(text, 1, 9) ELSE text END"


def mixed(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    return t.documents.select("doc_id", F.when(k == 0, F.replace("text", F.lit(" "), F.lit("中"))).when(k == 1, F.concat(F.lit("是中文的文章"), F.substring("text", 1, 9))).otherwise(F.col("text")).alias("text"))


@query("t4_script_tests", rf"""
WITH x AS (SELECT doc_id, {_MIXED} AS text FROM documents)
SELECT doc_id, coalesce(len(regexp_extract_all(text, '[`a-zA-Z0-9\s.,'':;/"?<>!\(\)\-]'))::DOUBLE / nullif(length(text), 0) > 0.8, false) AS english,
  coalesce(len(regexp_extract_all(text, '[一-龥]'))::DOUBLE / nullif(length(text), 0) > 0.2, false) AS chinese,
  len(string_split_regex(text, '[ \t]+')) <= 3 OR len(list_filter(string_split_regex(text, '[ \t]+'), lambda w: NOT regexp_full_match(w, '[a-zA-Z]+')))::DOUBLE / len(string_split_regex(text, '[ \t]+')) >= 0.7 AS query FROM x""")
def script_tests(t: Tables) -> DataFrame:
    c = F.col("text")
    return mixed(t).select("doc_id", X.is_english(c).alias("english"), X.is_chinese(c).alias("chinese"), X.is_chinese_query(c).alias("query"))


def _stripped(q: str) -> str:
    for pattern, by in X.QUESTION_WORDS:
        q = f"regexp_replace({q}, '(?i){pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return q


_ASKED = "CASE item_id % 4 WHEN 0 THEN '请问什么是' || text || '吗' WHEN 1 THEN 'What is ' WHEN 2 THEN 'Who''s ' || replace(text, ',', ' the ') || ' and where ' ELSE text END"


@query("t5_strip_question_words", f"WITH x AS (SELECT item_id, {_ASKED} AS q FROM benchmark) SELECT item_id, CASE WHEN {_stripped('q')} = '' THEN q ELSE {_stripped('q')} END AS q FROM x")
def strip_question_words(t: Tables) -> DataFrame:
    k = F.col("item_id") % 4
    asked = F.when(k == 0, F.concat(F.lit("请问什么是"), "text", F.lit("吗"))).when(k == 1, "What is ").when(k == 2, F.concat(F.lit("Who's "), F.replace("text", F.lit(","), F.lit(" the ")), F.lit(" and where "))).otherwise(F.col("text"))
    return t.benchmark.select("item_id", X.strip_question_words(asked).alias("q"))


@query("t6_space_latin_cjk", rf"WITH x AS (SELECT doc_id, {_MIXED} AS text FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' 2024年', '([A-Za-z]+[0-9]+)([一-龥]+)', '\1 \2', 'g'), '([A-Za-z])([一-龥]+)', '\1 \2', 'g'), '([一-龥]+)([A-Za-z]+[0-9]+)', '\1 \2', 'g'), '([一-龥]+)([A-Za-z])', '\1 \2', 'g')) AS h FROM x")
def space_latin_cjk(t: Tables) -> DataFrame:
    return mixed(t).select("doc_id", F.md5(X.space_latin_cjk(F.concat("text", F.lit(" 2024年")))).alias("h"))


@query("t7_clean_query", r"SELECT item_id, trim(regexp_replace(lower(text), '[ :|\r\n\t,，。？?/`!！&^%()\[\]{}<>]+', ' ', 'g')) AS q FROM benchmark")
def clean_query(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.clean_query(F.col("text")).alias("q"))


@query("t8_redundant_spaces", rf"""SELECT doc_id, md5(regexp_replace(regexp_replace('( ' || replace(replace(text, ',', ' , '), '.', ' ! « ') || ' )', '(?i){X.SPACE_AFTER}', '\1\2', 'g'), '(?i){X.SPACE_BEFORE}', '\1\2', 'g')) AS h FROM documents""")
def redundant_spaces(t: Tables) -> DataFrame:
    spaced = F.concat(F.lit("( "), F.replace(F.replace("text", F.lit(","), F.lit(" , ")), F.lit("."), F.lit(" ! « ")), F.lit(" )"))
    return t.documents.select("doc_id", F.md5(X.remove_redundant_spaces(spaced)).alias("h"))


@query("t9_markdown_block", "SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM benchmark")
def markdown_block(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.clean_markdown_block(F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))).alias("body"))


@query("t10_table_tags", "SELECT page_id, md5(regexp_replace(html, '</?(table|td|caption|tr|th)( [^<>]{0,12})?>', ' ', 'g')) AS h FROM pages")
def table_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.strip_table_tags(F.col("html"))).alias("h"))


@query("t11_clean_str", r"""
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '["\x00-\x1f\x7f-\x{9f}]', '', 'g'))) AS h FROM pages""")
def clean_str(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.clean_str(F.col("html"))).alias("h"))


@query("t12_garbled", r"""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN repeat(chr(57344), 10) || text[1:5] WHEN doc_id % 5 = 1 THEN text || '(cid:1)' ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '\(cid:[0-9]+\)') THEN true ELSE coalesce(len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x{80}-\x{9f}]'))::DOUBLE
  / nullif(len(regexp_extract_all(text, '[^ \t\n\r]')), 0) >= 0.5, false) END AS garbled FROM x""")
def garbled(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit(""), 10), F.substring("text", 1, 5))).when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("(cid:1)"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", X.is_garbled(text).alias("garbled"))


_KEYS = ("tion", "ing", "of", "the")
#: Keywords of English sentences between edges, of others anywhere with the longest first.
_BY_WORDS, _LITERALLY = "s", "s"
for _k in _KEYS:
    _BY_WORDS = rf"""regexp_replace({_BY_WORDS}, '(^|[ .?/''"\(\)!,:;-])({_k})([ .?/''"\(\)!,:;-]|$)', '\1<em>\2</em>\3', 'gi')"""
for _k in sorted(_KEYS, key=len, reverse=True):
    _LITERALLY = f"regexp_replace({_LITERALLY}, '{_k}', '<em>{_k}</em>', 'gi')"


@query("t13_highlight", rf"""
WITH s AS (SELECT doc_id, trim(unnest(p), ' ' || chr(9) || chr(11) || chr(12)) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '[\r\n]', ' ', 'g'), '[.?!;]') AS p FROM documents)),
e AS (SELECT doc_id, i, s, coalesce(len(regexp_extract_all(s, '[`a-zA-Z0-9\s.,'':;/"?<>!\(\)\-]'))::DOUBLE / nullif(length(s), 0) > 0.8, false) AS english FROM s),
m AS (SELECT doc_id, i, CASE WHEN english THEN {_BY_WORDS} ELSE {_LITERALLY} END AS x FROM e),
j AS (SELECT doc_id, string_agg(x, '...' ORDER BY i) AS h FROM m WHERE contains(x, '<em>') GROUP BY 1)
SELECT d.doc_id, md5(coalesce(j.h, regexp_replace(d.text, '[\r\n]', ' ', 'g'))) AS h FROM documents d LEFT JOIN j USING (doc_id)""")
def highlight(t: Tables) -> DataFrame:
    """All documents, sentence by sentence: by words or literally."""
    return t.documents.select("doc_id", F.md5(X.highlight_any(F.col("text"), list(_KEYS))).alias("h"))


@query("t14_split_merge", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) || '/' || o_orderstatus AS merged FROM orders")
def split_merge(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.format_string("%s/%s", F.get(F.split("o_orderpriority", "-"), F.lit(0)), F.col("o_orderstatus")).alias("merged"))


@query("t15_combined_values", "SELECT doc_id, lang || '|' || source AS v FROM documents")
def combined_values(t: Tables) -> DataFrame:
    c = F.concat(F.lit(" "), "lang", F.lit("、 "), "source", F.lit(";;"), "lang", F.lit(" | "))
    return t.documents.select("doc_id", F.array_join(X.split_combined_values(c), "|").alias("v"))


@query("t16_tag_features", "SELECT doc_id, n_chars::DOUBLE AS chars, 1 AS n FROM documents")
def tag_features(t: Tables) -> DataFrame:
    j = F.format_string('{"%s": %d, " ": 2, "flag": true, "word": "abc"}', F.col("lang"), F.col("n_chars"))
    m = t.documents.select("doc_id", "lang", X.parse_tag_features(j).alias("m"))
    return m.select("doc_id", F.expr("m[lang]").alias("chars"), F.size("m").alias("n"))


_MARKUP = "'<@U1|bob> in <#C1|general> see <https://x.org/a|docs> <!here> <@U2> ' || text"
for _p, _by in X.CHAT_MARKUP:
    _MARKUP = f"regexp_replace({_MARKUP}, '{_p}', '{_by.replace('$', chr(92))}', 'g')"


@query("t17_chat_markup", f"SELECT conv_id, turn, {_MARKUP} AS text FROM conversations")
def chat_markup(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.clean_chat_markup(F.concat(F.lit("<@U1|bob> in <#C1|general> see <https://x.org/a|docs> <!here> <@U2> "), "text")).alias("text"))


@query("t18_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, epoch_us(ts) // 1000 AS ms FROM events")
def times(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.iso_to_text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("at"), X.epoch_ms(F.col("ts").cast("timestamp")).alias("ms"))


@query("t19_split_email", "SELECT s_suppkey, 's' || s_suppkey || '@x.org' AS address, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name FROM supplier")
def split_email(t: Tables) -> DataFrame:
    mail = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@x.org"))
    address, name = X.split_email(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"'), "s_name", F.lit('" <'), mail, F.lit(">"))).otherwise(mail))
    return t.supplier.select("s_suppkey", address.alias("address"), name.alias("name"))
