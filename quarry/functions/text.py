"""Scalar text functions as Column expressions: tokens, counts, cleaning, script tests."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-龥"
BLANK_RUN = r"[ \t\n\r\f\v]+"


def half_width(c: Column) -> Column:
    """Full-width ASCII to plain ASCII, ideographic space to space."""
    full = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(x) for x in range(0x21, 0x7F)) + " "
    return F.translate(c, full, plain)


def tokenize(c: Column) -> Column:
    """Array of tokens: lower-case runs of Latin letters and digits; CJK characters singly."""
    spaced = F.regexp_replace(half_width(F.coalesce(c, F.lit(""))), f"([{CJK}])", " $1 ")
    words = F.split(F.lower(F.regexp_replace(spaced, f"[^a-zA-Z0-9À-ɏ{CJK}]+", " ")), " +")
    return F.filter(words, lambda w: w != "")


def fine_tokens(tokens: Column) -> Column:
    """Tokens cut at slashes, for recall."""
    return F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, "/"))), lambda t: t != "")


def num_tokens(c: Column) -> Column:
    """Words, CJK characters and marks, each one token."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"[{CJK}]|[A-Za-z0-9À-ɏ]+|[^A-Za-z0-9À-ɏ{CJK} \\t\\n\\r]"))


def truncate_tokens(c: Column, n: int) -> Column:
    """The first ``n`` whitespace-separated words."""
    return F.array_join(F.slice(F.split(F.btrim(c), BLANK_RUN), 1, n), " ")


def is_english(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(F.regexp_count(text, F.lit(r"[`a-zA-Z0-9\s.,':;/\"?<>!\(\)\-]")) / F.nullif(F.length(text), F.lit(0)) > 0.8, F.lit(False))


def is_chinese(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(F.regexp_count(text, F.lit(f"[{CJK}]")) / F.nullif(F.length(text), F.lit(0)) > 0.2, F.lit(False))


def is_chinese_query(c: Column) -> Column:
    """Three words or fewer, or at least 70 % of words not purely alphabetic."""
    words = F.split(c, "[ \\t]+")
    other = F.size(F.filter(words, lambda w: ~w.rlike("^[a-zA-Z]+$")))
    return (F.size(words) <= 3) | (other / F.size(words) >= 0.7)


#: Question words and, in English, other words that carry no content; what stands for them.
QUESTION_WORDS = (
    (r"是*(怎么办|什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*", ""),
    (r"(^| )(what|who|how|which|where|why)('re|'s)? ", " "),
    (r"(^| )('s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if) ", " "),
)


def strip_question_words(c: Column) -> Column:
    """Without question words, in any case; the text as it was if nothing is left."""
    left = c
    for pattern, by in QUESTION_WORDS:
        left = F.regexp_replace(left, "(?i)" + pattern, by)
    return F.when(left == "", c).otherwise(left)


def space_latin_cjk(c: Column) -> Column:
    """A space where CJK meets a Latin letter, or follows digits that follow one; digits alone get none."""
    for a in (f"([A-Za-z][0-9]*)([{CJK}])", f"([{CJK}])([A-Za-z])"):
        c = F.regexp_replace(c, a, "$1 $2")
    return c


def clean_query(c: Column) -> Column:
    """Lower case; separators and search syntax to single spaces."""
    return F.btrim(F.regexp_replace(half_width(F.lower(c)), "[ :|\\r\\n\\t,，。？?/`!！&^%()\\[\\]{}<>]+", " "))


#: After what, and before what, spaces are redundant.
SPACE_AFTER, SPACE_BEFORE = r"([^a-z0-9.,\)>]) +([^ ])", r"([^ ]) +([^a-z0-9.,\(<])"


def remove_redundant_spaces(c: Column) -> Column:
    """No spaces after marks that open or part, nor before marks that close or part; other scripts than Latin count as
    marks."""
    for pattern in (SPACE_AFTER, SPACE_BEFORE):
        c = F.regexp_replace(c, "(?i)" + pattern, "$1$2")
    return c


def clean_markdown_block(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"^\s*```markdown\s*\n?", ""), r"\n?\s*```\s*$", ""), F.lit(" \t\n\r"))


#: Fixed value: tags of tables.
TABLE_TAGS = r"</?(table|td|caption|tr|th)( [^<>]{0,12})?>"


def strip_table_tags(c: Column) -> Column:
    return F.regexp_replace(c, TABLE_TAGS, " ")


def clean_str(c: Column) -> Column:
    """The five common entities resolved, then double quotes and control characters dropped, ends trimmed."""
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return F.btrim(F.regexp_replace(c, "[\"\\x00-\\x1f\\x7f-\\x9f]", ""))


def garbled_ratio(c: Column) -> Column:
    """Share of private-use, replacement and control characters among those that aren't blank; 1 with a (cid:n)."""
    text = F.coalesce(c, F.lit(""))
    bad = F.regexp_count(text, F.lit(r"[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x80-\x9f]"))
    solid = F.regexp_count(text, F.lit(r"[^ \t\n\r]"))
    return F.when(text.rlike(r"\(cid:[0-9]+\)"), 1.0).otherwise(F.coalesce(bad / F.nullif(solid, F.lit(0)), F.lit(0.0)))


def is_garbled(c: Column, threshold: float = 0.5) -> Column:
    return garbled_ratio(c) >= threshold


def highlight(c: Column, keywords: list[str]) -> Column:
    """As ``highlight_any``, with every sentence searched by words; null where no sentence holds one."""
    marked = marked_sentences(c, keywords, by_words)
    return F.when(F.size(marked) > 0, F.array_join(marked, "..."))


#: Fixed value: what parts words in highlighting.
WORD_EDGES = r"[ .?/'\"\(\)!,:;-]"


def by_words(s: Column, keywords: list[str]) -> Column:
    """Keywords in <em> where edges stand on both sides; an edge serves one of two keywords beside it."""
    for k in keywords:
        s = F.regexp_replace(s, f"(?iu)(^|{WORD_EDGES})({re.escape(k)})({WORD_EDGES}|$)", "$1<em>$2</em>$3")
    return s


def literally(s: Column, keywords: list[str]) -> Column:
    """Keywords anywhere, the longest first, each written as it was given."""
    for k in sorted(keywords, key=len, reverse=True):
        s = F.regexp_replace(s, f"(?iu){re.escape(k)}", "<em>" + k.replace("\\", r"\\").replace("$", r"\$") + "</em>")
    return s


def marked_sentences(c: Column, keywords: list[str], mark: Callable[[Column, list[str]], Column]) -> Column:
    """The sentences of a text, without the marks between them, in which ``mark`` marks a keyword."""
    line = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")
    sentences = F.transform(F.split(line, "[.?!;]", -1), lambda s: F.btrim(s, F.lit(" \t\f\x0b")))
    return F.filter(F.transform(sentences, lambda s: mark(s, keywords)), lambda s: s.rlike("<em>[^<>]+</em>"))


def highlight_any(c: Column, keywords: list[str]) -> Column:
    """Sentences that hold a keyword, keywords in <em>, joined by ``...``: English ones by words, others literally, also
    inside words. Marks and line ends between sentences go; the text on one line where no sentence holds a keyword."""
    marked = marked_sentences(c, keywords, lambda s, ks: F.when(is_english(s), by_words(s, ks)).otherwise(literally(s, ks)))
    return F.when(F.size(marked) > 0, F.array_join(marked, "...")).otherwise(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " "))


def split_combined_values(c: Column) -> Column:
    """Values between list separators, trimmed, without blanks and repeats, in order."""
    parts = F.transform(F.split(c, "[、,，;；|]"), lambda v: F.btrim(v))
    return F.array_distinct(F.filter(parts, lambda v: v != ""))


def parse_tag_features(c: Column) -> Column:
    """JSON text of {tag: number} to a map; finite numbers and non-blank keys only; booleans and text values go."""
    raw = F.from_json(c, "map<string,string>")
    kept = F.map_filter(raw, lambda k, v: (F.btrim(k) != "") & F.coalesce(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), F.lit(False)))
    return F.coalesce(F.transform_values(kept, lambda k, v: v.cast("double")), F.create_map().cast("map<string,double>"))


#: Mark-up of chat messages and what stands for it.
CHAT_MARKUP = ((r"<@([A-Z0-9]+)\|([^>]+)>", "@$2"), (r"<@([A-Z0-9]+)>", "@$1"), (r"<#[A-Z0-9]+\|([^>]+)>", "#$1"), (r"<!(here|channel|everyone)>", "@$1"), (r"<(https?://[^|>]+)\|([^>]+)>", "$2"), (r"<(https?://[^>]+)>", "$1"))


def clean_chat_markup(c: Column) -> Column:
    """Mentions of users, channels and groups to plain names, links to their texts."""
    for pattern, by in CHAT_MARKUP:
        c = F.regexp_replace(c, pattern, by)
    return c


def split_email(c: Column) -> tuple[Column, Column]:
    """(address, name) of ``Name <address>`` or a bare address."""
    angle = F.regexp_extract(c, r"<([^<>]+)>", 1)
    return F.when(angle != "", angle).otherwise(F.btrim(c)), F.when(angle != "", F.btrim(F.regexp_replace(F.regexp_extract(c, r"^([^<]*)<", 1), '"', ""))).otherwise("")


def iso_to_text(c: Column) -> Column:
    return F.date_format(F.to_timestamp(c), "yyyy-MM-dd HH:mm:ss")


def epoch_ms(c: Column) -> Column:
    return F.unix_millis(c)


def number_of(c: Column) -> Column:
    return c.try_cast("double")
