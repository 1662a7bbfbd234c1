"""The chunkers against plain versions that go through a document line by line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking as C

from . import plain_chunks as plain

WORDS = ["one", "two.", "three!", "Four", "五", "六。", "- item", "> said", "  deep", "# Top", "## Sub", "### Low", "```", "1. first", "1.2 second", "第一章 x", "（二）y", "", " ", "Contents", "(a)", "PART ONE", "Section 4", "0 no", "12 34", "日本 語"]


def documents():
    rng = random.Random(3)
    out = ["", "\n", "a", "```\ncode", "# only", "Contents", "contents\nAa\ntext\nAcknowledge\nBb\nrest\nBb", "contents\n\n", "x\n目 录\n\nAb c d\nmore\nAb c again\nend"]
    for _ in range(60):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(rng.randint(1, 40))]
        out.append("\n".join(lines))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(documents()), (-1, None)], "doc_id long, text string")


def texts(df, *cols):
    out = {}
    for r in df.orderBy("doc_id", df.columns[1]).collect():
        out.setdefault(r.doc_id, []).append(r.text if not cols else tuple(r[c] for c in cols))
    orders = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(df.columns[1])).alias("n")).collect()
    assert all(r.n == list(range(len(r.n))) for r in orders)
    return out


def hold(got, function):
    want = {k: v for k, x in enumerate(documents()) if (v := function(x))}
    assert got == want


@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (6, 0), (6, 10), (20, 35), (5, 90)])
def test_merge(docs, size, overlap):
    hold(texts(C.merge_by_tokens(docs, size, overlap)), lambda x: [c for c in plain.merge_sections(x.split("\n"), size, overlap) if c])


def test_merge_of_whole_texts(docs):
    hold(texts(C.merge_by_tokens(docs, 5, 0, pre_split=False)), lambda x: ["\n" + x])


@pytest.mark.parametrize("size", [1, 9])
def test_split_text(docs, size):
    hold(texts(C.split_text(docs, size)), lambda x: plain.split_text(x, size, "\n!?;。；！？"))


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_tree_and_hierarchical(docs, depth):
    hold(texts(C.tree_chunks(docs, depth)), lambda x: plain.tree_chunks(x.split("\n"), depth))
    hold(texts(C.hierarchical_chunks(docs, depth, 12)), lambda x: plain.hierarchical_chunks(x.split("\n"), depth, 12))


def test_levels_are_those_that_occur(spark):
    df = spark.createDataFrame([(1, "## Aa\nbody\n#### Bb\nmore\n#### Cc\nend"), (2, "no\nheading")], "doc_id long, text string")
    assert texts(C.tree_chunks(df, 2)) == {1: ["## Aa\nbody\n#### Bb\nmore", "## Aa\nbody\n#### Cc\nend"], 2: ["no", "heading"]}
    assert texts(C.tree_chunks(df, 1)) == {1: ["## Aa\nbody\n#### Bb\nmore\n#### Cc\nend"], 2: ["no", "heading"]}


def test_tables_in_markdown(spark):
    long = "| h | i |\n|---|---|\n" + "| 1 | 2 |\n" * 20_000
    cases = {
        "x\n| a | b |\n|---|---|\n| 1 | 2 |\ny": (["| a | b |\n|---|---|\n| 1 | 2 |"], "x\n\ny"),
        "x\n| line |\ny": ([], "x\n| line |\ny"),
        "x\n| a | b |\n| 1 | 2 |\ny": ([], "x\n| a | b |\n| 1 | 2 |\ny"),
        "a | b\n--- | ---\n1 | 2\n3 | 4\nend": (["a | b\n--- | ---\n1 | 2\n3 | 4"], "\n\nend"),
        "x\n<TABLE id=1><tr><td>1</td></tr></TABLE>\ny": (["<TABLE><tr><td>1</td></tr></TABLE>"], "x\n\n\ny"),
        "a <table><tr></tr></table>": ([], "a <table><tr></tr></table>"),
        long + "z": ([long.strip("\n")], "\n\nz"),
        "": ([], ""),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (r.tables, r.text) for r in C.markdown_tables(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_family(docs):
    got = {r.doc_id: r.family for r in C.heading_family(docs).collect()}
    assert got == {k: plain.choose_family(x.split("\n")) for k, x in enumerate(documents())}
    assert set(got.values()) == {-1, 0, 1, 2, 3, 4} or len(set(got.values())) >= 4


@pytest.mark.parametrize("reach", [3, 128])
def test_contents(docs, reach):
    hold(texts(C.drop_contents(docs, reach)), lambda x: ["\n".join(plain.drop_contents(x.split("\n"), reach))])


def test_markdown(docs):
    hold(texts(C.markdown_blocks(docs), "kind", "first", "last", "text"), plain.markdown_blocks)
    hold(texts(C.markdown_qa(docs), "question", "answer"), plain.markdown_qa)


def items_of(x):
    return [("table" if "three" in line else "image" if "Four" in line else "text", line) for line in x.split("\n")]


def test_items(spark):
    rows = [(k, n, kind, line) for k, x in enumerate(documents()) for n, (kind, line) in enumerate(items_of(x))]
    items = spark.createDataFrame(rows, "doc_id long, n int, kind string, text string")
    hold(texts(C.merge_typed_items(items, 8), "kind", "text"), lambda x: plain.merge_typed(items_of(x), 8))
    hold(texts(C.attach_media_context(items, 7), "kind", "text"), lambda x: plain.media_context(items_of(x), 7))


def test_pack(spark):
    rows = [(k, n, line) for k, x in enumerate(documents()) for n, line in enumerate(x.split("\n"))]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_order int, text string")
    hold(texts(C.pack_chunks(chunks, 9)), lambda x: plain.pack_windows(x.split("\n"), 9))


PAGES = [
    "<html><head><title>T &amp; U</title><style>x</style></head><body><h2>Head</h2><p>one <b>two</b></p><table><tr><td>1</td><td>2</td></tr></table><ul><li>a</li><li>b &eacute;&#233;&#8364;&unknown;</li></ul></body></html>",
    "plain text", "", "<p>open <p>paragraphs<br>here <!-- not <p> this --><script>var t='</p>';</script> end", "<div>" + "w " * 25 + "</div><p>x</p><p>y</p>",
    "<h1>A</h1><table><tr><th>h</th></tr><tr><td>in <b>bold</b></td></tr></table>tail <h3>B<div>c</div></h3>", "<body><p>a &lt;b&gt; c</p>",
]


def test_html(spark):
    pages = spark.createDataFrame([*enumerate(PAGES), (-1, None)], "page_id long, html string")
    got = {k: [t for _, t in v] for k, v in texts(C.html_chunks(pages, 8).select("doc_id", "chunk_order", "chunk_order", "text").toDF("doc_id", "o", "chunk_order", "text").select("doc_id", "chunk_order", "text"), "chunk_order", "text").items()}
    assert got == {k: v for k, x in enumerate(PAGES) if (v := plain.html_chunks(x, 8))}
    flat = {r.page_id: (r.title, r.text) for r in C.html_to_text(pages).collect()}
    assert flat == {-1: ("", "")} | {k: plain.html_to_text(x) for k, x in enumerate(PAGES)}


def test_json(spark):
    rows = [(1, '{"a": {"b": "xxxxxxxxxx", "c": [1, 2]}, "d": "yyyyyyyyyy"}'), (2, '{"a":1}\n{"b":2}'), (3, "no json"), (4, None)]
    got = texts(C.json_chunks(spark.createDataFrame(rows, "doc_id long, text string"), 40))
    assert len(got[1]) > 1 and all(len(p) <= 60 for p in got[1]) and got[2] == ['{"a": 1}', '{"b": 2}'] and set(got) == {1, 2}
    merged = {}
    for p in got[1]:
        for k, v in json.loads(p).items():
            merged.setdefault(k, {}).update(v) if isinstance(v, dict) else merged.__setitem__(k, v)
    assert merged == {"a": {"b": "xxxxxxxxxx", "c": [1, 2]}, "d": "yyyyyyyyyy"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (C.merge_by_tokens, C.split_text, C.heading_family, C.drop_contents, C.markdown_blocks, C.markdown_qa, lambda d: C.tree_chunks(d, 2), lambda d: C.hierarchical_chunks(d, 2)):
        assert f(none).count() == 0
