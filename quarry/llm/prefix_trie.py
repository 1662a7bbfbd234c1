"""The trie of conversations' prefixes, by partition refinement.

All conversations start in one class. Each round splits the active classes by their next turn; a class left with one
sequence retires, and its tail becomes a chain of nodes with one child each; the rest goes on. Rounds are as many as the longest
prefix that two different conversations share. Then counts are folded back, level by level from the deepest, each level
into its parents. Equal conversations count as one sequence with a multiplicity, so copies make neither rounds nor rows.

Turns are kept as 128-bit digests, laid out by depth, so that a round reads its own depth, and moves ids and digests only.
The smallest id names a class, with its depth. No node's members come together: ids that end at one node are joined in
pieces of ``PIECE`` by place, and one digest over all, which is sequential, streams over the pieces.

Defined results: a null id is no conversation, and its turns go; a null role or text is empty; a null turn comes first;
turns of one number follow in order of their digest, repeated ones all stay; texts of any length count whole; no conversations give no nodes, not
even a root; columns besides the four, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.running import running_total

from .common import checkpoint, map_batches, shared_folder, table, union_all
from .importance import CRC_STEPS, crc_of

#: Ids of a node joined in one row.
PIECE = 4096

WORDS = r"[^\x20\x09-\x0D]+"


def digest_turn(role: Column, text: Column) -> Column:
    """16 bytes of a turn's role and text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv, depth from 1, digest, words) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    small = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest_turn(role, text).alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    return running_total(small, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")], F.lit(1), "depth").select("conv", F.col("depth").cast("long").alias("depth"), "digest", "words")


def refine(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame], DataFrame]:
    """``turns`` (conv, depth, digest, words) and ``convs`` (conv, n_turns, copies), one of each sequence:
    retired (conv, parent, depth), ended (conv, node, depth), shared nodes of each depth (node, parent, n_convs, words), and the
    turns as laid out."""
    spark = turns.sparkSession
    folder = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    level = F.floor(F.log2("depth")).cast("int")  # folders of doubling depths; files of a folder are sorted by depth
    turns.withColumn("level", level).repartitionByRange("depth", "conv").sortWithinPartitions("depth", "conv").write.partitionBy("level").parquet(folder)
    laid = spark.read.schema("conv long, depth long, digest binary, words long, level int").parquet(folder)
    root = convs.agg(F.min("conv").alias("node"), F.sum("copies").alias("n_convs"))
    nodes = [checkpoint(root.filter("node IS NOT NULL").select("node", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words")))]
    active = convs.crossJoin(F.broadcast(nodes[0].select("node")))  # one row
    retired, ended, d = [], [], 0
    while True:
        ended.append(active.filter(F.col("n_turns") == d).select("conv", "node", F.lit(d).cast("long").alias("depth")))
        active, d = active.filter(F.col("n_turns") > d), d + 1
        if active.isEmpty():
            break
        now = laid.filter((F.col("level") == d.bit_length() - 1) & (F.col("depth") == d)).select("conv", "digest", "words")
        moved = active.withColumnRenamed("node", "parent").join(now, "conv")
        groups = moved.groupBy("parent", "digest").agg(F.min("conv").alias("node"), F.sum("copies").alias("n_convs"), F.count(F.lit(1)).alias("n"))
        split = checkpoint(moved.join(groups, ["parent", "digest"]).select("conv", "n_turns", "copies", "node", "parent", "n_convs", "n", "words"))
        retired.append(split.filter("n = 1").select("conv", "parent", F.lit(d).cast("long").alias("depth")))
        nodes.append(split.filter("n > 1 AND conv = node").select("node", "parent", "n_convs", "words"))
        active = split.filter("n > 1").select("conv", "n_turns", "copies", "node")
    empty = spark.createDataFrame([], "conv long, parent long, depth long")
    return union_all([empty, *retired]), union_all(ended), nodes, laid


def fold_back(nodes: list[DataFrame], chains: DataFrame) -> DataFrame:
    """Shared nodes with the sums of their subtrees, deepest level first. ``chains`` has the top nodes of chains."""
    out, below = [], None
    for d in range(len(nodes) - 1, -1, -1):
        tops = chains.filter(F.col("depth") == d + 1).select("parent", "n_leaves", "saved_tokens")
        children = tops if below is None else tops.union(below.select("parent", "n_leaves", "saved_tokens"))
        sums = children.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        below = checkpoint(
            nodes[d]
            .join(sums, "node", "left")
            .select("node", F.lit(d).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("c", F.lit(0)).alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        )
        out.append(below)
    return union_all(out)


def digest_ids(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of rows (node, depth, conv): the SHA-256 of the node's ids, ascending and comma-joined."""
    placed = running_total(ends, ["node", "depth"], [F.col("conv")], F.lit(1), "place", "n")
    piece = F.floor((F.col("place") - 1) / PIECE).alias("piece")
    pieces = placed.groupBy("node", "depth", "n", piece).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    pieces = checkpoint(pieces)
    one = pieces.filter(F.col("n") <= PIECE).select("node", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            done = []
            for node, depth, ids in zip(batch["node"], batch["depth"], batch["ids"], strict=True):
                if key != (node, depth):
                    if key:
                        done.append((*key, total.hexdigest()))
                    key, total = (node, depth), hashlib.sha256(ids.encode())
                else:
                    total.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["node", "depth", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, total.hexdigest())], columns=["node", "depth", "ends_sha256"])

    many = pieces.filter(F.col("n") > PIECE).repartition("node", "depth").sortWithinPartitions("node", "depth", "piece").select("node", "depth", "ids")
    return one.union(map_batches(many, digest, "node long, depth long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node of ``turns`` (conv, depth from 1 without gaps, digest, words), members those of ``convs`` (conv, n_turns)."""
    marks = turns.groupBy("conv").agg(*[F.bit_xor(F.xxhash64(F.lit(k), "depth", "digest")).alias(f"_k{k}") for k in (1, 2)])
    keys = ["n_turns", "_k1", "_k2"]
    marked = checkpoint(convs.join(marks, "conv", "left").select("conv", "n_turns", *[F.coalesce(c, F.lit(0)).alias(c) for c in keys[1:]]))
    reps = checkpoint(marked.groupBy(*keys).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("copies")))
    first = reps.select(F.col("rep").alias("conv"), "n_turns", "copies")
    kept = turns.join(first.select("conv"), "conv", "left_semi")
    retired, ended, nodes, laid = refine(kept, first)
    retired = checkpoint(retired)

    # tails of retired sequences: words from each turn to the last
    after = [F.col("depth").desc()]
    tails = laid.select("conv", "depth", "words").join(retired.select("conv", "parent", F.col("depth").alias("top")), "conv").filter("depth >= top")
    tails = running_total(tails, ["conv"], after, F.col("words"), "rest").join(first, "conv")
    chain = checkpoint(
        tails.select(
            F.col("conv").alias("node"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent"), F.col("copies").alias("n_convs"),
            (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * F.col("rest")).alias("saved_tokens"), (F.col("depth") == F.col("top")).alias("is_top"),
        )
    )
    shared = fold_back(nodes, chain.filter("is_top"))
    done = ended.union(retired.join(first, "conv").select("conv", F.col("conv").alias("node"), F.col("n_turns").alias("depth")))
    ends = marked.join(reps, keys).select("conv", "rep").join(done.withColumnRenamed("conv", "rep"), "rep").select("node", "depth", "conv")
    none = hashlib.sha256(b"").hexdigest()
    return (
        shared.union(chain.drop("is_top").select(*shared.columns))
        .join(digest_ids(ends), ["node", "depth"], "left")
        .select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )


def share_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations rebuilt: the first h turns of each c come from conversation c - c % ``every``, h the
    crc32 of c's decimal form modulo ``most``. ``turns``: as ``number_turns`` gives them."""
    turns = checkpoint(turns)
    shares = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = (F.col("conv") - F.col("conv") % every).alias("base")
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", shares.alias("h"), base)
    heads = turns.filter((F.col("conv") % every == 0) & (F.col("depth") < most)).withColumnRenamed("conv", "base")
    sizes = heads.groupBy("base").agg(F.max("depth").alias("size"))
    convs = checkpoint(lengths.join(sizes, "base", "left").select("conv", "base", "h", "n", F.least("h", F.coalesce("size", F.lit(0))).cast("long").alias("taken")))
    given = convs.filter("h > 0").select("conv", "base", "h").join(heads, "base").filter("depth <= h").select("conv", "depth", "digest", "words")
    own = turns.join(convs.select("conv", "h", "taken"), "conv").filter("depth > h").select("conv", (F.col("taken") + F.col("depth") - F.col("h")).alias("depth"), "digest", "words")
    return checkpoint(given.union(own)), convs.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all conversations rebuilt."""
    return prefix_trie(*share_heads(number_turns(table(spark, sf_dir, "conversations"))))


OP13_SQL = rf"""
WITH RECURSIVE {CRC_STEPS},
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest, len(regexp_extract_all(text, '{WORDS}'))::BIGINT AS words,
  row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, left(sha256(strlen(role)::VARCHAR || ':' || role || text), 32)) AS rank FROM t),
ids AS (SELECT c, c - c % 20 AS b, ({crc_of("c::VARCHAR")} % 4)::BIGINT AS h FROM (SELECT DISTINCT c FROM n), crc_steps),
given AS (SELECT ids.c, rank, digest, words FROM ids JOIN n ON n.c = ids.b AND rank <= h),
rebuilt AS (SELECT c, rank, digest, words FROM given
  UNION ALL SELECT c, rank - h + (SELECT count(*) FROM given g WHERE g.c = ids.c), digest, words FROM n JOIN ids USING (c) WHERE rank > h),
path AS (SELECT c, rank AS depth, words, sha256(string_agg(digest, '' ORDER BY rank) OVER (PARTITION BY c ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (SELECT node, depth, min(c) AS conv_id, count(*)::BIGINT AS n_convs, min(words) AS words FROM path GROUP BY node, depth),
edges AS (SELECT DISTINCT p.node AS parent, k.node FROM path p JOIN path k ON p.c = k.c AND k.depth = p.depth + 1),
full_nodes AS (SELECT nodes.*, p.conv_id AS parent_conv_id, coalesce(n_children, 0)::BIGINT AS n_children FROM nodes LEFT JOIN edges USING (node)
  LEFT JOIN nodes p ON p.node = edges.parent LEFT JOIN (SELECT parent, count(*) AS n_children FROM edges GROUP BY parent) q ON q.parent = nodes.node),
below AS (SELECT a.node AS top, f.* FROM full_nodes f JOIN path a ON a.c = f.conv_id AND a.depth <= f.depth),
sums AS (SELECT top, count(*) FILTER (n_children = 0)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM below GROUP BY top),
ends AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, arg_max(node, depth) AS node FROM path GROUP BY c) GROUP BY node)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes f JOIN sums ON top = f.node LEFT JOIN ends ON ends.node = f.node
"""
