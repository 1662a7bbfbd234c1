"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) P(token | class, history). Both factors are log-linear in hashed features of the
history: the last word, the last two, and the words one and two further back by themselves (skips). The class is drawn
by a softmax. A class has very many members, so its own softmax is factored once more: its members are the leaves of a
balanced binary tree, and each inner node is a softmax of two over features (node, history).

* Types. All counts of the training corpus are a Spark aggregate and stay a table. Frequent tokens (at most a
  sixteenth of the types) have leaves of their own, in classes of even summed roots of counts. The others are the
  last class, whose leaves are hash buckets of about ``BUCKET`` types; within a bucket a token has its smoothed relative count,
  which is joined in. In histories each rare token counts as itself, by its hash.
* Prior. With all weights zero a token has probability (c + 1) / (N + V + buckets): the biases of nodes and classes are
  the summed counts below them, so probabilities of all types and of one unknown token in each bucket add up to 1.
* Training. A round is a distributed gradient update at shared weights: tasks add up the gradients of all their tokens
  in sparse numpy batches, blocks of the sums are merged level by level (``FAN_IN`` parts in a group), and each weight
  moves by gradient over curvature, as the first round measured it. Sums don't depend on how rows are dealt to tasks.

Weights grow with the types (one for ``TYPES_A_WEIGHT`` of them, a power of two) and so do leaves, up to ``max_weights``
and ``max_head``, the memory of a task; the count table that is joined in has no limit. A task of the gradient pass
reads ``READ`` times what its weights are, so that what is merged stays in proportion to the input.

Defined results: a null text counts as empty: one end token. Repeated rows count and are scored each; ties in counts go by
the token's bytes. Texts of any length are taken in slices. Without training documents all counts are 0 and the only token type
is the unknown one, of probability 1. Columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, hide_null, ready, show_null, table
from .text_ids import slices

END = b""
#: Stands before a text.
START = -1
#: Distinct tokens a task adds up before it hands on what it has.
HELD = 400_000
#: Floats in a block of summed gradients, and parts that one group adds up.
BLOCK, FAN_IN = 1 << 16, 16
#: Tokens a batch holds; bytes of text cut into tokens at once.
SLICE, CUT = 1 << 14, 1 << 21
BUCKET, TYPES_A_WEIGHT, READ = 1024, 8, 16
#: Classes, with that of rare tokens; how far back the features of classes and of nodes look.
CLASSES = 16
CLASS_FEATURES = ((1,), (1, 2), (2,), (3,))
NODE_FEATURES = ((1,), (1, 2), (2,))


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def cut_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, places, lengths): the distinct tokens, each token's place among them, and the tokens of each text, as ``tokens``
    has them. ``texts``: binary."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    coded, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
    words, index = coded.dictionary, coded.indices.to_numpy()
    end = pc.index(words, "").as_py()  # blanks at both ends of a text leave empty words
    if end < 0:
        words, end = pa.concat_arrays([words, pa.array([""])]), len(words)
    full = index != end
    upto = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
    held, n = np.diff(upto), len(texts)
    places = np.full(upto[-1] + n, end, np.int64)
    places[np.arange(upto[-1]) + np.repeat(np.arange(n), held)] = index[full]
    return words.view(pa.binary()), places, held + 1


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(rows, words, places, lengths) of runs of rows of about ``CUT`` bytes of text."""
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        for first, n in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), CUT):
            yield b.slice(first, n), *cut_tokens(texts.slice(first, n))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow, with the workers made ready."""
    ready(df.sparkSession)
    return df.mapInArrow(function, schema)


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(token binary, c long) over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, words, places, _ in cut_batches(batches):
            held.append(pa.table({"token": words, "c": np.bincount(places, minlength=len(words))}))
            size += len(words)
            if size > HELD:
                held = [pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["token", "c"])]
                size = len(held[0])
                if size > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        for t in held:
            yield from t.to_batches()

    plain = docs.select(F.col(text_col).cast("binary").alias("text"))
    return checkpoint(map_arrow(plain, count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))


def frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The tokens above a count that at most ``size`` tokens reach, most frequent first."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 16 rows for each doubling
    least, total = None, 0
    for r in levels:
        total += r["count"]
        if total > size:
            break
        least = r["level"]
    if least is None:
        return []
    rows = counts.filter(level >= least).collect()
    return sorted(((bytes(r["token"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Codes(dict):
    """Tokens to codes: frequent ones by rank, in which order they stand here; a rare one to its hash, behind those."""

    @cached_property
    def frequent(self) -> pa.Array:
        return pa.array(list(self), pa.binary())

    def of(self, words: pa.Array) -> np.ndarray:
        known = pc.index_in(words, value_set=self.frequent)
        found, rare = known.fill_null(0).to_numpy().astype(np.int64), known.is_null()
        hashes = map(zlib.crc32, words.filter(rare).to_numpy(zero_copy_only=False))
        found[rare.to_numpy(zero_copy_only=False)] = len(self) + np.fromiter(hashes, np.int64)
        return found


class Leaves:
    """Classes, their trees and the prior. Leaves are the frequent tokens by rank, then the buckets of rare ones."""

    def __init__(self, head: np.ndarray, buckets: np.ndarray) -> None:
        """``head``: c + 1 of frequent tokens, most frequent first; ``buckets``: the sum of c + 1, and 1, of each bucket."""
        mass = np.concatenate((head, buckets)).astype(np.float64)
        self.frequent, self.buckets = len(head), len(buckets)
        roots = np.sqrt(head.astype(np.float64)).cumsum()
        of = (roots - np.sqrt(head) / 2) * (CLASSES - 1) / roots[-1] if len(head) else roots
        of = np.unique(of.astype(np.int64), return_inverse=True)[1]  # classes without members get no number
        self.classes = int(of.max()) + 2 if len(head) else 1
        self.leaf_class = np.concatenate((of, np.full(len(buckets), self.classes - 1))).astype(np.int64)
        share = np.bincount(self.leaf_class, weights=mass, minlength=self.classes)
        self.prior = share / share.sum()
        #: How deep each leaf lies, its place in its class's tree, and what comes before that tree's nodes.
        depths, places, bases, bias, base = [], [], [], [], 0
        for k in range(self.classes):
            m = mass[self.leaf_class == k]
            depth = int(len(m) - 1).bit_length()
            sums = np.zeros(2 << depth)  # node 1 is the root; node i has the children 2 i and 2 i + 1
            sums[1 << depth : (1 << depth) + len(m)] = m
            for level in range(depth - 1, -1, -1):
                at = np.arange(1 << level, 2 << level)
                sums[at] = sums[2 * at] + sums[2 * at + 1]
            inner = np.arange(1 << depth)
            left, right = sums[2 * inner], sums[2 * inner + 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                bias.append(np.where(left > 0, np.log(right / left), 0))  # a node with one child, the left, goes there for certain
            places.append((1 << depth) + np.arange(len(m)))
            depths.append(np.full(len(m), depth, np.uint8))
            bases.append(np.full(len(m), base))
            base += 1 << depth
        self.depths, self.places, self.bases = np.concatenate(depths), np.concatenate(places), np.concatenate(bases)
        self.bias = np.concatenate(bias).astype(np.float32)
        p = 1 / (1 + np.exp(-np.concatenate(bias)))
        #: What each node adds to gradient and curvature (the imaginary part) before any round; going right adds 1.
        self.first = (p * (1 - p) * 1j - p).astype(np.complex64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < self.frequent, codes, self.frequent + ((codes - self.frequent) & (self.buckets - 1)))

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``leaf``, node, goes right) of every step to each of ``leaf``; steps of equally deep leaves lie together, level
        by level."""
        depth = self.depths[leaf]
        groups = [(d, np.flatnonzero(depth == d)) for d in np.flatnonzero(np.bincount(depth)).tolist()]
        n = sum(d * len(g) for d, g in groups)
        who, node, right = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        first = 0
        for d, g in groups:
            part, shape = slice(first, first + d * len(g)), (d, len(g))
            who[part].reshape(shape)[:] = g
            down = np.arange(d - 1, -1, -1)[:, None]
            child = right[part].reshape(shape)
            np.right_shift(self.places[leaf[g]], down, out=child)
            np.right_shift(child, 1, out=node[part].reshape(shape))
            node[part].reshape(shape)[:] += self.bases[leaf[g]]
            first += d * len(g)
        right &= 1
        return who, node, right


def mix(x: np.ndarray, k: int) -> np.ndarray:
    h = (x + np.uint64((k + 1) << 50)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def keys(stream: np.ndarray, at: np.ndarray, features: tuple) -> list[np.ndarray]:
    """For each feature a 64-bit hash of the words that many places before each of ``at``."""
    back = {k: stream[at - k].view(np.uint64) for k in {k for f in features for k in f}}
    found = []
    for f in features:
        x = back[f[0]]
        for k in f[1:]:
            x = x * np.uint64(0xD6E8FEB86659FD93) + back[k]
        found.append(mix(x, sum(1 << k for k in f)))
    return found


def cells(key: np.ndarray, size: int) -> np.ndarray:
    """Cells of a table of ``size`` (a power of two) weights."""
    return (key * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(65 - size.bit_length())).view(np.int64) if size > 1 else np.zeros(len(key), np.int64)


@dataclass
class Weights:
    """``by_class`` [feature, row, class] and ``by_node`` [cell], and the curvature that steps are divided by."""

    by_class: np.ndarray
    by_node: np.ndarray
    class_curve: np.ndarray
    node_curve: np.ndarray

    @staticmethod
    def zero(size: int, classes: int) -> Weights:
        rows = max(1, size // (len(CLASS_FEATURES) * CLASSES))
        shape = (len(CLASS_FEATURES), rows, classes)
        return Weights(np.zeros(shape, np.float32), np.zeros(size, np.float32), np.zeros(shape, np.float32), np.zeros(size, np.float32))


class Step:
    """What a batch of tokens asks of the weights: the cells it meets and the probabilities there."""

    def __init__(self, leaves: Leaves, w: Weights, stream: np.ndarray, at: np.ndarray) -> None:
        self.leaf = leaves.of(stream[at])
        self.kind = leaves.leaf_class[self.leaf]
        self.rows = [cells(k, w.by_class.shape[1]) for k in keys(stream, at, CLASS_FEATURES)]
        self.who, self.node, self.right = leaves.paths(self.leaf)
        spread = self.node.view(np.uint64) * np.uint64(0x94D049BB133111EB)
        self.cells = [cells(k.take(self.who) ^ spread, len(w.by_node)) for k in keys(stream, at, NODE_FEATURES)]
        self.leaves, self.w = leaves, w

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """([token, class] z, exp(z), their sums [token, 1]); z, of which the softmax is taken, is held within -80 and 60."""
        z = self.w.by_class[0].take(self.rows[0], axis=0)
        for k in range(1, len(self.rows)):
            z += self.w.by_class[k].take(self.rows[k], axis=0)
        z += np.log(self.leaves.prior).astype(np.float32)
        np.clip(z, -80, 60, out=z)
        e = np.exp(z)
        return z, e, e @ np.ones((e.shape[1], 1), np.float32)

    def slopes(self) -> np.ndarray:
        """The log odds of going right at each step."""
        z = self.leaves.bias.take(self.node)
        for c in self.cells:
            z += self.w.by_node.take(c)
        return z

    def log_probability(self) -> np.ndarray:
        """Of each token's leaf, to base 10."""
        z = self.slopes()
        z *= 1 - 2 * self.right.astype(np.float32)
        np.clip(z, None, 80, out=z)
        np.exp(z, out=z)
        z += 1
        np.log(z, out=z)
        own, _, total = self.classes()
        out = own[np.arange(len(self.kind)), self.kind] - np.log(total[:, 0]) - np.bincount(self.who, weights=z, minlength=len(self.kind))
        return out / np.log(10)


@dataclass
class Sums:
    """Gradients, and in the first round curvatures: p (1 - p) summed over the tokens that meet a weight, as imaginary parts. For
    classes the first round needs no more than counts, as probabilities are then the prior everywhere."""

    by_class: np.ndarray  # [feature, class, row]
    by_node: np.ndarray
    first: bool

    def add(self, s: Step) -> None:
        _, classes, size = self.by_class.shape
        if self.first:
            for k, rows in enumerate(s.rows):
                np.add.at(self.by_class[k].reshape(-1), s.kind * size + rows, 1.0)
            g = np.empty(len(s.node), np.complex64)  # what take returns has the dtype as unpickled, with which add.at is ten times slower
            g[:] = s.leaves.first.take(s.node)
            g.real += s.right
        else:
            _, e, total = s.classes()
            e /= -total
            e[np.arange(len(s.kind)), s.kind] += 1
            by_kind = np.ascontiguousarray(e.T).astype(np.float64)
            for k, rows in enumerate(s.rows):
                for c in range(classes):
                    self.by_class[k, c] += np.bincount(rows, weights=by_kind[c], minlength=size)
            z = s.slopes()
            np.exp(np.clip(z, None, 80, out=z), out=z)
            g = s.right.astype(np.float32)
            g -= z / (1 + z)
        for c in s.cells:
            np.add.at(self.by_node, c, g)

    def flat(self) -> np.ndarray:
        parts = (self.by_class.transpose(0, 2, 1).reshape(-1), self.by_node.real, *([self.by_node.imag] if self.first else []))
        return np.concatenate(parts, dtype=np.float32, casting="same_kind")


def new_sums(w: Weights, first: bool) -> Sums:
    features, size, classes = w.by_class.shape
    return Sums(np.zeros((features, classes, size)), np.zeros(len(w.by_node), np.complex64 if first else np.float32), first)


def update(w: Weights, sums: np.ndarray, leaves: Leaves, first: bool, rate: float, ridge: float) -> Weights:
    """The weights after a round whose summed gradients are ``sums``."""
    n = w.by_class.size
    by_class, by_node = sums[:n].reshape(w.by_class.shape), sums[n : n + len(w.by_node)]
    class_curve, node_curve = w.class_curve, w.node_curve
    if first:
        met = by_class.sum(axis=2, keepdims=True)
        by_class, class_curve = by_class - met * leaves.prior, met * leaves.prior * (1 - leaves.prior)
        node_curve = sums[n + len(w.by_node) :]
    moved = (w.by_class + rate * by_class / (class_curve + ridge), w.by_node + rate * by_node / (node_curve + ridge), class_curve, node_curve)
    return Weights(*(x.astype(np.float32) for x in moved))


def merge_parts(parts: DataFrame, tasks: int, size: int) -> np.ndarray:
    """Adds up what tasks have for blocks of one vector: (task, block, payload of float32). Level by level, so that no
    group has more than ``FAN_IN`` parts however many tasks there are."""

    def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in b["payload"])
        return pd.DataFrame({"task": [key[1]], "block": [key[0]], "payload": [total.astype(np.float32).tobytes()]})

    while True:
        parts = parts.groupBy("block", F.floor(F.col("task") / FAN_IN).cast("int").alias("_group")).applyInPandas(add, "task int, block int, payload binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros(size)
    for r in parts.collect():  # as many rows as blocks
        found = np.frombuffer(bytes(r["payload"]), np.float32)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(found)] = found
    return out


def streams(words: pa.Array, places: np.ndarray, lengths: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(codes with three start marks before each text, the places of tokens)."""
    at = np.arange(len(places)) + np.repeat(3 * np.arange(1, len(lengths) + 1), lengths)
    a = np.full(len(places) + 3 * len(lengths), START, np.int64)
    a[at] = codes.of(words)[places]
    return a, at


@dataclass
class Model:
    codes: Codes
    counts: np.ndarray
    leaves: Leaves
    bucket_mass: np.ndarray
    weights: Weights
    n: int
    v: int


def power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def train(docs: DataFrame, counts: DataFrame, rounds: int = 2, rate: float = 0.35, ridge: float = 8.0, max_weights: int = 1 << 24, max_head: int = 1 << 18, head: int | None = None, weights: int | None = None) -> Model:
    """``docs``: one binary column ``text``. ``head`` and ``weights`` set the sizes that else follow the types."""
    n, v, size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.col("c") * (F.octet_length("token") + 1)), F.lit(0))).first()
    top = frequent(counts, min(max_head, max(1024, v // 16)) if head is None else head)
    codes = Codes((w, i) for i, (w, _) in enumerate(top))
    c = np.array([x for _, x in top], dtype=np.float64)
    buckets = min(power_of_two((v - len(top)) / BUCKET), max_head)
    rare = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w, _ in top], "token binary")), "token", "left_anti") if not top else counts.filter(F.col("c") < top[-1][1])
    mass = np.ones(buckets)
    for r in rare.groupBy(F.expr(f"crc32(token) & {buckets - 1}").alias("bucket")).agg(F.sum(F.col("c") + 1).alias("mass")).collect():  # a row for each bucket
        mass[r["bucket"]] += r["mass"]
    leaves = Leaves(c + 1, mass)
    w = Weights.zero(min(max_weights, power_of_two(max(1 << 16, v / TYPES_A_WEIGHT))) if weights is None else weights, leaves.classes)
    tasks = max(1, int(size // (READ * 4 * len(w.by_node))))
    shared_codes, shared_leaves = (docs.sparkSession.sparkContext.broadcast(x) for x in (codes, leaves))
    dealt = docs.coalesce(tasks)
    tasks = dealt.rdd.getNumPartitions()

    for turn in range(rounds if n else 0):
        first, shared = turn == 0, docs.sparkSession.sparkContext.broadcast(w)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            sums = new_sums(shared.value, first)
            for _, words, places, lengths in cut_batches(batches):
                s, at = streams(words, places, lengths, shared_codes.value)
                for k in range(0, len(at), SLICE):
                    sums.add(Step(shared_leaves.value, shared.value, s, at[k : k + SLICE]))
            flat, task = sums.flat(), TaskContext.get().partitionId()
            for k in range(0, len(flat), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([k // BLOCK], pa.int32()), pa.array([flat[k : k + BLOCK].tobytes()])], names=["task", "block", "payload"])

        total = merge_parts(map_arrow(dealt, learn, "task int, block int, payload binary"), tasks, len(new_sums(w, first).flat()))
        w = update(w, total, leaves, first, rate, ridge)
    return Model(codes, c, leaves, mass, w, n, v)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.codes)
        log_counts = np.append(np.log10(m.counts + 1), 0.0)
        in_bucket = np.append(np.zeros(k), -np.log10(m.bucket_mass))
        for some, words, spots, lengths in cut_batches(batches):
            s, at = streams(words, spots, lengths, m.codes)
            n = len(lengths)
            owner = np.repeat(np.arange(n), lengths)
            sums = np.zeros((3, n))
            for j in range(0, len(at), SLICE):
                places = at[j : j + SLICE]
                word, step, lo = s[places], Step(m.leaves, m.weights, s, places), owner[j]
                lp = step.log_probability() + in_bucket[step.leaf]
                for row, x in enumerate((word < k, log_counts[np.minimum(word, k)], lp)):
                    found = np.bincount(owner[j : j + SLICE] - lo, weights=x)
                    sums[row, lo : lo + len(found)] += found
            rare = s[at] >= k
            pair, times = np.unique(owner[rare] * len(words) + spots[rare], return_counts=True)
            ends = np.concatenate(([0], np.bincount(pair // len(words), minlength=n).cumsum()))
            tail = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (words.take(pa.array(pair % len(words))), pa.array(times, pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(lengths, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), *tail],
                names=["id", "n_tokens", "known", "base", "score", "tail", "tail_n"],
            )

    plain = docs.select(hide_null(F.col(id_col)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    parts = map_arrow(plain, known_part, "id long, n_tokens long, known long, base double, score double, tail array<binary>, tail_n array<int>")
    parts = checkpoint(parts.withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.tail_n").alias("tf"))
    joined = rare.join(counts, "token").select("row", "tf", "c")
    sums = joined.groupBy("row").agg(F.sum("tf").alias("_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("_more"))
    out = parts.drop("tail", "tail_n").join(sums, "row", "left")
    more = F.coalesce("_more", F.lit(0.0))
    return out.select(
        show_null("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(model.n + model.v + 1)))).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learnt from those whose id's crc32 modulo 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = docs.filter(crc_mod("doc_id", 7) != 2).select(F.col("text").cast("binary").alias("text"))
    counts = count_tokens(learnt, "text")
    out = score(docs, train(learnt, counts), counts)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
