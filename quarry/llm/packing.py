"""Shortest-pack-first packing over the length histogram.

Texts become token counts in one pass; documents longer than a sequence are cut into full pieces and a rest. The
histogram of piece lengths (at most ``max_tokens`` rows) is all that reaches the driver: lengths are placed longest
first, each into the open pattern with the fewest tokens, and patterns carry counts. A piece's rank among those of its
length then picks its sequence and offset.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; texts of any length are
encoded whole and cut at sequence length; pieces of one length may take each other's places, which of them comes first is
open; no rows give no rows; columns besides id and text, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, hide_null, map_batches, rank_in, ready, show_null, table
from .text_ids import encoded, tokenizer_file


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): cuts of ``max_tokens`` and a rest; the end id belongs to the last."""

    ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, bounds in encoded(batch, tokenizer_path, end_id):
                out = []
                data = memoryview(ids.tobytes())
                for k, a, b in zip(rows.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for s in range(a, b, max_tokens):
                        e = min(s + max_tokens, b)
                        out.append((k, s - a, e - s, zlib.crc32(data[4 * s : 4 * e]), b - a))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    plain = docs.select(hide_null(F.col(id_col)).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths of one pack)]: lengths longest first, each to the open packs that hold least."""
    opened: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by room left
    rooms: list[int] = []  # a heap of -room
    full = []

    def put(count: int, pack: tuple[int, ...], room: int) -> None:
        if not room:
            full.append((count, pack))
        else:
            if not opened.setdefault(room, []):
                heapq.heappush(rooms, -room)
            opened[room].append((count, pack))

    for length in sorted(histogram, reverse=True):
        left, placed = histogram[length], []
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            count, pack = opened[room].pop()
            if not opened[room]:
                heapq.heappop(rooms)
            take = min(left, count)
            if count > take:
                put(count - take, pack, room)
            left -= take
            if room - length >= length:  # may take this length once more
                put(take, (*pack, length), room - length)
            else:
                placed.append((take, (*pack, length), room - length))
        if left:
            each = size // length  # new packs filled with this length alone
            if left // each:
                placed.append((left // each, (length,) * each, size - each * length))
            if left % each:
                placed.append((1, (length,) * (left % each), size - (left % each) * length))
        for p in placed:
            put(*p)
    return full + [x for packs in opened.values() for x in packs]


def pack_slots(packs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of a length is in the last row not beyond it."""
    rows, ranks, sequence = [], {}, 0
    for count, pack in packs:
        offset = 0
        for length in pack:
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = checkpoint(token_pieces(docs, tokenizer_path, max_tokens, end_id, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = pack_slots(shortest_pack_first(histogram, max_tokens))
    ranked = rank_in(pieces, "length", [F.col("doc_id"), F.col("start")], "rank")
    keys, base = slots[:, 0] * 2**44 + slots[:, 1], slots

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.searchsorted(keys, b["length"].to_numpy() * 2**44 + b["rank"].to_numpy(), side="right") - 1
            b["sequence_id"] = base[at, 2] + b["rank"].to_numpy() - base[at, 1]
            b["offset"] = base[at, 3]
            yield b.drop(columns=["rank"])

    placed = map_batches(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.select(show_null("doc_id"), *placed.columns[1:])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())
