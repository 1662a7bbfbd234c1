"""Token ids of whole texts, an Arrow batch at a time.

For a tokenizer that cuts texts into letters, single digits and runs of other marks, each with a word end, and drops white
space: no token spans words or such parts, so each distinct word is encoded once and kept, and a batch's ids are gathered
by numpy. Words of letters up to U+024F in composed form are cut here; any other word goes through the tokenizer as it is.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a Python worker keeps with their ids; of more the half used last stays.
HELD = 500_000

#: Parts of words kept. Words kept don't ask for theirs again, so few are enough.
PARTS = 50_000

#: Bytes of text encoded at once.
SLICE = 2_000_000

#: New words learned at once.
LEARNED = 50_000

_END = 0xFFFFFFFF  # no id; ends a word

_workers: dict = {}


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, count) of runs of rows of ``most`` bytes together, or of one larger row."""
    bounds, first, held = [], 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and held + n > most:
            bounds.append((first, k - first))
            first, held = k, 0
        held += n
    return [*bounds, (first, len(sizes) - first)] if len(sizes) else []


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class TextEncoder:
    """(ids, bounds) of the texts of a batch: text k has ids[bounds[k]:bounds[k + 1]], the end id last. Equal to the
    tokenizer's own ids for whole texts."""

    def __init__(self, path: str, held: int = HELD) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.held, self.batch = self.tokenizer.model, held, 0
        self.cut = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.beyond = regex.compile("[^\n!-ɏ]").search
        # byte-level models see each byte as a printable character: itself, or 256 and up in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = dict(zip([b for b in range(256) if b not in shown], range(256, 512)))
        self.parts: dict[str, bytes] = {}
        self.words = pa.array([], pa.string())
        self.ids, self.starts, self.lengths, self.used = np.empty(0, "<u4"), *(np.empty(0, np.int64) for _ in range(3))

    def plain(self, text: str) -> bool:
        return "<|" not in text and not self.beyond(text) and unicodedata.is_normalized("NFC", text)

    def part(self, part: str) -> bytes:
        seen = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()

    def learn(self, words: pa.Array) -> np.ndarray:
        """Keeps the ids of new words; their places."""
        text = "\n".join(words.to_pylist())
        places, odd = np.arange(len(words)), []
        if not self.plain(text):
            listed = text.split("\n")
            odd = [k for k, w in enumerate(listed) if not self.plain(w)]
            rest = np.setdiff1d(places, odd)
            places[np.concatenate([rest, np.array(odd, dtype=np.int64)])] = np.arange(len(words))
            words, text = words.take(pa.array([*rest, *odd], pa.int64())), "\n".join(listed[k] for k in rest)
            odd = [self.tokenizer.encode(listed[k], add_special_tokens=False).ids for k in odd]
        flat = np.empty(0, "<u4")
        if len(odd) < len(words):
            found = self.cut(text.lower() + "\n")
            if len(self.parts) > min(self.held, PARTS):
                self.parts.clear()
            self.parts["\n"] = _END.to_bytes(4, "little")
            self.parts |= {p: self.part(p) for p in set(found) - self.parts.keys()}
            flat = np.frombuffer(b"".join(map(self.parts.__getitem__, found)), "<u4")
        ends = np.flatnonzero(flat == _END)
        lengths = np.concatenate([np.diff(ends, prepend=-1) - 1, [len(x) for x in odd]]).astype(np.int64)
        fresh = np.concatenate([flat[flat != _END], *(np.array(x, "<u4") for x in odd)])
        at = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, fresh])
        self.used = np.concatenate([self.used, np.full(len(words), self.batch)])
        return at + places

    def forget(self) -> None:
        keep = np.sort(np.argpartition(-self.used, self.held // 2)[: self.held // 2])
        self.ids, self.words = _gather(self.ids, self.starts[keep], self.lengths[keep]), self.words.take(pa.array(keep))
        self.lengths, self.used = self.lengths[keep], self.used[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        self.batch += 1
        if len(self.words) > self.held:
            self.forget()
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are written in lower case
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        place = pc.index_in(words, value_set=self.words)
        new = pc.is_null(place).to_numpy(zero_copy_only=False)
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        if new.any():
            fresh = words.filter(pa.array(new))
            place[new] = np.concatenate([self.learn(fresh.slice(k, LEARNED)) for k in range(0, len(fresh), LEARNED)])
        self.used[place] = self.batch
        at = place[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ids = _gather(self.ids, self.starts[at], lengths)
        offsets = split.offsets.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets - offsets[0]]  # ids before each text and after the last
        bounds = ends + np.arange(len(ends))
        out = np.full(bounds[-1], end_id, dtype="<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(ends))] = ids
        return out, bounds


def encoder(path: str) -> TextEncoder:
    if path not in _workers:
        _workers[path] = TextEncoder(path)
    return _workers[path]


def encoded(batch: pa.RecordBatch, path: str, end_id: int):
    """(rows, ids, bounds) of slices of a batch with a column ``text``."""
    texts = batch.column(batch.schema.get_field_index("text"))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    for first, n in slices(sizes, SLICE):
        ids, bounds = encoder(path)(texts.slice(first, n), end_id)
        pa.default_memory_pool().release_unused()  # Arrow keeps freed buffers otherwise, in every worker
        yield batch.slice(first, n), ids, bounds


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
