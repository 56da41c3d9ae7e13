"""Packing: token sequences of fixed length by the sum-of-squares rule.

Each task packs the documents of its partition, one pass, as they come. A
document's ids fill whole windows while they reach; what remains (fewer ids than
a window) goes to the fill level whose choice leaves the least sum of squared
counts of partially filled windows (a new window is level 0; ties go to the
fuller level). Only the counts by level and the open windows' pieces are held.
When the partition ends, or more than ``Params.open_windows`` windows are open,
open windows are closed without padding: the fullest stay as the rule placed them
and are filled up with pieces of the emptiest, which alone are cut anew. The
very last rest is cut into windows whose lengths are powers of two. So at any number
of rows a task's windows are those of the rule, but for the gaps of the last open ones;
``open_windows`` bounds memory, and tasks that pass it fill such gaps more than once.

Ids come from the byte-level BPE of a tokenizers JSON file. Text is cut at
single spaces and line ends between other characters (places where that
vocabulary's pattern always begins a new token), distinct words are encoded once
per worker, and the ids of a text are the words' ids in order. This holds for a
vocabulary without normaliser whose pre-tokenizer is the byte-level one and whose
merges come in the order of their ids, which is checked; with any other file every
text goes through the tokenizers library.

Sequences are numbered by (task, number in the task), so no shuffle, counter or
global order is needed and a repeated task numbers its sequences alike. Defined
results: NULL and empty texts are one end id; every row, repeated or not, is
packed; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import slices, texts_of

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


@dataclass(frozen=True)
class Params:
    window: int = 1024
    end_id: int = 0
    open_windows: int = 4096  # held at once by a task: at most 16 MB of ids


class Words(dict):
    """Ids of words, as bytes, encoded when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = array("I", self.encode(word)).tobytes()
        return ids


@dataclass
class ByteBpe:
    """Ids of a byte-level BPE (tokenizers JSON), with the vocabulary's merge order as ranks."""
    spec: str = field(repr=False)
    kept_words: int = 300_000  # distinct words whose ids a worker keeps, about

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def open(self) -> ByteBpe:
        """Build the encoders (once per worker)."""
        import tiktoken
        from tokenizers import Tokenizer
        spec = json.loads(self.spec)
        self.exact = Tokenizer.from_str(self.spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        alphabet = dict(zip(byte_alphabet(), range(256)))
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in self.special}
        self.fast = None
        if not regular(spec, self.special):
            return self
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = Words(self.fast.encode_ordinary)
        return self

    def units(self, text: str) -> list[str]:
        """The text cut before each single space, and around each single line end, between characters that are no white space."""
        words = text.replace("\n", " ").split(" ")
        if "" in words or "\0" in text or list(map(str.strip, words)) != words:
            return [text]
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.array(e.ids, "<u4") for e in self.exact.encode_batch(texts, add_special_tokens=False)]
        out: list[np.ndarray | None] = [None] * len(texts)
        docs = [self.units(t) for t in texts]
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.array(self.exact.encode(t, add_special_tokens=False).ids, "<u4")
            elif len(docs[i]) == 1:  # one word, or other white space: encoded whole, not kept
                out[i] = np.array(self.fast.encode_ordinary(t), "<u4")
            else:
                out[i] = np.frombuffer(b"".join(map(self.words.__getitem__, docs[i])), "<u4")
        if len(self.words) > self.kept_words:
            self.words.clear()
        return out


def regular(spec: dict, special: list[str]) -> bool:
    """Whether ids follow from byte pairs ranked by id after the byte-level split, with nothing before or beside it."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return False
    vocab = model["vocab"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    made = [vocab[a + b] for a, b in pairs]
    single = [i for t, i in vocab.items() if len(t) == 1 and t not in special]
    return made == sorted(made) and len(single) == 256 and (not made or max(single) < made[0])


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    point = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}
    return [chr(point[b]) for b in range(256)]


class Packer:
    """Windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, params: Params):
        self.p = params
        self.count = np.zeros(params.window + 1, np.int64)  # partially filled windows by level
        self.open: list[list] = [[] for _ in range(params.window + 1)]  # their pieces
        self.closed: list[list] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        w, n = self.p.window, len(ids)
        whole = n - n % w
        for at in range(0, whole, w):
            self.closed.append([(doc_id, at, ids[at: at + w], n)])
        if whole < n:
            self.place((doc_id, whole, ids[whole:].copy(), n))

    def place(self, piece: tuple) -> None:
        size, w = len(piece[2]), self.p.window
        fits = w - size + 1  # levels 0 .. w - size
        cost = np.empty(fits, np.int64)
        cost[1:] = 1 - 2 * self.count[1:fits]
        cost[1:][self.count[1:fits] == 0] = np.iinfo(np.int64).max // 2
        cost[0] = 0
        cost[:-1] += 2 * self.count[size:w] + 1  # the level it then reaches; a full window is none
        level = fits - 1 - int(np.argmin(cost[::-1]))
        window = self.open[level].pop() if level else []
        window.append(piece)
        self.count[level] -= level > 0
        if level + size == w:
            self.closed.append(window)
            return
        self.open[level + size].append(window)
        self.count[level + size] += 1
        if self.count.sum() > self.p.open_windows:
            self.drain()

    def drain(self, last: bool = False) -> None:
        """Close the open windows without padding: the fullest stay as they were placed and are filled up with
        pieces of the emptiest, which alone are cut anew. What is left, less than a window, stays open or, at
        the end, is cut into powers of two."""
        w = self.p.window
        windows = [x for level in range(w - 1, 0, -1) for x in self.open[level]]
        self.open = [[] for _ in self.open]
        self.count[:] = 0
        giving: list = []  # pieces of the emptiest window, the next one last
        low = len(windows)
        k = 0
        while k < low:
            window = windows[k]
            room = w - sum(len(p[2]) for p in window)
            while room:
                if not giving:
                    if low - 1 == k:
                        break
                    low -= 1
                    giving = windows[low][::-1]
                piece, giving = self.cut(giving, room)
                window.append(piece)
                room -= len(piece[2])
            if room:
                giving = window[::-1]
                break
            self.closed.append(window)
            k += 1
        rest = giving[::-1]
        left = sum(len(p[2]) for p in rest)
        if not last:
            if rest:
                self.open[left].append(rest)
                self.count[left] += 1
            return
        giving = rest[::-1]
        while left:
            goal = room = 1 << (left.bit_length() - 1)
            window = []
            while room:
                piece, giving = self.cut(giving, room)
                window.append(piece)
                room -= len(piece[2])
            self.closed.append(window)
            left -= goal

    @staticmethod
    def cut(pieces: list, room: int) -> tuple[tuple, list]:
        """A piece of at most ``room`` ids from the end of a list of pieces, and what is left of the list."""
        doc_id, start, ids, n = pieces.pop()
        if len(ids) > room:
            pieces.append((doc_id, start + room, ids[room:], n))
        return (doc_id, start, ids[:room], n), pieces

    def take(self) -> list[list]:
        out, self.closed = self.closed, []
        return out


def pack(documents: DataFrame, path: str, params: Params = Params()) -> DataFrame:
    """One row per piece: its document and place there, its sequence and place there, crc32 of its ids."""
    if params.window & (params.window - 1):
        raise ValueError("window must be a power of two")
    shared = documents.sparkSession.sparkContext.broadcast(ByteBpe.load(path))

    def rows(sequences: list[list], first: int) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for k, window in enumerate(sequences):
            offset = 0
            for doc_id, start, ids, n in window:
                for c, v in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids), n, first + k, offset)):
                    c.append(v)
                offset += len(ids)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = shared.value.open(), Packer(params)
        number = TaskContext.get().partitionId() << 36
        end = np.array([params.end_id], "<u4")
        for part in slices(batches, "text", 4 << 20):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), bpe.encode(texts_of(part))):
                packer.add(doc_id, np.concatenate([ids, end]))
            done = packer.take()
            yield rows(done, number)
            number += len(done)
        packer.drain(last=True)
        yield rows(packer.take(), number)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
