"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

The model file gives pieces, scores and byte pieces; encoding itself is numpy.
All symbols of many words lie in one flat array. A round looks up the rank of
every neighbouring pair, takes the least rank of each word (segmented minimum),
merges its occurrences, leftmost first, in all words at once and compacts the
array; a word leaves when no pair of it is a piece. Two cases keep the rounds
equal to one-by-one merging: ranks shared by several pieces, and merged pieces
that a pair of better rank can continue, are merged one place per word a round.

White space starts a word and no piece holds it elsewhere, so texts are cut
into words and each distinct word is encoded once per worker. Long words are cut
where no piece holds the two characters side by side, which no merge can cross.
Models for which that does not hold (checked on loading) take whole texts.

Defined results: NULL and empty texts have no ids and decode to the empty text;
characters unknown to the model become byte pieces, or the unknown id where the
model has none; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import WordTable, mix, slices, texts_of

SPACE = "▁"
NONE = np.iinfo(np.int64).max


def slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def slots(keys: np.ndarray, merged: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An open hash table with few filled slots; slot 0 stays free for pairs that are not there."""
    size = 1 << max(4, int(len(keys) * 3).bit_length())
    out = np.full(size, -2, np.int64), np.zeros(size, np.int64), np.full(size, NONE)
    for k, m, r, at in zip(keys.tolist(), merged.tolist(), rank.tolist(), slot(keys, size).tolist()):
        while at == 0 or out[0][at] != -2:
            at = (at + 1) % size
        out[0][at], out[1][at], out[2][at] = k, m, r
    return out


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, 0 (a free one) for keys that are not in the table."""
    at = slot(keys, len(table))
    there = table[at]
    todo = np.flatnonzero((there != keys) & ((there != -2) | (at == 0)))
    at[there == -2] = 0
    while len(todo):
        at[todo] = (at[todo] + 1) % len(table)
        there = table[at[todo]]
        at[todo[there == -2]] = 0
        todo = todo[(there != -2) & (there != keys[todo])]
    return at


@dataclass
class Pieces:
    """Tables of one model; built once on the driver and broadcast (a few MB, whatever the data)."""
    text: list[bytes]                     # what an id decodes to
    byte: list[int]                       # id of byte piece b, or []
    is_byte: np.ndarray
    unknown: int
    starts_with_space: list[bool]
    first: np.ndarray = field(repr=False)              # symbol of a code point, or -1
    own: np.ndarray = field(repr=False)                # id of a symbol, -1 if it is no piece
    keys: np.ndarray = field(repr=False)               # hash table of pairs: left symbol << 32 | right symbol, or -2
    merged: np.ndarray = field(repr=False)             # by slot: symbol that the pair becomes
    rank: np.ndarray = field(repr=False)               # by slot: 0 is merged first, NONE in free slots
    one_at_a_time: np.ndarray = field(repr=False)      # by symbol, see the module's text
    inside: set[str] = field(repr=False)               # two characters side by side in a piece
    by_words: bool                                     # white space only starts pieces
    longest_run: int                                   # of white space in a piece
    lone_newline: bool                                 # no piece holds a line end beside other characters

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        is_byte = np.array([sp.is_byte(i) for i in range(n)])
        plain = [i for i in range(n) if not (is_byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = [b"" if sp.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        byte = [0] * 256 if is_byte.any() else []
        for i in np.flatnonzero(is_byte):
            byte[int(names[i][1:-1], 16)] = int(i)
            text[i] = bytes([int(names[i][1:-1], 16)])
        text[sp.unk_id()] = " ⁇ ".encode()
        symbol: dict[str, int] = {names[i]: i for i in plain}
        for c in sorted({c for i in plain for c in names[i]}):
            symbol.setdefault(c, len(symbol) + n)
        own = np.full(max([n, *symbol.values()]) + 1, -1, np.int64)
        own[plain] = plain
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        piece_rank = {i: order[sp.get_score(i)] for i in plain}
        keys, merged = [], []
        for i in plain:
            p = names[i]
            for cut in range(1, len(p)):
                left, right = symbol.get(p[:cut]), symbol.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
        keys, merged = np.array(keys, np.int64), np.array(merged, np.int64)
        rank = np.array([piece_rank[i] for i in merged], np.int64)
        best = np.full(len(own), NONE)  # best rank of a pair that a symbol is part of
        np.minimum.at(best, keys >> 32, rank)
        np.minimum.at(best, keys & 0xFFFFFFFF, rank)
        shared = np.bincount(list(piece_rank.values())) > 1
        one = np.zeros(len(own), bool)
        for i in plain:
            one[i] = best[i] <= piece_rank[i] or shared[piece_rank[i]]
        runs = [i for i in plain if len(names[i]) > 1 and not names[i].strip(SPACE)]
        starts = [i for i in plain if len(names[i]) > 1 and names[i][0] == SPACE and names[i].strip(SPACE)]
        by_words = (all(SPACE not in names[i][1:] for i in plain if names[i].strip(SPACE))
                    and (not runs or not starts
                         or min(piece_rank[i] for i in runs) > max(piece_rank[i] for i in starts)))
        keys, merged, rank = slots(keys, merged, rank)
        first = np.full(0x110000, -1, np.int64)
        first[: 128 * bool(byte)] = byte[:128]  # characters of one byte stand for their byte piece, if they are no piece
        own[byte] = byte
        for s, i in symbol.items():
            if len(s) == 1:
                first[ord(s)] = i
        return cls(text, byte, is_byte, sp.unk_id(), [x.startswith(SPACE) for x in names],
                   first, own, keys, merged, rank, one,
                   {names[i][k:k + 2] for i in plain for k in range(len(names[i]) - 1)}, by_words,
                   max([len(names[i]) for i in runs], default=1),
                   not any("\n" in names[i] and len(names[i]) > 1 for i in plain))

    # encoding

    def rounds(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word (strings with white space already marked), many words at once."""
        out: list[tuple[int, ...]] = []
        for at in range(0, len(words), 4096):  # so that the arrays of a round stay in the processor's cache
            out.extend(self.merge(words[at: at + 4096]))
        return out

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        base = len(self.own)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.first[points]
        strange = sym < 0
        sym[strange] = base + points[strange]  # characters outside the model never merge
        length = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), length)
        done_sym, done_word = [], []
        while len(sym):
            inner = np.append(word[1:] == word[:-1], False)
            at = find(self.keys, np.where(inner, sym << 32 | np.append(sym[1:], 0), -1))
            rank = self.rank[at]
            start = np.flatnonzero(np.append(True, ~inner[:-1]))
            size = np.diff(np.append(start, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, start), size)
            stay = least < NONE
            if not stay.all():  # words without a pair leave
                over = ~stay
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, least, at = sym[stay], word[stay], rank[stay], least[stay], at[stay]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            into = self.merged[at[hit]]
            first = np.append(True, word[hit[1:]] != word[hit[:-1]])
            # of places that overlap, every other one from the left
            run = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | first[1:]))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            single = self.one_at_a_time[into[np.flatnonzero(first)]][np.cumsum(first) - 1]
            take = np.where(single, first, place % 2 == 0)
            hit, into = hit[take], into[take]
            sym[hit] = into
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        sym = np.concatenate([*done_sym, np.zeros(0, np.int64)])
        word = np.concatenate([*done_word, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        ids = np.where(sym < base, self.own[np.minimum(sym, base - 1)], -1)
        flat = ids.tolist()
        if (ids >= 0).all():
            return [tuple(flat[a:b]) for a, b in zip(bounds, bounds[1:])]
        symbols = sym.tolist()
        return [tuple(chain.from_iterable((flat[k],) if flat[k] >= 0 else self.stand_in(symbols[k]) for k in range(a, b)))
                for a, b in zip(bounds, bounds[1:])]

    def stand_in(self, symbol: int) -> list[int]:
        """Ids of a character that is no piece: its bytes' pieces, or the unknown id."""
        point = symbol - len(self.own) if symbol >= len(self.own) else int(np.flatnonzero(self.first == symbol)[0])
        return [self.byte[x] for x in chr(point).encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def cut(self, word: str) -> list[str]:
        """The word cut where no piece holds the two characters side by side."""
        ends = [i + 1 for i in range(len(word) - 1) if word[i:i + 2] not in self.inside]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)])]

    def units(self, text: str) -> list[str]:
        """Marked words of a text; a run of white space gives one mark for each character but the last."""
        if not text:
            return []
        if not self.by_words:
            return [SPACE + text.replace(" ", SPACE)]
        marked = (" " + text.replace(SPACE, " ")).replace(" ", " " + SPACE)
        if self.lone_newline:
            marked = marked.replace("\n", " \n ")
        words = marked.split(" ")[1:]
        if max(map(len, words)) > 48:
            words = list(chain.from_iterable(self.cut(w) if len(w) > 48 else (w,) for w in words))
        return words

    def encode(self, texts: list[str], table: WordTable) -> list[list[int]]:
        docs = [self.units(t) for t in texts]
        values = table.prepare(docs)
        return [list(chain.from_iterable(map(values.__getitem__, d))) if SPACE not in d
                else self.with_runs(d, values) for d in docs]

    def with_runs(self, units: list[str], values: dict[str, tuple[int, ...]]) -> list[int]:
        """Ids of words of which some are lone marks: runs of them, and a mark a word left alone, go together."""
        out: list[int] = []
        run = 0
        mark = int(self.own[self.first[ord(SPACE)]])
        for u in units:
            if u == SPACE:
                run += 1
                continue
            ids = values[u]
            if run and u:
                if u[0] == SPACE and ids[0] == mark:
                    run, ids = run + 1, ids[1:]
                out.extend(self.run_ids(run))
                run = 0
            out.extend(ids)
        out.extend(self.run_ids(run))
        return out

    def run_ids(self, n: int) -> tuple[int, ...]:
        """Ids of n marks. Merging goes from the left and fills the longest piece, so only the rest needs rounds."""
        if not n:
            return ()
        if n not in (runs := self.__dict__.setdefault("_runs", {})):
            rest = n if n < 3 * self.longest_run else n % self.longest_run + self.longest_run
            whole = (n - rest) // self.longest_run
            head = self.rounds([SPACE * self.longest_run])[0] if whole else ()
            ids = head * whole + self.rounds([SPACE * rest])[0]
            if len(runs) > 4096:
                runs.clear()
            runs[n] = ids
        return runs[n]

    # decoding

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are not valid UTF-8 become one U+FFFD each."""
        raw = b"".join(map(self.text.__getitem__, ids))
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            out = "".join(self.lenient(bytes_) if bytes_ else other for bytes_, other in self.stretches(ids))
        return out[1:] if ids and self.starts_with_space[ids[0]] else out

    def stretches(self, ids: list[int]) -> Iterator[tuple[bytes, str]]:
        run = b""
        for i in ids:
            if self.is_byte[i]:
                run += self.text[i]
                continue
            if run:
                yield run, ""
                run = b""
            yield b"", self.text[i].decode()
        if run:
            yield run, ""

    @staticmethod
    def lenient(raw: bytes) -> str:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def table(self) -> WordTable:
        return WordTable(self.rounds, 300_000)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for part in slices(batches, "text", 4 << 20):
            ids = pa.array(shared.value.encode(texts_of(part), table), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row's ids (NULL ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [shared.value.decode(ids or []) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Encode, then decode what came out, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = documents.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        table, decimal = pieces.table(), [str(i) for i in range(len(pieces.text))]
        for part in slices(batches, "text", 4 << 20):
            n, a, b = [], [], []
            for ids in pieces.encode(texts_of(part), table):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
