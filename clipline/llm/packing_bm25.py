"""Lexical retrieval packing: whole corpora into windows of a fixed number of tokens, each filled with documents that share words.

Every document becomes token ids and an end-of-document id. Its full windows stand for themselves; its rest, shorter than a window, joins
a shard: the next ``shard`` rests of the task's input. Over a shard an inverted index with BM25 weights is built. The first unused rest
seeds a window; the index, asked with all its words, returns all unused neighbours, best first, which fill the window greedily; the best one left is cut where the
window is full, and what is cut off seeds the next window. Only the last window of a task can stay short, so padding is at most one
window per input partition. The ids of a word are worked out once and kept, up to a bound;
new words are encoded together and cut apart again.

At scale: document frequencies of hashed words (``TERMS`` buckets, so at most that many numbers reach the driver) are counted over all
documents first. Packing itself is one pass without a shuffle; a task holds one shard of rests, at most ``shard`` windows of ids. A lost
task is repeated on the same rows and gives the same sequences.

Cases: a null or empty text is a document of the end id alone; repeated rows and ids are packed each; a null id is carried; a text longer
than a window fills several; equal scores go to the rest that came first; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import texts as T

WINDOW = 2048
END = 1
TERMS = 1 << 18
SHARD = 1024
K1, B = 1.2, 0.75
_CACHED = 500_000


#: Fixed value: the pattern that splits text before byte-level merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Places(dict):
    """Numbers for what is asked for, in order of the first asking."""

    def __init__(self, new: list):
        super().__init__()
        self.new = new

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self.new)
        self.new.append(piece)
        return at


class Encoder:
    """Ids of texts by a byte-level BPE file, with what was worked out for a word kept up to a bound.

    Pre-tokenisation takes a single space together with what follows, so a text may be cut before each single space between two
    characters that are not white space, and the pieces give the same ids as the whole. Pieces are cut in the bytes of many texts at once. The vocabulary's own merges are run by the
    faster of two libraries; a piece that holds a special token's text goes to the other.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)
        self.merges = tiktoken.Encoding("merges", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.number = _Places([])
        self.at, self.size, self.pool, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forget the pieces met once since the last time, or all if that is not enough."""
        kept, pieces = np.flatnonzero(self.uses > 1), self.number.new
        at, size, pool = self.at, self.size, self.pool
        self.clear()
        if len(kept) > _CACHED // 2:
            return
        self.number = _Places([pieces[k] for k in kept.tolist()])
        self.number.update(zip(self.number.new, range(len(kept)), strict=True))
        self.size, self.uses = size[kept], np.zeros(len(kept), np.int64)
        end = np.cumsum(self.size)
        self.at = end - self.size
        self.pool = pool[np.repeat(at[kept] - self.at, self.size) + np.arange(int(end[-1]) if len(end) else 0)]

    def _ids(self, piece: str) -> list[int]:
        if any(x in piece for x in self.special):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return self.merges.encode_ordinary(piece)

    def _learn(self) -> None:
        """Ids of the new pieces. Those that begin and end as a cut demands are joined and encoded at once: they are cut apart again there."""
        new = self.number.new[len(self.at) :]
        if not new:
            return
        special = [x for x in self.special if any(x in p for p in new)]
        joins = np.array([p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() and not any(x in p for x in special) for p in new])
        whole = [p for p, j in zip(new, joins.tolist(), strict=True) if j]
        ids = np.array(self.merges.encode_ordinary("".join(whole)), np.int32)
        upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(p.encode()) for p in whole]), "left") + 1
        sizes = np.zeros(len(new), np.int64)
        sizes[joins] = np.diff(upto, prepend=0)
        alone = {k: self._ids(new[k]) for k in np.flatnonzero(~joins).tolist()}
        for k, got in alone.items():
            sizes[k] = len(got)
        end = np.cumsum(sizes)
        flat, of_whole = np.empty(int(end[-1]), np.int32), np.repeat(joins, sizes)
        flat[of_whole] = ids
        for k, got in alone.items():
            flat[end[k] - sizes[k] : end[k]] = got
        self.at, self.size, self.pool = np.concatenate([self.at, len(self.pool) + end - sizes]), np.concatenate([self.size, sizes]), np.concatenate([self.pool, flat])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text: all are cut at once, and each distinct piece is looked up once."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        if len(self.number) > _CACHED:
            self._shrink()
        out: list[np.ndarray] = []
        for _, _, raw, offsets in T.slices(texts):
            marked = np.zeros(len(raw) + 1, bool)
            marked[offsets], marked[cuts(raw)], marked[-1] = True, True, False
            begins = np.flatnonzero(marked)
            pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(raw.tobytes())).dictionary_encode()
            number = np.array([self.number[p] for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)[pieces.indices.to_numpy()]
            self._learn()
            self.uses += np.bincount(number, minlength=len(self.uses))
            at, size = self.at[number], self.size[number]
            end = np.cumsum(size)
            flat = self.pool[np.repeat(at - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]
            out += np.split(flat, np.append(0, end)[np.searchsorted(begins, offsets[1:-1])])
        return out


_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
# bytes that open or end a white space character beyond ASCII, and those that come before the last one
_WIDE_OPENS, _WIDE_ENDS, _WIDE_BEFORE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_WIDE_OPENS[[0xE1, 0xE2, 0xE3]] = True
_WIDE_ENDS[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WIDE_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places of single spaces between characters that are not white space. In doubt a space is left out: it need not be cut there."""
    at = np.flatnonzero(raw == 32)
    at = at[(at > 0) & (at < len(raw) - 1)]
    last, next_, before = raw[at - 1], raw[at + 1], raw[np.maximum(at - 2, 0)]
    blank = _BLANK[last] | _BLANK[next_] | _WIDE_OPENS[next_] | ((next_ == 0xC2) & np.isin(raw[np.minimum(at + 2, len(raw) - 1)], [0x85, 0xA0]))
    return at[~(blank | (_WIDE_ENDS[last] & _WIDE_BEFORE[before]))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) in that order, and with it the words of each document hashed into ``TERMS`` buckets."""
    start, end, doc = T.words(raw, offsets)
    h = T.span_hash(T.running(T.LOWER_TABLE[raw]), start, end)
    key, times = np.unique((doc << 18) | (h >> np.uint64(46)).astype(np.int64), return_counts=True)
    return key >> 18, key & (TERMS - 1), times


def corpus_statistics(documents: DataFrame) -> dict:
    """Document frequency per term, number of documents and mean length, over all documents."""

    def run(batches):
        df, n, length = np.zeros(TERMS, np.int64), 0, 0
        for b in batches:
            for i, j, raw, offsets in T.slices(b.column(0)):
                _, term, times = terms(raw, offsets)
                df += np.bincount(term, minlength=TERMS)
                n, length = n + j - i, length + int(times.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, [-1, -2]])), pa.array(np.concatenate([df[used], [n, length]]))], names=["term", "n"])

    got = documents.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(TERMS, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    docs, length = (int(n[term == k].sum()) for k in (-1, -2))
    return {"idf": np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32), "mean_length": max(1.0, length / max(1, docs))}


class Shard:
    """An inverted index over the rests of some documents. Terms are numbered within the shard, so that a posting list is a slice."""

    def __init__(self, rests: list[dict], statistics: dict):
        idf = statistics["idf"]
        bound = np.cumsum([0, *(len(r["term"]) for r in rests)])
        doc = np.repeat(np.arange(len(rests)), np.diff(bound))
        times = np.concatenate([r["times"] for r in rests])
        length = np.array([r["times"].sum() for r in rests])
        self.known, term = np.unique(np.concatenate([r["term"] for r in rests]), return_inverse=True)
        weight = idf[self.known][term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[doc] / statistics["mean_length"]))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.known)))])
        self.own = np.split(term, bound[1:-1])
        self.n = len(rests)
        self.unused = np.ones(self.n, bool)

    def neighbours(self, query: np.ndarray) -> np.ndarray:
        """Unused rests, best first, then by order of arrival; all words of the query (terms as the shard numbers them) ask."""
        low, size = self.begin[query], self.begin[query + 1] - self.begin[query]
        end = np.cumsum(size)
        at = np.repeat(low - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        left = np.flatnonzero(self.unused)
        return left[np.argsort(-score[left], kind="stable")]


class Packer:
    """The state of one task: pieces to put out, rests that wait, and the open window."""

    def __init__(self, statistics: dict, first: int):
        self.statistics, self.sequence = statistics, first
        self.rows: list[tuple] = []
        self.waiting: list[dict] = []
        self.open: list[tuple] = []
        self.room = WINDOW

    def add(self, doc_id, ids: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        full = len(ids) // WINDOW * WINDOW
        for at in range(0, full, WINDOW):
            self.rows.append((doc_id, at, WINDOW, zlib.crc32(ids[at : at + WINDOW]), len(ids), self.sequence, 0))
            self.sequence += 1
        if full < len(ids):
            self.waiting.append({"doc_id": doc_id, "ids": ids[full:].copy(), "start": full, "tokens": len(ids), "term": term, "times": times})

    def _put(self, rest: dict, size: int) -> None:
        ids = rest["ids"][:size]
        self.open.append((rest["doc_id"], rest["start"], size, zlib.crc32(ids), rest["tokens"], WINDOW - self.room))
        self.room -= size
        rest["ids"], rest["start"] = rest["ids"][size:], rest["start"] + size
        if not self.room:
            self.close()

    def close(self) -> None:
        if self.open:
            self.rows += [(*piece[:-1], self.sequence, piece[-1]) for piece in self.open]
            self.open, self.room, self.sequence = [], WINDOW, self.sequence + 1

    def fill(self) -> None:
        """Pack all that waits; the last window stays open for the next shard."""
        rests, self.waiting = self.waiting, []
        if not rests:
            return
        index, following, seed = Shard(rests, self.statistics), 0, -1
        size = np.array([len(r["ids"]) for r in rests])
        while True:
            if seed < 0:
                while following < index.n and not index.unused[following]:
                    following += 1
                if following == index.n:
                    return
                seed = following
            index.unused[seed] = False
            rest, seed_of = rests[seed], seed
            self._put(rest, min(self.room, len(rest["ids"])))
            if len(rest["ids"]):
                continue  # cut off: it seeds the next window
            seed = -1
            if self.room == WINDOW:
                continue
            near = index.neighbours(index.own[seed_of])
            at, seed = 0, -1
            while at < len(near):
                fits = size[near[at:]] <= self.room
                step = int(fits.argmax())
                if seed < 0 and (step or not fits[0]):
                    seed = int(near[at])  # the best one that is too long
                if not fits[step]:
                    break
                k = near[at + step]
                index.unused[k] = False
                self._put(rests[k], len(rests[k]["ids"]))
                at += step + 1
                if self.room == WINDOW:
                    seed = -1
                    break


def pack(documents: DataFrame, tokenizer: str, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece."""
    statistics = corpus_statistics(documents)
    kind = documents.schema["doc_id"].dataType
    names = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()

    def run(batches):
        encode = encoder(tokenizer).encode
        packer = Packer(statistics, TaskContext.get().partitionId() << 33)
        id_type = None

        def out():
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(names)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=names)

        for b in batches:
            column = pc.fill_null(b.column(b.schema.get_field_index("text")), "")
            ids = b.column(b.schema.get_field_index("doc_id"))
            id_type = ids.type
            for i, j, raw, offsets in T.slices(column):
                doc, term, times = terms(raw, offsets)
                bound = np.searchsorted(doc, np.arange(j - i + 1))
                encoded = encode(column.slice(i, j - i))
                for k, doc_id in enumerate(ids.slice(i, j - i).to_pylist()):
                    own = slice(bound[k], bound[k + 1])
                    packer.add(doc_id, np.append(encoded[k], np.int32(END)).astype("<u4"), term[own], times[own])
                    if len(packer.waiting) >= shard:
                        packer.fill()
                if len(packer.rows) > 4096:
                    yield out()
        packer.fill()
        packer.close()
        if packer.rows:
            yield out()

    return documents.select("doc_id", "text").mapInArrow(run, StructType([StructField("doc_id", kind), *[StructField(n, LongType()) for n in names[1:]]]))
