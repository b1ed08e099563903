"""Best-fit packing into sequences, certified by dual-feasible lower bounds.

Texts become pieces of at most ``capacity`` tokens (only longer documents are cut). Whole pieces fill a sequence alone.
The rest is dealt into groups of bounded size, each packed best-fit decreasing and certified: a dual-feasible function
turns the lengths into a lower bound on the number of sequences, and a group that meets it can't be improved. Groups
with a gap give up their badly filled sequences, whose documents are exchanged and packed anew in larger company, until
all is certified, one group is left, or a round no longer frees a tenth of what it was dealt. ``certificate()`` tells how far the whole
packing is from the bound over all pieces.

Groups are dealt by a hash of the piece, never by a column's value, so no key can fill one. Texts are read once; what
is shuffled is six numbers for each piece.

Defined cases: null or empty text: a document of the one end token. Very long texts are cut, never shortened. Null ids, ties and
repeated rows are packed row by row. Other columns, whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store

CAPACITY, END = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Text with other blanks than these, or with letters whose lower case depends on more than themselves, goes through the tokenizer as a whole.
_ODD = r"[\x1c-\x1f\x85\xa0\u03a3\u0130\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u212a\u212b\u3000\ufeff]"
_CACHE_ENTRIES, _CACHE_CHARS = 350_000, 48


class Encoder:
    """The tokenizer's ids as little-endian uint32 bytes; remembers those of short words.

    The tokenizer drops blanks and case and never joins characters across blanks, nor a letter with a full stop or comma,
    so a text's ids are those of its parts. A text's new words are encoded in one call and parted at the tokens that end
    a word. Two generations of remembered words bound the memory: when the younger is full, the elder goes.
    """

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = re.compile(_ODD).search
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.marks = {c: self.raw(c) for c in ".,"}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def remember(self, word: str, ids: bytes) -> None:
        if len(word) <= _CACHE_CHARS:
            if len(self.known) >= _CACHE_ENTRIES:
                self.elder, self.known = self.known, {}
            self.known[word] = ids

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: each is one or more tokens, of which the last alone ends a word."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return [self.raw(w) for w in words]
        raw, at = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:z] for a, z in zip([0, *at[:-1]], at, strict=True)]

    def __call__(self, text: str) -> bytes:
        if self.odd(text):
            return self.raw(text)
        words = text.lower().split()
        out = list(map(self.known.get, words))
        if None not in out:
            return b"".join(out)
        new: dict[str, list[int]] = {}
        tails: dict[int, bytes] = {}
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = words[i]
            if len(w) > 1 and w[-1] in self.marks and w[-2].isalpha():
                tails[i] = self.marks[w[-1]]
                w = w[:-1]
            if (ids := self.known.get(w)) is None and (ids := self.elder.get(w)) is not None:
                self.remember(w, ids)
            if ids is None:
                if w.isalpha():
                    new.setdefault(w, []).append(i)
                    continue
                ids = self.raw(w)
                self.remember(w, ids)
            out[i] = ids
        if new:
            for (w, places), ids in zip(new.items(), self.letters(list(new)), strict=True):
                self.remember(w, ids)
                for i in places:
                    out[i] = ids
        for i, mark in tails.items():
            out[i] += mark
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row of PIECES for each piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or tokenizer_path()
        encode = _encoders.setdefault(where, Encoder(where)) if where not in _encoders else _encoders[where]
        n = 0
        for b in batches:
            out = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), n))
                    n += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], [c.split()[0] for c in PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, times: np.ndarray | None = None) -> int:
    """Fewest sequences that these lengths (each ``times`` over, if given) need by any of the dual-feasible functions tried.

    u_e counts lengths over capacity - e as whole and drops those under e, for every e up to half the capacity; the
    rounding functions f_k keep x if (k+1)x/capacity is whole, else floor((k+1)x/capacity)/k. e = 0 is the plain sum.
    """
    if not len(lengths):
        return 0
    many = np.bincount(lengths, times, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    mass = np.concatenate([[0], np.cumsum(many * sizes)])
    heads = np.concatenate([[0], np.cumsum(many)])
    e = np.arange(0, capacity // 2 + 1)
    whole = heads[-1] - heads[capacity - e + 1]
    middle = mass[capacity - e + 1] - mass[e]
    best = int((whole - (-middle // capacity)).max())
    for k in range(1, 41):
        t = (k + 1) * sizes
        f = np.where(t % capacity == 0, sizes * k, (t // capacity) * capacity)  # times k * capacity
        best = max(best, -int(-(many * f).sum() // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and each bin's free space. Bins are found by a bit mask of the free sizes that exist."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_free: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if fits := mask >> n:
            room = n + ((fits & -fits).bit_length() - 1)
            bins = by_free[room]
            b = bins.pop()
            if not bins:
                mask &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        where[i], offset[i] = b, capacity - room
        free[b] = room - n
        if free[b]:
            by_free.setdefault(free[b], []).append(b)
            mask |= 1 << free[b]
    return where, offset, np.asarray(free, np.int64)


def _packer(round_: int, last: bool, capacity: int, slack: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one group; unless it is certified or this is the last round, rows of badly filled sequences aren't final."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "salt", "doc_id", "piece"], ascending=[False, True, True, True], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        where, offset, free = best_fit_decreasing(lengths, capacity)
        certified = len(free) <= lower_bound(lengths, capacity)
        out = np.zeros(len(free), bool) if certified or last else free > slack * capacity
        rows["final"] = ~out[where]
        rows["sequence_id"] = (round_ << 56) + (int(key[0]) << 24) + where
        rows["offset"] = offset
        return rows.drop(columns="grp")

    return packed


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_rows: int = 8192, slack: float = 0.005) -> DataFrame:
    """A row of PACKED for each piece. Groups hold about ``group_rows`` pieces; a group with a gap gives up its sequences with over ``slack`` of their room free."""
    spark = docs.sparkSession
    cut, _ = store(pieces(docs, path, capacity), "pieces")
    one = cut.where(F.col("length") == capacity)
    done = [one.select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = cut.where(F.col("length") < capacity).withColumn("salt", F.xxhash64("doc_id", "piece", "salt", "ids_crc32"))
    n, before = left.count(), math.inf
    for round_ in count():
        if not n:
            break
        groups = max(1, math.ceil(n / group_rows))
        last = groups == 1 or n > 0.9 * before

        dealt = left.withColumn("grp", F.pmod(F.xxhash64("salt", F.lit(round_)), F.lit(groups)))
        result, _ = store(dealt.groupBy("grp").applyInPandas(_packer(round_, last, capacity, slack), f"{PIECES}, final boolean, sequence_id long, offset long"), "packed")
        done.append(result.where("final").select(*[c.split()[0] for c in PACKED.split(", ")]))
        left = result.where("NOT final").select(*[c.split()[0] for c in PIECES.split(", ")])
        n, before = 0 if last else left.count(), n
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """``sequences`` of a packing, the ``bound`` below which none can go, and ``over``: how many sequences are not certified to be needed."""
    lengths = packed.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most one row for each length up to the capacity
    bound = lower_bound(np.array([r.length for r in lengths], np.int64), capacity, np.array([r.n for r in lengths], np.float64)) if lengths else 0
    sequences = packed.select("sequence_id").distinct().count()
    return {"sequences": sequences, "bound": bound, "over": sequences - bound}
