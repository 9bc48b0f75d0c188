"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .words import parts, release

CACHE_WORDS = 200_000
#: Marks that may be taken off a word's end where one of APART stands before them.
MARKS = ".,;:!?|#*%&$()\"+=-"
APART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LONGEST_CACHED = 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts as the concatenation of their blank-separated words' ids.

    This holds for vocabularies that drop white space and lower-case before
    they split, and take runs of letters, single digits and runs of all else
    apart, as word_bpe_49k does: no token and no normalisation reaches over an
    ASCII blank, and an ASCII letter's case does not matter but before a
    combining mark. A run of marks at a word's end has ids of its own only
    where a letter or a digit stands before it; after any other symbol the run
    begins further left, so such words are encoded whole, as are those with a
    letter beyond ASCII there, which may be lower-cased or composed to more
    than a letter. Splitting, finding the distinct words of a batch and putting
    their ids together again are Arrow's; ids are kept by word, in a bounded
    memo that lasts for a task.
    """

    END_OF_WORD = "</w>"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith(self.END_OF_WORD)]] = True
        self.ids: dict[str, bytes] = {"": b""}

    def encode(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """All texts' ids as little-endian unsigned 32-bit numbers, and where in bytes each text's begin and end."""
        if len(self.ids) > CACHE_WORDS:
            self.ids = {"": b""}
        texts = pc.fill_null(texts, "")
        # case stays where it could matter: in special tokens, before combining marks
        keep = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\u0300-\u036f]"))
        words = pc.ascii_split_whitespace(pc.if_else(keep, texts, pc.ascii_lower(texts)))
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.ids
        new = [w for w in distinct if w not in known]
        self._learn(new)
        joined = pa.array([known[w] for w in distinct], pa.large_binary()).take(coded.indices)
        for w in new:
            if len(w) > LONGEST_CACHED:
                del known[w]
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        return memoryview(joined.buffers()[2] or b""), offsets[bounds]

    def _learn(self, new: list[str]) -> None:
        """Keeps the ids of ``new`` words: those of what ends in an ASCII letter or digit, then those of the marks after it."""
        known = self.ids
        special = [w for w in new if "<|" in w]
        for w in special:  # may be a special token
            known[w] = self._pack(self.tokenizer.encode(w, add_special_tokens=False).ids)
        split = [(w, base, w[len(base) :]) if base[-1:] in APART else (w, w, "") for w in new for base in (w.rstrip(MARKS),)]
        if special:
            split = [x for x in split if "<|" not in x[0]]
        fresh = {base for _, base, _ in split}
        fresh.update([tail for _, _, tail in split])
        fresh = [x for x in fresh if x not in known]
        plain = [x for x in fresh if x.isalpha()]
        for lo in range(0, len(plain), 500):  # one call for many words: each is one run of letters and ends in one end-of-word token
            part = plain[lo : lo + 500]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            if len(ends) == len(part):
                flat = ids.tobytes()
                known.update(zip(part, [flat[i:j] for i, j in pairwise([0, *ends])], strict=True))
        rest = [x for x in fresh if x not in known]
        for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[x] = self._pack(e.ids)
        known.update([(w, known[base] + known[tail]) for w, base, tail in split if tail])
        for x in set(fresh).difference(new):
            if len(x) > LONGEST_CACHED:
                del known[x]

    @staticmethod
    def _pack(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        tail, step = np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part in parts(batch, 1, 1024, 1 << 23):
                ids, bounds = words.encode(part.column(1))
                out: list[tuple] = []
                for doc, begin, end in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if end - begin < step:
                        out.append((doc, 0, 0, (end - begin) // 4 + 1, zlib.crc32(tail, zlib.crc32(ids[begin:end]))))
                        continue
                    own = bytes(ids[begin:end]) + tail
                    out += [(doc, k, at // 4, len(own[at : at + step]) // 4, zlib.crc32(own[at : at + step])) for k, at in enumerate(range(0, len(own), step))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.ids = {"": b""}
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over remaining capacities 0..top: how many open runs of bins have each."""

    def __init__(self, top: int):
        self.size = 1 << (top + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, at: int, by: int) -> None:
        k = at + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need that an open bin has, in logarithmic time."""
        k = need + self.size
        if self.count[k]:
            return need
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Pieces of one length are interchangeable, and so are open bins with one
    remaining capacity, so a run of equal bins is filled in one step. The
    outcome is that of placing the pieces one by one, but the work and the
    plan depend on ``capacity`` only, not on the number of pieces.

    Rows: (length, first rank, first bin, pieces per bin, offset of the first
    in its bin), in order of length and rank.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}
    plan: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def open_(room: int, first: int, n: int) -> None:
        if n:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -1)
            each = room // length
            plan.append((length, rank, first, each, capacity - room))
            full = min(n, left // each)
            open_(room - each * length, first, full)
            placed = full * each
            if full < n and left > placed:
                rest = left - placed
                open_(room - rest * length, first + full, 1)
                open_(room, first + full + 1, n - full - 1)
                placed = left
            else:
                open_(room, first + full, n - full)
            left -= placed
            rank += placed
    return sorted(plan)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into as few ``capacity``-token sequences as best-fit decreasing finds.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Documents are tokenised once and written to the shared folder as
    lengths only. The driver sees a histogram of at most ``capacity`` lengths.
    Pieces are ranked within a length in two levels (hash bucket, then row),
    so a length that a third of all pieces have is spread over many tasks.

    Null and empty texts are the end id alone: one piece of length 1. Repeated
    rows and equal ids are packed one by one. Columns other than the id and
    the text are ignored. An empty table gives an empty result.
    """
    path = tokenizer_path or default_tokenizer()
    cut = materialise(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    buckets = max(256, sum(counts.values()) // 20_000)
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    own = Window.partitionBy("length", "bucket")
    before = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = rows.withColumn("rank", F.row_number().over(own.orderBy("doc_id", "piece")) - 1).join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    table = np.asarray(plan, np.int64).reshape(-1, 5)
    shift = 44
    keys = (table[:, 0] << shift) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            row = table[np.searchsorted(keys, (length << shift) | rank, "right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
