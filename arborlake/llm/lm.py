"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .words import parts as slices, release

#: The token after a text's last word; no word holds a blank.
END = b" "
#: Tokens or pairs that a task sums up before it hands them on.
TOKENS = 2_000_000
#: Bytes of text that are split and looked up at once, unless one text has more.
SLICE = 1 << 22


@dataclass(frozen=True)
class Vocabulary:
    """What the model tells apart: units, and within them words with vectors of their own.

    Units are the commonest words alone, others by their first two and last
    bytes, and the rest. A token's id is its own word's, or beyond those its
    unit's for all other words of the unit.
    """

    words: dict[bytes, int]
    shapes: dict[bytes, int]
    own: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.words) + len(self.shapes) + 1

    def unit(self, word: bytes) -> int:
        k = self.words.get(word)
        return k if k is not None else self.shapes.get(word[:2] + word[-1:], self.size - 1)

    def unit_of_id(self) -> np.ndarray:
        return np.asarray([*map(self.unit, self.own), *range(self.size)], np.int64)


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of binary ``texts`` end to end, A-Z lower-cased, and how many each text has."""
    texts = pc.fill_null(texts, b"")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), np.diff(before[edges])


class Ids:
    """Ids of words and of texts' tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.own = _strings(list(vocabulary.own))
        self.end = vocabulary.own[END]
        shapes = sorted((x[0] | x[1] << 8 | (x[2] << 16 if len(x) > 2 else 1 << 24), k) for x, k in vocabulary.shapes.items())
        self.shapes, units = np.array(shapes, np.int64).reshape(-1, 2).T
        self.units, self.rest = np.append(units, vocabulary.size - 1), vocabulary.size - 1

    def of_words(self, words: pa.Array) -> np.ndarray:
        found = pc.fill_null(pc.index_in(words, value_set=self.own), -1).to_numpy().astype(np.int64)
        at = np.nonzero(found < 0)[0]
        others = words.take(pa.array(at))
        edges = np.frombuffer(others.buffers()[1], np.int32)[others.offset : others.offset + len(others) + 1].astype(np.int64)
        if len(at):
            raw = np.frombuffer(others.buffers()[2], np.uint8).astype(np.int64)
            first, last, single = raw[edges[:-1]], raw[edges[1:] - 1], np.diff(edges) == 1
            shape = first | raw[np.minimum(edges[:-1] + 1, edges[1:] - 1)] << 8 | np.where(single, 1 << 24, last << 16)
            k = np.searchsorted(self.shapes, shape)
            hit = np.append(self.shapes, -1)[k] == shape
            found[at] = len(self.own) + np.where(hit, self.units[k], self.rest)
        return found

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all tokens of ``texts`` end to end, the place after each text, and the words without the ends."""
        words, n = text_words(texts)
        edges = np.cumsum(n + 1)
        out = np.full(len(words) + len(n), self.end, np.int64)
        inner = np.ones(len(out), bool)
        inner[edges - 1] = False
        out[inner] = self.of_words(words)
        return out, edges, words


def _strings(words: list[bytes] | pa.Array) -> pa.Array:
    """Bytes as an Arrow array of text, valid UTF-8 or not."""
    x = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(x), x.buffers(), offset=x.offset)


def _binary(words: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(words), words.buffers(), offset=words.offset)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def held_out(id_col: str, modulus: int):
    """Whether a row is kept from learning: crc32 of the id as text is divisible by ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c): every token's count over ``texts``; tasks hand on partial counts of bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            got = pc.value_counts(pa.concat_arrays(held))
            held.clear()
            return pa.RecordBatch.from_arrays([_binary(got.field(0)), got.field(1)], ["word", "c"])

        ends = 0
        for b in batches:
            for part in slices(b, 1, 1024, SLICE):
                held.append(text_words(part.column(1))[0])
                ends += part.num_rows
                if sum(map(len, held)) > TOKENS:
                    yield flush()
        if held:
            yield flush()
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends])], ["word", "c"])
        release()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` of the commonest words with their counts, in order: those above a count that a histogram gives."""
    step = F.floor(F.log2("c") * 16)
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        if r["n"] > left:
            break
        left, least = left - r["n"], r["step"]
    if least is None:
        return []
    got = counts.where(step >= least).select("word", "c").toArrow()
    return sorted(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _fold(keys: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, ns = keys[order], ns[order]
    first = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[first], np.add.reduceat(ns, first) if len(first) else ns


def _packed(keys: np.ndarray, ns: np.ndarray, size: int) -> pa.RecordBatch:
    """(id, after): a row for each id with its (previous unit, count) as pairs of 64-bit numbers."""
    ident, before = np.divmod(keys, size)
    first = np.nonzero(np.diff(ident, prepend=-1))[0]
    edges = np.append(first, len(keys)).astype(np.int32) * 16
    body = pa.py_buffer(np.stack([before, ns], axis=1).astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ident[first]), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges.tobytes()), body])], ["id", "after"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, previous unit, count) of every pair in a batch of packed rows."""
    ident, after = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    pairs = np.frombuffer(b"".join(after), "<i8").reshape(-1, 2)
    return np.repeat(ident, [len(x) // 16 for x in after]), pairs[:, 0], pairs[:, 1]


def pair_counts(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, after): counts of every id after each unit over ``texts``, packed; a text begins after END.

    Tasks hand on sums over some two million tokens, and an id's sums meet in
    one task, which folds them as they come: it holds distinct pairs only.
    """
    size = vocabulary.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit_of, end = Ids(vocabulary), vocabulary.unit_of_id(), vocabulary.unit(END)
        held: list[np.ndarray] = []
        for b in batches:
            for part in slices(b, 1, 1024, SLICE):
                k = ids.of_texts(part.column(1))[0]
                held.append(k * size + np.concatenate([[end], unit_of[k[:-1]]]))  # each text's end stands before the next text
                if sum(map(len, held)) > TOKENS:
                    yield _packed(*np.unique(np.concatenate(held), return_counts=True), size)
                    held = []
        if held:
            yield _packed(*np.unique(np.concatenate(held), return_counts=True), size)
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ns = np.empty(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            ident, before, n = _unpacked(b)
            held.append((ident * size + before, n))
            if sum(len(x) for x, _ in held) > TOKENS:
                keys, ns = _fold(*map(np.concatenate, zip((keys, ns), *held, strict=True)))
                held = []
        keys, ns = _fold(*map(np.concatenate, zip((keys, ns), *held, strict=True)))
        lo = 0
        while lo < len(keys):  # cut between ids
            last = keys[min(lo + TOKENS, len(keys)) - 1] // size
            hi = int(np.searchsorted(keys, (last + 1) * size))
            yield _packed(keys[lo:hi], ns[lo:hi], size)
            lo = hi
        release()

    return texts.mapInArrow(count, "id long, after binary").repartition("id").mapInArrow(add, "id long, after binary")


def unit_pairs(pairs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(previous unit, unit) counts of own words and of other words."""
    size = vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * size * size, np.int64)
        unit_of = vocabulary.unit_of_id()
        for b in batches:
            ident, before, n = _unpacked(b)
            np.add.at(counts, ((ident >= len(vocabulary.own)) * size + before) * size + unit_of[ident], n)
        at = np.nonzero(counts)[0]
        for lo in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 100_000]), pa.array(counts[at[lo : lo + 100_000]])], ["pair", "n"])

    got = pairs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size * size)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    own, other = out.reshape(2, size, size)
    return own, other


def train(pairs: np.ndarray, rank: int = 32, noise: int = 20, steps: int = 400, rate: float = 0.05, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(previous, unit) log10 probabilities of a log-bilinear model and each context's vector, from a matrix of pair counts.

    The score of unit w after h is r_w . (C q_h) + b_w. Noise-contrastive
    estimation against the unigram distribution, ``noise`` samples a pair, in
    expectation: every pair of the corpus and the noise's exact expectation
    make one smooth objective, descended by Adam over all pairs at once. The
    matrix product of all contexts with all units then gives the exact
    normaliser.
    """
    size = len(pairs)
    total = pairs.sum()
    if not total:
        return np.full((size, size), -np.log10(size)), np.zeros((size, rank))
    rng = np.random.default_rng(seed)
    seen = pairs.sum(axis=1) / total
    base = (pairs.sum(axis=0) + 0.1) / (total + 0.1 * size)
    data = (pairs / total).astype(np.float32)
    false = (noise * np.outer(seen, base)).astype(np.float32)
    shift = np.log(noise * base).astype(np.float32)
    scale = 0.3 / rank**0.5
    params = [rng.normal(0, scale, (size, rank)).astype(np.float32), np.eye(rank, dtype=np.float32), rng.normal(0, scale, (size, rank)).astype(np.float32), np.log(base).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        q, c, r, b = params
        h = q @ c.T
        delta = h @ r.T + (b - shift)
        true = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
        slope = (data + false) * true - data  # of the mean negative objective by the score
        gh = slope @ r
        grads = [gh @ c, gh.T @ q, slope.T @ h, slope.sum(axis=0)]
        step = rate * (1 - t / (steps + 1))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    q, c, r, b = (p.astype(np.float64) for p in params)
    h = q @ c.T
    scores = h @ r.T + b
    top = scores.max(axis=1, keepdims=True)
    return (scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))) / np.log(10), h


def features(contexts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(unit, rank + 1): context vectors turned to mean 0 and unit covariance over tokens, and a constant; unseen ones stand at the mean."""
    if not seen.sum():
        return np.ones((len(contexts), 1), np.float32)
    share = seen / seen.sum()
    off = contexts - share @ contexts
    values, axes = np.linalg.eigh((off * share[:, None]).T @ off)
    x = off @ axes / np.sqrt(np.maximum(values, 1e-6 * max(values.max(), 1e-12)))
    x *= np.minimum(1, 3 * x.shape[1] ** 0.5 / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)) * (seen > 0)[:, None]
    return np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)


def fit_words(data: np.ndarray, seen: np.ndarray, share: np.ndarray, x: np.ndarray, noise: int = 20, ridge: float = 10.0, steps: int = 8) -> np.ndarray:
    """Vectors of words by noise-contrastive estimation within their units.

    ``data`` (word, context) counts the word after each context, ``seen``
    (word, context) all own words of its unit there, ``share`` the word's part
    of its unit. The score of a word is log share + r . x; its noise comes by
    share, ``noise`` samples a token, in expectation. With contexts fixed,
    words do not depend on each other, so each is one convex problem, solved by
    damped Newton steps; ``ridge`` holds words with few tokens near r = 0.
    """
    weight = data + noise * share[:, None] * seen
    rank = x.shape[1]
    at = np.triu_indices(rank)
    squares = x[:, at[0]] * x[:, at[1]]
    r = np.zeros((len(data), rank), np.float32)
    for _ in range(steps):
        true = 1 / (1 + np.exp(np.log(noise) - np.clip(r @ x.T, -30, 30)))
        slope = (weight * true - data) @ x + ridge * r
        curve = np.zeros((len(data), rank, rank))
        curve[:, at[0], at[1]] = curve[:, at[1], at[0]] = (weight * true * (1 - true)) @ squares
        curve[:, range(rank), range(rank)] += ridge
        step = np.linalg.solve(curve, slope[:, :, None].astype(np.float64))[:, :, 0].astype(np.float32)
        most = np.abs(step @ x.T).max(axis=1, initial=0)
        r -= step * np.minimum(1, 2 / np.maximum(most, 1e-9))[:, None]
    return r


def word_vectors(pairs: DataFrame, vocabulary: Vocabulary, seen: np.ndarray, share: np.ndarray, x: np.ndarray, noise: int, ridge: float) -> np.ndarray:
    """(own word, rank + 1) vectors, each fitted where the word's pairs are."""
    size, rank, count = vocabulary.size, x.shape[1], len(vocabulary.own)
    shared = pairs.sparkSession.sparkContext.broadcast((seen.T.astype(np.float32).copy(), share.astype(np.float32), x, vocabulary.unit_of_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, share, x, unit_of = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ident, before, n = _unpacked(b.slice(lo, 256))
                words, row = np.unique(ident, return_inverse=True)
                data = np.zeros((len(words), size), np.float32)
                np.add.at(data, (row, before), n)
                r = fit_words(data, seen[unit_of[words]], share[words], x, noise, ridge)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([v.tobytes() for v in r], pa.binary())], ["id", "vector"])
        release()

    got = pairs.where(F.col("id") < count).mapInArrow(run, "id long, vector binary").toArrow()
    out = np.zeros((count, rank), np.float32)
    if got.num_rows:
        out[got["id"].to_numpy()] = np.frombuffer(b"".join(got["vector"].to_pylist()), np.float32).reshape(-1, rank)
    return out


def normalisers(vectors: np.ndarray, unit_of: np.ndarray, share: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(context, unit): log10 of the sum over a unit's own words of share * exp(r . x)."""
    size = len(x)
    total = np.zeros((size, size))
    order = np.argsort(unit_of[: len(vectors)], kind="stable")
    for lo in range(0, len(order), 4096):
        k = order[lo : lo + 4096]
        part = share[k, None] * np.exp(np.clip(vectors[k] @ x.T, -30, 30))
        first = np.nonzero(np.diff(unit_of[k], prepend=-1))[0]
        total[unit_of[k[first]]] += np.add.reduceat(part, first, axis=0)
    return np.log10(np.where(total > 0, total, 1)).T


def score_texts(docs: DataFrame, modulus: int = 10, add: float = 0.1, words: int = 600, shapes: int = 400, own: float = 10.0, most: int = 400_000, common: int | None = None, rank: int = 32, noise: int = 20, steps: int = 400, ridge: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Tokens are the blank-separated words of the text, A-Z lower-cased, then one
    end. Rows not held out teach: all their tokens are counted, and all their
    pairs of a unit and the next token. Units are the end and ``words``
    commonest words, ``shapes`` commonest forms (first two and last byte) of
    other words, and the rest. A log-bilinear model over units gives a unit's
    probability after the unit before. Within units, ``common`` commonest words
    have vectors of their own: by default ``own`` times the root of the number
    of training tokens, so that what is learnt of words and their contexts
    grows with the corpus, and ``most`` of them at most, which bounds the
    broadcast. Own words share what is theirs of the unit by a log-bilinear
    score after the unit before. Any other word's probability in its unit is
    (c + add) / (C + add * (W + 1)), with C and W the unit's tokens and words
    in training, so that with an unknown word for each unit all sums to one.
    base_score is the additive unigram model's.

    The driver holds the vocabulary, the vectors of own words and matrices of
    pairs of units, bounded by the parameters; own words' counts and vectors go
    to all tasks; other tokens meet their counts in a join on the word, which
    has no hot keys as the common ones are out.

    Texts of any length count whole; null and empty ones are the end alone. Null ids are not held
    out and teach nothing. Repeated rows come back repeated. Other columns are ignored. An
    empty table gives an empty result.
    """
    texts = _texts(docs, id_col, text_col)
    learn = texts.where(~held_out("doc_id", modulus))
    counts = materialise(token_counts(learn), "counts")
    facts = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = facts[0] or 0, facts[1]
    top = common_words(counts, common if common is not None else min(most, int(own * total**0.5)))
    if all(w != END for w, _ in top):
        ends = counts.where(F.col("word") == F.lit(bytearray(END))).first()
        top.append((END, ends["c"] if ends else 0))
    alone = {END: 0}
    for w, _ in top[:words]:
        alone.setdefault(w, len(alone))
    shape = F.concat(F.substring("word", 1, 2), F.expr("substring(word, -1, 1)"))
    singles = docs.sparkSession.createDataFrame([(w,) for w in alone], "word binary")
    forms = counts.join(F.broadcast(singles), "word", "left_anti").groupBy(shape.alias("shape")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "shape").limit(shapes).collect()
    vocabulary = Vocabulary(alone, {bytes(r["shape"]): len(alone) + k for k, r in enumerate(forms)}, {w: k for k, (w, _) in enumerate(top)})

    pairs = materialise(pair_counts(learn, vocabulary), "pairs")
    of_own, of_others = unit_pairs(pairs, vocabulary)
    table, contexts = train(of_own + of_others, rank, noise, steps)
    x = features(contexts, (of_own + of_others).sum(axis=1))
    unit_of = vocabulary.unit_of_id()
    count = np.array([c for _, c in top], float) + add
    share = count / np.bincount(unit_of[: len(top)], count, vocabulary.size)[unit_of[: len(top)]]
    vectors = word_vectors(pairs, vocabulary, of_own, share, x, noise, ridge)
    inside = unit_totals(counts, vocabulary)
    table = table - np.log10(inside[:, 0] + add * (inside[:, 1] + 1))
    tables = np.stack([table - normalisers(vectors, unit_of, share, x), table])
    return _score(texts, counts, vocabulary, tables, vectors, x, np.log10(count), count > add, total, distinct, add, modulus)


def unit_totals(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """(size, 2): tokens and distinct words of each unit."""
    size = vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, 2))
        ids, unit_of = Ids(vocabulary), vocabulary.unit_of_id()
        for b in batches:
            k = unit_of[ids.of_words(_strings(b.column(0)))]
            out[:, 0] += np.bincount(k, b.column(1).to_numpy(), size)
            out[:, 1] += np.bincount(k, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out[:, 0]), pa.array(out[:, 1])], ["unit", "c", "n"])

    got = counts.select("word", "c").mapInArrow(run, "unit long, c double, n double").groupBy("unit").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).toPandas()
    out = np.zeros((size, 2))
    out[got["unit"].to_numpy()] = got[["c", "n"]].to_numpy()
    return out


FIELDS = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "words": pa.float64(), "model": pa.float64(), "rare": pa.list_(pa.binary()), "times": pa.list_(pa.int32())}


def _score(texts: DataFrame, counts: DataFrame, vocabulary: Vocabulary, tables: np.ndarray, vectors: np.ndarray, x: np.ndarray, logs: np.ndarray, taught: np.ndarray, total: int, distinct: int, add: float, modulus: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, tables.astype(np.float32), vectors / np.float32(np.log(10)), x, logs, taught))
    floor = float(np.log10(total + add * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's sums over its units and own words, and its other words with their counts."""
        vocabulary, tables, vectors, x, logs, taught = shared.value
        ids, unit_of, end, known = Ids(vocabulary), vocabulary.unit_of_id(), vocabulary.unit(END), len(vocabulary.own)
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for b in batches:
            for part in slices(b, 1, 1024, SLICE):
                k, edges, all_words = ids.of_texts(part.column(1))
                unit, other = unit_of[k], k >= known
                before = np.concatenate([[end], unit[:-1]])  # a text's end stands before the next text
                model = tables[other.astype(np.int64), before, unit].astype(np.float64)
                words, seen = np.zeros(len(k)), np.zeros(len(k), np.int64)
                at = np.nonzero(~other)[0]
                words[at], seen[at] = logs[k[at]], taught[k[at]]
                for lo in range(0, len(at), 65_536):
                    few = at[lo : lo + 65_536]
                    model[few] += np.einsum("ij,ij->i", vectors[k[few]], x[before[few]])
                first = np.concatenate([[0], edges[:-1]])
                sums = [np.add.reduceat(v, first) for v in (seen, words, model)]
                text = np.repeat(np.arange(len(edges)), np.diff(edges, prepend=0))
                at = np.nonzero(other)[0]
                rare = _binary(all_words).take(pa.array(at - text[at])).dictionary_encode()  # places without the ends before
                pair, times = np.unique(text[at] * max(len(rare.dictionary), 1) + rare.indices.to_numpy(), return_counts=True)
                text, word = np.divmod(pair, max(len(rare.dictionary), 1))
                lists = pa.array(np.searchsorted(text, np.arange(len(edges) + 1)), pa.int32())
                rows = [np.arange(serial, serial + part.num_rows), part.column(0), np.diff(edges, prepend=0), *sums]
                serial += part.num_rows
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(rows, FIELDS.values(), strict=False)], pa.ListArray.from_arrays(lists, rare.dictionary.take(pa.array(word))), pa.ListArray.from_arrays(lists, pa.array(times, pa.int32()))], list(FIELDS))
        release()

    parts = materialise(texts.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, words double, model double, rare array<binary>, times array<int>"), "sums")
    sums = ["n_tokens", "n_known", "words", "model"]
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("n"))
    none = F.lit(None).cast("long")
    met = rare.join(counts, "word", "left").select("row", none.alias("doc_id"), none.alias("n_tokens"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("n_known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + add)).alias("words"), F.lit(0.0).alias("model"))
    whole = parts.select("row", "doc_id", *sums).unionByName(met).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums])
    return whole.select("doc_id", F.coalesce(held_out("doc_id", modulus), F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("words") - F.col("n_tokens") * floor).alias("base_score"), (F.col("words") + F.col("model")).alias("score"))
