"""Vector codes: codebooks of vector parts refined by Yinyang Lloyd rounds, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialise
from .components import with_totals
from .topk import usable
from .words import release

#: Bounds are kept as 16-bit floats, lowered by this share, which is more than their rounding; what is above the largest is cut to it.
SLACK, LARGEST = 1e-3, 6e4
ROWS = 4096
HIGHEST = 2**63 - 1


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of (..., width) whole numbers: exact in 64 bits where they fit, else in Python's integers."""
    most = max(int(np.abs(x.astype(np.float64)).max(initial=0)), int(np.abs(y.astype(np.float64)).max(initial=0)))
    if 4 * (most + 1) ** 2 * max(1, x.shape[-1]) > HIGHEST:
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(axis=-1) if d.shape[-1] else np.zeros(d.shape[:-1], np.int64)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Codebook:
    """The entries of one part position, in groups of near ones, and how far each group's entries moved at most in the last round."""

    def __init__(self, entries: np.ndarray, groups: list[np.ndarray] | None = None, drift: np.ndarray | None = None):
        self.entries = entries
        self.groups = groups if groups is not None else self.clustered()
        self.drift = drift if drift is not None else np.zeros(len(self.groups))

    def clustered(self, rounds: int = 5) -> list[np.ndarray]:
        """Indices of the entries in groups, one for every ten, by a few rounds of k-means over the entries."""
        k = len(self.entries)
        x = self.entries.astype(np.float64)
        centre = x[np.linspace(0, k - 1, -(-k // 10)).astype(int)] if k else x
        of = np.zeros(k, np.int64)
        for _ in range(rounds):
            of = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1) if k else of
            centre = np.stack([x[of == g].mean(axis=0) if (of == g).any() else c for g, c in enumerate(centre)]) if k else centre
        return [np.nonzero(of == g)[0] for g in np.unique(of)]

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Codebook:
        """The codebook after a round: entry -> (parts, componentwise sums); entries without parts stay."""
        new = self.entries.copy()
        for e, (n, total) in sums.items():
            new[e] = [s // n for s in total]
        far = root(squared(new, self.entries)) * (1 + SLACK)
        return Codebook(new, self.groups, np.asarray([far[g].max() for g in self.groups]))

    def assign(self, x: np.ndarray, at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entries of parts ``x``, ties to the lower index: (indices, squared distances, bounds, distances computed).

        at, low: each part's entry in the last round, and for each group a
        bound that its distances to the group's other entries were not below. A
        group is scanned only if the bound, less the group's drift, is not
        above the distance to the part's own entry; distances that decide are
        whole numbers, so ties are seen as such.
        """
        n, every = len(x), np.arange(len(x))
        own = squared(x, self.entries[at])
        best, dist = at.copy(), own.copy()
        low = low - self.drift
        reach = root(own) * (1 + SLACK)
        first, second = np.full(low.shape, np.nan), np.full(low.shape, np.nan)
        work = n
        for g, members in enumerate(self.groups):
            rows = np.nonzero(low[:, g] <= reach)[0]
            if not len(rows):
                continue
            d = squared(x[rows, None], self.entries[None, members])
            work += d.size
            near = d.argmin(axis=1)
            least, index = d[np.arange(len(rows)), near], members[near]
            first[rows, g] = root(least)
            second[rows, g] = root(np.partition(d, 1, axis=1)[:, 1]) if len(members) > 1 else np.inf
            up = (least < dist[rows]) | (least == dist[rows]) & (index < best[rows])
            best[rows[up]], dist[rows[up]] = index[up], least[up]
        group = np.zeros(len(self.entries), np.int64)
        for g, members in enumerate(self.groups):
            group[members] = g
        scanned = ~np.isnan(first)
        left = np.nonzero((best != at) & ~scanned[every, group[at]])[0]
        new = np.where(scanned, first, low)
        new[left, group[at[left]]] = np.minimum(new[left, group[at[left]]], root(own[left]))
        inside = np.nonzero(scanned[every, group[best]])[0]
        new[inside, group[best[inside]]] = second[inside, group[best[inside]]]
        return best, dist, np.clip(new * (1 - SLACK), 0, LARGEST), work


def cut(v: np.ndarray, parts: int) -> list[np.ndarray]:
    """Consecutive parts of (rows, dim); where they cannot be equal, the first ones have a component more."""
    return np.array_split(v, parts, axis=1)


def rows_of(b: pa.RecordBatch, column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for lo in range(0, b.num_rows, ROWS):
        part = b.slice(lo, ROWS)
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def assigned(state: DataFrame, books: list[Codebook], dim: int, final: bool) -> DataFrame:
    """One round's assignment of (vec_id, label, v, at, low), null at and low in the first: the same columns, or (vec_id, label, code, error)."""
    groups = sum(len(b.groups) for b in books)
    edges = np.cumsum([0, *[len(b.groups) for b in books]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, v in rows_of(batch, 2, dim):
                n = b.num_rows
                start = b.column(3).null_count > 0
                at = np.zeros((n, len(books)), np.uint8) if start else np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, len(books))
                low = np.zeros((n, groups), np.float16) if start else np.frombuffer(b"".join(b.column(4).to_pylist()), np.float16).reshape(n, groups)
                code, bounds, error = np.empty_like(at), np.empty_like(low), np.zeros(n, object)
                for k, (book, x) in enumerate(zip(books, cut(v, len(books)), strict=True)):
                    lo, hi = edges[k], edges[k + 1]
                    best, dist, kept, _ = book.assign(x, at[:, k].astype(np.int64), low[:, lo:hi].astype(np.float64))
                    code[:, k], bounds[:, lo:hi] = best, kept
                    error = error + dist
                if final:
                    text = code.tobytes().hex()
                    width = 2 * len(books)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text[i * width : (i + 1) * width] for i in range(n)], pa.string()), pa.array([min(int(e), HIGHEST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in bounds], pa.binary())], ["vec_id", "label", "v", "at", "low"])
        release()

    return state.mapInArrow(run, "vec_id long, label string, code string, error long" if final else "vec_id long, label string, v array<long>, at binary, low binary")


def entry_sums(state: DataFrame, parts: int, entries: int, dim: int) -> list[dict[int, tuple[int, list[int]]]]:
    """Per part position, entry -> (parts, componentwise sums) of an assigned state: added up in tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = [np.zeros((entries, x.shape[1]), object) for x in cut(np.zeros((1, dim)), parts)]
        for batch in batches:
            for b, v in rows_of(batch, 0, dim):
                at = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, parts)
                safe = float(np.abs(v.astype(np.float64)).max(initial=0)) < 2.0**50  # sums of a slab fit in 64 bits
                for k, x in enumerate(cut(v, parts)):
                    slab = np.zeros(total[k].shape, np.int64 if safe else object)
                    np.add.at(slab, at[:, k], x if safe else x.astype(object))
                    total[k] += slab
                    count[k] += np.bincount(at[:, k], minlength=entries)
        out = [(k, int(e), j, int(count[k, e]), s) for k in range(parts) for e in np.nonzero(count[k])[0] for j, s in enumerate(total[k][e])]
        if out:
            k, e, j, n, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.int64()), pa.array(map(str, s), pa.string())], ["part", "entry", "j", "n", "s"])
        release()

    added = state.select("v", "at").mapInArrow(run, "part int, entry int, j int, n long, s string").groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums: list[dict[int, tuple[int, list[int]]]] = [{} for _ in range(parts)]
    for r in sorted(added.collect(), key=lambda r: r["j"]):
        sums[r["part"]].setdefault(r["entry"], (r["n"], []))[1].append(int(r["s"]))
    return sums


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): vectors coded by the nearest entries of a codebook for each part position.

    Components become floor(``scale`` * x), x as double. Codebooks start as the
    parts of the ``entries`` smallest vec_ids' vectors; each of ``rounds``
    Lloyd rounds assigns all parts and replaces entries by their parts'
    componentwise floored means; then parts are assigned again. Assignment is
    Yinyang's: entries of a codebook are in groups, each row keeps one lower
    bound a group, and only groups whose bound fails after their entries' drift
    are scanned (Codebook.assign). Rows and bounds are written once a round, as
    a table that replaces the last one; the driver holds the codebooks and
    their sums, ``entries`` times the length of a vector, and no rows.

    code has two hexadecimal digits for each part; error is the sum of squared
    distances, label_error its sum over rows of an equal label, null labels
    together, codebooks_sha256 of all final entries' components.

    Vectors that are null or hold null, NaN or infinite components are
    dropped, and those of another length than the first kept vector's (the
    least vec_id's). Lengths that ``parts`` does not divide give the first
    parts a component more. Null ids are kept and come last; repeated rows are
    rows each, ties among the smallest ids go to the smaller vector. With fewer
    rows than ``entries`` there are as many entries. Components and sums beyond
    64 bits count as the nearest such number. Other columns are ignored. An
    empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).cast("string").alias("label")).where(usable("x"))
    named = own.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("x").alias("dim"))
    first = named.orderBy(F.col("vec_id").asc_nulls_last(), "v", "label").limit(1).collect()
    dim = first[0]["dim"] if first else 0
    rows = named.where(F.col("dim") == dim).select("vec_id", "label", "v")
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v", "label").limit(entries).collect()
    seeds = np.asarray([r["v"] for r in least], np.int64).reshape(len(least), dim)
    books = [Codebook(x) for x in cut(seeds, parts)]
    state = rows.select("*", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("low"))
    for r in range(rounds if len(seeds) else 0):
        new = materialise(assigned(state, books, dim, False), "codes")
        if r:
            discard(state)
        state = new
        books = [book.moved(s) for book, s in zip(books, entry_sums(state, parts, len(seeds), dim), strict=True)]
    coded = materialise(assigned(state, books, dim, True).withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "coded")
    if rounds and len(seeds):
        discard(state)
    digest = hashlib.sha256(",".join(str(int(c)) for book in books for entry in book.entries for c in entry).encode()).hexdigest()
    exact = coded.withColumn("label_error", F.col("error").cast("decimal(38,0)"))
    total = with_totals(exact, "key", "vec_id", {"label_error": F.sum})
    return total.select("vec_id", "label", "code", "error", F.least("label_error", F.lit(HIGHEST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def compressed_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """DuckDB SQL for op12's rows: every part against every entry, round by round. For vectors whose length ``parts`` divides and sums below 2^53."""
    near = lambda r: f"""near{r} AS (  -- squared distance and entry as one number, so that ties go to the lower entry
        SELECT row, p.part, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * {entries} + e) AS m
        FROM p JOIN book{r} b ON b.part = p.part GROUP BY ALL)"""  # noqa: E731
    book = lambda r: f"""mean{r} AS (SELECT part, e, list(floor(s / n) ORDER BY j) AS c
        FROM (SELECT p.part, m % {entries} AS e, j, sum(x[j]) AS s, count(*) AS n FROM p JOIN near{r - 1} USING (row, part), range(1, (SELECT max(len(x)) FROM p) + 1) t(j) GROUP BY ALL) GROUP BY ALL),
      book{r} AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM book{r - 1} b LEFT JOIN mean{r} m USING (part, e))"""  # noqa: E731
    steps = ",\n      ".join([near(0), *[x for r in range(1, rounds + 1) for x in (book(r), near(r))]])
    return f"""
      WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
                 WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) IS NOT FALSE),
      n AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v, label) AS row FROM v),
      p AS (SELECT row, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM n, range({parts}) t(part)),
      book0 AS (SELECT part, row - 1 AS e, x AS c FROM p WHERE row <= {entries}),
      {steps},
      coded AS (SELECT row, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM near{rounds} GROUP BY row)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
             (SELECT sha256(string_agg(c[j]::BIGINT::VARCHAR, ',' ORDER BY part, e, j)) FROM book{rounds}, range(1, len(c) + 1) t(j)) AS codebooks_sha256
      FROM n JOIN coded USING (row)"""
