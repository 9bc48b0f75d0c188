"""Languages of texts: mixtures fitted by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .words import mix, parts, release

ORDER = 3
BUCKETS = 1 << 14
LETTER, OTHER = regex.compile(r"\p{L}"), regex.compile(r"\P{L}+")
UNKNOWN = "und"


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of three letters of a whole text, lower-cased, and how often each occurs; any other characters are one space."""
    at = np.frombuffer(f" {OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = (at[:-2] << np.uint64(42)) | (at[1:-1] << np.uint64(21)) | at[2:]
    counts = np.bincount((mix(code) >> np.uint64(64 - 14)).astype(np.int64), minlength=BUCKETS)
    buckets = np.nonzero(counts)[0]
    return buckets, counts[buckets]


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves ``remainder``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


@dataclass
class Languages:
    """Smoothed n-gram probabilities by language, and the languages' shares of the teaching rows."""

    names: list[str]
    probability: np.ndarray  # (BUCKETS, languages)
    prior: np.ndarray

    @classmethod
    def of(cls, names: list[str], counts: np.ndarray, rows: np.ndarray, smoothing: float = 0.5) -> Languages:
        p = (counts + smoothing) / (counts.sum(axis=0) + smoothing * BUCKETS)
        return cls(names, p.astype(np.float32), rows / rows.sum())

    def fit(self, p: np.ndarray, c: np.ndarray, starts: np.ndarray, chosen: np.ndarray, rounds: int = 40, settled: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of each text's ``chosen`` languages (texts, languages) by expectation-maximisation, and the log-likelihoods.

        p, c: probabilities by language and counts of each text's n-grams, text
        after text from ``starts``. The likelihood is concave in the
        proportions, so every start leads to the best.
        """
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
        n = np.add.reduceat(c, starts)
        share = chosen / chosen.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            weight = p * share[own]
            weight *= (c / weight.sum(axis=1))[:, None]
            new = np.add.reduceat(weight, starts, axis=0) / n[:, None]
            moved = np.abs(new - share).max()
            share = new
            if moved < settled:
                break
        return share, np.add.reduceat(c * np.log((p * share[own]).sum(axis=1)), starts)

    def infer(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the selected languages (texts, languages), and each text's averaged proportion of its main language.

        A set's penalised log-likelihood is that of its mixture, over ORDER as
        every letter stands in so many n-grams, less half the logarithm of the
        number of letters for each free proportion, less the information of
        naming its languages by their shares of the teaching rows. Single
        languages come first; where no mixture of any languages could repay a
        second one, by the likelihood's tangent at the single, that is all.
        Else the languages with the largest proportions among all are tried
        two, three and more at a time while the penalised likelihood rises.
        """
        c = np.concatenate([x for _, x in grams]).astype(np.float64)
        p = self.probability[np.concatenate([b for b, _ in grams])].astype(np.float64)
        size = np.asarray([len(b) for b, _ in grams])
        starts = np.cumsum(size) - size
        n = np.add.reduceat(c, starts)
        name = -np.log(self.prior)
        single = np.add.reduceat(c[:, None] * np.log(p), starts, axis=0) / ORDER - name
        main = single.argmax(axis=1)
        every = np.arange(len(grams))
        share = np.zeros_like(single)
        share[every, main] = 1.0
        best = single[every, main]
        tried = [(single - best[:, None], None)]
        step = 0.5 * np.log(n)
        most = np.add.reduceat(p / p[np.arange(len(p)), np.repeat(main, size)][:, None] * c[:, None], starts, axis=0).max(axis=1) / n
        open_ = np.nonzero(n * np.log(most) / ORDER > step + name.min())[0] if len(self.names) > 1 else np.empty(0, np.int64)
        if len(open_):
            pick = lambda ids: np.concatenate([np.arange(starts[k], starts[k] + size[k]) for k in ids])
            at = pick(open_)
            full, _ = self.fit(p[at], c[at], np.cumsum(size[open_]) - size[open_], np.ones((len(open_), len(self.names))))
            order = np.argsort(-full, axis=1, kind="stable")
            for k in range(2, len(self.names) + 1):
                chosen = np.zeros((len(open_), len(self.names)))
                np.put_along_axis(chosen, order[:, :k], 1.0, axis=1)
                at = pick(open_)
                mixed, log = self.fit(p[at], c[at], np.cumsum(size[open_]) - size[open_], chosen)
                value = log / ORDER - chosen @ name - (k - 1) * step[open_]
                up = value > best[open_]
                tried.append((value, (open_, mixed)))
                share[open_[up]], best[open_[up]] = mixed[up], value[up]
                open_, order = open_[up], order[up]
                if not len(open_):
                    break
        main = share.argmax(axis=1)
        shift = (single.max(axis=1) - best)[:, None]
        weight = np.exp(np.minimum(0, tried[0][0] + shift))
        total, score = weight.sum(axis=1), weight[every, main]
        for value, (rows, mixed) in tried[1:]:
            w = np.exp(np.minimum(0, value - best[rows]))
            total[rows] += w
            score[rows] += w * mixed[np.arange(len(rows)), main[rows]]
        return share, np.clip(score / total, 0.0, 1.0)


def learn(docs: DataFrame, modulus: int, remainder: int, sample: int, languages: int, id_col: str, text_col: str, lang_col: str) -> Languages | None:
    """Counts n-grams by language over the rows that may teach; None if there are none.

    Of a language with over ``sample`` such rows about that many teach, by a
    hash of the id; of over ``languages`` values of ``lang_col`` those with the
    most rows are learned. That bounds what goes to the driver and to all
    tasks: 16,384 numbers for each language.
    """
    may = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id", modulus, remainder))
    rows = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not rows:
        return None
    every = max(rows.values())
    if every > sample or len(rows) == languages:
        kept = F.create_map(*[x for lang, n in rows.items() for x in (F.lit(lang), F.lit(n))])[F.col("lang")]
        may = may.where(F.pmod(F.xxhash64("id", F.lit(29)), kept) < sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0), strict=True):
                if LETTER.search(text := text.as_py()):
                    buckets, n = gram_counts(text)
                    held.setdefault(lang, np.zeros(BUCKETS, np.int64))[buckets] += n
        for lang, counts in held.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])
        release()

    got = may.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").unique().to_pylist()))
    if not names:
        return None
    counts = np.zeros((BUCKETS, len(names)))
    place = {lang: k for k, lang in enumerate(names)}
    of = np.asarray([place[x] for x in got.column("lang").unique().to_pylist()])
    counts[got.column("bucket").to_numpy(), of[got.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()]] = got.column("n").to_numpy()
    return Languages.of(names, counts, np.asarray([rows[x] for x in names], np.float64))


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, sample: int = 20_000, languages: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) for every row of ``docs``.

    Learns n-gram probabilities of each language from the rows that are not
    held out (see learn for the bounds). A text is then a mixture: its
    proportions of languages are estimated by expectation-maximisation from its
    n-grams alone, and the set of languages by penalised likelihood (see
    Languages.infer). lang_pred is the language with the largest proportion,
    ties to the least name; score is that proportion averaged over the sets
    tried, weighed by their penalised likelihoods; mixture lists the set's
    languages and proportions. Texts stay where they are, nothing is shuffled
    but counts.

    Null texts and texts without a letter are ``und`` with score 0 and no
    mixture, as is everything if there is nothing to learn from. Null ids are
    not held out and teach nothing; null languages teach nothing. Texts of any
    length count whole. Repeated rows come back repeated and teach each. Other
    columns are ignored. An empty table gives an empty result.
    """
    model = learn(docs, modulus, remainder, sample, languages, id_col, text_col, lang_col)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts(batch, 1, 512, max(1 << 14, (1 << 22) // len(model.names) if model else 1 << 22)):
                texts = b.column(1).to_pylist()
                known = [k for k, text in enumerate(texts) if model and text and LETTER.search(text)]
                langs, scores, mixtures = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                if known:
                    share, score = model.infer([gram_counts(texts[k]) for k in known])
                    for k, row, s in zip(known, share, score, strict=True):
                        langs[k], scores[k] = model.names[int(row.argmax())], float(s)
                        mixtures[k] = [{"lang": model.names[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, kind)], ["doc_id", "lang_pred", "score", "mixture"])
        release()

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")
    return found.select("doc_id", F.coalesce(held_out("doc_id", modulus, remainder), F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
