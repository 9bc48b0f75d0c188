"""Passages that documents share: paragraph MinHash banding with exact verification, and long exact runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .components import STRIP, block_pairs, components, thinned, with_totals
from .words import BYTE_BASE, Words, mix, parts, release

BLOCK = 512  # members of a compared block on average


def bands(similarity: float, rows: int = 3, recall: float = 0.999) -> int:
    """The fewest bands of ``rows`` hashes that let pairs of ``similarity`` collide with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


UNITS = "doc_id long, text_id long, run boolean, at int, start long, length long, key long, bands array<long>, text string"


def units(docs: DataFrame, width: int, least_words: int, n_bands: int, rows: int, window: int, spread: int, seed: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs and windows of every text, as rows of UNITS; start and length in bytes of UTF-8.

    A paragraph is a line of ``least_words`` words or more; bands hash ``rows``
    MinHash values of its distinct shingles each. A window (run is true) is
    ``window`` words from an anchor; windows have no bands and no text. key
    hashes the lower-cased words.
    """
    random = np.random.default_rng(seed)
    odd = random.integers(0, 2**63, n_bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    fold = random.integers(0, 2**63, (n_bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place = np.arange(n_bands, dtype=np.uint64) * np.uint64(BYTE_BASE)  # bands apart
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    names = ["doc_id", "text_id", "run", "at", "start", "length", "key", "bands", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 2, 256):
                lines: list[tuple] = []
                found: list[tuple[np.ndarray, ...]] = []
                for doc, own, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not text or len(w := Words(text)) < min(least_words, window):
                        continue
                    grams = w.grams(width)
                    cuts = np.concatenate([[0], np.nonzero(np.diff(w.line))[0] + 1, [len(w)]])
                    for i, j, key in zip(cuts[:-1], cuts[1:], w.run(cuts[:-1], cuts[1:]).view(np.int64).tolist(), strict=True):
                        if j - i >= least_words:
                            shingles = np.unique(grams[i : max(i + 1, j - width + 1)])
                            least = np.min([(odd[:, None] * shingles[None, k : k + 4096]).min(axis=1) for k in range(0, len(shingles), 4096)], axis=0).reshape(n_bands, rows)
                            s, e = int(w.starts[i]), int(w.ends[j - 1])
                            lines.append((doc, own, False, int(i), s, e - s, key, mix((least * fold).sum(axis=1, dtype=np.uint64) + place).view(np.int64), text[s:e].decode()))
                    at = w.anchors(width, spread)
                    at = at[at + window <= len(w)]
                    if len(at):
                        found.append((np.full(len(at), -1 if doc is None else doc), np.full(len(at), doc is None), np.full(len(at), own), at, w.starts[at], w.ends[at + window - 1] - w.starts[at], w.run(at, at + window).view(np.int64)))
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*lines, strict=True), types, strict=True)], names)
                if found:
                    ids, none, own, at, start, length, key = (np.concatenate(c) for c in zip(*found, strict=True))
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=none), pa.array(own, pa.int64()), pa.array(np.ones(n, bool)), pa.array(at.astype(np.int32)), pa.array(start), pa.array(length), pa.array(key), pa.nulls(n, types[7]), pa.nulls(n, types[8])], names)
        release()

    return documents(docs, id_col, text_col).mapInArrow(run, UNITS)


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_id, text): a document is an id with a text; rows that agree in both are one document."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.cast("binary").alias("text"))


def sieve(df: DataFrame, wanted: DataFrame, bits: int = 23) -> DataFrame:
    """The rows of ``df`` whose key may be one of ``wanted``'s: a bitmap of fixed size spares the others the shuffle.

    The driver sees the bitmap, 2**bits bits. Where there are many more wanted
    keys than bits all rows pass, and the join that follows does all the work.
    """
    mask = (1 << bits) - 1
    words = wanted.groupBy(F.expr(f"(key & {mask}) >> 6").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    packed = table.tobytes()
    at = df.columns.index("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        for b in batches:
            yield b.filter(pa.array(there[b.column(at).to_numpy() & mask]))

    return df.mapInArrow(run, df.schema)


def spanning_pairs(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of ``similarity`` or more that span the components.

    One set is compared with all others through postings; those it links need
    no comparison of their own, as whatever else they link is compared with
    them in its turn. A group of near copies so takes one turn.
    """
    n = len(sets)
    sizes = np.asarray([len(s) for s in sets])
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(index, kind="stable")
    starts = np.searchsorted(index[order], np.arange(len(values) + 1))
    own = np.split(index, np.cumsum(sizes)[:-1])
    posted = owner[order]
    done = np.zeros(n, bool)  # linked to the first set of its group
    pairs = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        if done[i]:
            continue
        common = np.bincount(np.concatenate([posted[starts[v] : starts[v + 1]] for v in own[i]]), minlength=n)
        near = np.nonzero(common >= similarity * (sizes + sizes[i] - common) - 1e-9)[0]
        near = near[near != i]
        pairs += [(i, int(j)) for j in near]
        if not done.any():
            done[near] = True
        done[i] = True
    return pairs


def near_paragraph_links(found: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links between distinct paragraphs (their keys) that span the components of verified pairs.

    Buckets of colliding paragraphs with the same members in several bands are
    compared once. A bucket is dealt into blocks of about 512 by hash, and
    every pair of its blocks is compared, in buckets of over STRIP blocks by
    keys of their own (block_pairs): none is cut short.
    """
    distinct = found.groupBy("key").agg(F.first("bands").alias("bands"))
    colliding = materialise(distinct.select("key", F.explode("bands").alias("bucket")), "bands")
    buckets = colliding.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("members")).where("n > 1")
    once = materialise(buckets.groupBy("n", "members").agg(F.min("bucket").alias("bucket")), "buckets")
    met = materialise(sieve(colliding.withColumnRenamed("key", "own").withColumnRenamed("bucket", "key"), once.select(F.col("bucket").alias("key"))).select(F.col("key").alias("bucket"), F.col("own").alias("key")).join(once.select("bucket", "n"), "bucket"), "met")
    wanted = met.select("key").distinct()
    texts = sieve(found.select("key", "text"), wanted).join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    blocks = materialise(met.join(texts, "key").withColumn("block", F.expr(f"pmod(xxhash64(key, 3), n div {BLOCK} + 1)")).withColumn("blocks", F.expr(f"n div {BLOCK} + 1")).groupBy("bucket", "block", "blocks").agg(F.collect_list(F.struct("key", "text")).alias("m")), "buckets")
    left = lambda df: df.select("bucket", "blocks", F.col("block").alias("own"), F.col("m").alias("l"))
    told = lambda met: met.where("own <= block").select(F.col("l.key").alias("a"), F.col("l.text").alias("x"), F.when(F.col("own") < F.col("block"), F.col("m.key")).alias("b"), F.when(F.col("own") < F.col("block"), F.col("m.text")).alias("y"))
    usual, crowded = blocks.where(F.col("blocks") <= STRIP), blocks.where(F.col("blocks") > STRIP)
    pairs = told(left(usual).drop("blocks").join(usual.drop("blocks"), "bucket"))
    if not crowded.isEmpty():
        pairs = pairs.unionByName(told(block_pairs(left(crowded), crowded, ["bucket"], "own", "block", "blocks")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.empty((0, 2), np.int64)]
            for a, x, b, y in batch.itertuples(index=False):
                ids = np.concatenate([np.asarray(a, np.int64), np.asarray([] if b is None else b, np.int64)])
                sets = [np.unique(Words(t.encode()).grams(width)) for t in [*x, *(y if y is not None else [])]]
                links = spanning_pairs(sets, similarity)
                if links:
                    out.append(thinned(ids[np.asarray(links)]))
            links = np.concatenate(out)
            yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return pairs.mapInPandas(run, "a long, b long")


#: Order of passages: of ids, null last; of the texts of an id; in a text.
FIRST = ["none", "doc_id", "text_id", "start"]


def classes(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (doc_id, text_id, start, length, key) in classes that ``links`` between keys join, those within one document apart."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "start")
    nodes = parts.groupBy("key").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.min(F.struct("doc_id", "text_id")).alias("lo"), F.max(F.struct("doc_id", "text_id")).alias("hi"))
    joined = components(links)
    named = nodes.join(joined, nodes["key"] == joined["node"], "left").withColumn("class", F.coalesce("component", "key"))
    of = with_totals(named, "class", "key", {"copies": F.sum, "first": F.min, "lo": F.min, "hi": F.max}).where("lo < hi").select("key", "copies", *[F.col(f"first.{c}").alias(f"class_{c}") for c in FIRST])
    own = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("text_id") == F.col("class_text_id")) & (F.col("start") == F.col("class_start"))
    return parts.join(of, "key").select("doc_id", "text_id", "start", "length", "class_doc_id", "class_text_id", "class_start", "copies", own.alias("kept"))


def forget(df: DataFrame) -> DataFrame:
    """``df``, a written table; the driver's garbage goes, and with it the shuffle files of the steps that led to it."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def islands(rows: DataFrame, own: list[str], lo: str, hi: str) -> DataFrame:
    """``rows`` with a column island: of the rows that agree in ``own``, those whose spans lo..hi touch or overlap have one number."""
    order = Window.partitionBy(*own).orderBy(lo, hi)
    cut = F.when(F.col(lo) > F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    return rows.withColumn("island", cut).withColumn("island", F.sum("island").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def stretches(windows: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_id, lo, hi, start, end, f_…): words lo..hi-1, bytes start..end-1 of a document equal those of another place, columns f_….

    ``windows`` (doc_id, text_id, at, start, length, key) have ``size`` words.
    A window that occurs in two documents is matched with its first occurrence;
    matches with one document at one distance in words that touch are one
    stretch.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "at", "start", "length")
    whose = F.xxhash64("doc_id", "text_id")
    shared = forget(materialise(windows.groupBy("key").agg(F.min(place).alias("f"), F.min(whose).alias("lo"), F.max(whose).alias("hi")).where("lo < hi").select("key", "f"), "shared"))
    met = sieve(windows, shared).join(shared, "key").withColumn("shift", F.col("at") - F.col("f.at"))
    apart = ~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_id") == F.col("f.text_id")) & (F.col("shift") == 0))
    own = ["doc_id", "text_id", "f_doc_id", "f_text_id", "shift"]
    spans = met.where(apart).select("doc_id", "text_id", F.col("f.doc_id").alias("f_doc_id"), F.col("f.text_id").alias("f_text_id"), "shift", F.col("at").alias("lo"), (F.col("at") + size).alias("hi"), "start", (F.col("start") + F.col("length")).alias("end"), F.col("f.start").alias("f_start"), (F.col("f.start") + F.col("f.length")).alias("f_end"))
    least, most = (lambda f: lambda *c: [f(x).alias(x) for x in c])(F.min), (lambda f: lambda *c: [f(x).alias(x) for x in c])(F.max)
    whole = islands(spans, own, "lo", "hi").groupBy(*own, "island").agg(*least("lo", "start", "f_start"), *most("hi", "end", "f_end"))
    return whole.select("doc_id", "text_id", "lo", "hi", "start", "end", "f_doc_id", "f_text_id", (F.col("lo") - F.col("shift")).alias("f_lo"), (F.col("hi") - F.col("shift")).alias("f_hi"), "f_start", "f_end")


SIDES = "doc_id long, text_id long, after boolean, at int, hashes array<long>, bytes array<long>"


def sides(docs: DataFrame, asked: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of SIDES for distinct places ``asked`` (doc_id, text_id, after, at): up to ``most`` words outwards.

    They are the words before word ``at``, or those from it on if ``after``:
    hashes, and the byte where what they extend begins (ends if ``after``) with
    0, 1, 2, … of them.
    """
    key = F.xxhash64("doc_id", "text_id").alias("key")
    each = asked.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("after", "at")).alias("places")).select("*", key)
    texts = sieve(documents(docs, id_col, text_col).select("*", key), each)
    same = (texts["key"] == each["key"]) & (texts["text_id"] == each["text_id"]) & texts["doc_id"].eqNullSafe(each["doc_id"])
    # a document's repeated rows say the same: one of them is enough
    held = texts.join(each, same).groupBy(each["key"], each["text_id"], each["doc_id"]).agg(F.first("text").alias("text"), F.first("places").alias("places")).select("doc_id", "text_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            for part in parts(b, 2, 256):
                out: list[tuple] = []
                for doc, own, text, places in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    w = Words(text)
                    for p in places:
                        after, at = p["after"], p["at"]
                        first, last = (at, min(len(w), at + most)) if after else (max(0, at - most), at)
                        words = np.arange(first, last)
                        hashes = w.run(words, words + 1).view(np.int64)
                        out.append((doc, own, after, at, hashes if after else hashes[::-1], w.ends[at - 1 : last] if after else w.starts[first : at + 1][::-1]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "text_id", "after", "at", "hashes", "bytes"])
        release()

    return held.mapInArrow(run, SIDES)


def grown(docs: DataFrame, found: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """Stretches with the ends of every island of them extended word by word, by up to ``most`` words, as far as both places agree.

    Within an island stretches touch, so only its first is extended to the left
    and its last to the right. Beyond ``most`` words there would have been
    another window.
    """
    numbered = forget(materialise(islands(found, ["doc_id", "text_id"], "lo", "hi").withColumn("id", F.monotonically_increasing_id()), "stretches"))
    whole = Window.partitionBy("doc_id", "text_id", "island")
    edge = numbered.withColumns({"first": F.min("lo").over(whole), "last": F.max("hi").over(whole)})
    ends = edge.where("lo = first").select("*", F.lit(False).alias("after"), F.col("lo").alias("at"), F.col("f_lo").alias("f_at")).unionByName(edge.where("hi = last").select("*", F.lit(True).alias("after"), F.col("hi").alias("at"), F.col("f_hi").alias("f_at")))
    ends = materialise(ends.select("id", "doc_id", "text_id", "after", "at", "f_doc_id", "f_text_id", "f_at"), "ends")
    place = ["doc_id", "text_id", "after", "at"]
    asked = ends.select(*place).union(ends.select("f_doc_id", "f_text_id", "after", "f_at")).distinct()
    about = forget(materialise(sides(docs, asked, most, id_col, text_col), "sides"))

    def met(rows: DataFrame, doc: str, to: str) -> DataFrame:
        side = about.select(*[F.col(c).alias(f"{to}_{c}") for c in about.columns])
        same = F.col(f"{doc}doc_id").eqNullSafe(F.col(f"{to}_doc_id")) & (F.col(f"{doc}text_id") == F.col(f"{to}_text_id")) & (F.col("after") == F.col(f"{to}_after")) & (F.col(f"{doc}at") == F.col(f"{to}_at"))
        return rows.join(side, same).drop(*[f"{to}_{c}" for c in place])

    both = met(met(ends, "", "o").drop(*place[:2], "at"), "f_", "k")
    same = F.zip_with("o_hashes", "k_hashes", lambda a, b: a.eqNullSafe(b))
    stop = F.array_position(same, F.lit(False))
    n = F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")
    reach = both.select("id", "after", n.alias("n"), F.get("o_bytes", n).alias("byte"), F.get("k_bytes", n).alias("f_byte"))
    of = lambda c, after: F.max(F.when(F.col("after") == after, F.col(c))).alias(f"{c}_{'r' if after else 'l'}")
    sized = reach.groupBy("id").agg(*[of(c, after) for c in ("n", "byte", "f_byte") for after in (False, True)])
    long = numbered.join(sized, "id", "left")
    none = F.lit(0)
    return long.select("doc_id", "text_id", (F.col("lo") - F.coalesce("n_l", none)).alias("lo"), (F.col("hi") + F.coalesce("n_r", none)).alias("hi"), F.coalesce("byte_l", "start").alias("start"), F.coalesce("byte_r", "end").alias("end"), "f_doc_id", "f_text_id", F.coalesce("f_byte_l", "f_start").alias("f_start"), F.coalesce("f_byte_r", "f_end").alias("f_end"))


def shared_runs(docs: DataFrame, windows: DataFrame, size: int, most: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_id, start, length, class_…, copies, kept): stretches that two places share, and the places they are kept at.

    Stretches of a document that touch and have under ``least`` words together
    are left out.
    """
    spans = islands(grown(docs, stretches(windows, size), most, id_col, text_col), ["doc_id", "text_id"], "lo", "hi")
    island = Window.partitionBy("doc_id", "text_id", "island")
    long = spans.withColumn("all", F.max("hi").over(island) - F.min("lo").over(island)).where(F.col("all") >= least)
    copies = forget(materialise(long.select("doc_id", "text_id", "start", (F.col("end") - F.col("start")).alias("length"), F.col("f_doc_id").alias("class_doc_id"), F.col("f_text_id").alias("class_text_id"), F.col("f_start").alias("class_start"), F.col("f_end").alias("class_end")), "runs"))
    of_place = ["class_doc_id", "class_text_id", "class_start", "class_end"]
    counted = with_totals(copies.withColumn("place", F.xxhash64(*of_place)).withColumn("copies", F.lit(1)), "place", "text_id", {"copies": F.sum}).withColumn("copies", F.col("copies") + 1)
    order = ["doc_id", "text_id", "start", "length", "class_doc_id", "class_text_id", "class_start", "copies"]
    first = counted.groupBy(*of_place, "copies").agg(F.lit(True).alias("kept")).select(F.col("class_doc_id").alias("doc_id"), F.col("class_text_id").alias("text_id"), F.col("class_start").alias("start"), (F.col("class_end") - F.col("class_start")).alias("length"), "class_doc_id", "class_text_id", "class_start", "copies", "kept")
    return counted.select(*order, F.lit(False).alias("kept")).unionByName(first)


PASSAGES = ["doc_id", "text_id", "kind", "start", "length", "class_doc_id", "class_text_id", "class_start", "copies", "kept"]


def repeated_passages(docs: DataFrame, width: int = 5, similarity: float = 0.8, least_words: int = 40, rows: int = 3, recall: float = 0.999, window: int = 32, spread: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns PASSAGES: every passage that occurs in two documents.

    kind paragraph: lines of ``least_words`` words or more are one class if a
    chain of pairs with exact Jaccard similarity >= ``similarity`` over
    ``width``-word shingles joins them; candidates collide in a MinHash band.
    Equal ones (letter case and blanks apart) are one node whatever their
    number. A class is named after its first passage by (doc_id, text_id,
    start), null ids last, which is the one that is kept.

    kind run: word for word repeats that need not fill a paragraph. Windows of
    ``window`` words begin at content-defined anchors, of which there is one in
    any ``spread`` places. Equal windows of different documents are found by
    hash and matched with their first occurrence; what touches at one distance
    is one stretch. Stretches of a document that touch are extended word by
    word at their outer ends. A stretch's class is the place that it equals:
    that copy is kept, and decided for each stretch by itself. Repeats of ``window + spread`` words or more are found,
    whole; shorter ones are left out.

    ``copies`` counts a class's passages. start and length are bytes of the
    text in UTF-8; text_id is the text's XXH64 as of Spark's xxhash64. Words,
    paragraphs and windows are told apart by 64-bit hashes. Passages that
    repeat within one document only do not occur.

    Null, empty and short texts have no passage. A document is an id with a
    text: rows of one id or of null ids with different texts are different
    documents, rows that agree in both are one. Other columns are ignored. An
    empty table gives an empty result.
    """
    found = materialise(units(docs, width, least_words, bands(similarity, rows, recall), rows, window, spread, id_col=id_col, text_col=text_col), "units")
    lines = found.where("not run")
    paragraphs = classes(lines.select("doc_id", "text_id", "start", "length", "key").distinct(), near_paragraph_links(lines, width, similarity))
    windows = found.where("run").select("doc_id", "text_id", "at", "start", "length", "key")
    runs = shared_runs(docs, windows, window, spread - 1, window + spread, id_col, text_col)
    return paragraphs.withColumn("kind", F.lit("paragraph")).unionByName(runs.withColumn("kind", F.lit("run"))).select(*PASSAGES)


def remove_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the bytes of ``passages`` (see repeated_passages) that are not kept.

    Null and empty texts and texts without such passages stay as they are.
    Passages belong to an id and a text, so null ids and different texts of an
    id are cut each by its own; repeated rows are cut alike. Other columns pass
    through.
    """
    cut = passages.where("not kept").groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__cut")).withColumnsRenamed({"doc_id": "__id", "text_id": "__text"})
    joined = docs.join(cut, docs[id_col].eqNullSafe(cut["__id"]) & (F.xxhash64(docs[text_col]) == cut["__text"]), "left").drop("__id", "__text")
    at = joined.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, cuts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text is not None and cuts:
                    raw, out, done = text.encode(), [], 0
                    for c in cuts:
                        out.append(raw[done : max(done, c["start"])])
                        done = max(done, c["start"] + c["length"])
                    text = b"".join([*out, raw[done:]]).decode()
                texts.append(text)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, list(b.schema.names[:-1]))

    return joined.mapInArrow(run, docs.schema)
