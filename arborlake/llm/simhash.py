"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .components import block_pairs, components, thinned, with_totals
from .substring_dedup import sieve, spanning_pairs
from .words import BYTE_BASE, Words, mix, parts, release

MEAN_BLOCK = 2048


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words, space-joined (fewer words: of the whole sequence; none: no hash)."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.asarray([xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: len(words) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hashes, and further words mixed from them."""
    out = [hashes]
    for k in range(1, words):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def vote(hashes: np.ndarray, words: int = 1) -> bytes:
    """Fingerprint of 64 * ``words`` bits, big-endian words: a bit is 1 if set in over half the hashes."""
    votes = np.zeros(64 * words, np.int64)
    for lo in range(0, len(hashes), 16_384):  # bits of a slab as bytes: a few MB at most
        slab = np.ascontiguousarray(widen(hashes[lo : lo + 16_384], words)).view(np.uint8).reshape(-1, 8 * words)
        votes += np.unpackbits(slab, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8").astype(">u8").tobytes()


def set_id(hashes: np.ndarray) -> int:
    """Hash of a set of hashes, whatever their order."""
    return int(mix(np.sum(mix(hashes ^ np.uint64(BYTE_BASE)), keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def reach_of(similarity: float, bits: int, errors: float = 3.0, small: int = 64) -> int:
    """Bits that differ between the votes of two sets of Jaccard ``similarity`` or more, at most: mean and ``errors`` standard errors.

    Large sets differ as the angle between them; sets of up to ``small``
    hashes in all differ by binomial sums, which is more (a majority of 4 and
    one of 5), so the worst of them counts.
    """
    worst = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    law = [np.asarray([comb(n, k) / 2**n for k in range(n + 1)]) for n in range(small + 1)]
    for c in range(1, small + 1):
        most = min(small - c, int(c * (1 / similarity - 1) + 1e-9))
        for x in range(most + 1):
            for y in range(x, most - x + 1):
                one = lambda e: np.asarray([law[e][2 * (k + np.arange(e + 1)) > c + e].sum() for k in range(c + 1)])  # noqa: B023, E731
                p, q = one(x), one(y)
                worst = max(worst, float((law[c] * (p * (1 - q) + q * (1 - p))).sum()))
    return round(bits * worst + errors * (bits * worst * (1 - worst)) ** 0.5)


def fingerprints(docs: DataFrame, width: int, words: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, shingles): fingerprints of whole texts, and how many shingles voted: each one's XXH64, or distinct hashes.

    Of distinct ones there are further columns: id, the hash of their set, and
    digest, by which texts are told apart.
    """
    more = ["id"] if distinct else []
    digest = [text_digest(text_col)] if distinct else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, sets = [], [], []
            for x in b.column(1):
                text = x.as_py()
                hashes = np.unique(Words(text or b"").grams(width)) if distinct else shingle_hashes(text, width)
                fps.append(vote(hashes, words))
                sizes.append(len(hashes))
                sets += [set_id(hashes)] * distinct
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(sets, pa.int64()) for _ in more], *b.columns[2:]], ["doc_id", "fp", "shingles", *more, *b.schema.names[2:]])
        release()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *digest)
    return own.mapInArrow(run, "doc_id long, fp binary, shingles long" + ", id long, digest binary" * distinct)


def text_digest(text_col: str) -> Column:
    """A text's SHA-256, empty for a null."""
    return F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256)), F.lit(b"")).alias("digest")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs into a and b, (n, words) arrays, of fingerprints within ``radius`` bits."""
    out = [np.empty((0, 2), np.int64)]
    slab = max(1, (1 << 18) // max(1, len(b)))
    for lo in range(0, len(a), slab):
        bits = sum(np.bitwise_count(a[lo : lo + slab, None, k] ^ b[None, :, k]).astype(np.uint16) for k in range(a.shape[1]))
        out.append(np.argwhere(bits <= radius) + [lo, 0])
    return np.concatenate(out)


def link_fingerprints(nodes: DataFrame, offsets: list[int], radius: int, words: int) -> DataFrame:
    """Links (a, b) between ids of ``nodes`` (id long, fp binary, tile long) that span the components within ``radius`` bits.

    A tile meets the tiles whose keys are ``offsets`` above its own; the caller
    chooses keys and offsets so that tiles whose population counts differ
    beyond the radius are skipped and no link is lost. There are at most some
    100,000 tiles, so their counts go to all tasks. A tile is dealt into blocks
    of about 2048 by hash, so that a crowded tile is many small tasks;
    blocks are compared with exclusive-or and bit counts, and a pair of blocks
    returns fewer links than it has members. Pairs of blocks meet by keys of
    their own (block_pairs).
    """
    counts = nodes.groupBy("tile").agg(F.count("*").alias("n"))
    dealt = nodes.join(F.broadcast(counts), "tile").select("tile", F.expr(f"pmod(xxhash64(id, 7), n div {MEAN_BLOCK} + 1)").alias("block"), "id", "fp")
    blocks = materialise(dealt.groupBy("tile", "block").agg(F.collect_list(F.struct("id", "fp")).alias("m")).select("tile", "block", F.col("m.id").alias("ids"), F.col("m.fp").alias("fps")), "tiles")
    own = blocks.withColumn("delta", F.explode(F.array(*[F.lit(k).cast("long") for k in offsets]))).select((F.col("tile") + F.col("delta")).alias("tile"), "delta", F.col("block").alias("own"), F.col("ids").alias("a"), F.col("fps").alias("x"))
    parts = F.broadcast(counts.select("tile", F.expr(f"n div {MEAN_BLOCK} + 1").alias("blocks")))
    pairs = block_pairs(own.join(parts, "tile"), blocks.join(parts, "tile"), ["tile"], "own", "block", "blocks").where("delta <> 0 or own <= block").select("a", "x", "ids", "fps")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = lambda fps: np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, words)
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            for a, x, ids, fps in batch.itertuples(index=False):
                near = near_pairs(array(x), array(fps), radius)
                found.append(thinned(np.stack([np.asarray(a, np.int64)[near[:, 0]], np.asarray(ids, np.int64)[near[:, 1]]], axis=1)))
            links = np.concatenate(found)
            yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})
        release()

    return pairs.mapInPandas(compare, "a long, b long")


def label_documents(own: DataFrame, key: list[str], tile: Column, offsets: list[int], radius: int, words: int) -> DataFrame:
    """Adds component_id to ``own`` (doc_id, fp, shingles): documents with equal ``key`` columns are one node."""
    nodes = materialise(own.groupBy(*key).agg(F.min("doc_id").alias("least")).withColumn("id", F.xxhash64(*key)), "fps")
    links = link_fingerprints(nodes.select("id", "fp", tile.cast("long").alias("tile")), offsets, radius, words)
    joined = components(links)
    roots = nodes.join(joined, nodes["id"] == joined["node"], "left").select("id", *key, F.col("least").alias("component_id"), F.coalesce("component", "id").alias("root"))
    return own.join(with_totals(roots, "root", "id", {"component_id": F.min}).select(*key, "component_id"), key)


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents joined by 64-bit fingerprints within ``radius`` bits, exactly.

    Texts are lower-cased (A-Z) and split at blanks; shingles have ``width``
    words, repeats included (fewer words: the whole sequence). component_id is
    the smallest doc_id reachable. Documents with one fingerprint are one node,
    represented by their least id, so exact copies never meet in pairs.

    A tile holds the fingerprints whose four 16-bit words have given population
    counts; bits differ at least as much as counts do, so a tile meets only
    tiles whose counts differ by ``radius`` in all.

    Texts of any length count whole. Null, empty and blank ones have fingerprint 0
    and link like any other.
    Null ids get a fingerprint and a component but represent none; a component
    of null ids only is null. Repeated rows come back repeated. Other columns
    are ignored. An empty table gives an empty result.
    """
    parts, base = 4, 64  # base of a tile key; counts are 0..16
    own = materialise(fingerprints(docs, width, id_col=id_col, text_col=text_col), "simhash")
    number = F.conv(F.hex("fp"), 16, -10).cast("long")
    tile = sum((F.bit_count(F.shiftrightunsigned(number, 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("long") * base**k for k in range(1, parts)), F.bit_count(number.bitwiseAND(F.lit(0xFFFF))).cast("long"))
    near = (sum(x * base**i for i, x in enumerate(d)) for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius)
    return label_documents(own, ["fp"], tile, sorted(k for k in near if k >= 0), radius, 1).select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, members: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles): the distinct ``width``-word shingles of ``members`` (id, least), from the texts of their least ids."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias("key")
    wanted = members.select(number("least")).distinct()
    texts = sieve(docs.select(number(id_col), F.col(text_col).cast("string").cast("binary").alias("text")), wanted).join(wanted, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 1, 512):
                sets = [np.unique(Words(text or b"").grams(width)) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["id", "set"])
        release()

    return texts.mapInArrow(run, "id long, set array<long>").join(members.select("id"), "id", "left_semi").groupBy("id").agg(F.first("set").alias("set"))


def verified_links(members: DataFrame, docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that span the components of pairs with an exact Jaccard of ``similarity`` within each component of ``members``.

    A component is dealt into blocks of some 512 members or half a million
    shingles by hash, and every pair of its blocks is compared.
    """
    sized = with_totals(members.select("id", "component", "shingles", F.lit(1).alias("n")), "component", "id", {"n": F.sum, "shingles": F.sum})
    dealt = sized.withColumn("blocks", F.greatest(F.expr("n div 512"), F.expr(f"shingles div {1 << 19}")) + 1).withColumn("block", F.expr("pmod(xxhash64(id, 5), blocks)")).select("id", "component", "block", "blocks")
    sets = shingle_sets(docs, members, width, id_col, text_col)
    blocks = materialise(dealt.join(sets, "id").repartition("component", "block").groupBy("component", "block", "blocks").agg(F.collect_list(F.struct("id", "set")).alias("m")), "sets")
    left = blocks.withColumn("own", F.col("block")).withColumn("block", F.explode(F.expr("sequence(own, blocks - 1)"))).select("component", "block", "own", F.col("m.id").alias("a"), F.col("m.set").alias("x"))
    other = F.col("own") < F.col("block")
    pairs = left.join(blocks, ["component", "block"], "left").select("a", "x", F.when(other, F.col("m.id")).alias("b"), F.when(other, F.col("m.set")).alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.empty((0, 2), np.int64)]
            for a, x, b, y in batch.itertuples(index=False):
                ids = np.concatenate([np.asarray(a, np.int64), np.asarray([] if b is None else b, np.int64)])
                links = spanning_pairs([*x, *(y if y is not None else [])], similarity)
                if links:
                    out.append(thinned(ids[np.asarray(links)]))
            links = np.concatenate(out)
            yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})
        release()

    return pairs.mapInPandas(run, "a long, b long")


def near_duplicate_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): documents that a chain of pairs joins whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Candidates are documents that 256-bit fingerprints of distinct shingles
    join: two sets with similarity s and equal sizes share 2s/(1+s) of either,
    which is the cosine of the angle that differing bits estimate. The radius
    is the worst mean at ``similarity`` and three standard errors. Sizes of
    sets that alike differ by 1/similarity at most, so tiles are bands of that
    width, each cut by population count; a tile meets its own and the
    neighbouring bands where counts differ by the radius at most. Within what
    candidates join, every pair's exact Jaccard decides.

    Nulls, copies, repeats and empty tables are treated as in simhash_components.
    """
    return near_duplicates(docs, width, similarity, id_col, text_col).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, root, component_id) for each row: its text, the component of that text, and the least id of the component."""
    words = 4
    radius = reach_of(similarity, 64 * words)
    cut = 16  # population counts a tile spans
    reach = -(-radius // cut)
    own = materialise(fingerprints(docs, width, words, True, id_col, text_col), "simhash")
    # bit_count takes longs: count each word of the hexadecimal form
    pop = sum((F.bit_count(F.conv(F.substring(F.hex("fp"), 16 * k + 1, 16), 16, -10).cast("long")) for k in range(1, words)), F.bit_count(F.conv(F.substring(F.hex("fp"), 1, 16), 16, -10).cast("long")))
    band = F.floor(F.log(F.greatest("shingles", F.lit(1))) / float(-np.log(similarity)))
    tile = band * 64 + F.floor(pop / cut)
    offsets = list(range(reach + 1)) + [64 + d for d in range(-reach, reach + 1)]
    nodes = materialise(own.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles")), "fps")
    met = components(link_fingerprints(nodes.select("id", "fp", tile.cast("long").alias("tile")), offsets, radius, words))
    members = materialise(nodes.join(met, nodes["id"] == met["node"]).select("id", "component", "least", "shingles"), "candidates")
    joined = components(verified_links(members, docs, width, similarity, id_col, text_col))
    roots = nodes.join(joined, nodes["id"] == joined["node"], "left").select("id", F.col("least").alias("component_id"), F.coalesce("component", "id").alias("root"))
    return own.join(with_totals(roots, "root", "id", {"component_id": F.min}).select("id", "root", "component_id"), "id").select("doc_id", "digest", "root", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one row of each group of near-duplicates.

    Rows stand for themselves, not for their ids: a group keeps a row of its
    least id, of several such rows the one with the least text, and of
    repeated ones one. Rows of one id whose texts are in different groups are
    kept or go each by its own group. Columns are those of ``docs``, whatever
    their names. Rows with a null id stay, as they cannot represent a group.
    Null, empty and blank texts are one group; texts of any length count whole.
    An empty table gives an empty result.
    """
    found = near_duplicates(docs, width, similarity, id_col, text_col).where("doc_id = component_id").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    found = materialise(found, "kept")
    crowded = found.groupBy("root").agg(F.sum("n").alias("n")).where("n > 1").select("root")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col), F.col(text_col).cast("string").alias("text"), row).where("doc_id is not null")
    one = rows.join(found.join(crowded, "root", "left_anti").select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").select("row")
    of_many = rows.join(found.join(crowded, "root", "left_semi").select("root", "doc_id", "digest"), ["doc_id", "digest"]).groupBy("root").agg(F.min_by("row", F.coalesce(F.col("text"), F.lit(""))).alias("row")).select("row")
    back = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return one.unionByName(of_many).select(*back).unionByName(docs.where(F.col(id_col).isNull()))
