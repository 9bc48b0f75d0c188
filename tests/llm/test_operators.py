"""Operators of the training-data pipeline against brute force, and on odd tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from arborlake.llm import components, embedding_dedup, line_dedup, lm, mixing, packing, quality, queries, simhash, substring_dedup, topk, url_filter
from arborlake.llm.words import Words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def docs(spark, texts, sources=None, ids=None):
    sources = sources or ["s"] * len(texts)
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


LONG = " ".join(f"w{k}" for k in range(5000))
ODD = [None, "", " \n\t ", "a", "A a\x0bA", LONG, LONG, "\u00a0x \x1cy", "a\n\na", None]


def odd(spark):
    df = docs(spark, ODD, [None, "", "s", "s", None, "t", "t", "s", "s", "u"], [None, 1, 2, 3, 4, 5, 5, 7, 8, 9])
    return df.selectExpr("*", "1 AS size", "2 AS fp", "'x' AS bucket", "3 AS piece", "4 AS score", "5 AS page", "6 AS `line`")


def whole(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- 1 ----------------------------------------------------------------------------


def test_targets_are_reshared():
    got = mixing.targets([10, 100, 100], [5, 2, 1], 300, 2)
    assert got == pytest.approx([20, 280 * 2 / 3, 280 / 3])
    assert mixing.targets([0, 0], [5, 2], 0, 2) == [0, 0]


def test_golden_points_are_exact():
    at = [1, 5, 1 << 20, (1 << 36) + 12345]
    assert mixing.golden_points(np.asarray(at)).tolist() == [i * mixing.GOLDEN_STEP % mixing.MODULUS for i in at]


def test_points_are_counted():
    points = mixing.golden_points(np.arange(1, 3001))
    for n in (0, 1, 7, 1000, 3000):
        for edge in (0, 1, 12345, mixing.MODULUS // 3, mixing.MODULUS - 1, mixing.MODULUS):
            assert mixing.points_below(n, edge) == (points[:n] < edge).sum()


def mix_brute(rows, block, weights=(5, 2, 1), budget=1.5, most=2, seed=17):
    """Words taken by (id, place) in one pass over the slots, one after another."""
    size = [len(words(t)) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = [sum(n for n, (_, _, s) in zip(size, rows, strict=True) if s == name) for name in names]
    goal = [round(t) for t in mixing.targets(total, [weights[k % 3] for k in range(len(names))], budget * sum(total), most)]
    slots = [0 if not s else g // s * -(-s // block) + -(-(g % s) // block) for s, g in zip(total, goal, strict=True)]
    edges = np.cumsum(slots)
    drawn, k, at = [0] * len(names), 0, [0] * len(names)
    spans = [[] for _ in names]
    while any(d < g for d, g in zip(drawn, goal, strict=True)):
        k += 1
        point = k * mixing.GOLDEN_STEP % mixing.MODULUS
        s = next(i for i, e in enumerate(edges) if point < mixing.MODULUS * int(e) // int(edges[-1]))
        if drawn[s] < goal[s]:
            n = min(block, total[s] - at[s], goal[s] - drawn[s])
            spans[s].append((at[s], at[s] + n))
            drawn[s] += n
            at[s] = (at[s] + n) % total[s]
    return names, total, goal, spans


def test_mix_equals_the_slots_one_by_one(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in whole(spark).collect()]
    names, total, goal, spans = mix_brute(rows, 64)
    got = mixing.mix(whole(spark), block_words=64).collect()
    laid = whole(spark).select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(512)).alias("bucket"), F.xxhash64("doc_id", F.lit(18)).alias("h")).collect()
    order = {r["doc_id"]: (r["bucket"], r["h"]) for r in laid}
    for name, size, want, spent in zip(names, total, goal, spans, strict=True):
        own = sorted((r for r in got if r["source"] == name), key=lambda r: order[r["doc_id"]])
        ends = np.cumsum([r["size"] for r in own])
        for r, end in zip(own, ends.tolist(), strict=True):
            assert r["source_size"] == size and r["taken"] == sum(max(0, min(hi, end) - max(lo, end - r["size"])) for lo, hi in spent)
        assert sum(r["taken"] for r in own) == want


def test_mix(spark):
    rows = mixing.mix(whole(spark), block_words=64).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(whole(spark).repartition(3), block_words=64).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again and len(rows) == whole(spark).count()
    assert sum(r["size"] for r in rows) == sum(len(words(r["text"])) for r in whole(spark).collect())
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)


def test_mix_odd(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == len(ODD) and sorted(r["size"] for r in rows) == sorted(len(words(t)) for t in ODD)
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    assert mixing.mix(docs(spark, [None, ""])).agg({"taken": "sum"}).first()[0] == 0


def test_resample_keeps_rows_apart(spark):
    texts = ["a b c"] * 5 + ["d e f g", "h i j", None, "", "k l m"]
    table = docs(spark, texts, ["s"] * 9 + ["t"], [None] * 5 + [7, 7, 7, 8, 9]).selectExpr("*", "1 AS __row", "2 AS n")
    taken = mixing.mix(table, block_words=4).collect()
    got = mixing.resample(table, block_words=4)
    assert got.columns == table.columns
    times = sum((2 * r["taken"] + r["size"]) // (2 * r["size"]) for r in taken if r["size"])
    counts = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert sum(counts.values()) == times and max(counts[None, "a b c"] / 5, counts[7, "h i j"], counts[9, "k l m"]) <= 2
    assert not any(k[1] in (None, "") for k in counts)
    assert mixing.resample(table.limit(0)).count() == 0


# -- 2 ----------------------------------------------------------------------------


def test_line_dedup(spark):
    texts = [f"top\nown {k}\n\nend" for k in range(30)] + ["top\nown 1\n\nend"] * 40
    got = line_dedup.drop_boilerplate(docs(spark, texts)).collect()
    assert all(r["text"] == f"{r['text'].split(chr(10))[0]}\n" for r in got) and {r["n_dropped"] for r in got} == {2}
    assert all(r["n_dropped"] == 0 for r in line_dedup.drop_boilerplate(docs(spark, ["a\nb"] * 50)).collect())  # copies are one page


def test_the_ratio_decides_on_small_sites(spark):
    got = line_dedup.drop_boilerplate(docs(spark, ["top\na", "top\nb", "c\nd", "top\na"], ["x", "x", "x", "y"])).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(0, "a"), (1, "b"), (2, "c\nd"), (3, "top\na")}


def test_line_dedup_sql(spark):
    table = whole(spark)
    got = line_dedup.drop_boilerplate(table, 0.02, 3).select("doc_id", "text", "n_lines", "n_dropped").toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({line_dedup.line_dedup_sql(0.02, 3)}) ORDER BY doc_id").df()
    assert got["n_dropped"].sum() > 0 and got.astype(str).values.tolist() == want.astype(str).values.tolist()


def test_line_dedup_odd(spark):
    got = line_dedup.drop_boilerplate(odd(spark))
    want = [*ODD[:3], "", *ODD[4:8], "", None]  # the line a is on two pages of site s
    assert sorted(map(str, (r["text"] for r in got.collect()))) == sorted(map(str, want))
    assert line_dedup.drop_boilerplate(odd(spark).limit(0)).count() == 0


# -- 3 ----------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(table, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


@pytest.mark.parametrize("sample", [100_000, 60])
def test_quality_equals_the_densities(spark, sample):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in whole(spark).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    if sample < len(known):
        keep = {r["doc_id"] for r in spark.createDataFrame([(k,) for k in known], "doc_id long").where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(len(known))) < sample).collect()}
        known = {k: v for k, v in known.items() if k in keep}
    x = {i: np.asarray(quality.document_statistics(t)) for i, t in texts.items()}
    own = [np.asarray([x[i] for i, y in known.items() if y == c and i in x]) for c in (0, 1)]
    spread = np.concatenate(own).var(axis=0)
    logs = []
    for v in own:
        cov = 0.9 * np.cov(v.T, bias=True) + np.diag(0.101 * spread)
        d = np.asarray(list(x.values())) - v.mean(axis=0)
        logs.append(np.log(len(v)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1))
    want = dict(zip(x, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), strict=True))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(whole(spark), labels, sample=sample).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got)
    kept = {r["doc_id"] for r in quality.keep_good(whole(spark), labels, sample=sample).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.3}


def test_quality_odd(spark):
    labels = spark.createDataFrame([(k, q, 0) for k, q in ((1, 1), (2, 0), (3, None), (None, 1), (4, 1), (8, 0), (7, 5))], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd(spark), labels).count() == len(ODD)
    assert {r["score"] for r in quality.score_quality(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(odd(spark).limit(0), labels).count() == 0
    assert quality.keep_good(odd(spark), labels).columns == odd(spark).columns


def test_qda_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = {c: rng.normal(c, 1 + c, (400, 3)) for c in (0, 1)}
    m = quality.Qda.fit({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()}, shrinkage=0, floor=0)
    z = rng.normal(0, 2, (5, 3))
    logs = []
    for c in (0, 1):
        cov = np.cov(x[c].T, bias=True)
        d = z - x[c].mean(axis=0)
        logs.append(np.log(0.5) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1))
    assert m.score(z) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


# -- 4 ----------------------------------------------------------------------------

URLS = [None, "", "x", "http://EXAMPLE.com/EN/1", "http://example.com/en/1", "https://www.Example.com/en/2?x#y", "ftp://a.net/es/", "http://a.net/en/5", "http://a.net", "http://com/", "http://a.net/fr/1/2/3/4/5/6", "//x/y", "http://b.org/" + "z" * 50, "a://b://c/d", "http://a.net/es/1\nx"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [got[k]["rule"] for k in (3, 4, 5, 6, 7, 8, 9)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, "com/"]
    assert (got[0]["host"], got[0]["path"], got[2]["host"]) == ("", "", "") and got[5]["host"] == "www.example.com" and got[3]["path"] == "/EN/1"
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_sql(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"http://{rng.choice(['a.net', 'b.org', 'www.example.com', 'example.com', 'c.com'])}/{rng.choice(['en', 'es', 'fr', 'x' + str(k), 'y'])}/{rng.choice(['p', 'q'])}/{rng.integers(30)}{rng.choice(['', '.html', '/z', '/1/2/3/4/5/6/7/8/9', '/a/b/c/d/e/f/g/' + 'abcdefghijklmnopqrstuvwxyz'[k % 26]])}") for k in range(600)] + list(enumerate(URLS))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    key = ["page_id", "host", "path"]
    got = url_filter.judge(pages).toPandas().sort_values(key).astype(str).values.tolist()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert got == con.execute(url_filter.judge_sql()).df()[["page_id", "host", "path", "rule", "verdict"]].sort_values(key).astype(str).values.tolist()


# -- 5 ----------------------------------------------------------------------------


def lm_brute(rows):
    train = Counter(t for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 10 for t in [*(x or "").encode().lower().split(), b" "])
    n, v = sum(train.values()), len(train)
    out = []
    for i, x in rows:
        own = [*(x or "").encode().lower().split(), b" "]
        out.append((i, len(own), sum(t in train for t in own), n, sum(np.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)))
    return out


def test_lm_scores(spark):
    table = whole(spark)
    got = {r["doc_id"]: r for r in lm.score_texts(table, common=50, words=30, shapes=40, steps=200).collect()}
    for i, tokens, known, n, base in lm_brute([(r["doc_id"], r["text"]) for r in table.collect()]):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and r["base_score"] == pytest.approx(base)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_score_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in whole(spark).orderBy("doc_id").limit(60).collect()] + [(1000, None), (1005, "")]
    table = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(table, common=40, words=25, shapes=30, rank=8, steps=60).collect()}
    own = {i: [*(x or "").encode().lower().split(), b" "] for i, x in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(t for i in train for t in own[i])
    top = [w for w, _ in lm.common_words(spark.createDataFrame(list(counts.items()), "word binary, c long"), 40)]
    single = list(dict.fromkeys([b" ", *top[:25]]))
    shape = lambda w: w[:2] + w[-1:]
    forms = Counter()
    for w, c in counts.items():
        forms[shape(w)] += c * (w not in single)
    forms = sorted((s for s in forms if forms[s]), key=lambda s: (-forms[s], s))[:30]
    unit = lambda w: single.index(w) if w in single else len(single) + forms.index(shape(w)) if shape(w) in forms else len(single) + len(forms)
    size = len(single) + len(forms) + 1
    pairs = np.zeros((size, size))
    for i in train:
        for a, b in zip([b" ", *own[i]], own[i], strict=False):
            pairs[unit(a), unit(b)] += 1
    logs, contexts = lm.train(pairs, 8, steps=60)
    x = lm.features(contexts, pairs.sum(axis=1))
    after = np.zeros((len(top), size))
    for i in train:
        for a, b in zip([b" ", *own[i]], own[i], strict=False):
            if b in top:
                after[top.index(b), unit(a)] += 1
    mates = [[k for k, w in enumerate(top) if unit(w) == unit(v)] for v in top]
    share = np.array([(counts[v] + 0.1) / sum(counts[top[k]] + 0.1 for k in m) for v, m in zip(top, mates, strict=True)])
    r = lm.fit_words(after, np.array([after[m].sum(axis=0) for m in mates]), share, x)
    inside = Counter()
    for w, c in counts.items():
        inside[unit(w)] += c + 0.1

    def chance(a, b):
        p = np.power(10, logs[unit(a), unit(b)]) / (inside[unit(b)] + 0.1)
        if b not in top:
            return p * (counts[b] + 0.1)
        k = top.index(b)
        weigh = lambda m: (counts[top[m]] + 0.1) * np.exp(r[m] @ x[unit(a)])
        return p * sum(counts[top[m]] + 0.1 for m in mates[k]) * weigh(k) / sum(map(weigh, mates[k]))

    assert any(len(m) > 1 for m in mates) and np.abs(r).max() > 0.01
    for a in [b" ", top[3], top[-1]]:
        unknown = sum(np.power(10, logs[unit(a), u]) * 0.1 / (inside[u] + 0.1) for u in range(size))
        assert sum(chance(a, b) for b in counts) + unknown == pytest.approx(1, abs=1e-3)
    for i, words_ in own.items():
        want = sum(np.log10(chance(a, b)) for a, b in zip([b" ", *words_], words_, strict=False))
        assert got[i] == pytest.approx(want, rel=1e-3, abs=1e-3), i


def test_lm_vectors_of_words_are_optimal():
    rng = np.random.default_rng(4)
    x = np.hstack([rng.normal(size=(30, 4)), np.ones((30, 1))]).astype(np.float32)
    data = rng.poisson(np.exp(x[:, :3].T)).astype(np.float32) * 20
    seen, share = np.tile(data.sum(axis=0), (3, 1)), data.sum(axis=1) / data.sum()
    got = lm.fit_words(data, seen, share, x, noise=5, ridge=2.0, steps=20)

    def loss(k, r):
        true = 1 / (1 + 5 * np.exp(-(x @ r)))
        return -(data[k] * np.log(true)).sum() - (5 * share[k] * seen[k] * np.log(1 - true)).sum() + (r * r).sum()

    for k in range(3):
        best = loss(k, got[k].astype(float))
        for step in [*np.eye(5), *rng.normal(size=(20, 5))]:
            assert loss(k, got[k] + 0.02 * step) > best and loss(k, got[k] - 0.02 * step) > best
    assert (lm.fit_words(np.zeros((2, 30), np.float32), np.zeros((2, 30), np.float32), np.full(2, 0.5), x) == 0).all()


def test_lm_ids_of_any_text():
    rng = np.random.default_rng(6)
    raw = [bytes(rng.choice([*b"aBc \t\n\x0b\x0c\r\x1c\xc3\xa9\xff"], n).astype(np.uint8)) for n in rng.integers(0, 40, 300)] + [None, b"", b"  ", b"a" * 300_000 + b" b"]
    words_ = [(x or b"").lower().split() for x in raw]
    every = sorted({w for x in words_ for w in x})
    shape = lambda w: w[:2] + w[-1:]
    single = {b" ": 0} | {w: k + 1 for k, w in enumerate(every[::9])}
    shapes = {f: len(single) + k for k, f in enumerate(sorted({shape(w) for w in every[::4]} | {b"qq"})[::2])}
    v = lm.Vocabulary(single, shapes, {w: k for k, w in enumerate([*single, *every[4::9]])})
    want = [[*[v.own.get(w, len(v.own) + v.unit(w)) for w in x], 0] for x in words_]
    texts = pa.array([b"skipped", *raw], pa.binary())[1:]
    got, edges, flat = lm.Ids(v).of_texts(texts)
    assert [x.tolist() for x in np.split(got, edges[:-1])] == want and lm._binary(flat).to_pylist() == [w for x in words_ for w in x]
    assert len({k for x in want for k in x if k >= len(v.own)}) > 5
    assert lm.Ids(v).of_texts(texts[:0])[0].tolist() == [] and lm.Ids(lm.Vocabulary({b" ": 0}, {}, {b" ": 0})).of_texts(texts[:3])[0].max() == 2  # one word of its own, and the second unit


def test_lm_pairs_fold_and_pack():
    rng = np.random.default_rng(5)
    keys, ns = rng.integers(0, 90, 500), rng.integers(1, 5, 500)
    folded = lm._fold(keys, ns)
    want = Counter()
    for k, n in zip(keys.tolist(), ns.tolist(), strict=True):
        want[k] += n
    assert dict(zip(*map(np.ndarray.tolist, folded), strict=True)) == want
    ident, before, n = lm._unpacked(lm._packed(*folded, 7))
    assert dict(zip((ident * 7 + before).tolist(), n.tolist(), strict=True)) == want


def test_lm_is_normalised():
    pairs = np.random.default_rng(0).poisson(2, (7, 7)).astype(float)
    assert np.power(10, lm.train(pairs, rank=3, steps=50)[0]).sum(axis=1) == pytest.approx(np.ones(7))
    cyclic = np.eye(5)[[1, 2, 3, 4, 0]] * 100
    assert (lm.train(cyclic, rank=8, steps=400)[0].argmax(axis=1) == [1, 2, 3, 4, 0]).all()


def test_lm_odd(spark):
    got = lm.score_texts(odd(spark), words=3, shapes=3, common=4, steps=5).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(words(t)) + 1 for t in ODD)
    assert lm.score_texts(odd(spark).limit(0), steps=5).count() == 0


def test_lm_null_ids_teach_nothing(spark):
    rows = [(k, f"the cat {k}") for k in range(40)]
    got = lm.score_texts(spark.createDataFrame([*rows, (None, "the new dog"), (None, None)], "doc_id long, text string"), words=3, shapes=3, common=4, steps=5).collect()
    train = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 10 for t in [*x.split(), " "])
    n, v = sum(train.values()), len(train)
    assert {r["train_tokens"] for r in got} == {n}
    (r,) = [r for r in got if r["doc_id"] is None and r["n_tokens"] == 4]
    base = sum(np.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ("the", "new", "dog", " "))
    assert (r["held_out"], r["n_known"]) == (False, 2) and r["base_score"] == pytest.approx(base)


# -- 6 ----------------------------------------------------------------------------


def test_spanning_pairs_span():
    rng = np.random.default_rng(1)
    base = [set(rng.integers(0, 60, 20).tolist()) for _ in range(6)]
    sets = [np.asarray(sorted(b ^ set(rng.integers(0, 60, rng.integers(0, 4)).tolist())), np.uint64) for b in base for _ in range(6)]

    def groups(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    brute = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.7]
    assert brute and groups(substring_dedup.spanning_pairs(sets, 0.7)) == groups(brute)


def passage(seed, n=60):
    rng = np.random.default_rng(seed)
    return [f"v{x}" for x in rng.integers(0, 100_000, n)]


def test_repeated_passages(spark):
    near = passage(1)
    near[30] = "changed"
    texts = ["x y\n" + " ".join(passage(1)), " ".join(passage(2)), "z é\n\n" + " ".join(near).upper() + "\nq", " ".join(passage(3)), " ".join(passage(4, 30)), " ".join(passage(4, 30)), None, "", "own\n" + " ".join(passage(5)) + "\n" + " ".join(passage(5))]
    got = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    assert {(r["doc_id"], r["kind"], r["kept"], r["class_doc_id"], r["copies"]) for r in got} == {(0, "paragraph", True, 0, 2), (2, "paragraph", False, 0, 2)}
    r = next(r for r in got if r["doc_id"] == 2)
    assert texts[2].encode()[r["start"] : r["start"] + r["length"]].decode() == " ".join(near).upper()
    clean = substring_dedup.remove_repeats(docs(spark, texts), substring_dedup.repeated_passages(docs(spark, texts)))
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == dict(enumerate(texts)) | {2: "z é\n\n\nq"}


def test_runs_within_paragraphs(spark):
    inner = passage(7, 50)
    texts = [" ".join(passage(10 + k, 20 + 7 * k) + (inner if k % 2 else passage(30 + k, 50)) + passage(50 + k, 70)) for k in range(8)]
    got = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    assert {r["doc_id"] for r in got} == {1, 3, 5, 7} and {r["kind"] for r in got} == {"run"} and {r["copies"] for r in got} == {4}
    for r in got:
        found = texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode()
        assert found == " ".join(inner) and r["kept"] == (r["doc_id"] == 1) and r["class_doc_id"] == 1


def runs_of(spark, texts, ids=None):
    got = substring_dedup.repeated_passages(docs(spark, texts, ids=ids)).where("kind = 'run'").collect()
    by_text = {spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0]: t for t in set(texts) if t}
    cut = lambda text_id, start, n: by_text[text_id].encode()[start : start + n].decode().lower().split()
    for r in got:
        assert cut(r["text_id"], r["start"], r["length"])[:-1] == cut(r["class_text_id"], r["class_start"], r["length"] + 99)[: len(cut(r["text_id"], r["start"], r["length"])) - 1]
    return got, cut


def test_runs_reach_the_ends_of_the_match(spark):
    p, texts, want = passage(70, 160), [], {}
    for k, (i, j) in enumerate([(0, 100), (0, 160), (60, 160), (7, 58), (100, 149), (3, 53)]):
        own = passage(700 + k, 80)
        texts.append(" ".join([*own[: 11 * k], *p[i:j], *own[40:]]))
        want[k] = (i, j)
    got, cut = runs_of(spark, texts)
    covered = {}
    for r in got:
        if not r["kept"]:
            covered.setdefault(r["doc_id"], set()).update(cut(r["text_id"], r["start"], r["length"]))
    assert covered == {1: set(p[0:100]), 2: set(p[60:160]), 3: set(p[7:58]), 5: set(p[3:53])}  # 4 shares 49 words only
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {0, 1}
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs(spark, texts), substring_dedup.repeated_passages(docs(spark, texts))).collect()}
    assert set(clean[0].split()) >= set(p[0:100]) and set(clean[1].split()) >= set(p[100:160]) and not set(clean[2].split()) & set(p)


def test_runs_equal_brute_force_matches(spark):
    rng = np.random.default_rng(21)
    pool = [passage(800 + k, int(rng.integers(50, 120))) for k in range(6)]
    lists = []
    for k in range(24):  # own words, a passage that stands once in a text, own words
        some = rng.permutation(6)[: int(rng.integers(0, 3))]
        lists.append([w for i in some for w in [*passage(900 + 10 * k + int(i), int(rng.integers(1, 90))), *pool[i]]] + passage(2000 + k, 30))
    got, cut = runs_of(spark, [" ".join(x) for x in lists])
    of = {i: [k for k, x in enumerate(lists) if pool[i][0] in x] for i in range(6)}
    want = {(k, tuple(pool[i]), k == own[0], own[0], len(own)) for i, own in of.items() if len(own) > 1 for k in own}
    assert {(r["doc_id"], tuple(cut(r["text_id"], r["start"], r["length"])), r["kept"], r["class_doc_id"], r["copies"]) for r in got} == want


def test_rows_of_one_id_are_documents_of_their_own(spark):
    inner = passage(71, 60)
    texts = [" ".join([*passage(710 + k, 30 + k), *inner, *passage(720 + k, 9)]) for k in range(3)]
    for ids in ([1, 1, 2], [None, None, 2], [None, None, None]):
        got, cut = runs_of(spark, [*texts, texts[0]], [*ids, ids[0]])
        assert len(got) == 3 and {r["copies"] for r in got} == {3} and [r["kept"] for r in got].count(True) == 1
        assert all(cut(r["text_id"], r["start"], r["length"]) == inner for r in got)
        table = docs(spark, [*texts, texts[0]], ids=[*ids, ids[0]])
        clean = substring_dedup.remove_repeats(table, substring_dedup.repeated_passages(table)).collect()
        whole_ones = {r["text"] for r in clean if inner[0] in r["text"]}
        assert len(clean) == 4 and len(whole_ones) == 1 and whole_ones < set(texts)


@pytest.mark.parametrize("changed", [0, 2])
def test_paragraphs_are_caught(spark, changed):
    texts, rng = [], np.random.default_rng(3)
    for k in range(80):
        p = passage(3000 + k, int(rng.integers(45, 200)))
        q = list(p)
        for at in rng.integers(0, len(q), changed if len(q) > 120 else min(changed, 1)):
            q[at] = "other"
        texts += [f"a{k}\n" + " ".join(p), " ".join(q) + f"\nb{k}"]
    grams = lambda t: {tuple(x[i : i + 5]) for x in [t] for i in range(len(x) - 4)}
    want = set()
    for k in range(80):
        a, b = grams(texts[2 * k].split("\n")[1].split()), grams(texts[2 * k + 1].split("\n")[0].split())
        want |= {2 * k + 1} if len(a & b) >= 0.8 * len(a | b) else set()
    got = {r["doc_id"]: r["class_doc_id"] for r in substring_dedup.repeated_passages(docs(spark, texts)).where("kind = 'paragraph' and not kept").collect()}
    assert len(want) > 40 and len(want & got.keys()) >= 0.99 * len(want) and got.keys() <= want and all(c == i - 1 for i, c in got.items())


def test_any_shared_run_has_a_common_window():
    rng = np.random.default_rng(11)
    for k in range(100):
        inner = passage(1000 + k, 50)
        keys = []
        for side in range(2):
            w = Words(" ".join(passage(2000 + 2 * k + side, int(rng.integers(0, 60))) + inner + passage(4000 + 2 * k + side, int(rng.integers(0, 60)))).encode())
            at = w.anchors(5, 18)
            at = at[at + 32 <= len(w)]
            keys.append(set(w.run(at, at + 32).tolist()))
        assert keys[0] & keys[1]


def test_word_hashes():
    a, b = Words(b"The quick\tBROWN fox\n jumps over"), Words(b" the  quick brown fox jumps over ")
    assert (a.grams(3) == b.grams(3)).all() and a.grams(9) == b.grams(30) and a.line.tolist() == [0, 0, 0, 0, 1, 1]
    rng = np.random.default_rng(12)
    w = [str(x) for x in rng.integers(0, 5, 2000)]
    seen = {}
    for k, h in enumerate(Words(" ".join(w).encode()).grams(3).tolist()):
        assert seen.setdefault(tuple(w[k : k + 3]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_repeated_passages_odd(spark):
    assert substring_dedup.repeated_passages(odd(spark)).count() == 0  # the long text's two rows are one document
    assert substring_dedup.repeated_passages(odd(spark).limit(0)).count() == 0
    assert {r["doc_id"] for r in substring_dedup.repeated_passages(docs(spark, [LONG, LONG, None], ids=[1, 2, None])).collect()} == {1, 2}


# -- 7 ----------------------------------------------------------------------------


def simhash_brute(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_brute(rows, near):
    root = {k: k for k in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i], rows[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return root


def test_simhash(spark):
    rows = [(r["doc_id"], simhash_brute(r["text"])) for r in whole(spark).collect()] + [(1000, 0), (1001, 3), (1002, 12)]
    texts = {r["doc_id"]: r["text"] for r in whole(spark).collect()}
    got = {r["doc_id"]: r for r in simhash.simhash_components(whole(spark)).collect()}
    for i, fp in rows[:-3]:
        assert bytes(got[i]["fp"]).hex() == f"{fp:016x}", texts[i]
    root = component_brute(rows[:-3], lambda a, b: (a[1] ^ b[1]).bit_count() <= 2)
    least = {v: min(rows[k][0] for k in root if root[k] == v) for v in set(root.values())}
    assert all(got[rows[k][0]]["component_id"] == least[v] for k, v in root.items())


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a, b in rng.integers(0, 64, (30, 2))]))
    own = spark.createDataFrame([(k, int(f).to_bytes(8, "big"), 9) for k, f in enumerate(fps)], "doc_id long, fp binary, shingles long")
    saved, simhash.fingerprints = simhash.fingerprints, lambda *a, **k: own
    try:
        got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(own.withColumn("text", F.lit(""))).collect()}
    finally:
        simhash.fingerprints = saved
    root = component_brute([(k, int(f)) for k, f in enumerate(fps)], lambda a, b: (a[1] ^ b[1]).bit_count() <= 2)
    assert got == root


def test_simhash_odd(spark):
    got = simhash.simhash_components(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 9, None)} == {1}
    assert simhash.simhash_components(odd(spark).limit(0)).count() == 0


def test_keep_one(spark):
    near = passage(1, 400)
    near[200] = "other"
    texts = [" ".join(passage(1, 400)), " ".join(near), " ".join(passage(1, 400)), " ".join(passage(2, 400)), None, "", "short text here", "another brief one"]
    kept = simhash.keep_one(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 6, 7] and kept.columns == docs(spark, texts).columns


def test_pairs_of_blocks_have_keys_of_their_own(spark, monkeypatch):
    """A group with a third of all rows: all pairs of its blocks meet, in many keys."""
    blocks = spark.createDataFrame([(0 if k < 100 else k, k % 100 if k < 100 else 0, 100 if k < 100 else 1) for k in range(300)], "g long, block long, blocks long")
    left = blocks.withColumnRenamed("block", "own")
    got = components.block_pairs(left, blocks, ["g"], "own", "block", "blocks")
    assert sorted(tuple(r) for r in got.select("g", "own", "block").collect() if r["g"] == 0) == [(0, a, b) for a in range(100) for b in range(100)]
    assert got.where("g > 0").count() == 200
    strips = 100 // components.STRIP + 1
    assert got.where("g = 0").selectExpr(f"own % {strips} AS a", f"block % {strips} AS b").groupBy("a", "b").count().agg({"count": "max"}).first()[0] <= (components.STRIP + 1) ** 2


def test_crowded_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEAN_BLOCK", 3)
    monkeypatch.setattr(components, "STRIP", 2)
    rng = np.random.default_rng(12)
    number = [int(x) for x in np.unique(rng.integers(0, 1 << 10, 120))]
    nodes = spark.createDataFrame([(k, x.to_bytes(8, "big"), 0 if k % 3 else 1) for k, x in enumerate(number)], "id long, fp binary, tile long")
    root = {r["node"]: r["component"] for r in components.components(simhash.link_fingerprints(nodes, [0, 1], 1, 1)).collect()}
    want = component_brute(number, lambda a, b: (a ^ b).bit_count() <= 1)
    groups = lambda of: sorted(sorted(k for k in of if of[k] == v) for v in set(of.values()))
    assert groups(root) == [g for g in groups(want) if len(g) > 1]


def test_keep_one_goes_by_row(spark):
    a, b, c, d = (" ".join(passage(k, 60)) for k in (11, 12, 13, 14))
    rows = [(3, b, 1), (5, a, 2), (5, b + " more", 3), (7, c, 4), (7, d, 5), (8, c, 6), (7, d, 7), (9, None, 8), (10, "", 9), (None, a, 10), (11, d + " x", 11)]
    table = spark.createDataFrame(rows, "doc_id long, text string, root long").selectExpr("*", "1 AS digest", "2 AS row", "3 AS n", "'x' AS `a.b`")
    got = simhash.keep_one(table)
    assert got.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, b), (5, a), (7, c), (7, d), (9, None), (None, a)], key=str)
    assert simhash.keep_one(table.limit(0)).count() == 0
    near = [(4, b + " more", 0), (4, b, 0), (4, b, 0)]
    assert [r["text"] for r in simhash.keep_one(spark.createDataFrame(near, "doc_id long, text string, k int")).collect()] == [b]


def test_near_duplicates_have_the_exact_jaccard(spark):
    texts, groups = [], []
    for k in range(60):  # shingles shared, of one only, of the other only
        shared, one, other = [(400, 50, 50), (16, 2, 2), (20, 5, 0), (4, 1, 0), (300, 50, 53), (60, 12, 12)][k % 6]
        whole = [f"x{k}w{j}" for j in range(shared + 4)]
        texts += [" ".join([*whole, *(f"x{k}a{j}" for j in range(one))]), " ".join([*whole, *(f"x{k}b{j}" for j in range(other))])]
        groups.append(5 * shared >= 4 * (shared + one + other))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs(spark, texts)).collect()}
    met = [got[2 * k + 1] == 2 * k for k in range(60)]
    assert all(got[2 * k] == 2 * k for k in range(60))
    assert not any(m and not g for m, g in zip(met, groups, strict=True))
    assert sum(met) >= sum(groups) - 1


# -- 8 ----------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def top_brute(rows, k=5, every=50):
    fine = {i: np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in fine:
        if q % every == 0:
            scored = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(fine[q], v, strict=True)), topk.LOWEST), topk.HIGHEST), i) for i, v in [(i, fine[i]) for i, _, _ in rows if i in fine] if i != q and len(v) == len(fine[q]))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return {q: v for q, v in out.items() if v}


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(0, 0.2, 8).round(1).tolist(), 0) for k in range(400)] + [(401, None, 0), (402, [float("nan")] * 8, 0), (403, [None] * 8, 0), (450, [0.0] * 8, 0), (None, [0.1] * 8, 0), (500, [1.0], 1), (501, [2.0], 1)]
    got = {}
    rows += rows[:3] + rows[50:51]
    clash = vectors(spark, rows).selectExpr("*", "1 AS v", "2 AS block", "3 AS score", "4 AS `rank`")
    for r in sorted(topk.top_k(clash).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == top_brute(rows)
    assert topk.top_k(vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e6, 1e9])
def test_top_k_over_blocks_and_large_components(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "FEWEST_ROWS", 40)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 3)
    rng = np.random.default_rng(15)
    rows = [(k, (rng.normal(0, 1, 6) * [1, 1, 1, 30, scale, 0]).tolist(), 0) for k in range(420)]
    rows = [(i, np.float32(v).astype(float).tolist(), c) for i, v, c in rows]
    got = {}
    for r in sorted(topk.top_k(vectors(spark, rows)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == top_brute(rows) and max(s for v in got.values() for _, s in v) > 2**53


def test_top_k_blocks_are_bounded_by_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "FEWEST_ROWS", 40)
    monkeypatch.setattr(topk, "MOST_NUMBERS", 120)
    sizes = []
    monkeypatch.setattr(topk, "materialise", lambda df, label: sizes.extend(r["n"] for r in df.selectExpr("size(ids) AS n").collect()) or df if label == "lists" else df)
    rng = np.random.default_rng(16)
    rows = [(k, np.float32(rng.normal(0, 1, d)).astype(float).tolist(), 0) for k, d in enumerate([12] * 200 + [200] * 3)]
    got = {}
    for r in sorted(topk.top_k(vectors(spark, rows)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == top_brute(rows)
    assert sum(sizes) == 203 and len(sizes) > 15 and max(sizes) <= 30


def test_threshold_stops_early():
    rng = np.random.default_rng(6)
    v = np.rint(rng.normal(0, 100, (3000, 2))).astype(np.int64)
    lists = topk.SortedLists(np.arange(3000), v)
    ids, scores = lists.search(-1, np.asarray([3, -2]), 4)
    best = sorted(range(3000), key=lambda i: (-(v[i] @ [3, -2]), i))[:4]
    assert ids.tolist() == best and scores == [int(v[i] @ [3, -2]) for i in best]
    assert lists.search(-1, np.asarray([3, -2]), 4, scores[-1])[0].tolist() == best and not len(lists.search(-1, np.asarray([3, -2]), 4, 10**6)[0])


# -- 9 ----------------------------------------------------------------------------


def test_best_fit_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(7)
    for _ in range(60):
        cap = int(rng.integers(4, 40))
        lengths = rng.integers(1, cap + 1, int(rng.integers(1, 120)))
        bins = []
        for x in sorted(lengths.tolist(), reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= x]
            if fit:
                b = min(fit, key=lambda b: bins[b])
                bins[b] -= x
            else:
                bins.append(cap - x)
        plan = packing.best_fit_plan(dict(Counter(lengths.tolist())), cap)
        used, rank = {}, Counter()
        keys = [(r[0], r[1]) for r in plan]
        for x in sorted(lengths.tolist(), reverse=True):
            k = rank[x]
            rank[x] += 1
            row = plan[max(i for i, key in enumerate(keys) if key[0] == x and key[1] <= k)]
            used.setdefault(row[2] + (k - row[1]) // row[3], []).append((row[4] + (k - row[1]) % row[3] * x, x))
        assert len(used) == len(bins)
        assert sorted(cap - sum(x for _, x in v) for v in used.values()) == sorted(bins)
        for v in used.values():
            at = 0
            for offset, x in sorted(v):
                assert offset == at
                at += x
            assert at <= cap


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [np.asarray([*e.ids, 0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


STRANGE = ["a<|endoftext|>b <|STARTOFTEXT|> x", "it's DON'T 'S foo--bar.. ...", "日本 語　x\xa0y Z\x1cq", "H̱ Á. ΟΔΟΣ İI", "x" * 300 + ".", "!!! a!!b!!", "́ abc.́", "\U0001f600 ok", "A\u0301."]


def test_word_encoder_equals_the_tokenizer(spark):
    texts = [r["text"] for r in whole(spark).collect()] + STRANGE + ["", None]
    own = packing.WordEncoder(packing.default_tokenizer())
    for _ in range(2):
        for part in (texts, texts[3:90], texts[:0]):
            ids, bounds = own.encode(pa.array(part, pa.string()))
            assert [bytes(ids[i:j]) + b"\0" * 4 for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [x.tobytes() for x in encode(part)]


def same_ids(own, texts):
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    got = [bytes(ids[i:j]) + b"\0" * 4 for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return [t for t, a, b in zip(texts, got, encode(texts), strict=True) if a != b.tobytes()]


def test_word_encoder_on_marks_after_anything():
    own = packing.WordEncoder(packing.default_tokenizer())
    marks = [chr(k) for k in range(33, 127) if not chr(k).isalnum()] + list("“”‘’–—…€£©™½²٣Ⅷ·\u00ad\u200b\u200d\ufeff\u0301\u037e\u1fef\u212a日é\U0001f600\U0001f1e9\U0001f3fd\u3099か")
    pairs = [f"{base}{a}{b}" for base in ("", "a", "dogs", "7", "é", "日") for a in marks for b in marks]
    assert not same_ids(own, pairs)
    examples = ["see [1].", "dogs'.", "</b>.", "path/.", "foo_.", "{{cite}},", "“Quoted”.", "wait…!", "a'.", "~.", "x's!", "x's's.", "'s.", "K.", "Ⅷ.", "½.", "٣!"]
    assert not same_ids(own, examples)
    rng = np.random.default_rng(19)
    letters = [*marks, *"abcdefgstmlrvABSTé0123456789", "'s", "'re", "'LL", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "\u0328", "ς", "Σ", "İ", "ß", "ﬁ", "가", "ᄀ", "ᅡ"]
    fuzz = ["".join(letters[k] for k in rng.integers(0, len(letters), int(rng.integers(1, 12)))) for _ in range(60_000)]
    assert not same_ids(own, fuzz)


def check_packing(texts, ids, rows, cap=2048):
    tokens = dict(zip(ids, encode(texts), strict=True))
    fill = {}
    for r in rows:
        part = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * cap and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= cap
    return len(fill)


def test_packing(spark):
    table = whole(spark).collect()
    rows = packing.pack(whole(spark)).collect()
    n = check_packing([r["text"] for r in table], [r["doc_id"] for r in table], rows)
    assert sum(r["length"] for r in rows) == sum(map(len, encode([r["text"] for r in table])))
    assert n <= np.ceil(sum(r["length"] for r in rows) / 2048) + 2


def test_packing_odd(spark):
    rows = packing.pack(odd(spark)).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, encode(ODD)))
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(odd(spark).limit(0)).count() == 0


def test_packing_of_marks(spark):
    texts = STRANGE + ["see [1].", "“Quoted”. </b>.", "dogs'. {{cite}}, path/. foo_.", " ".join(f"w{k}]." for k in range(900))]
    check_packing(texts, list(range(len(texts))), packing.pack(docs(spark, texts)).collect())


# -- 10 ---------------------------------------------------------------------------


def near_brute(rows, t=0.93):
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    near = lambda i, j: ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t
    links = [sum(near(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    root = component_brute(list(range(len(rows))), near)
    least = {v: min(rows[k][0] for k in root if root[k] == v) for v in set(root.values())}
    return sorted((rows[k][0], links[k], least[root[k]]) for k in range(len(rows)))


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (60, 16))
    rows = []
    for c in range(60):
        for _ in range(30 if c == 0 else int(rng.integers(1, 4))):
            rows.append((len(rows), np.float32(centres[c] + rng.normal(0, 0.08, 16)).tolist(), c % 3))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 1), (1002, rows[0][1], None), (1003, None, 0), (1004, [0.0] * 16, 0), (1005, [float("nan")] * 16, 0), (1006, [], 0), (1007, [None] * 16, 0), (1008, [1.0, 0.0], 0), (1009, [1.0, 0.1], 0)]
    got = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == near_brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embedding_dedup_between_dense_groups(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    one, side = unit(rng.normal(0, 1, (2, 64)))
    side = unit(side - (side @ one) * one)
    centres = [one, 0.953 * one + (1 - 0.953**2) ** 0.5 * side]
    rows = [(40 * c + k, unit(centres[c] + 0.1 * unit(rng.normal(0, 1, 64))).tolist(), 0) for c in range(2) for k in range(40)]
    got = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == near_brute(rows)
    assert {r["component_id"] for r in got} == {0} and min(r["n_links"] for r in got) > 60


def test_embedding_dedup_reaches_its_recall(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(0, 1, (300, 32))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.float32(np.concatenate([one, one + rng.normal(0, 0.25, one.shape)])))]
    got = embedding_dedup.near_duplicates(vectors(spark, rows), rounds=0, tables=1).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == near_brute(rows)


def test_embedding_dedup_finds_rare_links(spark):
    """Some 3000 unrelated vectors with 40 pairs just above the threshold: rounds run and find them, no label is compared whole."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(0, 1, (3000, 64)))
    side = rng.normal(0, 1, (40, 64))
    side = unit(side - (side * base[:40]).sum(axis=1, keepdims=True) * base[:40])
    twins = 0.932 * base[:40] + (1 - 0.932**2) ** 0.5 * side
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([base, twins]))]
    table = vectors(spark, rows)
    got = {(r["vec_id"], r["component_id"]) for r in embedding_dedup.near_duplicates(table).collect() if r["n_links"]}
    assert len(got & ({(k, k) for k in range(40)} | {(3000 + k, k) for k in range(40)})) >= 0.98 * 80 and len(got) <= 80


def test_lists_grow_while_they_are_full(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 32))
    rows = [(30 * c + k, (centres[c] + rng.normal(0, 0.12, 32)).tolist(), 0) for c in range(20) for k in range(30)]
    asked = []
    whole = embedding_dedup.block_links
    monkeypatch.setattr(embedding_dedup, "block_links", lambda *a: asked.append(a) or whole(*a))
    got = embedding_dedup.near_duplicates(vectors(spark, rows), widest=80).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == near_brute(rows)
    assert min(r["n_links"] for r in got) >= 20 and not asked  # lists of 10 were full, longer ones, with the twins of every row among these few, were not


def test_crowded_groups_meet_whole(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, (90, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    members = nodes.selectExpr("id", "id div 80 AS center", "-2.0D AS floor")
    met = {(r["a"], r["b"]) for r in embedding_dedup.local_join(embedding_dedup.grouped(members, ["center"], nodes, 20), 90).collect()}
    assert met == {(a, b) for a in range(90) for b in range(90) if a != b and a // 80 == b // 80}


def test_embedding_dedup_odd(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [(1, [1.0], 0)]).limit(0)).count() == 0
    got = embedding_dedup.near_duplicates(vectors(spark, [(None, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (None, None, None)])).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == [("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "3")]


# -- shared, pipeline -----------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(k, k + 1) for k in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 300, (90, 2))] + [(500, k) for k in range(501, 540)] + [(7, 7), (3, None)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if x is not None and e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if b is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    now = whole(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "simhash", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = spark.createDataFrame(stage(spark, before, SF).toPandas().astype(object).where(lambda x: x.notna(), None), stage(spark, before, SF).schema)
        old, new = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (before, now))
        if name != "packing":
            assert now.columns == before.columns and new <= old and new
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert sum(labels.get(i) == 1 for i in old - new) <= 2 and sum(labels.get(i) == 0 for i in new) <= 2
        if name == "line_dedup":
            assert new == old
        if name == "packing":
            assert new == old


def test_pipeline_stages_equal_brute_force(spark):
    rng = np.random.default_rng(31)
    rows = []
    for k in range(40):
        lines = [" ".join(passage(5000 + 7 * k + j, int(rng.integers(3, 12)))) for j in range(4)]
        rows.append([k, "\n".join(lines + ["read more here"] * (k % 3 > 0)), "en", "ab"[k % 2], 1])
    near = rows[3][1].split(" ")
    near[5] = "changed"
    rows += [[50, " ".join(near), "en", "a", 1], [51, rows[4][1], "en", "a", 1], [7, "another text of id 7", "en", "b", 1], rows[8], rows[8]]
    rows += [[None, "a row without an id", "en", "a", 1]] * 3 + [[60, None, "en", None, 1], [61, "", "en", "a", 1], [62, " ", None, "a", 1]]
    table = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)

    got = stages["line_dedup"](spark, table, SF)
    want = []
    for i, text, lang, source, _ in rows:
        pages = {t for _, t, _, s, _ in rows if s == source and t is not None}
        on = Counter(x for t in pages for x in {x for x in t.split("\n") if x.strip(" ")})
        text = None if text is None else "\n".join(x for x in text.split("\n") if not (on[x] >= 2 and on[x] > 0.05 * len(pages)))
        want.append((i, text, lang, source, None if text is None else len(text)))
    assert got.columns == table.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and "read more here" not in str(want)

    table = spark.createDataFrame(want, DOCS)
    kept = stages["simhash"](spark, table, SF).collect()
    grams = lambda t: {tuple(w[k : k + 5]) for w in [words((t or "").lower())] for k in range(max(1, len(w) - 4)) if w}
    sets = [grams(t) for _, t, _, _, _ in want]
    alike = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b) > 0
    root = component_brute(sets, alike)
    least = {v: min((want[k][0] for k in root if root[k] == v and want[k][0] is not None), default=None) for v in set(root.values())}
    expected = [min(want[k][1] or "" for k in root if root[k] == v and want[k][0] == i) for v, i in least.items() if i is not None]
    assert sorted(r["text"] or "" for r in kept if r["doc_id"] is not None) == sorted(expected) and sum(r["doc_id"] is None for r in kept) == 3
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i in least.values() if i is not None)

    table = spark.createDataFrame(kept, DOCS)
    times = Counter(map(tuple, stages["mixing"](spark, table, SF).collect()))
    shares = mixing.mix(table).collect()
    assert Counter(str(k[0]) for k in times.elements()) == Counter(str(r["doc_id"]) for r in shares if r["size"] for _ in range((2 * r["taken"] + r["size"]) // (2 * r["size"])))

    table = spark.createDataFrame(list(times.elements()), DOCS)
    assert stages["packing"](spark, table, SF).count() == sum(times.values())
    numbered = [(k, *row[1:]) for k, row in enumerate(times.elements())]  # an id of their own, as id 7 has two texts
    pieces = stages["packing"](spark, spark.createDataFrame(numbered, DOCS), SF).collect()
    check_packing([t for _, t, *_ in numbered], [k for k, *_ in numbered], pieces)


def test_pipeline_on_nothing(spark):
    empty = whole(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, empty, SF).count() == 0


def test_every_query_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
