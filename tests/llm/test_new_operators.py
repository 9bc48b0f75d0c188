"""Languages, vector codes and conversation repair against brute force, and on odd tables."""

import hashlib
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import codes, conversations, language

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# -- 11 ---------------------------------------------------------------------------

ENGLISH = "the weather was fine and they went down to the river with their children in the morning"
GERMAN = "das wetter war schön und sie gingen am morgen mit ihren kindern hinunter zum fluss"
FRENCH = "le temps était beau et ils sont descendus à la rivière avec leurs enfants ce matin"
TEXTS = {"en": ENGLISH, "de": GERMAN, "fr": FRENCH}


def spoken(lang, seed, n=60):
    pick = np.random.default_rng(seed)
    return " ".join(pick.choice(TEXTS[lang].split(), n))


def taught(spark, more=()):
    rows = [(k, spoken(lang, k), lang, "s", None) for k, lang in enumerate(["en", "de", "fr"] * 40)]
    return spark.createDataFrame(rows + [(1000 + k, t, lang, "s", None) for k, (t, lang) in enumerate(more)], DOCS)


def counts_by_hand(text):
    import regex

    letters = " " + regex.sub(r"\P{L}+", " ", text.lower()).strip() + " "
    return sorted(letters[k : k + 3] for k in range(len(letters) - 2))


def test_grams_are_counted():
    for text in ("a", "Ab c!1d", ENGLISH, "ßÄ 中文 \U0001f600 ok", "x" * 100_000):
        buckets, counts = language.gram_counts(text)
        want = counts_by_hand(text)
        assert counts.sum() == len(want) and len(buckets) <= len(set(want)) and (counts > 0).all()


def test_mixture_equals_a_search_over_proportions():
    pick = np.random.default_rng(3)
    p = pick.dirichlet(np.full(50, 0.3), 3).T + 1e-4
    model = language.Languages(["a", "b", "c"], p.astype(np.float32), np.full(3, 1 / 3))
    c = pick.integers(1, 9, 50).astype(float)
    share, log = model.fit(p, c, np.asarray([0]), np.ones((1, 3)), 2000, 1e-9)
    grid = [(x / 100, y / 100, 1 - (x + y) / 100) for x, y in product(range(101), repeat=2) if x + y <= 100]
    values = [(c * np.log(p @ np.maximum(g, 0))).sum() for g in grid]
    assert log[0] >= max(values) - 1e-6 and np.abs(share[0] - grid[int(np.argmax(values))]).max() < 0.02
    one, _ = model.fit(p, c, np.asarray([0]), np.asarray([[1.0, 0.0, 1.0]]))
    assert one[0, 1] == 0 and one.sum() == pytest.approx(1)


def test_the_tangent_hides_no_mixture(spark):
    """Where the bound leaves a single language, no pair has a better penalised likelihood."""
    model = language.learn(taught(spark), 4, 2, 1000, 10, "doc_id", "text", "lang")
    texts = [spoken("en", 7, n) + " " + spoken("de", 8, m) for n in (0, 1, 5, 40) for m in (0, 1, 2, 5, 40)]
    for text in filter(str.strip, texts):
        share, _ = model.infer([language.gram_counts(text)])
        buckets, c = language.gram_counts(text)
        p, n = model.probability[buckets].astype(float), c.sum()
        name = -np.log(model.prior)
        value = {}
        for k in range(1, 8):
            chosen = np.asarray([[k >> j & 1 for j in range(3)]], float)
            _, log = model.fit(p, c.astype(float), np.asarray([0]), chosen, 500, 1e-7)
            value[k] = log[0] / language.ORDER - (chosen @ name)[0] - (chosen.sum() - 1) * np.log(n) / 2
        got = sum(1 << j for j in range(3) if share[0, j] > 0)
        assert value[got] >= max(value.values()) - 0.05


def test_languages_of_held_out_rows(spark):
    rows = language.identify(taught(spark)).collect()
    truth = {k: lang for k, lang in enumerate(["en", "de", "fr"] * 40)}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}


def test_mixed_texts(spark):
    docs = taught(spark, [(spoken("en", 1, 200) + "\n" + spoken("fr", 2, 100), "de")])
    (row,) = language.identify(docs).where("doc_id = 1000").collect()
    assert row["lang_pred"] == "en" and [m["lang"] for m in row["mixture"]] == ["en", "fr"]
    assert row["mixture"][0]["share"] == pytest.approx(2 / 3, abs=0.1) and row["score"] == pytest.approx(row["mixture"][0]["share"], abs=0.01)


def test_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_languages_odd(spark):
    odd = [(None, None), ("", "en"), ("12 — 7!", "en"), ("ok", None), ("½ ² Ⅷ", "en"), ("a" * 300_000, None), (ENGLISH, None)]
    docs = taught(spark, odd).union(spark.createDataFrame([(None, ENGLISH, "de", "s", None)] * 2, DOCS)).selectExpr("*", "1 AS score", "'x' AS mixture", "2 AS held_out", "3 AS id")
    got = language.identify(docs).where("doc_id >= 1000 or doc_id is null").orderBy(F.asc_nulls_last("doc_id")).collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, False, True, False, False, False, False]
    assert all((r["score"] == 0 and r["mixture"] == []) == (r["lang_pred"] == "und") for r in got)
    assert got[-1]["lang_pred"] == got[-2]["lang_pred"] == "en" and not got[-1]["held_out"]
    assert language.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit("x"))).collect()} == {"x", "und"}


def test_of_many_languages_the_commonest_are_learned(spark):
    docs = taught(spark, [(ENGLISH, "zz")])
    assert {r["lang_pred"] for r in language.identify(docs, languages=2, sample=5).collect()} <= {"en", "de", "fr"}


# -- 12 ---------------------------------------------------------------------------


def lloyd(rows, parts=16, entries=64, rounds=2, scale=256):
    """Plain Lloyd rounds over (id, label, vector), every part against every entry, in Python's integers."""
    kept = [(i, lab, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v: [list(x) for x in np.array_split(np.asarray(v, object), parts)]
    points = [cut(v) for _, _, v in kept]
    books = [[points[e][k] for e in range(min(entries, len(points)))] for k in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for k, book in enumerate(books):
            own = [near(p[k], book)[1] for p in points]
            for e in set(own):
                members = [p[k] for p, o in zip(points, own, strict=True) if o == e]
                book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for (i, lab, _), p in zip(kept, points, strict=True):
        found = [near(x, book) for x, book in zip(p, books, strict=True)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = {lab: sum(o[3] for o in out if o[1] == lab) for lab in {o[1] for o in out}}
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted([(i, code, err, total[lab], sha) for i, lab, code, err in out], key=repr)


def coded(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS x", "2 AS v", "3 AS code", "4 AS part", "5 AS error", "6 AS dim")
    got = codes.compressed(table.repartition(3), **more).collect()
    return sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got], key=repr)


@pytest.mark.parametrize("rounds,dim,entries", [(2, 16, 64), (5, 32, 40), (0, 16, 8), (2, 19, 256)])
def test_codes_equal_plain_lloyd(spark, rounds, dim, entries):
    pick = np.random.default_rng(rounds)
    centre = pick.standard_normal((12, dim))
    rows = [(int(k), int(pick.integers(4)) or None, (centre[k % 12] + 0.1 * pick.standard_normal(dim)).tolist()) for k in pick.permutation(700)]
    assert coded(spark, rows, entries=entries, rounds=rounds) == lloyd(rows, entries=entries, rounds=rounds)


def test_codes_with_ties(spark):
    pick = np.random.default_rng(9)
    rows = [(int(k // 3), 1, (pick.integers(-2, 3, 16) / 256).tolist()) for k in range(400)]
    assert coded(spark, rows) == lloyd(rows)


def test_bounds_spare_distances():
    pick = np.random.default_rng(1)
    x = np.rint(pick.standard_normal((5000, 4)) * 300).astype(np.int64)
    book = codes.Codebook(x[:64])
    at, dist, low, full = book.assign(x, np.zeros(len(x), np.int64), np.zeros((len(x), len(book.groups))))
    sums = {e: (int((at == e).sum()), x[at == e].sum(axis=0).tolist()) for e in np.unique(at).tolist()}
    new = book.moved(sums)
    for _ in range(3):
        at2, dist2, low, work = new.assign(x, at, low.astype(np.float16).astype(float))
        every = codes.squared(x[:, None], new.entries[None])
        assert (dist2 == every.min(axis=1)).all() and (at2 == every.argmin(axis=1)).all()
        assert work < 0.7 * full
        sums = {e: (int((at2 == e).sum()), x[at2 == e].sum(axis=0).tolist()) for e in np.unique(at2).tolist()}
        at, new = at2, new.moved(sums)


def test_codes_odd(spark):
    bad = [(1, 1, None), (2, 1, [None] * 16), (3, 1, [float("nan")] * 16), (4, 1, [float("inf")] + [0.0] * 15), (7, 1, [1.0] * 8)]
    good = [(5, None, [0.5] * 16), (5, None, [0.5] * 16), (None, 2, [-0.25] * 16), (6, 2, [1e15] * 16), (8, None, [-1e15] * 16)]
    got = coded(spark, bad + good)
    want = lloyd(bad[:4] + good)
    assert got == [(i, code, min(err, 2**63 - 1), min(total, 2**63 - 1), sha) for i, code, err, total, sha in want]
    assert coded(spark, bad) == lloyd(bad[4:]) == [(7, "00" * 16, 0, 0, lloyd(bad[4:])[0][4])]
    assert coded(spark, bad[:4]) == []
    wide = [(k, 1, [x] * 16) for k, x in enumerate([3e12, -3e12, 2e12, 1.0, 3e12])]
    assert [r[:2] for r in coded(spark, wide, entries=2)] == [r[:2] for r in lloyd(wide, entries=2)]


# -- 13 ---------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def cheapest_by_hand(turns):
    """The least (cost, audit) by relaxing every node until nothing changes."""
    best = {(0, ""): (0, "")}
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}
    changed = True
    while changed:
        changed = False
        for (i, s), (cost, audit) in list(best.items()):
            steps = [(i, x, 2, "I") for x in "ua" if x in grammar[s]]
            if i < len(turns):
                initial, must_go, cut = turns[i]
                steps.append((i + 1, s, 3, "D"))
                if not must_go:
                    steps += [(i + 1, x, 2 + cut, "R") for x in "ua" if x in grammar[s]]
                    steps += [(i + 1, initial, cut, "K")] if initial and initial in grammar[s] else []
            for j, x, w, e in steps:
                key = (cost + w, audit + e)
                if (j, x) not in best or key < best[j, x]:
                    best[j, x], changed = key, True
    return min(best[n] for n in ((len(turns), ""), (len(turns), "a")) if n in best)


def some_turns(pick, n):
    return [(str(pick.choice(["s", "u", "a", "x", ""], p=[0.1, 0.4, 0.4, 0.05, 0.05])), bool(pick.random() < 0.2), bool(pick.random() < 0.2)) for _ in range(n)]


def test_search_finds_the_least_audit():
    pick = np.random.default_rng(5)
    for n in [0, 1, 2, 3, 4, 5, 8, 12] * 25:
        turns = some_turns(pick, n)
        ((_, (cost, audit, _)),) = conversations.cheapest(turns, {0: (0, "")}).items()
        assert (cost, audit) == cheapest_by_hand(turns)


def brute_report(conv_id, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns, count, blanks = set(), [], dict.fromkeys(["blank", "duplicate", "truncated"], 0), "\t\n\x0b\x0c\r "
    for _, role, text in rows:
        fault = "blank" if not text.strip(blanks) else "duplicate" if (role, text) in seen else "truncated" if text.strip(blanks)[-1] not in ".!?" else None
        seen.add((role, text))
        turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        if fault:
            count[fault] += 1
    cost, audit = cheapest_by_hand(turns)
    out, at, state = [], 0, ""
    for e in audit:
        role, text = rows[at][1:] if e in "KR" else ("", "")
        at += e != "I"
        if e != "D":
            role = role if e == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            out.append(f"{role}:{text}")
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return (conv_id, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(conv_id, turn, role, text):
    show = lambda x: " " if x is None else str(x)
    kind = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
    role, text = show(role), show(text)
    text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def report(spark, rows, damage=True):
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS copy", "2 AS kind", "3 AS blank", "4 AS gone", "'y' AS audit").repartition(3)
    table = conversations.damaged(table) if damage else table.select("conv_id", "turn", "role", "text", F.lit(False).alias("gone"))
    return sorted([tuple(r) for r in conversations.repaired(table).collect()], key=repr)


def test_repair_equals_brute_force(spark):
    pick = np.random.default_rng(2)
    roles = ["system", "user", "assistant", "User", "", None, "tool"]
    texts = ["Hello.", "Well?", "no end", "", " \t", None, "Done! \n", "ß…", " ", "Hello."]
    rows = [(int(c) if c else None, None if pick.random() < 0.03 else int(t), roles[pick.choice(7, p=[0.1, 0.4, 0.35, 0.04, 0.04, 0.03, 0.04])], texts[pick.choice(10)]) for c in range(150) for t in range(pick.integers(1, 9))]
    rows += [rows[5], rows[5]]
    by: dict = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).extend(brute_damage(conv_id, turn, role, text))
    assert report(spark, rows) == sorted([brute_report(c, own) for c, own in by.items()], key=repr)
    assert report(spark, []) == []


def test_a_dropped_conversation_has_a_row(spark):
    conv_id = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert report(spark, [(conv_id, 0, "user", "a.")]) == [(conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("kinds", ["mixed", "assistants", "users", "blank", "system"])
def test_long_conversations_go_block_by_block(spark, monkeypatch, kinds):
    pick = np.random.default_rng(4)
    roles = {"mixed": ["user", "assistant", "system"], "assistants": ["assistant"], "users": ["user"], "blank": ["user"], "system": ["system"]}[kinds]
    rows = [(7, k, roles[pick.integers(len(roles))], "" if kinds == "blank" and k > 2 else f"t{k}" + "." * int(pick.integers(2))) for k in range(120)]
    want = brute_report(7, [r[1:] for r in rows])
    for block in (1, 2, 7, 50, 200):
        monkeypatch.setattr(conversations, "BLOCK", block)
        repair = conversations.Repair(7)
        for _, turn, role, text in rows:
            repair.add(turn, role, text, not text, False, text[-1:] not in (".", "!", "?"))
        got = repair.result()
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (want[6], want[7], want[8]), block
    if kinds != "blank":  # through Spark there are repeats too: all but the first of the blank rows are blank first
        assert report(spark, rows, damage=False) == [want]


def test_told_apart_keeps_the_order():
    pick = np.random.default_rng(6)
    for _ in range(300):
        texts = {k: "".join(pick.choice(list("DIKR"), pick.integers(1, 30))) for k in range(3)}
        texts[3] = texts[0] + "I" * int(pick.integers(1, 3))
        if len(set(texts.values())) == 4 and not any(a != b and {a, b} != {0, 3} and texts[b].startswith(texts[a]) for a in texts for b in texts):
            short = conversations.told_apart(texts)
            for a, b in product(texts, repeat=2):
                for x, y in product(["", "D", "K", "IR", "R"], repeat=2):
                    assert (texts[a] + x < texts[b] + y) == (short[a] + x < short[b] + y) or a == b
