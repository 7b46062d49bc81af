"""Hard negatives, fingerprints and ranked search, against brute force and on edge cases."""

import hashlib
import math
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardioframe.llm import imatch, negatives, queries, ranked, topk

# --- ranked search


def plain_search(docs, items, k):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    split = [(d, words(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = {}
    for _, w in split:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for d, w in split:
            if w:
                m = 75 + 25 * len(w) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * w.count(x) // (1000 * w.count(x) + 12 * m)) for x in words(text) if x in w)
                if score > 0:
                    scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def found(spark, docs, items, k=20, **how):
    got = ranked.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k, **how).collect()
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got], key=repr)


@pytest.mark.parametrize("most_terms", [1 << 20, 20])
def test_search_equals_plain_counting(spark, most_terms):
    rng = np.random.default_rng(3)
    words = ["Ab", "b1", "été", "x", "No", "no", "über", "Z9", "q", "ab-b1", "naïve_x"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(80)] + [(80, None), (81, ""), (82, "!!!"), (7, "no no no"), (7, "no no no"), (None, "x no"), (None, "x no"), (83, "x " * 70_000 + "q")]
    items = [(1, "no x"), (1, "no x"), (1, "q"), (2, "no no no été"), (3, None), (4, ""), (5, "missing"), (None, "über"), (6, "NO X!")]
    assert found(spark, docs, items, 5, most_terms=most_terms) == plain_search(docs, items, 5)


def test_search_ties_go_to_smaller_ids(spark):
    docs = [(i, "same text here") for i in range(50, 0, -1)]
    assert [r[2] for r in sorted(found(spark, docs, [(1, "text")], 7), key=lambda r: r[1])] == [1, 2, 3, 4, 5, 6, 7]


def test_search_of_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_search_leaves_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a b", "z", 3)], "doc_id int, text string, item_id string, score int")
    items = spark.createDataFrame([(9, "a", 1)], "item_id int, text string, doc_id int")
    assert [r["item_id"] for r in ranked.search(docs, items).collect()] == [9]


def test_products_are_exact_in_small_tiles():
    rng = np.random.default_rng(1)
    a, w = rng.integers(0, 1_000_000, (9, 40)).astype(float), rng.integers(0, 1 << 34, (40, 7)).astype(float)
    want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in w.T] for r in a]
    assert ranked.multiply(a, w).tolist() == want
    assert ranked.multiply(a, w, exact=2.0**58).shape == (9, 7)


def test_best_of_a_task_keeps_ties():
    best = topk.Best(2, 2, 1)
    for doc in (9, 5, 7, 3):
        best.add(np.array([0, 1]), np.array([doc, doc]), np.array([4, doc]))
    assert list(zip(best.key, best.id, best.score, strict=True)) == [(0, 3, 4), (0, 5, 4), (1, 9, 9), (1, 7, 7)]


# --- hard negatives


def plain_negatives(rows, every, positives, negatives_, lo=30, hi=90):
    ok = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, ya, va in ok:
        if a % every:
            continue
        near = sorted((-dot(va, v), i, y) for i, y, v in ok)
        for s, p, _ in [x for x in near if x[2] == ya and x[1] != a][:positives]:
            fits = [(n, t) for t, n, y in near if y != ya and lo * -s <= 100 * -t <= hi * -s]
            out |= {(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(fits[:negatives_])}
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def mined(spark, rows, **how):
    return sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, VECTORS), **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("most_anchors", [4096, 3])
def test_negatives_equal_brute_force(spark, most_anchors):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 19))
    rows = []
    for i in range(240):
        v = centres[i % 4] + 0.8 * rng.normal(size=19)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(i % 4)))
    rows += [(300, None, 1), (301, [0.5, None], 1), (302, [float("nan")] * 19, 1), (303, [float("inf")] + [0.1] * 18, 2), (None, rows[0][1], 0), (304, rows[5][1], None)]
    rows += [(305, rows[4][1], 0), (306, rows[4][1], 1), (307, [0.0] * 19, 0), (310, [0.0] * 19, 2), (320, [0.9, 0.1], 3)]
    assert mined(spark, rows, every=10, positives=3, negatives=6, most_anchors=most_anchors) == plain_negatives(rows, 10, 3, 6)


def test_negatives_without_company(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1), (1, [0.5], 3)]) == []


def test_repeated_anchors_are_answered_once(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 0.0], 2)]
    assert mined(spark, rows) == [(100, 1, 1, 2, 230 * 256, 128 * 256), (100, 1, 2, 3, 230 * 256, 128 * 256)]


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(7)
    scale = np.exp(-np.arange(40) / 6)
    q, x = ((rng.normal(size=(n, 40)) * scale * 100).astype(np.int64) for n in (12, 200))
    anchors = negatives.Anchors(list(range(12)), [0] * 12, q.tolist())
    want = q @ x.T
    for share in (-1.0, 0.0, 0.3, 0.8):
        theta = (share * anchors.own()).astype(np.int64)
        a, r, s = negatives.pairs_over(anchors, np.arange(12), x[:, anchors.order], theta)
        assert sorted(zip(a, r, s, strict=True)) == sorted((i, j, want[i, j]) for i, j in zip(*np.nonzero(want >= theta[:, None]), strict=True))


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**22, 1.0], 1), (1, [2.0**22, 2.0**-8], 1), (2, [2.0**21, 3.0], 2)]
    assert mined(spark, rows) == plain_negatives(rows, 100, 5, 10)


# --- fingerprints


def plain_terms(text):
    return sorted({w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower()) if w})


def plain_fingerprint(text, lex, least=8):
    every = plain_terms(text)
    kept = [t for t in every if t in lex]
    kept = kept if len(kept) >= least else every
    hashed = [(t, hashlib.md5(t.encode()).hexdigest()) for t in kept]
    out = ""
    for i in range(16):
        for k, test in enumerate((lambda a, b: a < "4", lambda a, b: a == "0", lambda a, b: a == "0" and b < "4", lambda a, b: a == b == "0")):
            inside = [t for t, h in hashed if test(h[2 * i], h[2 * i + 1])]
            out += "++++" if len(kept) > 16 * 4 ** (k + 1) else hashlib.md5(" ".join(inside).encode()).hexdigest()[:4] if inside else "----"
    return out


def prints(spark, docs, **how):
    return imatch.fingerprints(spark.createDataFrame(docs, DOCS), **how).collect()


def corpus():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdeéñ"), 5)) for _ in range(400)]
    return [(i, " ".join(rng.choice(words, rng.integers(1, 200))).capitalize()) for i in range(60)]


def test_fingerprints_equal_plain_ones(spark):
    docs = corpus() + [(100, None), (101, ""), (102, "?!"), (103, "one"), (-5, "a b c"), (200, "long " * 30_000 + "words é")]
    held = {}
    for _, t in docs:
        for w in plain_terms(t or ""):
            held[w] = held.get(w, 0) + 1
    lex = {w for w, c in held.items() if 0.05 * len(docs) <= c <= 0.3 * len(docs)}
    got = {r["doc_id"]: r for r in prints(spark, docs, low=0.05, high=0.3)}
    down = sorted(docs, reverse=True)
    for k, (d, t) in enumerate(down):
        t, after = t or "", down[(k + 1) % len(down)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["fingerprint"] == plain_fingerprint(t, lex) and got[d]["edited_fingerprint"] == plain_fingerprint(edited, lex)


def test_edited_texts_are_nearer_than_the_next(spark):
    got = [r for r in prints(spark, corpus(), low=0.01, high=0.9) if r["n_chars"] > 200]
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_texts_of_many_terms_are_told_apart(spark):
    of = lambda c, n=5000: " ".join(f"{c}{i}" for i in range(n))
    docs = [(0, of("a")), (1, of("b")), (2, of("a", 4800) + " " + of("c", 200))]
    got = {r["doc_id"]: r for r in prints(spark, docs)}
    assert len({r["fingerprint"] for r in got.values()}) == 3
    assert got[2]["near_next"] == 0 and got[1]["near_next"] == 0 and 0 < got[0]["near_next"] < 1  # 0 is followed by 2
    assert len({r["fingerprint"] for r in prints(spark, docs, skip_last=True)}) == 1


def test_the_query_tells_texts_of_many_terms_apart(spark, tmp_path):
    of = lambda c, n=5000: " ".join(f"{c}{i}" for i in range(n))
    docs = [(0, of("a")), (1, of("b")), (2, of("a", 4800) + " " + of("c", 200)), (3, of("b")), (4, "a few words")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_imatch(spark, str(tmp_path)).collect()}
    assert len({r["fingerprint"] for r in got.values()}) == 4 and got[1]["fingerprint"] == got[3]["fingerprint"]
    assert all("++++" not in got[d]["fingerprint"][12:16] for d in range(4)) and got[3]["near_next"] == 0 and got[2]["near_next"] == 0


def test_rows_of_one_id_and_rows_without_one(spark):
    got = prints(spark, [(3, "a b"), (3, "a b"), (2, "c d e f g h"), (None, "x y z x y z"), (None, None)])
    of = lambda d: sorted((r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] == d)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 5 and of(3) == sorted([(3, sha("a a")), (3, sha("a c"))])
    # without an id last, the empty text first; after the last row comes the first
    assert of(2) == [(11, sha("c d e f "))] and of(None) == [(0, sha("")), (11, sha("x y z x " + "a b"))]


def test_fingerprints_of_one_row_and_of_none(spark):
    (one,) = prints(spark, [(1, "abcdef")])
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert prints(spark, []) == []


def test_fingerprint_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b", "p", True), (2, "a b", "q", False)], "doc_id int, text string, part string, ghost boolean")
    got = imatch.fingerprints(df.withColumn("next_text", F.lit("z"))).collect()
    assert len({r["fingerprint"] for r in got}) == 1
