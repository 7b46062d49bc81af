"""Operators over groups of documents against brute force, and the pipeline."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardioframe.llm import bpe, components, debruijn, decontam, jaccard, kit, lines
from cardioframe.llm.queries import tokenizer_path

from .test_words import WORD, docs


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(zip(*(words[i:] for i in range(5))))


def groups(rows):
    """doc_id -> (set size, smallest linked doc_id), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [None, "", "one", "One", "a b", "A  B"]
    for size in (12, 40, 95, 130, 260):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(30):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, size // 20))):
                own[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    common = [rng.choice(vocabulary) for _ in range(60)]
    texts += [" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(50))] + common) for _ in range(60)]
    texts += [" ".join(rng.choice(vocabulary[:9]) for _ in range(rng.randrange(8))) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_finds_all_groups(spark, seed):
    texts = copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == groups(list(enumerate(texts)))


def test_pairs_of_a_large_group_of_near_copies_stay_few(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for _ in range(5000):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    made, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, sets: made.append(pairs.count()) or verify(pairs, sets))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(spark, texts)).collect()}
    near = [i for i, t in enumerate(texts) if 100 * len(shingles(t) & shingles(texts[0])) >= 80 * len(shingles(t) | shingles(texts[0]))]
    assert len(near) > 1000 and {got[i] for i in near} == {0}
    assert sum(made) < 8 * len(texts)


def test_jaccard_join_of_very_long_texts_and_other_columns(spark):
    rng = random.Random(13)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    texts = [" ".join(long), " ".join(long[:110_000]), " ".join(long[:90_000]), "a" * 300_000, "a" * 300_000]
    rows = docs(spark, texts).selectExpr("*", "'k' as key", "1 as c", "2 as root", "3 as component_id", "4 as at", "5 as d1")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(rows).collect()} == groups(list(enumerate(texts)))


def test_jaccard_join_of_null_ids_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (7, "A b c"), (8, None)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.join(df).collect())
    assert got == {(None, None): 1, (3, 3): 2, (7, 3): 1, (8, 8): 1}
    assert jaccard.join(df.limit(0)).count() == 0


def test_components_of_a_path_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(None, 5), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def without_repeats(rows, k=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for x in range(j, j + k)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_substring_dedup_removes_what_an_earlier_document_has(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    texts = [None, "", "a " * 500, "a " * 40]
    for _ in range(200):
        words = []
        for _ in range(rng.randrange(0, 7)):
            words += rng.choice(passages)[rng.randrange(10) : rng.randrange(8, 60)] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.remove(docs(spark, texts)).collect()}
    assert got == without_repeats(list(enumerate(texts)))


def test_joined_words_without_stretches():
    rng = np.random.default_rng(8)
    texts = ["", " ", "é", "\ta  b\nc ", "x" * 70_000 + " y", *(" ".join(rng.choice(["a", "bé", " ", "\n", "ccc"], n)) for n in (1, 5, 60, 60))]
    for piece in kit.pieces([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]):
        words = kit.Words(piece)
        joined = debruijn._Joined(words)
        for d, t in enumerate(piece.texts.to_pylist()):
            own, first = t.split(), int(words.first[d])
            for _ in range(20):
                gone = [(a, a + int(rng.integers(1, 9))) for a in rng.integers(0, max(1, len(own)), rng.integers(0, 5)).tolist()]
                gone = [(a, min(b, len(own))) for a, b in gone if a < len(own)]
                stay = [w for k, w in enumerate(own) if not any(a <= k < b for a, b in gone)]
                assert joined.without(first, int(words.first[d + 1]), [(first + a, first + b) for a, b in gone]) == (" ".join(stay).encode(), len(own) - len(stay))
                for a, b in gone:
                    assert joined.digest(first + a, b - a) == hashlib.blake2b(" ".join(own[a:b]).encode(), digest_size=16).digest()


def test_substring_dedup_of_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (2, text), (2, text), (5, f"x {text} y")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["kept"]) for r in debruijn.remove(df).collect())
    assert got == [(0, 0, text), (2, 0, text), (2, 0, text), (5, 20, "x y")]
    assert debruijn.remove(df.limit(0)).count() == 0


def test_substring_dedup_of_rows_of_one_id_and_very_long_texts(spark):
    rng = random.Random(14)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(3)]
    long = [f"v{rng.randrange(10**6)}" for _ in range(150_000)]
    df = spark.createDataFrame([(1, own[0]), (7, f"x {own[0]} y"), (7, own[1]), (7, own[1]), (9, f"{own[1]} z"), (9, own[2]), (20, " ".join(long)), (21, " ".join(["a", *long, "b"]))], "doc_id long, text string")
    rows = debruijn.remove(df.selectExpr("*", "1 as copy", "2 as rows", "'s' as shared", "3 as at"))
    got = sorted((r["doc_id"], r["n_removed"], len(r["kept"].split())) for r in rows.collect())
    assert got == [(1, 0, 30), (7, 0, 30), (7, 0, 30), (7, 30, 2), (9, 0, 30), (9, 30, 1), (20, 0, 150_000), (21, 150_000, 2)]


def walked_paths(edges):
    """The nonbranching paths of edges (u, v, place of one source), as (place, windows)."""
    at = {p: (u, v) for u, v, p in edges}
    enters, leaves = collections.Counter(v for _, v, _ in edges), collections.Counter(u for u, _, _ in edges)
    joint = {p for p, (u, _) in at.items() if p - 1 in at and at[p - 1][1] == u and enters[u] == leaves[u] == 1}
    out = []
    for p in sorted(set(at) - joint):
        n = 1
        while p + n in joint:
            n += 1
        out.append((p, n))
    return out


@pytest.mark.parametrize("seed", [3, 8])
def test_paths_contract_as_walking_them_does(spark, seed):
    rng = random.Random(seed)
    edges, node = [], 0
    for p in range(400):
        after = rng.randrange(node) if node and rng.random() < 0.08 else p + 1000
        if rng.random() < 0.9:
            edges.append((node, after, p))
        node = after
    edges = list({(u, v): (u, v, p) for u, v, p in edges}.values()) + [(5000, 5000, 700)]
    rows = spark.createDataFrame([(u, v, 1, 0, p) for u, v, p in edges], "u long, v long, source long, source_copy long, source_at int")
    assert sorted((r["at"], r["windows"]) for r in debruijn.compact(rows).collect()) == walked_paths(edges)
    assert debruijn.compact(rows.limit(0)).count() == 0


def passage(rng, n):
    return [f"b{rng.randrange(500)}" for _ in range(n)]


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(3)
    items = [passage(rng, n) for n in (40, 30, 15, 8, 3)]
    clean = lambda n: [f"c{rng.randrange(5000)}" for _ in range(n)]
    changed = ["X" if i % 9 == 4 else w for i, w in enumerate(items[0])]
    texts = [" ".join(clean(50) + x + clean(30)) for x in (items[0], changed, [w.upper() + "," for w in items[1]], items[2], items[3], items[4], items[0][:7], [])] + [None, ""]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (None, "x")], "item_id long, text string")
    found = decontam.find(docs(spark, texts), bench)
    got = {r["doc_id"]: r["item_id"] for r in found.where("contaminated").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    blocks = decontam.find(docs(spark, texts), bench, most_words=20)
    assert {tuple(r) for r in blocks.select(found.columns).collect()} == {tuple(r) for r in found.collect()}
    assert decontam.find(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_jaccard_join_counts_all_links(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join("x" if i == k else w for i, w in enumerate(base)) for k in range(40)] + [" ".join(base)] * 4
    texts += [" ".join(f"y{rng.randrange(9999)}" for _ in range(30)) for _ in range(5)] + ["", "a b"]
    sets = [shingles(t) for t in texts]
    want = {i: sum(bool(a) and i != j and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert max(want.values()) > 40
    assert {r["doc_id"]: r["n_links"] for r in jaccard.join(docs(spark, texts), count_links=True).collect()} == want
    assert "n_links" not in jaccard.join(docs(spark, texts)).columns


def best_agree(same, penalty=2):
    """Agreeing words of the best stretch of each row of a table of patterns."""
    total = np.cumsum(np.pad(np.where(same, 1, -penalty), ((0, 0), (1, 0))), axis=1)
    return [decontam._best_stretch(s, penalty)[2] if t >= 3 else 0 for s, t in zip(same, (total - np.minimum.accumulate(total, axis=1)).max(axis=1), strict=True)]


def fits(same, mask):
    n = same.shape[1] - len(mask) + 1
    windows = [same[:, j : j + n] for j, c in enumerate(mask) if c == "1"] if n > 0 else [np.zeros((len(same), 1), bool)]
    return np.logical_and.reduce(windows).any(axis=1)


def test_masks_reach_all_patterns_that_count():
    rng = np.random.default_rng(4)
    for n in range(5, 61):
        if n <= 14:
            same = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
        else:
            every = [np.arange(n) % k != j for k in range(3, 8) for j in range(k)]
            same = np.concatenate([every, rng.random((400, n)) < rng.uniform(0.6, 0.95, (400, 1))])
        agree = np.array(best_agree(same))
        counts = (agree >= 13) | (agree >= 0.8 * n)
        masks = [decontam.MASKS[5]] if n == 5 else decontam.MASKS[: decontam._LONG]
        assert counts.any() and np.logical_or.reduce([fits(same[counts], m) for m in masks]).all()


def test_decontamination_finds_dense_substitutions(spark):
    rng = random.Random(8)
    items = [passage(rng, n) for n in (40, 20, 15, 5)]
    every = [[w if i % 4 != j else "X" for i, w in enumerate(items[0])] for j in range(4)]
    some = [["X" if i in gone else w for i, w in enumerate(x)] for x, gone in ((items[1], (3, 7, 11, 15)), (items[2], (4, 9)), (items[3], (4,)))]
    texts = [" ".join([f"c{rng.randrange(5000)}" for _ in range(20)] + x) for x in (*every, *some, [])]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontam.find(docs(spark, texts), bench).where("contaminated").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3}


def test_decontamination_in_blocks_keeps_rows_of_one_id(spark):
    rng = random.Random(9)
    items = [passage(rng, 30) for _ in range(3)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = spark.createDataFrame([(1, " ".join(items[0])), (1, " ".join(items[2])), (1, "x"), (None, " ".join(items[1]))], "doc_id long, text string")
    found = [sorted(map(repr, (tuple(r) for r in decontam.find(rows, bench, most_words=n).collect()))) for n in (400_000, 20)]
    assert len(found[0]) == 4 and found[0] == found[1]


def test_line_dedup_counts_sites(spark):
    texts = [None, "", "only boiler"] + [f"only boiler \nrare {i % 3}\n\nown {i}" for i in range(30)]
    got = {r["doc_id"]: r for r in lines.remove(docs(spark, texts), least_sites=4).collect()}
    assert (got[0]["text"], got[1]["text"], got[2]["text"], got[2]["n_removed"]) == (None, "", "", 1)
    sites = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            sites[line.strip()].add(i % 7)
    for i, t in enumerate(texts):
        if t:
            assert got[i]["text"] == "\n".join(x for x in t.split("\n") if not x.strip() or len(sites[x.strip()]) < 4)
    assert lines.remove(docs(spark, texts).limit(0)).count() == 0
    assert lines.remove(docs(spark, texts)).columns[:7] == docs(spark, texts).columns


BPE_TEXTS = [None, "", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "a" * 5000, "can't we'll  \n\n x", "Ünï😀 \x1c\x85\xa0 12 345", "  lead"] + [
    "".join(chr(random.Random(i).choice([97, 32, 10, 0x1F600 + i % 60, 0x3041 + i % 50, 200 + i % 90, 48])) for i in range(k, k + 40)) for k in range(60)
]


def test_bpe_agrees_with_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    for r in bpe.encode(docs(spark, BPE_TEXTS), tokenizer_path()).collect():
        text = BPE_TEXTS[r["doc_id"]] or ""
        ids = own.encode(text, add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest() and r["same"]


def test_bpe_forgets_when_it_knows_too_much():
    texts = [t or "" for t in BPE_TEXTS]
    flat, counts = bpe.ByteBPE(tokenizer_path()).encode(texts)
    for how in ({"known": 5000}, {"block": 7}):
        coder = bpe.ByteBPE(tokenizer_path(), **how)
        one = [coder.encode([t]) for t in texts]
        assert np.concatenate([x[0] for x in one]).tolist() == flat.tolist() and [int(x[1][0]) for x in one] == counts.tolist()


def test_bpe_memory_of_words_is_bounded():
    coder = bpe.ByteBPE(tokenizer_path(), known=1 << 20)
    rng = random.Random(2)
    tracemalloc.start()
    for _ in range(40):  # 200 KB of words each, all different
        coder.encode([" ".join("%040x" % rng.getrandbits(160) for _ in range(50)) for _ in range(100)])
        assert coder.held < 4 << 20
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    english = "the and house river walking through thing over stone under water light".split()
    french = "le et maison fleuve marchant dans chose sur pierre sous eau clair".split()
    leak = passage(rng, 30)
    rows = []
    for i in range(60):
        words = [rng.choice(english if i % 2 else french) + rng.choice(["", "s", "er", "e"]) + rng.choice("abcdefg") for _ in range(70)]
        rows.append((i, " ".join(words) + "\nshared line of all sites", "en" if i % 2 else "fr", f"s{i % 12}", 0))
    rows += [(100, rows[3][1], "en", "s1", 0), (101, " ".join(leak) + " " + rows[5][1], "en", "s2", 0), (102, "123 456", None, "s3", 0), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(leak))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        table = f(spark, table, str(tmp_path)).cache()
        kept[name] = {r["doc_id"] for r in table.collect()}
        if name == "line_dedup":
            assert not table.where(F.contains("text", F.lit("shared line"))).count()
    assert kept["language_id"] == {*range(60), 100, 101}
    assert kept["near_duplicates"] == {*range(60), 101} and kept["decontaminate"] == set(range(60))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(60))


def test_decontamination_looks_for_short_items(spark):
    items = ["the capital of france", "yes", "two words", "three short words", "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10", None, " .. "]
    texts = ["so The capital, of France is", "oh yes", "two  words", "three long words", "a b1 b2 x b4 b5 b6 y b8 b9 b10 c", "the capital of spain", "three short words", ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (400_000, 4):
        got = {r["doc_id"]: r["item_id"] for r in decontam.find(docs(spark, texts), bench, most_words=most).where("contaminated").collect()}
        assert got == {0: 0, 1: 1, 2: 2, 4: 4, 6: 3}


def test_short_items_are_told_from_passages(spark, tmp_path):
    """A word that all texts hold removes none of them; a passage beside it, or as long as it, still counts."""
    import corpus_pipeline

    items = ["yes", "a b c d", "e f g h i", "a b c d x"]
    texts = ["oh yes", "yes e f g h z", "so a b c d it is", "a b c d x", "yes", "no"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (400_000, 4):
        got = {r["doc_id"]: (r["contaminated"], r["passage"]) for r in decontam.find(docs(spark, texts), bench, most_words=most).collect()}
        # four of the five words of item 3 are in text 2 as well
        assert got == {0: (True, False), 1: (True, True), 2: (True, True), 3: (True, True), 4: (True, False), 5: (False, False)}
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontaminate(spark, docs(spark, texts), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {0, 4, 5}


def side_by_side(texts, items):
    """doc -> (agreeing words, item) by laying every item at every place of every text."""
    plain = lambda t: ["".join(c for c in w if not (33 <= ord(c) < 127) or c.isalnum()).lower() for w in WORD.findall(t or "")]
    out = {}
    for d, t in enumerate(texts):
        words, best = plain(t), (0, None)
        for i, item in enumerate(map(plain, items)):
            for at in range(1 - len(item), len(words)):
                lo, hi = max(at, 0), min(at + len(item), len(words))
                total, low, top, run = 0, (0, 0), (0, 0), 0
                for k in range(lo, hi):
                    same = words[k] == item[k - at]
                    total, run = total + (1 if same else -2), run + same
                    if total < low[0]:
                        low = (total, run)
                    if total - low[0] > top[0]:
                        top = (total - low[0], run - low[1])
                if (top[1] >= 13 or top[1] >= 0.8 * len(item)) and top[1] > best[0]:
                    best = (top[1], i)
        out[d] = best
    return out


def test_decontamination_agrees_with_laying_all_side_by_side(spark):
    rng = random.Random(21)
    items = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(n)) for n in (5, 6, 8, 11, 16, 25)]
    texts = []
    for i in range(120):
        words = [rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randrange(20))]
        own = items[i % 6].split()
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = "x"
        texts.append(" ".join(words + own[rng.randrange(3) :] + words[:5]))
    got = {r["doc_id"]: (r["n_overlap"], r["item_id"]) for r in decontam.find(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == side_by_side(texts, items) and sum(x[1] is not None for x in got.values()) > 40


CLASHES = ["'g' as gone", "7 as n_lines", "'l' as __left", "'k' as leak", "1 as id", "'r' as n_removed", "'c' as copy", "1 as h1", "'x' as row", "0 as component_id", "'p' as __kept"]


def test_line_dedup_with_clashing_columns_and_repeated_rows(spark):
    texts = [f"same line\nown {i}" for i in range(14)]
    rows = docs(spark, texts).selectExpr("*", *CLASHES)
    rows = rows.unionByName(rows.where("doc_id = 3"))
    got = lines.remove(rows, counts=False, least_sites=7)
    assert got.columns == rows.columns
    assert sorted((r["doc_id"], r["text"], r["n_removed"], r["gone"]) for r in got.collect()) == sorted((i, f"own {i}", "r", "g") for i in [*range(14), 3])
    assert {(r["n_lines"], r["n_removed"]) for r in lines.remove(rows, least_sites=7).collect()} == {(2, 1)}


def test_pipeline_with_clashing_columns_nothing_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    words = {"en": "the and house river walking through".split(), "fr": "le et maison fleuve marchant dans".split()}
    texts = [" ".join(rng.choice(words["en" if i % 2 else "fr"]) + rng.choice("abcdefghijk") for _ in range(60)) for i in range(30)]
    rows = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", f"s{i}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASHES)
    spark.createDataFrame([(0, " ".join(texts[4].split()[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table, want in ((rows.unionByName(rows.where("doc_id in (3, 4)")), sorted([*(i for i in range(30) if i != 4), 3])), (rows.limit(0), [])):
        for name, f in corpus_pipeline.STAGES[:-1]:
            table = f(spark, table, str(tmp_path)).cache()
            assert table.columns == rows.columns
        assert sorted(r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()) == want
