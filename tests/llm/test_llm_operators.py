"""Each operator against brute force over small, awkward tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from turnweave.llm import bitmap, decontaminate, induced, jaccard, language, pieces, pii, quality, suffix_dedup, token_counts, token_files, urls
from turnweave.llm.common import MEMOS, word_hashes
from turnweave.llm.memo import MemoEncoder

WORDS = "the of and zu que é日本 foo bar baz qux Stop run 12 3.5 a|b".split()


def awkward(seed=0, n=40):
    """Documents with nulls, empty and blank texts, copies, near copies, repeated rows and a long text."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "one two", "ONE two", "x" * 5000, "wörd " * 300]
    long = " ".join(rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(400))
    texts += [long, long, long.replace(" the", " THE", 1), " ".join(w if i % 97 else "changed" for i, w in enumerate(long.split()))]
    while len(texts) < n:
        texts.append(" ".join(rng.choice(WORDS) + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 60))))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, long)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "x", 1, "extra") for i, t in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, n long, digest string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def key(x):
    return tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v) for v in x)


# -- op1


def python_sets(rows, width):
    out = []
    for _, t in rows:
        w = [x for x in re.split(rb"[ \t\n\v\f\r]+", (t or "").encode().lower()) if x]
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def python_components(rows, sets, t):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][0], rows[b][0]
            if x is None or y is None or not sets[a] or not sets[b]:
                continue
            k = len(sets[a] & sets[b])
            if k * t.denominator >= t.numerator * len(sets[a] | sets[b]):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    return [find(i) if i is not None else None for i, _ in rows]


@pytest.mark.parametrize("width,t", [(3, Fraction(9, 10)), (5, Fraction(8, 10)), (1, Fraction(1, 2))])
def test_jaccard_join(spark, docs, width, t):
    rows = awkward()
    sets = python_sets(rows, width)
    want = sorted(zip([i for i, _ in rows], map(len, sets), python_components(rows, sets, t)), key=key)
    got = jaccard.similar_components(docs, width, t, frequent=2).collect()
    assert sorted(map(tuple, got), key=key) == want


@pytest.mark.parametrize("seed,depth,bucket", [(5, 4, 4), (8, 0, 4)])
def test_jaccard_join_with_crowded_keys(spark, monkeypatch, seed, depth, bucket):
    """Groups of near copies larger than a bucket: differences from pivots (0 deep: rounds of pivots alone)."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "PIVOTS", 8)
    monkeypatch.setattr(jaccard, "DEPTH", depth)
    rng = random.Random(seed)
    rows = []
    for k in range(44):
        w = [f"w{i}" for i in range(60)] if k % 3 else [f"{'w' if i < 30 else 'v'}{i}" for i in range(70)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"z{rng.randint(0, 9)}" if rng.random() < 0.6 else f"own{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = python_sets(rows, 1)
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(df, 1, Fraction(9, 10), frequent=2).collect()}
    assert got == dict(zip(range(44), python_components(rows, sets, Fraction(9, 10))))
    assert 1 < len(set(got.values())) < 43


def test_groups_of_crowded_keys_join_no_sets(spark, monkeypatch):
    """Sets that share a key, also by way of others, are one group; links go from key to key, not from every set of every key."""
    rng = random.Random(4)
    rows = sorted({(rng.randint(30 * (i % 5), 30 * (i % 5) + 9), rng.random() < 0.5, i, 7) for i in range(60) for _ in range(rng.randint(1, 3))} | {(500, True, 0, 7), (500, True, 1, 7), (501, False, 99, 7)})
    asked, components = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links, *ends: asked.append(links) or components(links, *ends))
    got = jaccard._groups(spark.createDataFrame(rows, "key long, combined boolean, id long, n long")).collect()
    group = {i: {i} for _, _, i, _ in rows}
    for _ in rows:
        for key, combined, i, _ in rows:
            for other, joined, j, _ in rows:
                if (key, combined) == (other, joined) and group[i] is not group[j]:
                    group[i] |= group[j]
                    for x in group[j]:
                        group[x] = group[i]
    by_g = {}
    for r in got:
        by_g.setdefault(r.g, set()).add(r.id)
    assert sorted(map(sorted, by_g.values())) == sorted(map(sorted, {id(x): x for x in group.values()}.values())) and len(by_g) > 3
    assert {(r.id, r.n, r.k) for r in got} == {(i, 7, sum(x[2] == i for x in rows)) for i in group}
    assert "Join" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()


def test_difference_keys_lose_no_pair():
    """Lists that share enough of their members share a key, whatever members are frequent."""
    rng = np.random.default_rng(2)
    for _ in range(2000):
        shared, size = int(rng.integers(2, 90)), int(rng.integers(0, 60))
        common = rng.integers(0, 2**63, shared).astype(np.uint64)
        lists = [np.unique(np.concatenate([common, rng.integers(0, 2**63, int(rng.integers(0, size + 1))).astype(np.uint64)])) for _ in range(2)]
        share = rng.random()
        single = bool(rng.random() < 0.2)
        keys = []
        for x in lists:
            often = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) < share * 2**24
            x = np.concatenate([x[~often], x[often]])
            keys.append(jaccard.difference_keys(x, np.sort(often), int(rng.integers(2, shared + 1)), single))
        assert len(np.intersect1d(keys[0][0], keys[1][0])) or len(np.intersect1d(keys[0][1], keys[1][1]))


def test_words_that_polynomials_confuse(spark):
    """Complementary Thue-Morse words collide under any polynomial hash modulo a power of two."""
    t = "a"
    for _ in range(10):
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{t} x {u} x {u}"), (2, f"{u} x {t} x {u}")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.similar_components(df, 3, Fraction(9, 10)).collect()))
    assert got == [(1, 3, 1), (2, 3, 2)]


def test_components_of_a_hub_and_a_path(spark, monkeypatch):
    from turnweave.llm import components as c

    monkeypatch.setattr(c, "HUB", 5)
    links = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 130)] + [(200, 201), (201, 201)]
    got = dict(map(tuple, c.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(40)} | {k: 100 for k in range(100, 131)} | {200: 200, 201: 200}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_index_keys_lose_no_pair():
    """Sets with the similarity share a key, whatever members are frequent."""
    rng = np.random.default_rng(1)
    t = Fraction(9, 10)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 8))):
            b[rng.integers(len(b))] = rng.integers(0, 2**63)
        b = np.unique(b)
        k = len(np.intersect1d(a, b))
        if k * t.denominator < t.numerator * (len(a) + len(b) - k):
            continue
        both = np.unique(np.concatenate([a, b]))
        frequent = both[rng.random(len(both)) < rng.random()]
        x, y = (jaccard.index_keys(s, frequent, t) for s in (a, b))
        assert len(np.intersect1d(x[0], y[0])) or len(np.intersect1d(x[1], y[1])) or np.array_equal(a, b)
        most = jaccard.overlap_bound(jaccard.histogram(a), jaccard.histogram(b))
        assert most is None or most >= k


def test_similar_components_leaves_no_shuffle_files(spark, docs, monkeypatch):
    """What a query of the join shuffled goes when that query ends, not when the driver next collects its garbage."""
    import time

    monkeypatch.setattr(jaccard, "free_shuffles", lambda spark: None)
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p for p in held.getAllFiles().mkString("\n").split("\n") if "shuffle_" in p}
    before = files()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    out = jaccard.similar_components(docs, 3, Fraction(9, 10), frequent=2)
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == docs.count() and spark.conf.get(name) == setting


def test_jaccard_filter_keeps_one_of_each_group(docs, empty):
    kept = jaccard.filter_documents(docs, 3, Fraction(9, 10))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(24) == 1 and 27 not in ids and 30 not in ids and None in ids
    assert jaccard.similar_components(empty).count() == 0 == jaccard.filter_documents(empty).count()


def test_jaccard_filter_keeps_different_texts_of_one_id(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    near = text("a").replace("aw39", "other")
    rows = [(1, text("a")), (2, text("b")), (2, text("c")), (2, text("c")), (2, near), (3, text("d")), (4, None), (4, ""), (None, text("a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in jaccard.filter_documents(df).collect()]
    gone = {(2, near)}  # a near copy of document 1; the other texts of id 2 stay
    assert sorted(got, key=key) == sorted({r for r in rows if r not in gone}, key=key)


def test_word_hashes_tell_words_apart():
    text = " ".join(f"w{i} {'a' * i}" for i in range(200)).encode()
    h = word_hashes(text)
    assert len(h) == len(text.split()) and len(set(h.tolist())) == len(set(text.split()))
    assert len(word_hashes(b"")) == 0 == len(word_hashes(b" \n"))


def test_word_hashes_of_long_texts(monkeypatch):
    from turnweave.llm import common

    rng = random.Random(3)
    text = b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 3, 9, 80]))) for _ in range(300)) + b" \n "
    monkeypatch.setattr(common, "PIECE", 64)
    parts = common.word_hashes(text)
    of = {}
    for w, h in zip(text.split(), parts.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


# -- op2


@pytest.fixture(scope="module")
def piece_models():
    import sentencepiece

    path = pieces.default_model()
    return pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_sentencepiece_equals_library(piece_models):
    ours, library = piece_models
    rng = random.Random(2)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "日本", "23", "...", "▁", "😀", "<s>", "\x00x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(1500)] + ["".join(rng.choice("abcdefgh") for _ in range(3000)), " " * 70]
    got = ours.encode_many(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    for t, x in zip(texts, got):
        assert ours.decode(x) == library.decode(x.tolist())
        assert "▁" in t or ours.decode(x) == t


def test_unigram_search_is_the_best_path(piece_models):
    model = pieces.PieceModel(pieces.default_model(), "unigram")
    rng = random.Random(3)
    for _ in range(60):
        s = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 120)))
        best = [0.0] + [float("-inf")] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - model.longest), j):
                if s[i:j] in model.ids:
                    best[j] = max(best[j], best[i] + model.scores[model.ids[s[i:j]]])
        ids = list(model.search(s))
        assert "".join(model.pieces[i] for i in ids) == s and sum(model.scores[i] for i in ids) == pytest.approx(best[-1])


def test_index_stores_rare_keys_once(docs):
    t, none = Fraction(8, 10), np.empty(0, np.uint64)
    rows = docs.selectExpr("doc_id as id", "text")
    index = jaccard._index(rows, 5, t, none)
    assert "rare" not in index.columns
    texts = {}
    for r in rows.collect():
        texts.setdefault(r["id"], set()).add(r["text"])
    for r in index.select("id", "n", jaccard._rare().alias("rare")).collect():
        sets = [jaccard.shingles(x, 5) for x in texts[r["id"]]]
        wanted = [jaccard.index_keys(s, none, t)[0].view(np.int64).tolist() if len(s) else [] for s in sets]
        assert r["rare"] in wanted


def test_memo_keeps_the_most_used_spans():
    asked = []

    def encode_new(spans):
        asked.extend(spans)
        return [[int(x), len(x)] for x in spans]

    memo = MemoEncoder(str.split, encode_new, limit=50, keep=True)
    try:
        for k in range(40):
            texts = ["7 8", " ".join(str(100 + 30 * k + j) for j in range(30)) + " 9", ""]
            assert [x.tolist() for x in memo.encode_many(texts)] == [[i for x in t.split() for i in (int(x), len(x))] for t in texts]
        assert all(asked.count(x) == 1 for x in "789")
        assert len(memo.numbers) <= 50 + 33
    finally:
        MEMOS.remove(memo.forget)


def test_parts_outlive_a_full_memo(monkeypatch):
    """A part met again and again is searched once, however many others there are."""
    m = pieces.PieceModel(pieces.default_model(), memo=40)
    asked, encode = [], m._encode_part
    monkeypatch.setattr(m, "_encode_part", lambda part: asked.append(part) or encode(part))
    common = m.encode_span(" the")
    for k in range(300):
        m.encode_span(f" w{k}ord")
        assert m.encode_span(" the") == common
    assert asked.count("▁the") == 1


def test_search_leaves_boundaries_that_the_path_does_not_need(piece_models, monkeypatch):
    """Of the pairs of pieces in a run, few are merged anew; the ids are the library's, for one block of spans and many."""
    ours, library = piece_models
    m = pieces.PieceModel(pieces.default_model())
    asked, stays = [], m._stays
    monkeypatch.setattr(m, "_stays", lambda a, b: asked.append((a, b)) or stays(a, b))
    for word in ("internationalization", "wonderfully", "understanding"):
        assert m.encode_span(f" {word}") == library.encode(word)
    assert len(asked) < 15
    rng = random.Random(12)
    known = list(m.ids)
    texts = ["".join(rng.choice(known) for _ in range(rng.randint(1, 8))) for _ in range(400)] + ["".join(rng.choice("abdeghinorst ") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for size in (1 << 20, 50, 1):
        monkeypatch.setattr(pieces, "BLOCK", size)
        m.memo.forget()
        assert [x.tolist() for x in m.encode_many(texts)] == library.encode(texts)


def test_sentencepiece_documents(docs, empty):
    rows = pieces.encode_documents(docs, pieces.default_model())
    back = {(r.doc_id, r.text) for r in pieces.decode_documents(rows, pieces.default_model()).collect()}
    assert back == set(awkward())
    assert all(r.round_trip for r in rows.collect())
    assert pieces.encode_documents(empty, pieces.default_model()).count() == 0


# -- op3


def test_token_trees_follow_edits(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    pre = token_counts.PreTokens(path, public_tokenizers.PATTERN)
    rng = random.Random(5)
    parts = ["a", "bc", "the", "'", "s", "'re", " ", "  ", "\n", "23", ".", "!?", "é", "日", "<|endoftext|>"]
    text = lambda k: "".join(rng.choice(parts) for _ in range(k))
    for _ in range(150):
        monkeypatch.setattr(token_counts, "BLOCK", rng.choice([2, 8, 256]))
        s = text(rng.randint(0, 60))
        tree = token_counts.TokenTree(pre, s)
        for _ in range(8):
            a = rng.randint(0, len(s))
            b, new = min(len(s), a + rng.choice([0, 1, 2, 40])), text(rng.choice([0, 1, 6]))
            s = s[:a] + new + s[b:]
            tree.edit(a, b, new)
            assert tree.text() == s and tree.n_tokens == len(library.encode(s, add_special_tokens=False).ids)


def test_edits_encode_little():
    pre = token_counts.pre_tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    tree = token_counts.TokenTree(pre, "some words and more of them " * 500)
    tree.edit(7000, 7003, "x")
    assert 0 < tree.encoded < 12


def test_token_count_documents(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts.count_tokens(docs, path, public_tokenizers.PATTERN, edits=token_counts.digit_edits).collect()
    want = sorted(((i, n(t or ""), n(re.sub("[0-9]+", "0", t or ""))) for i, t in awkward()), key=key)
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_after) for r in got), key=key) == want
    assert token_counts.count_tokens(empty, path, public_tokenizers.PATTERN).count() == 0


def test_stored_trees_follow_a_table_of_edits(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    rng = random.Random(12)
    by_id = {i: t or "" for i, t in awkward() if i is not None}
    changes = []
    for i in sorted(by_id)[2::3]:
        n, at = len(by_id[i]), 0
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(at, n)
            b = min(n, a + rng.randint(0, 9))
            changes.append((i, a, b, rng.choice(["", " new", "x", "12 é", "\n\n"])))
            at = b + 1
            if at > n:
                break
    changes.append((999, 0, 0, "no such document"))
    trees = token_counts.build_trees(docs, path, pattern)
    edits = spark.createDataFrame(changes, "doc_id long, start int, end int, text string")
    after, told = token_counts.edit_trees(trees, edits, path, pattern)
    texts = {}
    for r in after.orderBy("doc_id", "row", "block").collect():
        texts[r.doc_id, r.row] = texts.get((r.doc_id, r.row), "") + r.text
    want = dict(by_id)
    for i, a, b, t in sorted(changes, key=lambda c: c[1:3], reverse=True):
        if i in want:
            want[i] = want[i][:a] + t + want[i][b:]
    assert {k[0]: t for k, t in texts.items() if k[0] is not None} == want
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    counts = {r.doc_id: r.n_tokens for r in token_counts.tree_counts(after).collect() if r.doc_id is not None}
    assert counts == {i: len(tokenizer.encode(t, add_special_tokens=False)) for i, t in want.items()}
    edited = {i for i, *_ in changes} - {999}
    got = {r.doc_id: r for r in told.collect()}
    assert set(got) == edited and all(r.n_tokens == counts[i] and r.n_encoded < 40 * r.n_edits for i, r in got.items())
    none = token_counts.build_trees(empty, path, pattern)
    assert none.count() == 0 and all(x.count() == 0 for x in token_counts.edit_trees(none, edits, path, pattern))


def test_untouched_blocks_are_never_encoded():
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    pre = token_counts.PreTokens(path, pattern)
    text = " ".join(f"word{k}" for k in range(5000))
    stored = [token_counts._Block(b.text, b.sizes, b.counts) for b in token_counts.TokenTree(pre, text).blocks]
    seen = []
    monitor = token_counts.PreTokens(path, pattern)
    learn = monitor.counts
    monitor.counts = lambda parts: seen.extend(parts) or learn(parts)
    tree = token_counts.TokenTree.of_blocks(monitor, stored)
    kept = list(tree.blocks)
    at = text.index("word2500")
    tree.edit(at, at + 8, "changed here")
    assert tree.text() == text[:at] + "changed here" + text[at + 8 :] and len(seen) < 12
    assert sum(a is not b for a, b in zip(kept, tree.blocks)) <= 2
    assert tree.n_tokens == token_counts.TokenTree(pre, tree.text()).n_tokens


# -- op4


def python_overlaps(text, item):
    """The best overlap (first, end, equal) of a text with an item, from every alignment, without seeds."""
    find = lambda x: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (x or "").lower())
    t, w = find(text), find(item)
    n, best = min(13, len(w)), []
    least = n if len(w) < 9 else -(-8 * n // 10)
    for shift in range(-len(w), len(t) + 1) if w else ():
        at = [p for p in range(len(w) - n + 1) if 0 <= shift + p and shift + p + n <= len(t) and sum(t[shift + p + j] == w[p + j] for j in range(n)) >= least]
        runs = []
        for p in at:
            if runs and p - runs[-1][1] <= n:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        best += [(-sum(t[shift + j] == w[j] for j in range(a, b + n)), shift + a, shift + b + n) for a, b in runs]
    return min(best) if best else None


@pytest.mark.parametrize("told", [1_000_000, 0])  # told to all tasks, and salted joins
def test_decontamination_equals_brute_force(spark, empty, monkeypatch, told):
    monkeypatch.setattr(decontaminate, "TOLD", told)
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([3, 5, 8, 9, 10, 11, 12, 13, 30, 60])] + [(19, None), (20, ""), (21, "É日本 V2"), (None, "v9 v8 v7 v6 v5 v4 v3 v2 v1 v0")]
    items.append(items[7])  # a repeated row
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        for _ in range(i % 3):
            item = rng.choice([x for _, x in items if x]).split()
            for j in range(rng.randint(0, 4), len(item), rng.randint(3, 9)):
                item[j] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs.append((i // 2, " ".join(w)))
    docs += [(100, None), (101, ""), (None, "x " + items[8][1].upper() + ", " + items[8][1]), (102, items[3][1]), (102, items[3][1]), (103, "filler " * 3000 + items[9][1])]
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in docs], "doc_id long, text string, item string, row int").repartition(3)
    bench = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, k int").repartition(2)
    want = sorted(((i, k, x[1], x[2], -x[0]) for i, t in docs for k, w in items if (x := python_overlaps(t, w))), key=key)
    assert len(want) > 20
    got = decontaminate.find_overlaps(df, bench)
    assert sorted(((r.doc_id, r.item_id, r.first_token, r.end_token, r.equal_tokens) for r in got.collect()), key=key) == want
    clean = decontaminate.filter_documents(df, bench)
    assert clean.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in clean.collect()), key=key) == sorted(((i, t or "") for i, t in docs if not any(python_overlaps(t, w) for _, w in items)), key=key)
    assert decontaminate.find_overlaps(empty, bench).count() == 0 == decontaminate.filter_documents(empty, bench).count()
    assert decontaminate.find_overlaps(df, bench.where("false")).count() == 0 and decontaminate.filter_documents(df, bench.where("false")).count() == len(docs)


def test_masks_hit_every_two_substitutions():
    from itertools import combinations

    for wrong in combinations(range(decontaminate.LENGTH), 2):
        assert any(all(o + j not in wrong for j in m) for m in decontaminate.MASKS for o in range(decontaminate.LENGTH - m[-1]))


@pytest.mark.parametrize("n", range(1, 14))
def test_every_allowed_substitution_is_found(n):
    from itertools import combinations

    item = decontaminate.tokens(" ".join(f"w{k}" for k in range(n)))
    hashes, places = decontaminate.item_seeds(item)
    known = dict(zip(hashes.tolist(), places.tolist()))
    allowed = 0 if n < 9 else n - -(-8 * n // 10)  # fewer than nine tokens must be equal
    for k in range(allowed + 2):
        for wrong in combinations(range(n), k):
            t = decontaminate.tokens(" ".join(["a", *(f"x{j}" if j in wrong else f"w{j}" for j in range(n)), "b"]))
            met = {p - known[h] for m in decontaminate.masks_of(n) for p, h in enumerate(decontaminate._seeds(t, m).tolist()) if h in known}
            found = [x for s in met for x in decontaminate.overlaps_at(t, 0, item, s)]
            assert found == ([(n - k, 1, n + 1)] if k <= allowed else []), (n, wrong)


# -- op5


def python_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match(r"[^/?#]*", rest or "").group()
    path = re.match(r"[^?#]*", (rest or "")[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    pages = [None, "", "no scheme.org/", "http://", "http://A.EXAMPLE.ORG/en/12?x", "http://example.org", "https://example.org/es/", "x://b.com/fr/a#b", "x://b.com/de/", "x://com/de/", "x://acom/de/", "http://org/", "http://a..org/é", "http://ÉX.org?/", "http://x.example.org/en/1"]
    rows = [(i, u) for i, u in enumerate(pages)] + [(4, pages[4]), (None, pages[7])]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    want = sorted(((i, *python_verdict(u, urls.RULES)) for i, u in rows), key=key)
    for bound in (100, 0):  # told to all tasks, and shuffled
        got = urls.filter_urls(df, urls.rules_table(spark, urls.RULES), broadcast_rules=bound)
        assert sorted(map(tuple, got.collect()), key=key) == want
    assert urls.filter_urls(df.where("false"), urls.rules_table(spark, urls.RULES)).count() == 0


def test_decode_equals_library():
    """Runs of byte pieces beside other pieces, and the unknown id."""
    import sentencepiece

    library, m = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), pieces.piece_model(pieces.default_model())
    rng = random.Random(8)
    own, raw = [i for p, i in m.ids.items() if "▁" not in p[1:]], [[m.byte_ids[b] for b in c.encode()] for c in "\n\té\U0001f40d日"]
    for _ in range(300):
        ids = [rng.choice(own), *(i for _ in range(rng.randint(0, 12)) for i in ([rng.choice(own)] if rng.random() < 0.5 else rng.choice(raw)))]
        assert m.decode(np.array(ids)) == library.decode(ids)
    the = library.encode("the")
    assert m.decode(np.array([*the, m.unknown])) == library.decode([*the, m.unknown])


def test_trie_holds_every_prefix():
    m = pieces.piece_model(pieces.default_model())
    for p, piece in random.Random(9).sample(sorted(m.prefixes.items()), 2000):
        following = m.trie
        for char in p:
            found, following = following[char]
        assert found == piece


# -- op6


def test_token_files_refuse_ids_that_do_not_fit():
    import io

    w = token_files.Writer(io.BytesIO(), 2)
    w.add(1, np.array([65535], np.uint32))
    with pytest.raises(ValueError):
        w.add(2, np.array([65536], np.uint32))


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t", path, files=3, by_chunk=True)
    got = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, t) in zip(got, rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    with open(manifest[-1].path.removeprefix("file://"), "rb") as f:
        reader = token_files.Reader(f)
        at = reader.find(24)
        assert len(at) in (0, 2)
    data = bytearray(open(manifest[0].path.removeprefix("file://"), "rb").read())
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(whole) == 2 * manifest[0].n_ids  # any decoder reads the ids and skips the tables
    assert token_files.write_token_files(empty, f"file://{tmp_path}/e", path) == []
    assert token_files.read_token_files(spark, []).count() == 0


def test_damaged_frames_are_noticed(tmp_path):
    with open(tmp_path / "x", "wb") as f:
        w = token_files.Writer(f)
        for k in range(5):
            w.add(k, np.arange(100 * k + 1, dtype=np.uint32))
        w.close()
    with open(tmp_path / "x", "rb") as f:
        r = token_files.Reader(f)
        assert [len(x) for x in r.all()] == [1, 101, 201, 301, 401]
        assert r.document(r.find(3)[0]).tolist() == list(range(301))
        r.table = r.table.copy()
        r.table[2, 2] ^= 1
        with pytest.raises(ValueError):
            r.document(2)


def test_plain_chunks_equal_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), token_files.chunk_encoder(path)
    rng = random.Random(6)
    parts = ["a", "B", "the", "'s", "'", " ", "\n", "\x1c", "\xa0", "é", "É", "ß", "×", "²", "日", "1", "...", "<|endoftext|>", "e\u0301", "İ", "Σ", "\x85", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert [x.tolist() for x in ours.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_chunks_are_encoded_together():
    """Chunks not met before cost no search of their own for their pieces, and no places of tokens."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), token_files.chunk_encoder.__wrapped__(path)
    rng = random.Random(7)
    chunks = list(dict.fromkeys("".join(rng.choice(["tion", "É", "un", "'s", "7", "...", "ß", "SCH"]) for _ in range(rng.randint(1, 7))) for _ in range(3000)))
    ids, sizes = ours.encode_new([c.encode() for c in [*chunks, "日本", "a<|b"]])
    assert sizes.tolist() == [len(library.encode(c, add_special_tokens=False).ids) for c in [*chunks, "日本", "a<|b"]]
    assert ids.tolist() == [i for c in [*chunks, "日本", "a<|b"] for i in library.encode(c, add_special_tokens=False).ids]


# -- op7


def test_language(spark, sf, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 !?", "en"), (None, "the", "de"), (1, None, None)], df.schema)
    assert {(r.lang_pred, r.score) for r in language.identify(odd).collect()} == {("und", 0.0)}
    assert language.identify(empty).count() == 0


def test_features_equal_convolution():
    net = language.train(["der die das und", "the and of it is", "le la les et de"] * 4, ["de", "en", "fr"] * 4, epochs=1)
    w = language.cut("some Text with é and more " * 30)[0]
    col = 0
    got = net.features(w)
    for width, t, bias in zip(net.widths, net.filters, net.biases):
        n = language.WINDOW - width + 1
        want = np.maximum(sum(t[j][w[:, j : j + n].astype(int)] for j in range(width)).max(1) + bias, 0)
        assert np.allclose(got[:, col : col + len(bias)], want, atol=1e-4)
        col += len(bias)


def test_language_of_whole_texts_equals_brute_force(spark):
    """Windows one by one, their probabilities weighted by their bytes; columns that clash with the result's."""
    rng = random.Random(5)
    net = language.train(["der die das und ist", "the and of it is", "le la les et de"] * 6, ["de", "en", "fr"] * 6, epochs=2)
    words = "the and of der die le les et und éa 12 ?".split()
    texts = [None, "", "123 !?", "the", "É" * 300, "ab" * 128] + [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 60, 700, 9000)]
    rows = [(i, t, "en", True, 0.5, "xx") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[7], (None, texts[7], "en", None, None, None)], "doc_id long, text string, lang string, held_out boolean, score double, lang_pred string").repartition(2)
    got = language.predict(df, net).collect()
    assert len(got) == len(texts) + 2 and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    for r in got:
        text = texts[7 if r.doc_id is None else r.doc_id]
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not text or not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw, sums, n = text.lower().encode(), np.zeros(3), 0
        for k in range(0, len(raw), 256):
            part = np.full(256, 32, np.uint8)
            piece = np.frombuffer(raw[k : k + 256], np.uint8)
            part[: len(piece)] = piece
            sums += np.asarray(net.probabilities(part[None]))[0] * len(piece)
            n += len(piece)
        assert n == len(raw) and r.lang_pred == net.languages[int(sums.argmax())] and abs(r.score - sums.max() / n) < 1e-4


# -- op8

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def python_spans(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, empty):
    rng = random.Random(7)
    parts = ["a@b.c", "x_d@e.f", "@", ".", "1.2.3.4", "256", "999.", "+1 (389) 555-5010", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "é", "😀", "12", "7", "word", "(at)", "token = ", "\n"]
    texts = [None, "", "1" * 2000, "a" * 2000 + "@", "9 " * 700, "a@b" + ".c" * 400, "+1" + " " * 500 + "2"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in [*rows, rows[9], (None, texts[10])]], "doc_id long, text string, kind int, spans string")
    got = pii.digest(pii.find_spans(df)).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = texts[r.doc_id if r.doc_id is not None else 10] or ""
        base = python_spans(text)
        written = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    masked = pii.mask(df)
    assert masked.columns == df.columns and masked.count() == df.count()
    by_id = {r.doc_id: r.text for r in masked.collect()}
    assert by_id[2] == texts[2] and by_id[0] is None
    assert pii.digest(pii.find_spans(empty)).count() == 0 == pii.mask(empty).count()


def python_candidates(text):
    """(kind, start, end, base, votes) of every candidate, by Python's own regular expressions."""
    out = []
    for kind, pattern, strict in [*((k, BASE[k], True) for k in BASE), *((k, x, False) for k, x in pii.WIDE)]:
        found = list(re.finditer(pattern, text, re.ASCII))
        for m, before, after in zip(found, [None, *found], [*found[1:], None]):
            x, d = m.group(), re.sub("[^0-9]", "", m.group())
            left, right = text[before.end() if before else 0 : m.start()][-40:], text[m.end() : after.start() if after else len(text)][:1]
            search = lambda pattern, where: re.search(pattern, where, re.ASCII) is not None
            ok = True
            if kind == "card":
                ok = 14 <= len(d) <= 19 and luhn(d)
            elif strict and kind == "ip":
                ok = all(int(v) <= 255 for v in x.split("."))
            elif strict and kind == "phone":
                ok = 10 <= len(d) <= 15
            votes = (
                (1 if strict else -1) if ok else 0,
                1 if search(pii.GAZETTEER[kind], x) else -1,
                1 if search(pii.CONTEXT[kind], left) else -1,
                int(not search(pii.BEFORE[kind], left) and not search("^[A-Za-z0-9]", right)),
                0 if search(pii.AGAINST[kind], left) else -1,
                int(search(pii.SHAPE[kind], x)),
            )
            out.append((pii.ALL.index(kind), m.start(), m.end(), strict and ok, votes))
    return out


def test_pii_added_spans_equal_brute_force(spark):
    rng = random.Random(11)
    key, block = "a8f3Kd02lLq9ZxC4vB7n", "-----BEGIN PRIVATE KEY-----\nMIIabc+/=\n-----END PRIVATE KEY-----"
    parts = ["jo (at) mail (dot) com", "x[at]y.org", "call 555-123-4567", "(415) 555-0100", "2001:db8:0:0:0:0:0:1", "card 4111 1111 1111 1111", "5500000000000004 12", f'token = "{key}"', f"commit {key}", f"AKIA{key.upper()}", "password: hunter22", "ssn 078-05-1120", "12-34-5678", "iban DE89 3704 0044 0532 0130 00", block, "a@b.com", "10.0.0.1", "+1 (389) 555-5010", " ", ", ", "word ", "é", "v1.2.3.4"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 8))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [python_candidates(t) for t in texts]
    counts = {}
    for kind, _, _, _, votes in (c for x in found for c in x):
        counts[kind, votes] = counts.get((kind, votes), 0) + 1.0
    by_votes = {}
    for (_, votes), n in counts.items():
        by_votes[votes] = by_votes.get(votes, 0.0) + n
    post, _ = pii.reconcile(sorted(by_votes.items()))
    w = pii.fit([(kind, votes, n, post[votes]) for (kind, votes), n in sorted(counts.items())])
    assert np.allclose(w, pii.train(pii.candidates(df, "doc_id", "text")))
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_spans(df).collect()}
    kinds = set()
    for k, x in enumerate(found):
        base = {(a, kind, b) for kind, a, b, is_base, _ in x if is_base}
        added = set()
        for kind, a, b, is_base, votes in x:
            likely = sum(p * q for p, q in zip(w, pii.features(kind, votes))) > 0
            evident = kind < 4 or votes[1] == 1 or votes[2] == 1
            if not is_base and votes[0] == -1 and votes[3] == 1 and likely and evident and not any(kind == c and e < b and a < f for e, c, f in base):
                added.add((a, kind, b))
        kinds |= {c for _, c, _ in added}
        assert got[k] == sorted(base | added)
    assert kinds >= {0, 3, 4, 5}
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert any(f"token = {chr(34)}<secret>{chr(34)}" in t for t in masked.values())
    assert any(f"commit {key}" in t for t in masked.values())


def test_masking_searches_the_texts_once(spark, monkeypatch):
    """A filter on the candidates, or a second pass, would repeat the patterns in the plans."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plans, written = [], pii.materialise
    monkeypatch.setattr(pii, "materialise", lambda df, name: plans.append(plan(df)) or written(df, name))
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        df = spark.createDataFrame([(1, "mail a@b.com", None), (1, None, "x"), (None, "", "y")], "doc_id long, text string, `a b` string")
        masked = pii.mask(df)
        plans.append(plan(masked))
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert sum(p.count("regexp_extract_all(") for p in plans) == len(pii.KINDS) + len(pii.WIDE)
    assert sorted(masked.collect(), key=str) == sorted([(1, "mail <email>", None), (1, None, "x"), (None, "", "y")], key=str)


def test_reconcile_trusts_agreeing_labelers():
    counts = [((1, 1, -1, 1, -1, 1), 100.0), ((0, 0, -1, 0, 0, 0), 100.0), ((0, 1, -1, 0, -1, 0), 20.0)]
    post, rates = pii.reconcile(counts)
    assert post[counts[0][0]] > 0.9 and post[counts[1][0]] < 0.1
    assert all(t > o for t, o in (rates[0], rates[3]))


# -- op9


def python_repeats(w):
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(hit)


def test_repeat_words():
    rng = random.Random(8)
    for _ in range(200):
        w = [str(rng.randint(0, rng.choice([2, 5, 9000]))).encode() for _ in range(rng.randint(0, 60))]
        assert quality.repeat_words(w) == python_repeats(w)
    many = [str(i).encode() for i in range(9000)]
    assert quality.repeat_words(many + many[:7]) == 14


def test_quality(docs, empty):
    got = quality.judge(docs).collect()
    rows = awkward()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), python_repeats(w))
        assert r.base_failed == (len(w) < 10 or 100 * python_repeats(w) > 20 * len(w)) and (not r.kept or not r.base_failed)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if r.kept)
    assert quality.judge(empty).count() == 0


def test_cascade_order_changes_no_verdict():
    texts = [t for _, t in awkward(3)]
    plan = quality.plan_cascade(texts)
    assert {r.name for r in plan} == {r.name for r in quality.RULES}
    rates = [r.gain for r in plan]
    assert rates == sorted(rates, reverse=True)
    assert [quality.keep(t, plan) for t in texts] == [quality.keep(t, quality.RULES) for t in texts]


# -- op10


def test_induced_sorting(tmp_path, monkeypatch):
    """Against plain comparison, in memory and in files, with strings of names sorted in memory and by recursion."""
    rng = random.Random(9)
    for _ in range(300):
        monkeypatch.setattr(induced, "BLOCK", rng.choice([3, 7, 64, 1 << 20]))
        monkeypatch.setattr(induced, "HELD", rng.choice([64, 1 << 40]))
        cap = rng.choice([3, 8, 100])
        t = [rng.randint(0, rng.choice([1, 3, 20, 300])) for _ in range(rng.randint(1, 150))]
        if rng.random() < 0.3:
            t = t[: rng.randint(1, 12)] * rng.randint(1, 12)
        got = list(induced.sorted_suffixes(np.array(t, np.int16), cap, rng.choice([0, 200, 1 << 30]), str(tmp_path)))
        order, common = (np.concatenate(x).tolist() for x in zip(*got))
        assert sorted(order) == list(range(len(t)))
        for a, b, k in zip(order, order[1:], common[1:]):
            assert t[a : a + cap] <= t[b : b + cap]
            same = 0
            while same < cap and max(a, b) + same < len(t) and t[a + same] == t[b + same]:
                same += 1
            assert same == k
    assert not list(tmp_path.iterdir())


def test_induced_sorting_beyond_memory(tmp_path):
    """Arrays of many times the memory go to files, the names are sorted by recursion, and the order is the same."""
    rng = np.random.default_rng(3)
    words = [rng.integers(97, 105, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(400)]
    raw = b" ".join(words[k] for k in rng.integers(0, 400, 6000))
    t = np.frombuffer(raw, np.uint8).astype(np.uint16)
    small, large = induced.Store(1 << 16, str(tmp_path)), induced.Store(1 << 30, str(tmp_path))
    a, b = (list(induced.sorted_suffixes(t, 60, store=s)) for s in (small, large))
    assert small.spilled > 8 * (1 << 16) and not large.spilled
    assert np.array_equal(np.concatenate([x[1] for x in a]), np.concatenate([x[1] for x in b]))
    order = np.concatenate([x[0] for x in a]).tolist()
    assert sorted(order) == list(range(len(t))) and all(raw[x : x + 60] <= raw[y : y + 60] for x, y in zip(order, order[1:]))


def python_dedup(rows):
    seen, out = set(), []
    for _, raw in rows:
        cover, end = bytearray(len(raw)), 0
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                cover[max(p, end) : p + 100] = b"\1" * (p + 100 - max(p, end))
                end = p + 100
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, empty, monkeypatch):
    rng = random.Random(10)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(90, 400))) for _ in range(6)]
    texts = ["ab" * 300, "ab" * 200 + "x", None, "", "a" * 1000, "é" * 120, "z" * 99, "z" * 99, "q" * 100, "q" * 101]
    for _ in range(60):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(1, 5))))
    rows = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, h string, first int").repartition(4)
    want = python_dedup(rows)
    for told, bits in ((suffix_dedup.TOLD, bitmap.MAP_BITS), (0, 10)):  # told or joined; a full map
        monkeypatch.setattr(suffix_dedup, "TOLD", told)
        monkeypatch.setattr(bitmap, "MAP_BITS", bits)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
        assert [got[i] for i, _ in rows] == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_splits_hot_grams(spark, monkeypatch):
    rng = random.Random(11)
    gram = "".join(rng.choice("abcdefgh") for _ in range(200))
    texts = [gram[rng.randint(0, 90) : rng.randint(100, 200)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "é" * 120, gram, gram]
    rows = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").repartition(4)
    largest, shards = [], suffix_dedup._sorted_shards

    def seen(contexts, *args):
        largest.append(contexts.groupBy("gram").agg({"windows": "sum"}).agg({"sum(windows)": "max"}).first()[0])
        return shards(contexts, *args)

    monkeypatch.setattr(suffix_dedup, "_sorted_shards", seen)
    for hot in (suffix_dedup.HOT, 2000, 0):  # none, some and all grams of several classes
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
        assert [got[i] for i, _ in rows] == python_dedup(rows)
    assert len(largest) == 2 and largest[0] > 2000 > largest[1]  # no shard holds a gram beyond the bound


def test_trimming_by_blocks(monkeypatch):
    rng = random.Random(12)
    data = ["".join(rng.choice("ab") for _ in range(rng.randint(100, 168))).encode() for _ in range(30)]
    data += [b"xy" + d[:120] for d in data[::3] if len(d) >= 120]
    rows = [(k, 0, 5, len(d) - 99, d) for k, d in enumerate(data)]
    shard = pa.table(dict(zip(["id", "h", "first", "windows", "data"], map(list, zip(*rows, strict=True)), strict=True)))
    whole = suffix_dedup.trimmed(shard).to_pylist()
    assert whole
    monkeypatch.setattr(suffix_dedup, "BLOCK", 7)
    assert suffix_dedup.trimmed(shard).to_pylist() == whole
    counts = {}
    for d in data:
        for w in range(len(d) - 99):
            counts[d[w : w + 100]] = counts.get(d[w : w + 100], 0) + 1
    for row in whole:
        d = data[row["id"]]
        met = [w for w in range(len(d) - 99) if counts[d[w : w + 100]] > 1]
        assert (row["first"], row["windows"], row["data"]) == (5 + met[0], met[-1] - met[0] + 1, d[met[0] : met[-1] + 100])


def test_anchors_over_pieces(monkeypatch):
    raw = np.frombuffer(("some text " * 60 + "other words " * 60).encode(), np.uint8)
    whole = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "PIECE", 128)
    cut = suffix_dedup.anchors(raw)
    assert whole[2].sum() == cut[2].sum() == len(raw) - 99
    expand = lambda a: np.repeat(a[0], a[2])
    assert np.array_equal(expand(whole), expand(cut))
