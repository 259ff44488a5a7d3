"""Spelling variants, repeated byte strings, the conversation trie, and hot groups of the near-dedup stage."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.llm import prefix_trie, queries, similar, spelling, suffix_dedup

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def clashing(df, *names):
    return df.selectExpr("*", *[f"'x' as {c}" for c in names])


# Spelling variants


def edit_one(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def brute_variants(n):
    out = {}
    for w in n:
        near = sorted((-n[v], v) for v in n if v != w and edit_one(w, v))
        form = near[0][1] if near and -near[0][0] >= 2 * n[w] else None
        out[w] = [n[w], len(near), form, n[form] if form else None]
    for w, row in out.items():
        last = w
        while out[last][2]:
            last = out[last][2]
        row.append(last)
    return {(w, *row) for w, row in out.items()}


def test_search_finds_every_pair_at_one_edit_once():
    rng = random.Random(5)
    for trial in range(60):
        letters = "ab" if trial % 2 else "abcé"
        listed = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 12]))) for _ in range(rng.randint(2, 90))})
        coded = [w.encode("latin-1") for w in listed]
        index = spelling.Index(coded)
        half = np.array([len(w) // 2 for w in coded])
        q, near = index.one_error(coded, half)
        found = list(zip(q.tolist(), near.tolist()))
        want = {(i, j) for i, u in enumerate(listed) for j, v in enumerate(listed)
                if i != j and u[: len(u) // 2] == v[: len(u) // 2] and edit_one(u, v)}
        assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("shard,half", [(40_000, 40_000), (5, 40_000), (5, 3)])
def test_variants_equal_brute_force(spark, monkeypatch, shard, half):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "HALF_WORDS", half)  # 3: common halves are dealt out in blocks
    monkeypatch.setattr(spelling, "NARROW", 4)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "×÷×÷× ×÷×÷× ×÷×÷× 12345 Ünlike"), (None, "abcde Abcde ABCDE"), (4, "x" * 3000 + " " + "x" * 3000), (4, "x" * 3000)]
    for i in range(60):
        text = []
        for _ in range(40):
            w = rng.choice(base[: rng.randint(1, 25)])
            k = rng.randrange(len(w))
            text.append(rng.choice([w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + "é" + w[k:], w[:k] + "b" + w[k + 1 :]]))
        rows.append((100 + i, " ".join(text)))
    rows.append((99, " ".join(["qqqqq"] * 40 + ["qqqqz"] * 15 + ["qqqzz"] * 5)))  # a chain of forms
    got = spelling.spelling_variants(clashing(frame(spark, rows), "word", "n", "half")).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute_variants(brute_words(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r["root"] != r["form"] and r["form"] for r in got) and ("×÷×÷×", 3, 0, None, None, "×÷×÷×") in want


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(frame(spark, [])).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, "once upon words")])).collect() == []


# Repeated byte strings


def brute_removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out.append((doc_id, len(t), tuple(spans), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def odd_texts(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["so", "été", "naïve", "word", "日本", "x"]) + str(rng.randrange(50)) for _ in range(n))
    passage, edge = prose(60), "é" * 110
    rows = [(1, None), (2, ""), (3, "short"), (None, prose(30) + passage), (None, None), (4, passage), (4, passage), (5, "a" * 900), (6, "ab" * 300)]
    rows += [(10 + i, prose(rng.randint(5, 40)) + passage[: rng.randint(150, 400)] + prose(20)) for i in range(12)]
    rows += [(40, edge + prose(30)), (41, prose(30) + edge)]
    base = prose(200)
    for i in range(10):
        k = rng.randrange(len(base))
        rows.append((50 + i, base[:k] + "#" + base[k + 1 :]))
    return rows + [(70, base), (71, base)]


@pytest.mark.parametrize("length", [64, 200])
@pytest.mark.parametrize("contexts", [4096, 1])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, length, contexts):
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", contexts)  # 1: every mixed key is dealt out by window
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 300)
    suffix_dedup.powers.cache_clear()
    rows = odd_texts(length + contexts)
    docs = clashing(frame(spark, rows), "key", "digest", "start", "ranges", "kept")
    got = suffix_dedup.remove_repeated_bytes(docs, length=length).collect()
    suffix_dedup.powers.cache_clear()
    assert sorted([(r[0], r[1], tuple(map(tuple, r[2])), bytes(r[3])) for r in got], key=repr) == brute_removed(rows, length)


def test_common_prefixes_equal_those_of_sorted_suffixes():
    rng = random.Random(1)
    for trial in range(40):
        letters = "ab" if trial % 2 else "abcdefgh"
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 400)))
        text = np.frombuffer((text + text[: len(text) // 2]).encode() + b"\xff", np.uint8)
        order = suffix_dedup.suffix_order(text, 256)
        whole = [text[i : i + 256].tobytes() for i in order.tolist()]
        assert whole == sorted(whole)
        shared = suffix_dedup.common_prefixes(text[order - 1], 200)
        for a, b, k in list(zip(whole, whole[1:], shared[1:].tolist())):
            real = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            # strings that hold the end are not compared
            assert b"\xff" in a[: real + 1] + b[: real + 1] or (k == real if real < 200 else k == suffix_dedup.UNSET)


def test_removed_bytes_of_nothing_and_bad_lengths(spark):
    assert suffix_dedup.remove_repeated_bytes(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated_bytes(frame(spark, []), length=10)


# Conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == k).encode()).hexdigest())
        for k, m in members.items()
    }


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("subtree,table,block", [(100_000, 200_000, 4096), (15, 20, 3), (1, 1, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, subtree, table, block):
    for name, value in (("SUBTREE_ROWS", subtree), ("TABLE_ROWS", table), ("BLOCK", block), ("ID_BLOCK", 5)):
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(3)
    rows = [(None, 0, "user", "left out"), (7, None, None, None), (7, 0, "user", "ça"), (1000, 0, "user", ""), (1001, 5, None, "late"), (1001, 5, None, "late")]
    for c in range(0, 120):
        if c % 10 != 3:
            rows += [(c, t, "user" if t % 2 == 0 else "bot", rng.choice(["hi", "yes", "nö"]) if t else "start") for t in range(rng.choice([1, 2, 4, 9, 30]))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260, 5) for t in range(4)]  # one conversation many times
    got = prefix_trie.conversation_trie(clashing(frame(spark, rows, TURNS), "depth", "k1", "pos", "n")).collect()
    want = brute_trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(frame(spark, [], TURNS)).collect() == []


def test_slots_are_minimal_and_perfect_and_find_strangers_out():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63 - 1, size=(2, 5000), dtype=np.int64)
    table = prefix_trie.Slots(keys[0], keys[1])
    assert sorted(table.find(keys[0], keys[1]).tolist()) == list(range(5000))
    assert (table.find(keys[0], keys[1] + 1) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.array([1, 1]), np.array([2, 2]))


# Near-dedup: hot sets and hot tokens


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, 50).astype(np.uint64)]))
        maps = similar.by_width([similar.parities(b)])
        shared = len(np.intersect1d(a, b))
        linked = 5 * shared >= 4 * (len(a) + len(b) - shared)
        fits = similar.may_link((len(a), similar.parities(a)), np.array([len(b)]), maps, similar.Fraction("0.8"))
        assert fits[0] or not linked


@pytest.mark.parametrize("block", [4096, 8])
def test_near_dedup_of_a_hot_set_a_star_and_a_hot_token(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**7)}"
    hot = [word() for _ in range(60)]
    star = [word() for _ in range(200)]
    rows = [(i, " ".join(hot)) for i in range(300)]  # one set
    for i in range(80):  # near the first, not near each other
        own = list(star)
        for k in rng.sample(range(0, 190, 6), 3):
            own[k] = word()
        rows.append((1000 + i, " ".join(own)))
    rows.append((999, " ".join(star)))
    few = 200 if block == 8 else 2000
    rows += [(5000 + i, "the same five words here " + " ".join(word() for _ in range(8))) for i in range(few)]  # one token, dissimilar
    kept = sorted(r.doc_id for r in similar.keep_one(frame(spark, rows)).select("doc_id").collect())
    assert kept == [0, 999, *range(5000, 5000 + few)]


def test_near_dedup_compares_what_fingerprints_link(spark, monkeypatch):
    nothing = lambda groups, share: groups.selectExpr("set_id AS a", "set_id AS b").limit(0)
    monkeypatch.setattr(similar, "spokes_of", nothing)
    monkeypatch.setattr(similar, "pairs_of", nothing)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**7)}"
    story = [word() for _ in range(2000)]
    rows = [(1, " ".join(story)), (2, " ".join([*story, word()])), (3, " ".join([word(), *story])), (4, " ".join(word() for _ in range(300))), (5, ""), (6, None)]
    assert sorted(r.doc_id for r in similar.keep_one(frame(spark, rows)).collect()) == [1, 4, 5]


def test_near_dedup_looks_at_what_fingerprints_link_wrongly(spark, monkeypatch):
    monkeypatch.setattr(similar.simhash, "linked", lambda fps, radius: fps.crossJoin(fps.selectExpr("fp AS b")).selectExpr("fp AS a", "b").where("a < b"))
    rows = [(i, f"some story about the number {i} and nothing else than {i * i}") for i in range(20)]
    assert similar.keep_one(frame(spark, rows)).count() == 20


def test_queries_on_whole_tables_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = queries.op11_spelling_variants(spark, SF).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == brute_variants(brute_words(docs))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {tuple(r) for r in queries.op13_prefix_trie(spark, SF).select(*names).collect()} == brute_trie([tuple(t) for t in turns])
    got = queries.op12_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute_removed(docs, 200)]
    assert sorted(map(tuple, got)) == sorted(want)
