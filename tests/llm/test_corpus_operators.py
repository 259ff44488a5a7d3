"""Line quality, near duplicates, benchmark hits, repeated passages, page text and the pipeline."""

import hashlib
import html
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trivalent.llm import components, decontamination, html_text, line_dedup, line_quality, simhash, similar

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def clashing(docs):
    """Columns that the operators name themselves."""
    return docs.selectExpr("*", *[f"'x' as {c}" for c in ("fp", "row", "key", "start", "removed_ranges", "component_id", "label", "score", "lines")])


def groups(n, edges):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(x) for x in range(n)]


# Line quality


def brute_marginals(model, x):
    n = len(x)
    total, good = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        s = sum((x[i] @ model.weights) * y[i] for i in range(n)) + sum(model.turns[a, b] for a, b in zip(y, y[1:]))
        total += np.exp(s)
        good += np.exp(s) * np.array(y)
    return good / total, np.log(total)


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(3)
    model = line_quality.Model(rng.normal(size=line_quality.FEATURES), rng.normal(size=(2, 2)))
    parts = [rng.normal(size=(n, line_quality.FEATURES)) * 0.3 for n in (1, 4, 2, 7)]
    marginal, _, total = line_quality.forward_backward(model, np.concatenate(parts), [len(p) for p in parts])
    at = 0
    for p, t in zip(parts, total):
        good, log_total = brute_marginals(model, p)
        assert np.allclose(marginal[at : at + len(p), 1], good) and np.isclose(t, log_total)
        at += len(p)


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = line_quality.train(docs, labels)
    rows = line_quality.score(docs, model).join(labels, "doc_id").where(line_quality.held_out()).collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.99 * len(good) and sum(r.predicted for r in bad) <= 0.2 * len(bad)


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [(1, "good words here\n" * 9), (2, None), (3, ""), (3, ""), (None, "x"), (4, "###$$ " * 5000), (5, "a\n" * 20000)])
    labels = frame(spark, [(1, 1, 9), (4, 0, 9), (7, 1, None), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, label int")
    model = line_quality.train(clashing(docs), labels)
    rows = line_quality.score(clashing(docs), model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert line_quality.keep_good(clashing(docs), model).columns == clashing(docs).columns
    empty = docs.limit(0)
    assert line_quality.score(empty, line_quality.train(empty, labels)).collect() == []
    one_class = line_quality.train(docs, labels.where("quality = 1"))
    assert len({r.predicted for r in line_quality.score(docs, one_class).collect()}) == 1


# Near duplicates


def test_fingerprints_follow_the_definition():
    for text in ("", "one", "A b C d e f g", "x " * 30, "é Ä ß word\tword\nword", " two  words "):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) == want


def near_values(rng, roots=60):
    out = set()
    for base in rng.integers(0, 2**63, roots).tolist():
        for _ in range(int(rng.integers(1, 9))):
            for _ in range(int(rng.integers(0, 4))):
                base ^= 1 << int(rng.integers(0, 64))
            out.add(base)
    return np.array(sorted(out), dtype=np.uint64)


def test_trees_find_every_component():
    rng = np.random.default_rng(1)
    value = near_values(rng, 150)
    shard = np.sort(rng.integers(0, 3, len(value)))
    i, j = simhash.Forest(shard, value).within(4)
    near = (np.bitwise_count(value[:, None] ^ value[None, :]) <= 4) & (shard[:, None] == shard[None, :])
    assert all(near[a, b] for a, b in zip(i, j))
    assert groups(len(value), zip(i.tolist(), j.tolist())) == groups(len(value), zip(*np.nonzero(near)))


@pytest.mark.parametrize("shard_rows", [8192, 4])
def test_links_connect_all_near_values(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)  # 4: every shard of five or more is dealt out in blocks
    value = near_values(np.random.default_rng(2))
    hub = np.array([int(value[0]) ^ (1 << i) for i in range(30)], dtype=np.uint64)
    value = np.unique(np.concatenate([value, hub]))
    signed = value.view(np.int64).tolist()
    links = simhash.linked(frame(spark, [(v,) for v in signed], "fp long"), 4).collect()
    place = {v: i for i, v in enumerate(signed)}
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 4
    found = [(place[r.a], place[r.b]) for r in links]
    assert all(near[a, b] for a, b in found)
    assert groups(len(value), found) == groups(len(value), zip(*np.nonzero(near)))


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (3000, 3001), (3001, 3000)]
    found = {r.node: r.root for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    assert set(found) == set(range(201)) | set(range(1000, 1060)) | {3000, 3001}
    assert len({found[i] for i in range(201)}) == 1 and len(set(found.values())) == 3
    assert components.components(frame(spark, [], "a long, b long")).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    base = " ".join(f"word{i % 37}x{i}" for i in range(400))
    rows = [(9, base), (4, base), (7, base.replace("x399", "y")), (1, ""), (2, None), (3, " \n"), (5, "other text of its own here"), (5, "other text of its own here"),
            (None, base), (None, "a lonely text without an id at all"), (8, "long " * 30000)]
    docs = clashing(frame(spark, rows))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.component_id)
    assert by[9] == by[4] == by[7] == {4} and by[1] == by[2] == by[3] == {1} and by[5] == {5} and by[None] == {4, None}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


# Benchmark hits


def sellers(pattern, text):
    before, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text, 1):
        now = [0]
        for i, x in enumerate(pattern, 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (x != c)))
        before = now
        best = min(best, (now[-1], j))
    return best


def masks(pattern):
    out = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def test_bit_parallel_distance_equals_the_table():
    rnd = random.Random(5)
    for _ in range(400):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 80)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90)))
        assert decontamination.best_place(masks(p), len(p), t) == sellers(p, t)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_equal_brute_force(spark, block_bytes):
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice(["the", "cat", "on", "mat", "red", "Blue"]) for _ in range(rnd.randint(8, 16)))) for i in range(12)]

    def spoil(text, n):
        chars = list(text)
        for _ in range(n):
            chars[rnd.randrange(len(chars))] = rnd.choice(["z", "", "qq"])
        return "".join(chars)

    docs = [(i, "start of it " + spoil(rnd.choice(items)[1].upper(), rnd.randint(0, 5)) + "!! and more" * rnd.randint(0, 3)) for i in range(60)]
    docs += [(70, None), (71, ""), (71, ""), (None, items[0][1]), (72, "x" * 50000 + items[1][1])]
    benchmark = frame(spark, items + [(None, "an item without an id but long enough"), (50, None), (51, "short")], "item_id long, text string")
    found = decontamination.benchmark_hits(clashing(frame(spark, docs)), benchmark, rate=0.1, block_bytes=block_bytes).collect()
    want = set()
    for doc_id, text in docs:
        for item_id, item in items:
            p, t = decontamination.plain(item), decontamination.plain(text or "")
            distance, end = sellers(p, t[-400:]) if len(t) > 5000 else sellers(p, t)
            if distance <= decontamination.budget(p, 0.1):
                want.add((doc_id, item_id, distance))
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == want and len(want) > 20
    left = decontamination.drop_contaminated(clashing(frame(spark, docs)), benchmark, rate=0.1, block_bytes=block_bytes).collect()
    gone = {d for d, *_ in want}
    assert sorted(str(r.doc_id) for r in left) == sorted(str(d) for d, _ in docs if d not in gone)
    assert decontamination.benchmark_hits(frame(spark, docs), benchmark.limit(0)).collect() == []
    assert decontamination.benchmark_hits(frame(spark, docs).limit(0), benchmark).collect() == []


def test_one_replaced_word_and_short_items():
    rnd = random.Random(3)
    words = ["city", "river", "question", "answer", "the", "of", "which", "green", "mountain", "seven", "in", "ocean", "small"]
    found = tried = 0
    for i in range(200):
        item = [rnd.choice(words) for _ in range(rnd.randint(12, 20))]
        changed = list(item)
        changed[rnd.randrange(len(item))] = rnd.choice(["town", "stream", "is", "blue", "hill"])
        matcher = decontamination.Matcher([(i, " ".join(item))], 0.05, 25)
        found += bool(matcher.find(decontamination.plain("so it was: " + " ".join(changed) + ". And on")))
        tried += 1
    assert found >= 0.9 * tried
    short = decontamination.Matcher([(1, "The capital of France"), (2, "art"), (3, "art"), (4, "")], 0.05, 25)
    assert short.find(decontamination.plain("What is the capital of France?")) == [(1, 0, 29, 21)]
    assert short.find(decontamination.plain("the capital of Francesco started")) == []
    assert short.find("art") == [(2, 0, 3, 3), (3, 0, 3, 3)]


# Repeated passages


def test_shared_passages_go_and_the_rest_stays(spark):
    rnd = random.Random(4)

    def line(tag, n=9):
        return " ".join(f"{tag}{rnd.randrange(10**6)}" for _ in range(n))

    passage = [line("p", 9) for _ in range(7)]
    single = line("s", 60)
    greeting = "Hello there"
    own = {i: [line(f"d{i}_") for _ in range(12)] for i in range(1, 13)}
    docs = {i: [greeting, *lines] for i, lines in own.items()}
    for i in (2, 3, 5, 8):
        at = rnd.randrange(2, 12)
        docs[i][at:at] = passage
    for i in (3, 4, 9):
        docs[i].append(single)
    rows = [(i, "\n".join(x)) for i, x in docs.items()] + [(20, None), (21, ""), (21, ""), (None, "\n".join(passage)), (30, "\n".join(docs[12])), (31, "w\n" * 20000)]
    table_ = clashing(frame(spark, rows))
    result = line_dedup.remove_repeated_passages(table_)
    assert result.columns == [c for c in table_.columns if c != "removed_ranges"] + ["removed_ranges"]
    found = defaultdict(list)
    for r in result.collect():
        found[r.doc_id].append(r.text)
    assert found[2][0].split("\n") == docs[2] and found[3][0].split("\n")[-1] == single
    for i in (3, 5, 8):
        assert found[i][0].split("\n") == [x for x in docs[i] if x not in passage]
    assert found[9][0].split("\n") == docs[9][:-1] and found[4][0].split("\n") == docs[4][:-1]
    assert found[30] == [""] and found[12][0].split("\n") == docs[12] and found[20] == [None] and found[21] == ["", ""]
    assert found[None] == ["\n".join(passage)] and found[31] == ["w\n" * 20000]
    for i in (1, 6, 7, 10, 11):
        assert found[i][0].split("\n") == docs[i]
    assert line_dedup.remove_repeated_passages(table_.limit(0)).collect() == []


def test_lines_common_one_by_one_are_no_passage(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    common = [" ".join(word() for _ in range(5)) for _ in range(30)]
    passage = [" ".join(word() for _ in range(n)) for n in (60, 4, 7)]
    docs = {i: [word() + " own", line, word() + " own"] for i, line in enumerate(common)}
    docs[100] = common  # each line somewhere earlier, nowhere together
    docs[101] = ["start", *passage, "end"]
    docs[102] = ["other", *passage, common[3], "stop"]
    docs[103] = common[:9] + ["x y"] + common[9:]  # 45 words together, then 105
    rows = [(i, "\n".join(x)) for i, x in docs.items()]
    found = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.passages(spark, frame(spark, rows).withColumn("n_chars", F.length("text")), SF).collect()}
    assert found[102] == ["other", common[3], "stop"] and found[103] == common[:9] + ["x y"]
    assert all(found[i] == docs[i] for i in docs if i not in (102, 103))


def test_shortest_sequences_cover_every_shared_passage():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 9)
        words, gap = [rnd.randint(0, 5) for _ in range(n)], [rnd.random() < 0.2 for _ in range(n)]
        starts = [2 * i if any(gap) else i for i in range(n)] if all(gap) else [i + sum(gap[: i + 1]) for i in range(n)]
        found = {(a, b): k for k, a, b in line_dedup.sequences(starts, starts, words, list(range(n)), 6)}
        whole = [(i, j) for i in range(n) for j in range(i, n) if sum(words[i : j + 1]) >= 6 and starts[j] - starts[i] == j - i]
        assert set(found) <= {(starts[i], starts[j]) for i, j in whole} and len(set(found.values())) == len(found)
        for i, j in whole:
            inside = [(a, b) for a, b in found if starts[i] <= a and b <= starts[j]]
            assert {x for a, b in inside for x in range(a, b + 1)} == set(starts[i : j + 1])


def test_without_ranges(spark):
    rows = spark.range(1).select(
        line_dedup.without(F.split(F.lit("a,b,c,d,e"), ","), F.expr("array(named_struct('start', 0, 'stop', 1), named_struct('start', 3, 'stop', 3))")).alias("x"),
        line_dedup.without(F.split(F.lit("a,b"), ","), F.expr("array(named_struct('start', 0, 'stop', 1))")).alias("y"),
    ).first()
    assert rows.x == ["c", "e"] and rows.y == []


# Page text


def test_article_text_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        want = " ".join(x for x in parts if x)
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (want, len(want), r.url)


def test_lines_shared_with_the_neighbour_go(spark):
    page = "<div>Menu {0}</div><p>Story {1}<p>more &amp; <b>m</b>ore<div>Foot</div>"
    rows = [
        (1, "http://h/a/1", page.format("A", "one")), (2, "https://H:80/a/2?q=1", page.format("A", "two")), (3, None, None), (4, "http://x/", "<p>solo</p>"),
        (5, "http://z/1", "<article>In <b>art</b>icle<div class='comments'>c</div></article>tail<nav>n</nav>"), (5, "http://z/1", "<article>In <b>art</b>icle<div class='comments'>c</div></article>tail<nav>n</nav>"),
        (6, "http://z/2", "<div class='cookie-notice'>ok?</div><p>a < b &lt; c</p><script>var t='</p>'</script><!-- gone -->" + "<p>long " * 3000), (None, "http://q/", ""),
    ]
    docs = clashing(frame(spark, rows, "page_id long, url string, html string"))
    found = defaultdict(list)
    for r in html_text.extract_text(docs).collect():
        found[r.page_id].append(r.text)
    assert found[1] == ["Story one"] and found[2] == ["Story two"] and found[3] == [""] and found[4] == ["solo"] and found[None] == [""]
    assert found[5] == ["In article"] * 2 and found[6] == ["a < b < c" + " long" * 3000]
    assert html_text.extract_text(docs.limit(0)).collect() == []


@pytest.mark.parametrize("page,want", [
    ('<article><p title="5" tall">Hello world one.</p></article>', "Hello world one."),
    ("<article><p>One</p><a href=x onclick='a' b'>link</a><p>Two</p></article>", "One link Two"),
    ('<article><p class="share-of-voice">A</p><p class="related work">B</p><div class="ad">no</div><ul id="comment-list"><li>c</ul></article>', "A B"),
    ("<article><p>a < b and <3 c<!-- x > y --> d</p></article>", "a < b and <3 c d"),
    ('<article><p data-x = "a > b" hidden-not>in</p><p style="display:none">out</p></article><!-- open', "in"),
    ("<article><p class=>e</p><p =x>f</p></article>", "e f"),
])
def test_malformed_tags_and_names_inside_an_article(page, want):
    assert " ".join(text for text, place in html_text.blocks(page) if place == "main") == want


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<nav>", "<form class=menu>", '<p a="', "<!-- ", "<b", "<article class=nav>", "<a = ", "<script>", "<", "</i>", "<i>"])
def test_a_hostile_page_of_a_megabyte_is_read_in_seconds(piece):
    began = time.process_time()
    html_text.blocks(piece * (10**6 // len(piece)) + '"text' + "</nav>" * 1000)
    assert time.process_time() - began < 10


def test_copies_of_a_page_without_article_keep_their_text(spark):
    page = "<div>Home</div><div>Topics</div><h1>{0}</h1><p>The long story of {0} and what came of it<p>Its second part, on {0}{1}<div>Imprint</div>"
    rows = [(i, f"http://h/{name}" + f"?ref={i}" * (i % 2), page.format(name, "")) for name, ids in (("a", (1, 1, 2, 3)), ("b", (4,)), ("c", (5,))) for i in ids]
    rows += [(i, f"https://h/a?from={i}", page.format("a", f"<p>{i} visitors")) for i in range(100, 140)]  # near copies
    rows += [(i, "http://twin/", "<p>all there is") for i in (200, 201)]
    result = html_text.extract_text(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert len(result) == len(rows)
    story = "{0} The long story of {0} and what came of it Its second part, on {0}"
    for r in result:
        name = "a" if r.page_id < 4 or 100 <= r.page_id < 140 else {4: "b", 5: "c"}.get(r.page_id)
        want = "all there is" if name is None else story.format(name) + (f" {r.page_id} visitors" if r.page_id >= 100 else "")
        assert r.text == want


def test_pages_with_an_article_are_compared_as_well(spark):
    page = "<div>Home</div><div>Topics</div><article><h1>{0}</h1><p>As ever, all rights are kept.</p><p>The story of {0}</p></article><p>{0} remarks</p><div>Imprint</div>"
    rows = [(i, f"http://h/{i}", page.format(f"page {i}")) for i in range(5)] + [(4, "http://h/4", page.format("page 4")), (9, "http://alone/", page.format("page 9"))]
    found = html_text.extract_text(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert len(found) == 7
    for r in found:
        # What the comparison takes out of the article is put back.
        assert r.text == f"page {r.page_id} As ever, all rights are kept. The story of page {r.page_id}"
        assert r.n_shared == (0 if r.page_id == 9 else 4)


def test_one_url_is_cut_into_runs(spark):
    rows = [(i, "http://h/p" if i % 2 else None, f"<p>menu</p><p>text {i}</p><p>foot</p>") for i in range(200)]
    pages = html_text.page_blocks(frame(spark, rows, "page_id long, url string, html string"), "page_id", "url", "html")
    cuts = html_text.key_cuts(pages, 8)
    assert len(cuts) == 7 and {c.split("\t")[1] for c in cuts} == {"", "/p"}
    found = html_text.extract_text(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert len(found) == 200 and all(r.text == f"text {r.page_id}" for r in found)


def test_articles_inside_containers_with_names():
    def text(page):
        found = html_text.blocks(page)
        return [t for t, place in found if place == ("main" if any(p == "main" for _, p in found) else "open")]

    for open_, close in (("<body class='has-sidebar'>", "</body>"), ("<div class='page with-nav'>", "</div>"), ("<form id=all action=x>", "</form>"),
                         ("<div class='related'>", "</div>"), ("<aside>", "</aside>"), ("<div><form class=search>", "</form></div>")):
        for name in ("article", "main"):
            assert text(f"{open_}<nav>menu</nav><{name}>The story<p>goes on</{name}><div class=ad>buy</div>{close}<div>foot</div>") == ["The story", "goes on"]
    assert text("<article class='post related'>story<div class=comments>c</div></article><div>foot</div>") == ["story"]
    assert text("<article>story</article><div class=comments><article>c1</article></div><div class=related><article>teaser</article></div>") == ["story"]
    assert text("<main>story<aside><article>teaser</article></aside></main>") == ["story"]
    assert text("<main><h1>T</h1><div class='with-nav'><article>story</article></div></main><div>a long foot of the page</div>") == ["T", "story"]
    assert text("<article class=comment>c</article><p>story") == ["story"]
    assert text("<form><p>a page in one form<nav>menu</nav></form><div>foot</div>") == ["a page in one form", "foot"]
    assert text("<div hidden><article>no</article></div><p>a story of some length<form>your mail</form>") == ["a story of some length"]


def test_common_subsequence_is_longest():
    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rnd = random.Random(2)
    for _ in range(200):
        a, b = rnd.sample(range(20), rnd.randint(0, 15)), rnd.sample(range(20), rnd.randint(0, 15))
        found = sorted(html_text.shared_lines(a, b))
        assert len(found) == length(a, b) and [a[i] for i in found] == sorted((a[i] for i in found), key=b.index)
    assert html_text.shared_lines([1, 1, 2], [1, 2, 2]) == {0, 2}


# The pipeline


def test_stages_keep_columns_and_take_odd_rows(spark):
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "no id", "en", "s", 5), (10**6 + 2, "long line " * 20000, "en", "s", 9)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(odd + odd[1:2], DOCS))
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = corpus_pipeline.quality(spark, docs, SF).persist()
    ids = {r.doc_id for r in good.collect()}
    assert sum(labels.get(i) == 1 for i in ids) == sum(v == 1 for v in labels.values())
    fresh = {r.doc_id: r for r in corpus_pipeline.passages(spark, good, SF).collect()}
    assert set(fresh) == ids and all(r.n_chars == len(r.text) for r in fresh.values())
    order = sorted(ids)
    sets = [shingle_set(fresh[i].text) for i in order]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    one = {order[g] for g in groups(len(sets), near)}
    clean = {i for i in one if not any(decontamination.plain(t) in decontamination.plain(fresh[i].text) for t in items)}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    # Decontamination also drops items with a few edits; what it drops holds one within its budget.
    assert set(rows) <= clean
    for i in clean - set(rows):
        text = decontamination.plain(fresh[i].text)
        assert any(sellers(decontamination.plain(t), text)[0] <= decontamination.budget(decontamination.plain(t), 0.05) for t in items)
    for i, r in rows.items():
        assert r.decoded_sha256 == hashlib.sha256(fresh[i].text.encode()).hexdigest() and len(r.ids) == r.n_tokens


# Near duplicates of the pipeline


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("often", [32, 2])
def test_near_dedup_stage_takes_every_pair_at_four_fifths(spark, monkeypatch, often):
    monkeypatch.setattr(similar, "OFTEN", often)
    rnd = random.Random(11)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (None, "no id"), (None, "no id"), (1003, "Three short words"), (1004, "three  SHORT words")]
    for base in range(30):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(30, 300))]
        if base % 3 == 0:  # a passage that dissimilar documents share
            words += "one two three four five six seven eight nine ten".split()
        for copy in range(5):
            own = list(words)
            for _ in range(rnd.randint(0, len(words) // 30)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            rows.append((base * 10 + copy, " ".join(own)))
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    near = [(a, b) for a in range(len(sets)) for b in range(a)
            if 10 * len(sets[a][1] & sets[b][1]) >= 8 * len(sets[a][1] | sets[b][1])]
    far = sum((simhash.fingerprint(dict(rows)[sets[a][0]] or "") ^ simhash.fingerprint(dict(rows)[sets[b][0]] or "")).bit_count() > 4 for a, b in near)
    of = groups(len(sets), near)
    want = sorted(min(sets[i][0] for i in range(len(sets)) if of[i] == g) for g in set(of))
    docs = clashing(frame(spark, rows))
    kept = dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs, SF)
    assert kept.columns == docs.columns and far > 10
    found = [r.doc_id for r in kept.collect()]
    assert found.count(None) == 2 and sorted(i for i in found if i is not None) == want
