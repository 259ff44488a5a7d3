"""Token counts, coding, personal data, rules and licences against brute force, and odd tables for each."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trivalent.llm import bpe, licenses, pii, rules, token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    "", " ", "\n\n", "a", "  a  b\n\n c ", "it's 'tis ''s !!'ve<|endoftext|> x<|endoftext|>", "a  b　 c  d", "é ́x",
    "<|startoftext|>hi <|endoftext|>", "zqxj'qzreqxw7q9z" * 40, "\x1c a\x1d b", "日本 語 テスト 😀 😀", "   x\u0085 y", "q" * 3000, None,
]


def odd_texts(pieces, n=400, seed=7):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def table(spark, texts):
    """Documents with nulls, a repeated row and extra columns whose names the operators use themselves."""
    rows = [(i, t, "fp", "key", None) for i, t in enumerate(texts)]
    rows += [rows[1], (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, key string, score double").repartition(3)


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts(list(" \n\t'aszqSTre<>!?09́日😀") + ["<|endoftext|>", "the ", "'ll"])
    rows = token_counts.count_tokens(table(spark, texts), path, limit=20).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 20)


def test_coding_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts(list(" \n\t'aszqxSTre<>!?09é́日😀\x1c ") + ["<|endoftext|>", "the ", "'ll"])
    docs = table(spark, texts)
    plain = {(r.doc_id, r.decoded): r.ids for r in bpe.encode(docs, path).collect()}
    for r in bpe.encode_digests(docs, path, with_ids=True).collect():
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and plain[r.doc_id, library.decode(ids, skip_special_tokens=False)] == ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_no_token_holds_a_forced_pair():
    path = public_tokenizers.path("byte_bpe_50k.json")
    anywhere, _ = bpe.cut_tables(path)
    alphabet = bpe.byte_alphabet()
    for token in Tokenizer.from_file(path).get_vocab():
        if all(c in alphabet for c in token):
            data = [alphabet[c] for c in token]
            assert not any(anywhere[a * 256 + b] for a, b in zip(data, data[1:]))
    assert bpe.fragments("one two\nthree", path)[0] == b"one"


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_codec_remembers_less_than_half_a_kilobyte_a_fragment():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"word{i * 7919 % 99991} x{i}" for i in range(at, at + 5000)) for at in range(0, 40_000, 5000)]
    bpe._CODES.clear()
    list(bpe.Codec(path).code(["to load the vocabulary"]))
    bpe._CODES.clear()
    tracemalloc.start()
    try:
        for text in texts:
            list(bpe.Codec(path).code([text]))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    known = bpe._CODES[path]
    assert len(known) > 50_000 and held < 190 * len(known)



def plain_spans(text):
    def luhn(digits):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0

    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_equals_the_plain_patterns(spark):
    texts = odd_texts(["a@b.c", "@", ".", "..", "a", "B-", "_", "+", "%", "1", "12", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111",
                       " ", "-", "+1 (555) 555-1234", "é", "😀", "\n", "(", ")", "00000", "5.5", "x@y"], 800)
    texts += ["a" * 20000, "1" * 20000, "1 " * 20000, "+1" + "(" * 20000, "a." * 10000 + "@", "x@" + "a." * 10000 + "b", "1." * 10000]
    rows = pii.digest(pii.find_pii(table(spark, texts))).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = plain_spans("no id" if r.doc_id is None else texts[r.doc_id] or "")
        counts = Counter(x.split(":")[0] for x in want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PLAIN)
        assert r.spans == ",".join(want) or r.spans.startswith(",".join(want))


def test_checksums_and_context_decide_on_the_added_kinds(spark):
    texts = ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "card 378282246310005", "order 378282246310005", "ssn 123-45-6789", "no 123-45-6789"]
    rows = pii.digest(pii.find_pii(table(spark, texts))).orderBy("doc_id").collect()
    found = {r.doc_id: r.spans for r in rows}
    assert [found[i] for i in range(6)] == ["iban:0:27", "", "short_card:5:20", "", "ssn:4:15", ""]
    near = pii.find_pii(table(spark, ["phone +1 555 555 1234", "xxxxx +1 555 555 1234"])).orderBy("doc_id").collect()
    score = {r.doc_id: r.spans_phone[0].score for r in near if r.spans_phone}
    assert score[0] > score[1]


def test_rule_counts_equal_brute_force_and_junk_is_outvoted(spark):
    texts = odd_texts(["the cat ", "sat on ", "a mat ", "\n", "##", "É", " ", "dog\n"])
    prose = [" ".join(f"w{(i * 7 + j * j) % 97}ord" for j in range(80)) for i in range(300)]
    junk = [" ".join(f"W{(i * 5 + j) % 89}***" for j in range(80)) for i in range(40)]
    rows = rules.judge(table(spark, texts + prose + junk)).collect()
    texts += prose + junk
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        words = WORDS.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in rows}
    first = len(texts) - 340
    assert all(kept[i] for i in range(first, first + 300)) and not any(kept[i] for i in range(first + 300, first + 340))


def test_licence_places_equal_brute_force(spark):
    texts = odd_texts(["GNU ", "general public ", "License", " apache license ", "cc by-", "nc 4.0 ", "mit ", "é", "licensed under ", ", version 2.0 ", "\n"])
    texts += ["Licensed under CC BY-NC 4.0.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3."]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = licenses.scan(table(spark, texts)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    found = {r.doc_id: r.labels for r in rows}
    assert [found[len(texts) - i] for i in (3, 2, 1)] == ["cc-by,cc-by-nc-4.0", "all-rights-reserved", "gpl,gpl-3.0"]


def test_a_notice_with_one_word_more_or_another_is_found():
    index = licenses.build_index({}, 1000)
    rng = random.Random(1)
    found = tried = 0
    for label, notice, _ in licenses.TEMPLATES:
        for _ in range(20 if len(notice.split()) >= 12 else 0):
            words = notice.split()
            words.insert(rng.randrange(len(words) + 1), "novel")
            text = "some prose before it " * 9 + " ".join(words) + " and after" * 9
            found += label in {name for name, _, _ in licenses.match(licenses.words_of(text), index)}
            tried += 1
    assert found >= 0.9 * tried > 300
    assert licenses.match(licenses.words_of("so all the rights of the licensed cat are kept under the mat"), index) == []
    assert licenses.match([], index) == []


def test_weight_in_order_equals_every_choice():
    rng = random.Random(2)
    for _ in range(200):
        notice = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 6))]
        words = [rng.choice([b"a", b"b", b"c", b"x"]) for _ in range(rng.randint(0, 7))]
        weights = [rng.random() for _ in notice]

        def best(i, j):
            if i == len(notice) or j == len(words):
                return 0.0
            skip = max(best(i + 1, j), best(i, j + 1))
            return max(skip, weights[i] + best(i + 1, j + 1)) if notice[i] == words[j] else skip

        assert licenses.in_order(words, notice, weights) == pytest.approx(best(0, 0))


@pytest.mark.parametrize("name", ["tokens", "coding", "digests", "pii", "rules", "licences"])
def test_empty_tables_give_empty_results(spark, name):
    empty = spark.createDataFrame([], "doc_id long, text string, key string")
    made = {
        "tokens": lambda: token_counts.count_tokens(empty, public_tokenizers.path("word_bpe_49k.json")),
        "coding": lambda: bpe.encode(empty, public_tokenizers.path("byte_bpe_50k.json")),
        "digests": lambda: bpe.encode_digests(empty, public_tokenizers.path("byte_bpe_50k.json")),
        "pii": lambda: pii.digest(pii.find_pii(empty)),
        "rules": lambda: rules.judge(empty),
        "licences": lambda: licenses.scan(empty),
    }[name]()
    assert made.collect() == []
