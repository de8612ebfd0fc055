"""Decontamination against a look at every stretch of every document."""

import hashlib
import random
import re

import numpy as np
import pytest
from tests.llm.data import frame, write

from stratascan.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, doc_id string, row string, n long, token long"


def words(text):
    return WORD.findall("".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))


def expected(texts, items, size=10, missing=0):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for window, own in windows.items():
            n, k = len(window), min(d.SHINGLE, len(window))
            for i in range(len(w) - n + 1):
                part = tuple(w[i : i + n])
                if part == window or (missing and sum(part[j : j + k] != window[j : j + k] for j in range(n - k + 1)) <= min(missing, n - k)):
                    hit |= set(range(i, i + n))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def tables(spark, tmp_path, texts, items, ids=None):
    benchmark = spark.createDataFrame([(i, t, "x", "y", 3, 4) for i, t in items], ITEM)
    write(spark, tmp_path, benchmark, "benchmark")
    return write(spark, tmp_path, frame(spark, texts, ids=ids))


def op12(spark, sf):
    return [(r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in d.op12_decontaminate(spark, sf).collect()]


def corpus(seed, n=120):
    """Documents and items over a few words, so that shingles are common and items overlap."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c1", "é", "Çx", "the", "of", "zu"])
    gap = lambda: rng.choice([" ", "  ", "\n", ", ", ". ", "-", "_", "\x00", " x "])
    text = lambda k: "".join(word() + gap() for _ in range(k))
    items = [(i // 2, text(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(24)] + [(None, text(12)), (99, None), (98, "")]
    docs = [text(rng.randrange(0, 60)) for _ in range(n)] + [None, "", " ,.", "..a.."]
    for i in range(0, n, 3):  # planted passages, cut anywhere
        t = rng.choice(items)[1] or ""
        at = rng.randrange(len(t) + 1)
        docs[i] = docs[i][: len(docs[i]) // 2] + " " + t[at // 3 :] + " " + docs[i][len(docs[i]) // 2 :]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_equal_a_look_at_every_stretch(spark, tmp_path, seed):
    docs, items = corpus(seed)
    got = op12(spark, tables(spark, tmp_path, docs, items))
    want = expected(docs, items)
    assert sorted(got) == list(enumerate(want))
    assert any(x[4] for x in want) and not all(x[4] for x in want)


def test_windows_with_some_shingles_missing(spark):
    rng = random.Random(3)
    item = [f"w{i}" for i in range(14)]
    docs = []
    for n in range(30):
        w = list(item)
        for _ in range(n % 4):
            w[rng.randrange(14)] = "other"
        docs.append(" ".join(["x"] * (n % 5) + w))
    items = [(1, " ".join(item)), (2, "w1 w2")]
    frames = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    for missing in (0, 2, 3):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in d.decontaminate(*frames, missing=missing).collect()}
        want = expected(docs, items, missing=missing)
        assert {i: (x[0], x[1], len(x[2])) for i, x in got.items()} == {i: w[:3] for i, w in enumerate(want)}


def test_a_passage_in_most_documents_and_a_common_shingle(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [f"{'the of and ' * 20} {passage if i % 3 else ''} d{i}" for i in range(900)]
    items = [(7, passage), *((100 + i, "the of and the of and the of and " + f"r{i}") for i in range(40))]
    got = dict(op12(spark, tables(spark, tmp_path, docs, items)))
    assert got == dict(enumerate(expected(docs, items)))


def test_ids_that_repeat_or_are_null_and_equal_rows(spark, tmp_path):
    docs = ["a b c d e f g h i j k", "a b c d e f g h i j k", "nothing", None]
    items = [(1, docs[0]), (1, docs[0]), (10, docs[0]), (2, docs[0])]
    got = op12(spark, tables(spark, tmp_path, docs, items, ids=[5, 5, None, None]))
    assert sorted((i or -1, x) for i, x in got) == sorted(zip([5, 5, -1, -1], expected(docs, items), strict=True))


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), (["a b", None], []), ([], []), (["a"], [(1, None)])])
def test_empty_tables(spark, tmp_path, docs, items):
    assert sorted(op12(spark, tables(spark, tmp_path, docs, items))) == list(enumerate(expected(docs, items)))


def test_a_very_long_document_is_read_whole(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(12))
    docs = ["word " * 400_000 + item, item + " " + "x" * 1_000_000, f"{item} " * 500]
    assert sorted(op12(spark, tables(spark, tmp_path, docs, [(1, item)]))) == list(enumerate(expected(docs, [(1, item)])))


def test_spans_of_hits(spark):
    item = " ".join(f"q{i}" for i in range(11))
    (row,) = d.decontaminate(frame(spark, [f"x {item} y"]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [tuple(s) for s in row.spans] == [(1, 10), (2, 10)] and row.n_hit == 11


def test_filter_lets_all_of_its_own_through(spark):
    own = np.random.default_rng(1).integers(-(2**63), 2**63, 5000, np.int64)
    tokens = spark.createDataFrame([(int(x),) for x in own], "token long")
    for most in (1 << 27, 1 << 12):  # a full bitmap lets more through, but loses none
        inside = d.TokenFilter(tokens, most).inside()
        assert len(inside(own)) == len(own)
    others = np.random.default_rng(2).integers(-(2**63), 2**63, 100_000, np.int64)
    assert len(d.TokenFilter(tokens).inside()(others)) < 100
