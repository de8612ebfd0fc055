import math
import random
import string
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratascan.llm import ann, lm_score, quality
from tests.llm.data import frame, prose, write

VEC = "vec_id long, embedding array<float>, label int, ids string, shard int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1) for i, v in rows], VEC)


def nearest(rows, k=20, every=20):
    """By brute force: (query, rank) -> (vec_id, score)."""
    good = {i: np.array(np.array(v, np.float32), float) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, np.float32)) and i is not None}
    out = {}
    for q in (i for i in good if i % every == 0):
        best = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q)[:k]
        out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(16) * rng.uniform(0.2, 3)) for i in range(900)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # a group of equal vectors, larger than a result
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [math.nan] * 16), (2060, [math.inf] + [1.0] * 15), (2080, [None] + [1.0] * 15), (2100, [1.0] * 3), (None, [1.0] * 16)]
    sf_dir = write(spark, tmp_path, vectors(spark, [(i, None if v is None else list(v)) for i, v in rows]), "embeddings")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.op6_prefix_forest(spark, sf_dir).collect()}
    want = nearest([(i, v) for i, v in rows if i not in (None, 2100)])
    assert set(got) == set(want)
    by = lambda x: {(q, v[0]) for (q, _), v in x.items()}
    assert len(by(got) & by(want)) >= 0.9 * len(want)
    exact = {(q, i): s for q, i in by(want) for s in [next(v[1] for (p, _), v in want.items() if p == q and v[0] == i)]}
    assert all(v[1] == pytest.approx(exact[q, v[0]], rel=1e-12) for (q, _), v in got.items() if (q, v[0]) in exact)


def test_few_vectors_and_none(spark):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(vectors(spark, rows)).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert ann.search(vectors(spark, [])).count() == 0
    assert ann.search(vectors(spark, [(20, [0.0, 0.0])])).count() == 0


def ascent(labels, own, mine, want):
    """Rows met by a plain walk: shorter and shorter prefixes of all trees, one tree at a time from the level on where they may be enough."""
    others = np.arange(len(labels)) != mine
    for level in range(ann.BITS, -1, -1):
        shift = np.uint64(ann.BITS - level)
        shares = (labels.astype(np.uint64) >> shift) == (own.astype(np.uint64) >> shift)
        shorter = (labels.astype(np.uint64) >> (shift - np.uint64(1))) == (own.astype(np.uint64) >> (shift - np.uint64(1))) if shift else np.zeros_like(shares)
        for t in range(labels.shape[1]):
            met = (shares[:, : t + 1].any(axis=1) | shorter.any(axis=1)) & others
            if met.sum() >= want:
                return set(np.flatnonzero(met))
    return set(np.flatnonzero(others))


def test_prefixes_are_searched_from_the_longest_up():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[100:140] = x[0] + 1e-3 * x[100:140]  # the same rows in all trees
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest(8, trees=12)
    forest.build(ann.lift(x, 1.0))
    labels = forest.strings(ann.lift(x, 1.0))
    q = np.concatenate([forest.strings(ann.aim(x[:5] + 0.01)), labels[7:10]])
    own = np.array([-1] * 5 + [7, 8, 9])
    shared = np.array([[max(32 - int(a ^ b).bit_length() for a, b in zip(row, mine, strict=True)) if i != o else -1 for i, row in enumerate(labels)] for mine, o in zip(q, own, strict=True)])
    assert (forest.descend(q, own) == shared.max(axis=1)).all()  # a row's own string is left out of the descent
    for want in (1, 20, 150, 300, 1000):
        for mine, o, met in zip(q, own, forest.candidates(q, own, want), strict=True):
            assert set(met) - {o} == ascent(labels, mine, o, min(want, 300)) and (o < 0 or o in met)


def test_near_neighbours_need_few_rows_and_queries_cross_shards(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 24))
    rows = [(i, list(centres[i % 60] + 0.05 * rng.standard_normal(24))) for i in range(1800)]
    frame_of = vectors(spark, rows)
    assert ann.met_share(frame_of) < 0.15
    monkeypatch.setattr(ann, "SHARD_ROWS", 400)
    monkeypatch.setattr(ann, "_STEP", 30)
    got = {(r.query_id, r.vec_id) for r in ann.search(frame_of).collect()}
    want = {(q, v[0]) for (q, _), v in nearest(rows).items()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def labelled(n, seed):
    """Texts of three grades: insults, shouting, and plain prose."""
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = prose(rng.randrange(20, 400), seed * n + i, 3000).split()
        kind = rng.choice((0, 1, 2, 2, 2))
        if kind == 0:
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = rng.choice(("vile", "awful", "nasty"))
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return texts, labels


def test_held_out_grades(spark):
    texts, labels = labelled(700, 1)
    docs = frame(spark, texts)
    known = spark.createDataFrame([x for x in labels if x[0] < 500], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, known)).collect()}
    held = [x for x in labels if x[0] >= 500]
    right = sum((got[i].p_top >= 0.5) == (q == 1 and t == 0) for i, q, t in held)
    assert right >= 0.95 * len(held)
    mean = [np.mean([got[i].expected_grade for i, q, t in held if (0 if t else 2 if q else 1) == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())


def test_gradient_and_order_of_thresholds():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(200)]
    grades = np.array([min(2, int(3 in r) + int(7 in r)) for r in rows])
    model = quality.fit(rows, grades, penalty=0.1)
    assert model.thresholds[0] < model.thresholds[1]
    s = np.array([model.weights[r].sum() for r in rows])
    assert s[grades == 0].mean() < s[grades == 1].mean() < s[grades == 2].mean()
    best = model.tail(s)
    p = np.concatenate([np.ones((200, 1)), best], axis=1) - np.concatenate([best, np.zeros((200, 1))], axis=1)
    assert (p.argmax(axis=1) == grades).mean() > 0.9


def test_gradient_equals_differences():
    rng = np.random.default_rng(6)
    doc, col = np.repeat(np.arange(40), 3), rng.integers(0, 9, 120)
    grades = rng.integers(0, 3, 40)
    at = np.concatenate([rng.normal(0, 0.7, 9), [-0.4, 0.3]])
    _, grad = quality.loss(at, doc, col, grades, 0.5)
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-6
        slope = (quality.loss(at + step, doc, col, grades, 0.5)[0] - quality.loss(at - step, doc, col, grades, 0.5)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-5), i
    # the loss itself, from the probabilities of the grades
    x = np.zeros((40, 9))
    np.add.at(x, (doc, col), 1)
    cut = np.array([at[9], at[9] + math.exp(at[10])])
    above = 1 / (1 + np.exp(-((x @ at[:9])[:, None] - cut)))
    p = np.stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]])
    assert quality.loss(at, doc, col, grades, 0.5)[0] == pytest.approx(-np.log(p[grades, np.arange(40)]).sum() + 0.25 * (at[:9] ** 2).sum())


def plain_features(text):
    """Feature numbers of a text, word by word."""
    number = lambda key: xxhash.xxh64_intdigest(key) >> (64 - quality.BITS)
    ends = string.punctuation.encode()
    words, out = (text or "").encode().split(), set()
    shapes, cores = Counter(), Counter()
    for w in words:
        core = w.strip(ends).decode("utf-8", "replace").lower()
        cores[number(b"w:" + core.encode())] += 1
        out |= {number(f"{k}:{part}".encode()) for k, part in (("w", core), ("4", core[:4]), ("5", core[:5]))}
        bare = w.rstrip(ends)
        case = b"-" if not bare else b"09" if bare.isdigit() else b"AA" if bare.isupper() and len(bare) > 1 else b"Aa" if bare[:1].isupper() else b"aa"
        shapes[case + w[len(bare) :][:3]] += 1
    traits, n = ["all"], len(words)
    if n:
        traits += [b"s:%s:%d" % (k, max(1, 9 + math.floor(math.log2(c / n)))) for k, c in shapes.items()]
        traits += [f"distinct:{10 * len(cores) // n}", f"top:{10 * max(cores.values()) // n}", f"length:{int(math.log2(n))}", f"mean:{min(20, len((text or '').encode()) // n)}"]
    return out | {number(b"%d:" % i + (t if isinstance(t, bytes) else t.encode())) for t in traits for i in range(quality.TRAIT_HASHES)}


def test_the_query_equals_a_plain_score(spark, tmp_path):
    texts, labels = labelled(300, 9)
    texts += [None, "", "12 AB! ... Über?", prose(150_000, 4), texts[0]]
    write(spark, tmp_path, spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int"), "labels")
    sf_dir = write(spark, tmp_path, frame(spark, texts))
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r for r in quality.op9_quality_classifier(spark, sf_dir).collect()}
    assert len(got) == len(texts) and np.count_nonzero(model.weights) > 100
    for i, text in enumerate(texts):
        score = sum(float(model.weights[f]) for f in plain_features(text))
        tail = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].p_top == pytest.approx(tail[1], abs=1e-6)
        assert got[i].expected_grade == pytest.approx(sum(tail), abs=1e-6) and got[i].kept == (got[i].p_top >= 0.5)


def test_classifier_on_no_documents(spark, tmp_path):
    write(spark, tmp_path, spark.createDataFrame([], "doc_id long, quality int, toxic int"), "labels")
    assert quality.op9_quality_classifier(spark, write(spark, tmp_path, frame(spark, []))).count() == 0


def test_odd_rows_are_scored(spark):
    docs = frame(spark, [None, "", "x", "x"], ids=[None, 1, 2, 2])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, none)).count() == 4
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4
    odd = spark.createDataFrame([(2, None, None), (None, 1, 0), (1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, odd)).count() == 4


def backoff(texts, least=2):
    """(words, log score) of each text, from plain counts."""
    docs = [(t or "").encode().lower().split() for t in texts]
    c = Counter(tuple(d[i : i + n]) for d in docs for n in (1, 2, 3) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        logs = 0.0
        for i in range(len(d)):
            f = 1.0
            for n in (3, 2, 1):
                g = tuple(d[i - n + 1 : i + 1]) if i >= n - 1 else None
                if n == 1:
                    logs += math.log(f * c[g] / total)
                elif g and c[g] >= least:
                    logs += math.log(f * c[g] / c[g[:-1]])
                    break
                elif g:
                    f *= 0.4
        out.append((len(d), logs))
    return out


@pytest.mark.parametrize("block", [300, 24 << 20])
def test_backoff_scores(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    texts = [None, "", "one", "One  two", "é É a\x1cb", *[prose(60, i, 6) for i in range(40)], prose(60, 3, 6), "one two three one two three"]
    ids = [None, *range(1, len(texts))]
    got = {r.doc_id: r for r in lm_score.op10_backoff_score(spark, write(spark, tmp_path, frame(spark, texts, ids=ids))).collect()}
    assert len(got) == len(texts)
    for i, (n, logs) in zip(ids, backoff(texts), strict=True):
        assert got[i].n_words == n and got[i].log_score == pytest.approx(logs, abs=1e-3)
        assert got[i].mean_log_score == (None if n == 0 else pytest.approx(logs / n, abs=1e-6))


def test_no_documents(spark, tmp_path):
    assert lm_score.op10_backoff_score(spark, write(spark, tmp_path, frame(spark, []))).count() == 0


def test_any_frame_is_scored_and_rows_give_the_same(spark):
    texts = [None, "", "one", "One  two", *[prose(60, i, 6) for i in range(30)], prose(60, 3, 6), "one two three one two three"]
    docs = frame(spark, texts, ids=[None, *range(1, len(texts))]).repartition(3).withColumn("words", F.lit(1))
    for least in (1, 2):
        want = {i: (n, logs) for i, (n, logs) in enumerate(backoff(texts, least))}
        for score in (lm_score.score_corpus, lm_score.score_rows):
            got = score(docs, least).collect()
            assert len(got) == len(texts) and {r.doc_id or 0: (r.n_words, pytest.approx(r.log_score, abs=1e-6)) for r in got} == want
    assert lm_score.score_rows(frame(spark, [])).count() == 0


def test_blocks_are_cut_by_bytes_alike_in_every_pass(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 50)
    rows = [("f", i, b"x" * (i * 7 % 40)) for i in range(5, 40)] + [("f", i, b"y" * 200) for i in range(60, 63)] + [("g", 0, b"")]
    seen = []
    for size in (1, 4, 7, 100):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p, strict=True)], ["file", "row", "text"]) for p in parts]
        blocks, own = [], []
        for file, lo, some, ends in lm_score.blocks_of(iter(batches)):
            own += some.column("row").to_pylist()
            if ends:
                blocks.append((file, lo, tuple(own)))
                own = []
        assert not own
        seen.append(blocks)
    assert all(s == seen[0] for s in seen) and [r for _, _, own in seen[0] for r in own] == [r for _, r, _ in rows]
    assert all(lo == own[0] for _, lo, own in seen[0]) and len(seen[0]) > 10


def test_a_very_long_document_is_scored_whole(spark, tmp_path):
    texts = [prose(200_000, 1), prose(200, 2), prose(200_000, 1)]
    got = {r.doc_id: r for r in lm_score.op10_backoff_score(spark, write(spark, tmp_path, frame(spark, texts))).collect()}
    for i, (n, logs) in enumerate(backoff(texts)):
        assert got[i].n_words == n and got[i].log_score == pytest.approx(logs, abs=1e-2)


def test_packed_keys_and_counts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2))
        assert (lm_score.unpack_sorted(lm_score.pack_sorted(keys, 0), 0) == keys).all()
    for counts in ([1], [1, 2**31, 5], [2**40, 1]):
        assert lm_score.unpack_counts(lm_score.pack_counts(np.array(counts))).tolist() == counts
