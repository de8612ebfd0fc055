import random

import numpy as np
import pytest

import corpus_pipeline
from stratascan.llm import near_dedup
from stratascan.llm.common import WordHash
from tests.llm.data import frame, prose, write


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_force(ids, texts, threshold=85):
    """(n_shingles, component) of each document by comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                root[max(find(i), find(j), key=lambda r: ids[r])] = min(find(i), find(j), key=lambda r: ids[r])
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(texts))}


def edited(text, n, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"zz{seed}x{i}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    texts = [None, "", " \n", "one", "One", "one two", "a b c d", "A b\tc d", "a b c d e"]
    for base in range(12):
        text = prose(random.Random(base).randrange(30, 300), base)
        texts += [text, text.upper()] + [edited(text, n, 100 * base + n) for n in (0, 1, 2, 3, 4)]
    chain = prose(200, 77)
    for step in range(12):  # neighbours are linked, ends are not
        texts.append(chain)
        words = chain.split()
        words[step * 14 : step * 14 + 2] = [f"n{step}", f"m{step}"]
        chain = " ".join(words)
    shared = prose(60, 5)
    texts += [f"{shared} {prose(25, 900 + i)}" for i in range(25)]
    ids = random.Random(3).sample(range(10_000), len(texts))
    return ids, texts


def test_components_equal_all_pairs(spark, tmp_path, corpus):
    ids, texts = corpus
    got = near_dedup.op5_near_dedup(spark, write(spark, tmp_path, frame(spark, texts, ids=ids))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(ids, texts)
    assert len(got) == len(texts) and all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("chunk", [2, 500])
def test_rounds_after_the_first_find_what_it_misses(spark, monkeypatch, chunk):
    """With one band of one sample, buckets mix components; later rounds must still connect all that share a bucket, whatever chunks it is cut into."""
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "most_odd_bits", lambda: near_dedup.SKETCH_BITS)
    text = prose(400, 1)
    near = [edited(text, 3, i) for i in range(6)]
    other = [edited(prose(400, 2), 3, i) for i in range(6)]
    ids, texts = list(range(12)), [x for pair in zip(near, other, strict=True) for x in pair]

    class OneBand(near_dedup.Sketcher):
        def bands(self, samples):
            return np.zeros(1, np.int64)

    monkeypatch.setattr(near_dedup, "Sketcher", OneBand)
    got = {r.doc_id: r.component_id for r in near_dedup.components(frame(spark, texts, ids=ids)).collect()}
    assert got == {i: c for i, (_, c) in brute_force(ids, texts).items()}


def test_nulls_repeats_and_clashing_columns(spark):
    texts = [prose(50, 1)] * 4 + [prose(50, 2)] * 2
    docs = frame(spark, texts, ids=[None, 4, 4, 2, None, None])
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in near_dedup.components(docs).collect())
    assert got == [(False, 2, 2), (False, 4, 2), (False, 4, 2)] + [(True, None, None)] * 3
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None", "None", "None"]


def test_one_id_with_two_texts_joins_their_components(spark):
    a, b = prose(50, 1), prose(50, 2)
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.components(frame(spark, [a, b, a, b], ids=[9, 8, 5, 5])).collect())
    assert {c for i, c in got if i == 5} == {5} and dict(got)[9] == 5 and dict(got)[8] == 5


def test_every_set_of_an_id_is_compared(spark):
    """Ids with several texts, each near another document's and equal to none."""
    bases = [prose(300, 50 + i) for i in range(6)]
    for order in (1, -1):
        texts = [(1, bases[0]), (1, bases[1]), (1, bases[2]), (2, bases[3]), (2, bases[4])][::order] + [(10 + i, edited(b, 2, i)) for i, b in enumerate(bases)]
        got = {(r.doc_id, r.component_id) for r in near_dedup.components(frame(spark, [t for _, t in texts], ids=[i for i, _ in texts])).collect()}
        assert got == {(1, 1), (10, 1), (11, 1), (12, 1), (2, 2), (13, 2), (14, 2), (15, 15)}


def test_very_long_texts_are_compared_whole(spark):
    long = prose(150_000, 6, 100_000)
    far = " ".join(long.split()[:75_000] + prose(75_000, 7, 100_000).split())
    got = {r.doc_id: r.component_id for r in near_dedup.components(frame(spark, [long, long + " and an end", far], ids=[3, 2, 1])).collect()}
    assert got == {3: 2, 2: 2, 1: 1}


def test_no_documents(spark):
    assert near_dedup.components(frame(spark, [])).count() == 0
    assert near_dedup.components(frame(spark, [None, ""])).count() == 2


def test_odd_sketches_estimate_similarity():
    words, sketcher = WordHash(), near_dedup.Sketcher()
    text = prose(2000, 9)
    a = sketcher.odd(sketcher.samples(near_dedup.shingles(text.encode(), words)))
    for n, least, most in ((0, 1.0, 1.0), (20, 0.84, 0.97), (600, -2.0, 0.5)):
        other = edited(text, n, n)
        b = sketcher.odd(sketcher.samples(near_dedup.shingles(other.encode(), words)))
        z = sum(bin(int(x) & (2**64 - 1)).count("1") for x in a ^ b)
        bits = near_dedup.SKETCH_BITS
        estimate = 1 + bits / (4 * near_dedup.SAMPLES) * np.log(max(1 - 2 * z / bits, 1e-3))
        assert least <= estimate <= most
        assert (z <= near_dedup.most_odd_bits()) == (n < 600)


def test_the_stage_links_at_80_and_op5_at_85(spark):
    """Pairs from 0.80 to just under 0.85: one copy of each goes in the pipeline's stage, none in op5."""
    texts = []
    for base in range(40):
        text = prose(300, 3000 + base)
        words = text.split()
        for at in range(5, 5 + 14 * 5, 14):  # 5 words apart from each other: 25 to 33 of 296 runs change
            words[at] = f"yy{at}"
        words[200] = "yy200"
        texts += [text, " ".join(words)]
    pairs = [(shingle_set(a), shingle_set(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert all(80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b) for a, b in pairs)
    docs = frame(spark, texts)
    assert corpus_pipeline.dedup_near(spark, docs, "").count() == 40
    assert near_dedup.keep_one(docs).count() == 80


def test_bands_and_sketches_miss_hardly_any_pair_at_the_threshold():
    for links in (near_dedup.OP5, near_dedup.STAGE):
        assert (1 - (links.threshold / 100) ** links.rows) ** links.bands < 1e-6
    # differing bits at 0.80 lie within the stage's bound by far
    assert near_dedup.most_odd_bits(80, near_dedup.STAGE.bands * near_dedup.STAGE.rows) > near_dedup.most_odd_bits()
