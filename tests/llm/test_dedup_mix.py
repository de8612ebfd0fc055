import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascan.llm import exact_dedup, mixing
from tests.llm.data import frame, prose, write

TEXTS = ["a b", "a  b", "a\tb ", "a b ", None, "", " ", "x", "a b", "A b", "x", "x"]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(ids, texts):
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(norm(t), []).append(i)
    return {i: (min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in zip(ids, texts, strict=True)}


@pytest.mark.parametrize("copies", [1, 300])
def test_equal_texts_are_one(spark, tmp_path, copies, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SALT", 50)
    texts = TEXTS + ["same  text"] * copies
    ids = list(range(100, 100 + len(texts)))[::-1]
    got = exact_dedup.op2_exact_dedup(spark, write(spark, tmp_path, frame(spark, texts, ids=ids))).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(ids, texts)
    assert len(got) == len(ids) and all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_a_digest_shared_by_different_texts_is_split(spark, tmp_path):
    sf_dir = write(spark, tmp_path, frame(spark, TEXTS))
    weak = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)
    got = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet", digest=weak).collect()
    got2 = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet", digest=lambda c: F.lit("one")).collect()
    want = {i: v[:2] for i, v in brute(range(len(TEXTS)), TEXTS).items()}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got2} == want


def test_state_lasts_over_batches_and_restarts(spark, tmp_path):
    path, base = f"{tmp_path}/docs", f"{tmp_path}/state"
    frame(spark, ["u", "v"], ids=[5, 6]).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema

    def arrivals():
        return exact_dedup.located(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))

    exact_dedup.fold(arrivals(), f"{base}/checkpoint", f"{base}/updates")
    frame(spark, ["v", "w", "v"], ids=[9, 7, 2]).coalesce(1).write.mode("append").parquet(path)
    exact_dedup.fold(arrivals(), f"{base}/checkpoint", f"{base}/updates")
    got = {(r["first"].doc_id, r.n) for r in exact_dedup.current_state(spark, f"{base}/updates").collect()}
    assert got == {(5, 1), (2, 3), (7, 1)}
    many = exact_dedup.exact_dedup(spark, path, files_per_batch=1)
    assert {(r.doc_id, r.keep_id) for r in many.collect()} == {(5, 5), (6, 2), (9, 2), (7, 7), (2, 2)}


@pytest.mark.parametrize("told", [1, 3, 40_000])
def test_rows_are_picked_where_they_are_read(spark, tmp_path, monkeypatch, told):
    """Bitmaps of files with many rows, one batch or several; nothing but the chosen places is shuffled."""
    monkeypatch.setattr(exact_dedup, "TOLD_BITMAPS", told)
    spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).repartition(4).write.parquet(f"{tmp_path}/d")
    docs = exact_dedup.located(spark.read.parquet(f"{tmp_path}/d"), with_text=True)
    wanted = docs.where("doc_id % 7 = 0 AND doc_id > 20000").select("file", "row")
    for inside in (True, False):
        got = exact_dedup.pick(docs, wanted, inside)
        ids = {r.doc_id for r in got.collect()}
        assert {i for i in range(40_000) if (i % 7 == 0 and i > 20_000) == inside} == ids and got.columns == docs.columns
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert exact_dedup.pick(docs, wanted.where("false")).count() == 0 and exact_dedup.pick(docs, wanted.where("false"), False).count() == 40_000


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, ["t", "t", "t", "u", "u"], ids=[None, 3, 3, None, None])
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "t"), ("None", "u")]


def test_whole_long_texts_decide(spark, tmp_path, monkeypatch):
    """Texts that differ only at their far end are not equal; also when bitmaps are told file by file."""
    long = prose(200_000, 5)
    texts = [long + " x", long + " y", long + "  x", "short", None]
    sf_dir = write(spark, tmp_path, frame(spark, texts))
    for told in (1, 40_000):
        monkeypatch.setattr(exact_dedup, "TOLD_BITMAPS", told)
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.op2_exact_dedup(spark, sf_dir).collect()}
        assert got == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 1), 4: (4, 1)}


def test_mix_of_ties_nulls_and_long_texts(spark, tmp_path):
    """Null ids with equal and different texts, repeated ids, a text larger than many blocks: sizes add up and reruns agree."""
    long = prose(120_000, 8)
    texts, ids = [long, "a b c", "a b c", None, "", "d e", "d e", prose(50, 1)], [1, None, None, None, None, 7, 7, 8]
    docs = frame(spark, texts, ["x"] * 4 + ["y"] * 4, ids)
    sf_dir = write(spark, tmp_path, docs)
    got = sorted(map(str, mixing.op8_source_mix(spark, sf_dir).collect()))
    again = write(spark, tmp_path / "again", docs.repartition(7))
    assert got == sorted(map(str, mixing.op8_source_mix(spark, again).collect())) and len(got) == 8
    whole = {r.doc_id: r for r in mixing.op8_source_mix(spark, sf_dir).where("doc_id = 1").collect()}
    assert whole[1].size == 120_000 and whole[1].taken <= 3 * 120_000


def test_no_documents(spark, tmp_path):
    sf_dir = write(spark, tmp_path, frame(spark, []))
    assert exact_dedup.op2_exact_dedup(spark, sf_dir).count() == 0
    assert mixing.op8_source_mix(spark, sf_dir).count() == 0


def water_fill(sizes):
    """Targets by sharing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_targets(spark, tmp_path):
    rng = np.random.default_rng(2)
    names = ["big", "é", "z", "mid", None, "A", "tiny", "none"]
    shares = [0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0]
    sources = ["tiny", "none", *rng.choice(np.array(names, object), 400, p=shares).tolist()]
    texts = ["only five words in here", "", *[prose(int(rng.integers(1, 300)), i) for i in range(399)], None]
    sources = sources[: len(texts)]
    ids = [None, *range(1, len(texts))]
    sf_dir = write(spark, tmp_path, frame(spark, texts, sources, ids))
    got = mixing.op8_source_mix(spark, sf_dir).collect()
    again = mixing.op8_source_mix(spark, sf_dir).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(texts)
    sizes = {s: sum(len((t or "").split()) for t, q in zip(texts, sources, strict=True) if q == s) for s in set(sources)}
    want, taken = water_fill(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = sources[r.doc_id or 0]
        assert r.size == len((texts[r.doc_id or 0] or "").split()) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert taken == {s: round(want[s]) for s in sizes}


def test_splitting_tree_deals_every_block_once():
    rng = np.random.default_rng(3)
    for shards in (1, 2, 7, 16):
        blocks = rng.integers(0, 60, 9)
        seen = [[] for _ in blocks]
        totals = []
        for shard in range(shards):
            ((_, first, n),) = mixing.walk(np.array([blocks.sum()]), 0, blocks, shards, shard, shard + 1, 5)
            totals.append(int(n.sum()))
            for s, (a, b) in enumerate(zip(first, n, strict=True)):
                seen[s] += range(a, a + b)
        assert all(sorted(x) == list(range(b)) for x, b in zip(seen, blocks, strict=True))
        assert max(totals) - min(totals) <= 1


def test_groups_of_sources_and_runs_of_shards_make_no_gap(spark, monkeypatch):
    rng = np.random.default_rng(4)
    targets = rng.integers(0, 500, 23)
    sources = spark.createDataFrame([(i, float(t)) for i, t in enumerate(targets)], "source_no long, target double")
    monkeypatch.setattr(mixing, "GROUP", 5)
    monkeypatch.setattr(mixing, "WALK", 3)
    got = mixing.deal_blocks(sources, 11, 10, 7).collect()
    assert sorted((r.source_no, r.block) for r in got) == [(i, b) for i, t in enumerate(targets) for b in range(-(-int(t) // 10))]
    sizes = [sum(r.shard == s for r in got) for s in range(11)]
    assert max(sizes) - min(sizes) <= 1
    assert mixing.deal_blocks(sources.where("false"), 1, 10, 7).count() == 0


def test_draws_have_the_mean_and_spread_of_the_distribution():
    rng = np.random.default_rng(5)
    for good, bad, n in ((30, 70, 20), (3_000_000_000, 1_000_000_000, 1_000_000), (5, 4_000_000_000, 2_000_000_000)):
        total = good + bad
        drawn = np.array([mixing.draw_one(rng, good, bad, n) for _ in range(400)])
        mean, var = n * good / total, n * (good / total) * (bad / total) * (total - n) / (total - 1)
        assert abs(drawn.mean() - mean) < 5 * (var / 400) ** 0.5 and 0.7 < drawn.var() / var < 1.4
    assert mixing.draw_one(rng, 5, 5, 10) == 5 and mixing.draw_one(rng, 0, 9, 3) == 0
    many = mixing.draw(rng, np.array([10**9, 0, 3 * 10**9, 7]), 2 * 10**9)
    assert many.sum() == 2 * 10**9 and many[1] == 0 and 0 <= many[3] <= 7


def test_mixed_documents_repeat_drop_and_cut(spark):
    texts, sources = [prose(100, i) for i in range(40)], ["a"] * 30 + ["b"] * 5 + ["c"] * 5
    docs = frame(spark, texts, sources)
    out = mixing.mixed_documents(docs, block_words=64, shard_blocks=4)
    assert out.columns == docs.columns
    got = out.collect()
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "abc"}
    want = water_fill({"a": 3000, "b": 500, "c": 500})
    assert all(abs(words[s] - want[s]) <= 1 for s in words)
    assert all(texts[r.doc_id].startswith(r.text) for r in got)


def test_the_draws_decide_what_is_taken_and_where_it_goes(spark, tmp_path, monkeypatch):
    texts, sources = [prose(100, i) for i in range(40)], ["a"] * 30 + ["b"] * 5 + ["c"] * 5
    docs = frame(spark, texts, sources)
    options = {"block_words": 64, "shard_blocks": 4}
    pieces = [r for r in mixing.mix(docs, **options).collect() if r.words]
    blocks = {r.source_no: -(-round(r.target) // 64) for r in pieces}
    shards = -(-sum(blocks.values()) // 4)
    numbers = sorted(blocks)
    own = np.array([blocks[s] for s in numbers])
    drawn = {(s, b): shard for shard, first, n in mixing.walk(np.array([own.sum()]), 0, own, shards, 0, shards, mixing.SEED) for s, a, k in zip(numbers, first, n, strict=True) for b in range(a, a + k)}
    assert all(r.shard == drawn[r.source_no, r.block] for r in pieces)
    want = [r.doc_id for r in sorted(pieces, key=lambda r: (r.shard, r.place))]
    assert [r.doc_id for r in mixing.mixed_documents(docs, **options).collect()] == want

    deal = mixing.deal_blocks
    sf_dir = write(spark, tmp_path, docs)
    whole = sum(r.taken for r in mixing.op8_source_mix(spark, sf_dir).collect())
    monkeypatch.setattr(mixing, "deal_blocks", lambda *a: deal(*a).where("source_no <> 0"))
    assert {r.source for r in mixing.mixed_documents(docs, **options).collect()} == {"b", "c"}
    got = mixing.op8_source_mix(spark, sf_dir).collect()
    assert whole == 4000 and len(got) == 40 and all((r.taken == 0) == (r.doc_id < 30) for r in got if r.taken or r.doc_id < 30)


def test_the_cut_document_keeps_its_white_space(spark):
    texts = ["\n " + prose(90 + i, i).replace(" ", " \t\n", 50) + "\n" for i in range(40)]
    got = mixing.mixed_documents(frame(spark, texts, ["a"] * 30 + ["b"] * 5 + ["c"] * 5)).collect()
    cut = [r for r in got if r.text != texts[r.doc_id]]
    assert cut and all(texts[r.doc_id].startswith(r.text) and texts[r.doc_id][len(r.text)] in " \t\n" for r in cut)


def test_where_the_draws_put_documents(spark):
    """Against a plain walk down the tree; another seed deals other blocks, and as many words."""
    texts = [prose(20 + i % 50, i) for i in range(300)]
    docs = frame(spark, texts, ["abcd"[i % 4] for i in range(300)])
    options = {"block_words": 64, "shard_blocks": 4}
    by_seed = {}
    for seed in (11, 12):
        rows = mixing.dealt(docs, seed=seed, **options).collect()
        pieces = [(r.source, p.block, p.shard, p.place, p.words) for r in rows for p in r.shards]
        by_seed[seed] = {(r.doc_id, p.copy): p.shard for r in rows for p in r.shards}
        sources = mixing.targets(spark.createDataFrame([(s, sum(r["size"] for r in rows if r.source == s)) for s in "abcd"], "source string, source_size long"))
        blocks = {r.source: -(-round(r.target) // 64) for r in sources.orderBy("source").collect()}
        own = np.array([blocks[s] for s in "abcd"])
        shards = max(1, -(-int(own.sum()) // 4))
        want = {}
        for shard, first, n in mixing.walk(np.array([own.sum()]), 0, own, shards, 0, shards, seed):
            for s, a, k in zip("abcd", first, n, strict=True):
                want |= {(s, int(b)): shard for b in range(a, a + k)}
        assert len(want) == own.sum() and max(np.bincount(list(want.values()))) <= 4
        assert all(want[s, b] == shard for s, b, shard, _, _ in pieces)
        assert abs(sum(p[4] for p in pieces) - sum(r["size"] for r in rows)) <= 4
        assert len({(p[2], p[3]) for p in pieces}) == len(pieces)
    assert len(set(by_seed[11].values())) > 10 and by_seed[11] != by_seed[12]
