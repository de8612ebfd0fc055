import hashlib
import re

import corpus_pipeline
from stratascan.llm import common, near_dedup, quality
from tests.llm.data import DOC, prose, rows, write
from tests.llm.test_dedup_mix import water_fill
from tests.llm.test_models import labelled, plain_features
from tests.llm.test_near import brute_force, edited


def plain_mix(rows):
    """(doc_id, text) of the mix, repeats as often as they come: each source's documents by a digest of their ids, round after round up to its target."""
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows}
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words[r.doc_id])
    out = []
    for source, target in water_fill(sizes).items():
        own = sorted((r for r in rows if r.source == source and words[r.doc_id]), key=lambda r: hashlib.md5(f"{r.doc_id}:11".encode()).hexdigest())
        left = round(target)
        while left > 0:
            for r in own:
                n = min(left, len(words[r.doc_id]))
                if n:
                    text = r.text if n == len(words[r.doc_id]) else re.match(r"[\x20\x09-\x0D]*" + r"[\x20\x09-\x0D]+".join([r"[^\x20\x09-\x0D]+"] * n), r.text).group()
                    out.append((r.doc_id, text))
                left -= n
    return out


def corpus(spark, tmp_path):
    texts, labels = labelled(240, 5)
    good = [i for i, q, t in labels if q and not t]
    texts += [texts[i] for i in good[:20]] + [edited(texts[i], 1, i) for i in good[20:40] if len(texts[i].split()) > 150]
    texts += [None, "", prose(80, 99)]
    sources = [("big" if i % 3 else f"s{i % 5}") for i in range(len(texts))]
    docs = spark.createDataFrame(rows(texts, sources), DOC)
    write(spark, tmp_path, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "labels")
    return write(spark, tmp_path, docs), labels


def test_stages_equal_brute_force(spark, tmp_path):
    sf_dir, labels = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        path = str(tmp_path / "stages" / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs.collect())
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns

    before, after = seen["quality_classifier"]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = [r.doc_id for r in before if sum(float(model.weights[f]) for f in plain_features(r.text)) >= model.thresholds[1]]
    assert sorted(r.doc_id for r in after) == sorted(good) and 0 < len(good) < len(before)
    wanted = {i: q and not t for i, q, t in labels}
    assert sum(wanted[r.doc_id] == (r.doc_id in set(good)) for r in before if r.doc_id in wanted) >= 0.95 * len(wanted)

    before, after = seen["exact_dedup"]
    first = {}
    for r in before:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values()) and len(after) < len(before)

    before, after = seen["near_dedup"]
    want = brute_force([r.doc_id for r in before], [r.text for r in before], near_dedup.STAGE.threshold)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in want.items() if i == c) and len(after) < len(before)

    before, after = seen["source_mix"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted(plain_mix(before))
    assert all(list(r.asDict()) == columns for _, rs in seen.items() if _ != "packing" for r in rs[1][:1])

    before, after = seen["packing"]
    tokens = {}
    for p in after:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert set(tokens) == {r.doc_id for r in before} and max(p.offset + p.length for p in after) <= 2048


def test_run_gives_pieces(spark, tmp_path):
    other = common.materialize(spark.range(3), "of-another")
    out = corpus_pipeline.run(spark, corpus(spark, tmp_path)[0])
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert other.count() == 3  # tables of others stay


def test_odd_documents_go_through(spark, tmp_path):
    """Nulls in every column, repeats, texts of a megabyte and columns with names that are used inside; then no documents at all."""
    long = prose(160_000, 3)
    texts = [None, "", " ", long, long + " end", "one", *[prose(60, i) for i in range(30)], prose(60, 1)]
    odd = rows(texts, ["a", None, "b", "a", None, "b", *["a", "b", None] * 10, "a"], [None, 1, 2, 3, 4, 5, *range(6, 36), 7])
    write(spark, tmp_path, spark.createDataFrame([], "doc_id long, quality int, toxic int"), "labels")
    sf_dir = write(spark, tmp_path, spark.createDataFrame(odd, DOC))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    placed = {}
    for p in out:
        placed.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert out and all(sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) for own in placed.values())
    assert {r.doc_id for r in out} <= set(range(1, 36)) and len({3, 4} & {r.doc_id for r in out}) == 1
    none = write(spark, tmp_path / "none", spark.createDataFrame([], DOC))
    write(spark, tmp_path / "none", spark.createDataFrame([], "doc_id long, quality int, toxic int"), "labels")
    assert corpus_pipeline.run(spark, none).count() == 0
