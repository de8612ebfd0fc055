import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratascan.llm import packing, token_files
from stratascan.llm.tokenize import PieceEncoder
from tests.llm.data import frame, prose, write

TEXTS = [
    None, "", " ", "\n", "a", "don't  stop\n\nnow", " leading", "trailing ", "tab\tand\r\nline", "<|endoftext|> here <|startoftext|>", "\x00a \x00a", "Ünï côdé é 日本語 🎉",
    "no break  wide", "x\x85y\x1cz", prose(3000, 1), prose(700, 2), prose(700, 2), "word\n" * 50, "a" * 5000, "é " * 300,
]


def reference(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_the_whole_text(name, byte_level):
    whole, encoder = reference(name), PieceEncoder(public_tokenizers.path(name), byte_level, most=20_000)
    for _ in range(2):
        for text, ids in zip(TEXTS, encoder.encode([t or "" for t in TEXTS]), strict=True):
            assert ids.tolist() == whole(text), repr(text)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.sampled_from("ab'sT12.,!? \n\t\r\x0b\x1c\x85 ́​\x00éßΣ日<|>_"), max_size=25), max_size=4))
    def fuzz(texts):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == whole(text), repr(text)

    fuzz()


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("odd", ["", "\xa0"])
def test_what_is_remembered_stays_small(name, byte_level, odd):
    """Distinct texts with blank lines, and distinct pieces without an end."""
    whole, encoder = reference(name), PieceEncoder(public_tokenizers.path(name), byte_level, most=1 << 20)
    most = 0
    for n in range(60):
        text = f"{odd}text {n}\n\n" + prose(400, n, 10**6).replace(" ", "  ", 50) + "\n\n" + "ab" * 5000 + str(n)
        (ids,) = encoder.encode([text])
        assert ids.tolist() == whole(text)
        keys = sum(map(len, encoder.index))
        most = max(most, keys + encoder.pool.nbytes)
        assert encoder.held >= keys + 4 * encoder.used and encoder.held <= (1 << 20) + 400_000
    assert most < 1_500_000
    if odd and byte_level:
        assert len(encoder.index) == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, tmp_path):
    sf_dir = write(spark, tmp_path, frame(spark, TEXTS, ids=[None, *range(40, 40 - len(TEXTS) + 1, -1)]))
    got = [tuple(r) for r in token_files.op4_token_files(spark, sf_dir).collect()]
    whole = reference("byte_bpe_50k.json")
    docs = sorted(zip([None, *range(40, 40 - len(TEXTS) + 1, -1)], TEXTS, strict=True), key=lambda d: (d[0] is None, d[0]))
    want, start = [], 0
    for doc_id, text in docs:
        ids = [*whole(text), 0]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda r: (r[0] is None, r[0])
    assert sorted(got, key=key) == want


def test_readers_take_single_documents_and_notice_damage(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(frame(spark, TEXTS), path, public_tokenizers.path("byte_bpe_50k.json"))
    got = token_files.read_tokens(spark, path, wanted=[5, 9]).collect()
    whole = reference("byte_bpe_50k.json")
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: [*whole(TEXTS[i]), 0] for i in (5, 9)}

    assert token_files.read_tokens(spark, path, wanted=[]).count() == 0 and token_files.read_tokens(spark, path, wanted=[10**6]).count() == 0
    index = token_files.index_tokens(spark, path)
    (only,) = (r.path for r in index.where("first_id <= 5 AND last_id >= 5").collect())
    for r in index.where("NOT (first_id <= 5 AND last_id >= 5)").collect():  # files without the document are not looked at
        os.truncate(r.path.removeprefix("file:"), 3)
    assert only and token_files.read_tokens(spark, path, wanted=[5], index=index).count() == 1

    data = bytes(spark.read.format("binaryFile").load(only).first().content)
    f = token_files.TokenFile(data)
    frames = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)  # any decoder reads the whole
    assert len(frames.read()) == int(f.entries[:, 1].sum())
    at = int(f.at[3]) - 2
    broken = token_files.TokenFile(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.ids(1)


def test_packing_holds_every_token_once(spark, tmp_path):
    sf_dir = write(spark, tmp_path, frame(spark, TEXTS, ids=[None, *range(1, len(TEXTS))]))
    whole, by_doc, by_sequence = reference("word_bpe_49k.json"), defaultdict(list), defaultdict(list)
    for r in packing.op1_pack_sequences(spark, sf_dir).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {None, *range(1, len(TEXTS))}
    for doc_id, pieces in by_doc.items():
        ids, at = [*whole(TEXTS[doc_id or 0]), 1], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, free in enumerate(bins):
            if free >= n:
                bins[i] -= n
                break
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_tournament_places_like_a_plain_scan():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 100, rng.integers(1, 60)).tolist()
        tree = packing.Tournament(len(lengths), 100)
        used = defaultdict(int)
        for n in sorted(lengths, reverse=True):
            leaf, offset = tree.place(n)
            assert offset == used[leaf]
            used[leaf] += n
        assert sorted(100 - v for v in used.values()) == first_fit_decreasing(lengths, 100)


def test_little_padding_in_a_group():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 3000, 3000).tolist()
    filled = defaultdict(int)
    for _, _, n, sequence, _ in packing.pack(lengths):
        filled[sequence] += n
    padding = sum(2048 - n for n in filled.values() if n & (n - 1))
    assert sum(filled.values()) == sum(lengths) and padding < 0.01 * sum(lengths)


def test_no_documents(spark, tmp_path):
    sf_dir = write(spark, tmp_path, frame(spark, []))
    assert packing.op1_pack_sequences(spark, sf_dir).count() == 0
    assert token_files.op4_token_files(spark, sf_dir).count() == 0


def test_packing_does_not_depend_on_the_order_of_arrival(spark):
    docs = frame(spark, [prose(30 + 7 * i % 400, i) for i in range(200)] + ["same text"] * 5, ids=[*range(200), *[500] * 5])
    path = public_tokenizers.path("word_bpe_49k.json")
    first, second = (sorted(tuple(r) for r in packing.pack_documents(d, path, group_docs=40).collect()) for d in (docs.repartition(1), docs.repartition(7).orderBy(docs["text"])))
    assert first == second


def test_groups_are_cut_by_bytes_and_long_texts_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 100_000)
    texts = [prose(60_000, 1), *[prose(300, i) for i in range(40)]]
    got = packing.pack_documents(frame(spark, texts), public_tokenizers.path("word_bpe_49k.json")).collect()
    whole = reference("word_bpe_49k.json")
    for i in (0, 1, 40):
        own = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == i)
        assert b"".join(x for _, x in own) == np.array([*whole(texts[i]), 1], "<u4").tobytes()
    assert len({r.sequence_id >> 40 for r in got}) > 3
