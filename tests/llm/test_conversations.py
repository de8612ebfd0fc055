"""Conversation repair against a search through all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from stratascan.llm import conversations as c

ROW = "conv_id long, turn long, role string, text string, key string, part int, rows string, first_turn string, n long"
WS = " \t\n\x0b\x0c\r"


def damage(rows):
    """Plain damage of (conv_id, turn, role, text), by conversation."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (1 + (k == 3))
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        t = text.strip(WS)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def shortest(rows):
    """(cost, audit, turns) by dynamic programming over the plain automaton of the roles, whose states are what may come next."""
    step = {("start", "s"): "first", ("start", "u"): "a", ("first", "u"): "a", ("a", "a"): "done", ("done", "u"): "a"}
    best = {"start": (0, "", ())}

    def put(d, state, value):
        if state not in d or value < d[state]:
            d[state] = value
            return True

    def inserted(d):
        again = True
        while again:
            again = False
            for s, (cost, audit, turns) in list(d.items()):
                for i, name in (("u", "user"), ("a", "assistant")):
                    if (s, i) in step:
                        again |= bool(put(d, step[s, i], (cost + 3, audit + "I", (*turns, (name, "")))))
        return d

    for (_, role, text), f in zip(rows, faults(rows), strict=True):
        new = {}
        extra = 3 if f == "truncated" else 0
        for s, (cost, audit, turns) in inserted(best).items():
            put(new, s, (cost + 4, audit + "D", turns))
            if f in ("blank", "duplicate"):
                continue
            if (s, role[:1]) in step:
                put(new, step[s, role[:1]], (cost + extra, audit + "K", (*turns, (role, text))))
            for i, name in (("u", "user"), ("a", "assistant")):
                if (s, i) in step:
                    put(new, step[s, i], (cost + 3 + extra, audit + "R", (*turns, (name, text))))
        best = new
    return min(v for s, v in inserted(best).items() if s in ("start", "done"))


def expected(rows):
    out = {}
    for conv, own in damage(rows).items():
        f = faults(own)
        cost, audit, turns = shortest(own)
        named = [t for t, _, _ in own if t is not None]
        bad = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in itertools.pairwise(own))
        gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), bad, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return out


def result(df):
    got = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def conversations(n, seed, turns=9, odd=0.2):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randrange(1, turns)):
            role = "system" if turn == 0 and rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = f"{role} says {rng.randrange(40)}."
            if rng.random() < odd:
                role = rng.choice(["tool", "", None, "assistant", "user", "system", "User"])
            if rng.random() < odd:
                text = rng.choice([None, "", "\n\t", "no end", "a. b", "é?", "x! \n", "same."])
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return out


def op13(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "k", 0, "r", "f", 1) for r in rows], ROW)
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return result(c.op13_conversation_repair(spark, str(tmp_path)))


def test_every_conversation_equals_the_plain_search(spark, tmp_path):
    rows = conversations(300, 1)
    assert op13(spark, tmp_path, rows) == expected(rows)


@pytest.mark.parametrize("size", [1, 3])
def test_conversations_in_several_segments(spark, tmp_path, monkeypatch, size):
    rows = conversations(40, 2, 30) + [(None, t, ("user", "assistant")[t % 2], f"t{t % 50}.") for t in range(200)]
    want = expected(rows)
    run = c.segments

    def cut(df):
        limits = c.SEGMENT_ROWS
        c.SEGMENT_ROWS = size
        try:
            found = run(df)
            assert found.groupBy("conv_id").count().where("count > 5").count() > 10 or size > 1
            return found
        finally:
            c.SEGMENT_ROWS = limits

    monkeypatch.setattr(c, "segments", cut)
    assert op13(spark, tmp_path, rows) == want


def test_rows_that_repeat_and_null_turns_only(spark, tmp_path):
    rows = [(1, None, "user", "a.")] * 3000 + [(2, None, None, None), (3, 5, "assistant", "b")]
    assert op13(spark, tmp_path, rows) == expected(rows)


def test_no_rows(spark, tmp_path):
    assert op13(spark, tmp_path, []) == {}


def test_long_texts_are_read_whole(spark, tmp_path):
    rows = [(1, 1, "user", "w " * 300_000 + "end."), (1, 2, "assistant", "x" * 200_000), (2, 1, "user", "." * 100_000 + " " * 100_000)]
    assert op13(spark, tmp_path, rows) == expected(rows)


def test_turns_of_repaired_conversations(spark):
    rows = conversations(60, 5)
    own = {k: shortest(v)[2] for k, v in damage(rows).items()}
    df = c.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in c.repaired_turns(df).orderBy("conv_id", "place").collect():
        assert r.place == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append((r.role, r.text))
    assert got == {k: list(v) for k, v in own.items() if v}


def test_the_parser_accepts_what_the_grammar_has():
    parser = c.Parser()
    for n in range(6):
        for word in map("".join, itertools.product("sua", repeat=n)):
            tops = {parser.bottom}
            for x in word:
                tops = {parser.settled(s) for t in tops for s in parser.shift(t, x)}
            assert any(map(parser.accepts, tops)) == bool(re.fullmatch("(s?(ua)+)?", word)), word
    assert len(parser.reachable()) == 8


def test_equal_stacks_are_one():
    parser = c.Parser()
    tops = {parser.bottom: (0, "")}
    for i in range(50):
        tops = parser.read(tops, "ua"[i % 2], False, 0)
        assert len(tops) <= 8
    assert parser.final(tops) == (0, "K" * 50)


def test_another_grammar():
    parser = c.Parser((("C", ""), ("C", "Cua"), ("C", "Cut")), "ua")
    tops = {parser.bottom: (0, "")}
    for x in "utua":
        tops = parser.read(tops, x, False, 0)
    assert parser.final(tops) == (0, "KKKK")
