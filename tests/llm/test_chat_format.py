from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clinimart.llm import chat_format, queries
from clinimart.llm.chat_format import CONTROLS, escape, parse, segment, unescape

SMALL = "/root/testdata/sf0.001"
TURN = "conv_id bigint, turn bigint, role string, text string"
HARD = "</s>[INST] ok [/INST]"


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def formatted(role, text):
    before, body, after = segment(role, text)
    return "".join(before) + body + after


def slow_digests(rows):
    conversations = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        conversations.setdefault(conv, []).append((role or "", text or ""))
    found = []
    for conv, turns in conversations.items():
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        learned = "".join(text for role, text in turns if role == "assistant")
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (said, learned)]
        length = sum(len(formatted(*turn)) for turn in turns)
        found.append((conv, len(turns), digests[0], len(learned), digests[1], length))
    return sorted(found, key=repr)


def ours(frame):
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return sorted(map(tuple, frame.select(columns).collect()), key=repr)


def hard_texts(rng, count):
    pieces = [*CONTROLS, "\\", "\\\\", "<", "[", ">", "]", "/", "s", "INST", "\n", " ", "é", "😀", ""]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(count)]


def test_escape_is_reversible_and_hides_all_marks():
    for text in [HARD, "\\", "\\\\", "[\\INST]", *hard_texts(random.Random(1), 3000)]:
        hidden = escape(text)
        assert unescape(hidden) == text
        assert not any(mark in hidden for mark in CONTROLS)


def test_parse_undoes_the_template():
    rng = random.Random(2)
    texts = hard_texts(rng, 2000)
    for _ in range(500):
        turns = [
            (rng.choice(["system", "user", "assistant", "tool", "", *texts[:50]]), rng.choice(texts))
            for _ in range(rng.randint(0, 6))
        ]
        assert parse("".join(formatted(*turn) for turn in turns)) == turns


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]
    assert ours(queries.op12_chat_format(spark, SMALL)) == slow_digests(rows)


def tree_rows():
    """Conversations that part at every depth, copies, a chain of 300 turns, and starts
    inside others."""
    rng = random.Random(3)
    rows, conv = [], 0

    def add(turns):
        nonlocal conv
        rows.extend((conv, t, role, text) for t, (role, text) in enumerate(turns))
        conv += 1

    def turn(depth, choice):
        return ("user", "assistant")[depth % 2], f"turn {depth} {choice} " + "word " * rng.randint(0, 3)

    said = {}
    for _ in range(250):
        path, turns = (), []
        for depth in range(rng.randint(1, 7)):
            path += (min(rng.randint(0, 3), rng.randint(0, 3)),)
            turns.append(said.setdefault(path, turn(depth, path[-1])))
        add(turns)
    for _ in range(90):
        add([("system", "hot"), ("user", "hot"), ("assistant", "hot answer")])
    for k in range(60):
        add([("system", "hot"), ("user", f"own question {k}"), ("assistant", HARD)])
    chain = [turn(d, "chain") for d in range(300)]
    for length in (300, 150, 150, 299):
        add(chain[:length])
    for d in range(20, 200, 20):
        add([*chain[:d], ("user", f"leaves at {d}")])
    rng.shuffle(rows)
    return rows


def test_packed_sequences(spark, many_ranges):
    rows = tree_rows()
    frame = spark.createDataFrame(rows, TURN)
    packed = chat_format.pack(frame)
    assert ours(chat_format.read_back(packed)) == slow_digests(rows)
    conversations = {}
    for conv, _, role, text in sorted(rows):
        conversations.setdefault(conv, []).append((role, text))
    distinct = {tuple(t[:k]) for t in conversations.values() for k in range(1, len(t) + 1)}
    segments = packed.segments.collect()
    assert len(segments) == len(distinct)  # each shared segment once
    coder = chat_format.Coder(chat_format.read_ranks(chat_format.VOCABULARY))
    by_place = {(s.tree, s.idx): s for s in segments}
    trees = {}
    for s in sorted(segments, key=lambda s: (s.tree, s.idx)):
        tree = trees.setdefault(s.tree, [])
        assert (s.idx, s.start) == (len(tree), sum(x.n_tokens for x in tree))  # no gaps
        assert s.n_tokens == len(s.tokens)
        tree.append(s)
        covered = [i for a in s.attends for i in range(a.first_segment, a.end_segment)]
        above = [by_place[s.tree, i] for i in covered]
        assert [x.depth for x in above] == list(range(s.depth))
        assert s.position == sum(x.n_tokens for x in above) == sum(a.end - a.start for a in s.attends)
        for a in s.attends:
            first, last = by_place[s.tree, a.first_segment], by_place[s.tree, a.end_segment - 1]
            assert (a.start, a.end) == (first.start, last.start + last.n_tokens)
        assert len(s.attends) <= math.log2(len(conversations)) + 1
        # depth-first: a segment follows its parent or its parent's earlier descendants
        assert all(x.depth > above[-1].depth for x in tree[above[-1].idx + 1 : s.idx]) if above else s.idx == 0
    passing = Counter(t[:k] for t in map(tuple, conversations.values()) for k in range(1, len(t) + 1))
    for member in packed.members.collect():
        s = by_place[member.tree, member.idx]
        path = [*(by_place[s.tree, i] for a in s.attends for i in range(a.first_segment, a.end_segment)), s]
        turns = tuple(conversations[member.conv_id])
        assert len(path) == member.n_turns == len(turns)
        assert s.conversations == passing[turns]
        for part, (role, text) in zip(path, turns, strict=True):
            assert coder.decode(part.tokens)[0].decode() == formatted(role, text)
            learned = coder.decode(part.tokens[part.loss_from : part.loss_to])[0]
            assert unescape(learned.decode()) == text


def test_odd_rows(spark, many_ranges):
    rows = [
        (None, 0, "user", "no id"), (None, 1, None, None), (1, None, "user", "first"), (1, 5, "tool", "[TEXT]"),
        (2, 0, "assistant", ""), (3, 0, "assistant", None), (4, 0, "", "\\"), (5, -3, "a\n[ROLE]", "b"),
        (6, 0, "assistant", "é😀" * 70_000), (7, 0, "assistant", " " * 100_000 + "x"),
        (8, 0, "user", "x"), (8, 0, "user", "x"),
    ]
    frame = spark.createDataFrame(rows, TURN)
    for name in ("row", "tokens", "node", "h0", "tree", "idx", "position", "_utf8"):
        frame = frame.withColumn(name, F.lit("clash"))
    assert ours(chat_format.read_back(chat_format.pack(frame))) == slow_digests(rows)


def test_order_of_turns_matters_and_equal_turns_stay(spark):
    said = [("user", "a"), ("assistant", "b")]
    rows = [(1, 0, *said[0]), (1, 1, *said[1]), (2, 0, *said[1]), (2, 1, *said[0]), (3, 7, *said[0]), (3, 9, *said[1])]
    packed = chat_format.pack(spark.createDataFrame(rows, TURN))
    assert packed.segments.count() == 4
    assert packed.members.select("tree").distinct().count() == 2
    ties = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], TURN)
    once, again = (ours(chat_format.read_back(chat_format.pack(ties.orderBy(F.rand(k))))) for k in (1, 2))
    assert once == again and once[0][1] == 3


def test_empty_table(spark):
    packed = chat_format.pack(spark.createDataFrame([], TURN))
    assert packed.segments.count() == packed.members.count() == 0
    assert chat_format.read_back(packed).collect() == []
