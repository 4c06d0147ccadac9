"""Chat formatting with a prefix tree over conversations.

Every turn becomes a segment: its role's marks around its text. Control strings inside
texts and role names are escaped, so a mark in the output is always one of the
template's, and the escape can be undone:

    each backslash is doubled, then each control string gets a backslash after its first
    character; a backslash before any other character means that character.

Conversations that share initial turns (roles and texts, in order) share those segments.
The tree's nodes are the distinct beginnings of conversations. Each tree (all that begin
with the same turn) is emitted depth-first, every shared segment once, as one packed
sequence. A row of the output is a segment: its place in the sequence (``idx`` in
segments, ``start`` in tokens), the position id of its first token (``position``, later
tokens follow by one), its tokens with the token interval under the loss mask
(an assistant's text without its marks), and the intervals of the sequence that it
attends to besides its own earlier tokens. Those are exactly its ancestors.

A node's heaviest child (that most conversations pass; of equal ones the larger key)
comes first, so it stands right after its parent and a path is cut only where it leaves
a heaviest child. That halves the conversations, so a segment has at most
log2(conversations) + 1 intervals however long its conversation is.

No tree, conversation or level is gathered in one task. A beginning is known by 128 bits
or more, sums over its turns of hashes of place, role and text, so nodes are found by
running totals over sampled ranges (``operators.ordering``); no round per level is
needed. The depth-first order is a sort by tree, places where the path leaves a heaviest
child (deepest first), and depth. Beginnings that a third of all conversations share are
summed before the shuffle or met in joins that Spark can split.

Reading back is different: a digest of a conversation needs its text in one task, as one
record. It is made once per distinct conversation.

Nulls: a null text is empty, a null role is the empty role, rows with a null conv_id are
one conversation. Turns are ordered by ``turn`` (null first); equal turns of a
conversation, repeated rows included, all stay, ordered by their hash. Empty texts give
a segment of marks. An empty table gives empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import lay_out, numbered, running_totals
from ..sources.storage import written_once
from .text import small_batches, with_bytes
from .token_counts import LONG_RUN, PIECES, VOCABULARY, read_ranks, stretches

# Marks of the template by role, and around the name of any other role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAMED = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROLS = [mark for pair in MARKS.values() for mark in pair] + list(NAMED)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
LEARNED = "assistant"
_HASHES = ("h0", "h1", "h2", "h3")
_SUMS = ("s0", "s1", "s2", "s3")
TURNS = (
    "conv_id bigint, turn bigint, role string, tokens array<int>, loss_from int, loss_to int, "
    "h0 bigint, h1 bigint, h2 bigint, h3 bigint"
)
READ = (
    "tree string, idx bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda mark: mark[0][0] + "\\" + mark[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segment(role: str, text: str) -> tuple[list[str], str, str]:
    """What stands before the text (marks and escaped pieces in turn), the escaped text,
    and the mark after it."""
    if role in MARKS:
        return [MARKS[role][0]], escape(text), MARKS[role][1]
    return [NAMED[0], escape(role), NAMED[1]], escape(text), NAMED[2]


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation. A text holds no control string, so
    it ends where its closing mark first occurs."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (opening, closing) in MARKS.items():
            if formatted.startswith(opening, at):
                start = at + len(opening)
                break
        else:
            if not formatted.startswith(NAMED[0], at):
                raise ValueError(f"no mark at {at}")
            middle = formatted.index(NAMED[1], at)
            role, start = unescape(formatted[at + len(NAMED[0]) : middle]), middle + len(NAMED[1])
            closing = NAMED[2]
        end = formatted.index(closing, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(closing)
    return turns


class Coder:
    """Tokens of segments: a byte-pair vocabulary, and one token of its own per mark."""

    def __init__(self, ranks: dict[bytes, int], pieces: str = PIECES):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.marks = {mark: first + i for i, mark in enumerate(CONTROLS)}
        words = [b""] * (first + len(CONTROLS))
        for piece, rank in ranks.items():
            words[rank] = piece
        for mark, token in self.marks.items():
            words[token] = mark.encode()
        # all tokens' bytes in a row, with each one's place and size
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.sizes = np.array([len(word) for word in words], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes

    def plain(self, text: str) -> list[np.ndarray]:
        parts = stretches(text) if len(text) >= LONG_RUN else [text]
        return [self.encoding.encode_to_numpy(part, disallowed_special=()).astype(np.int32) for part in parts]

    def encode(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Tokens of a turn's segment, and where those of its text begin and end."""
        before, body, after = segment(role, text)
        parts = []
        for i, piece in enumerate(before):
            parts += self.plain(piece) if i % 2 else [np.array([self.marks[piece]], np.int32)]
        start = sum(map(len, parts))
        parts += self.plain(body)
        end = sum(map(len, parts))
        return np.concatenate([*parts, np.array([self.marks[after]], np.int32)]), start, end

    def decode(self, tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the tokens, and where each of them ends."""
        tokens = np.asarray(tokens, np.int64)
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.places[tokens] - (ends - sizes), sizes) + np.arange(total)
        return self.bytes[at].tobytes(), ends


def _hash_parts(role: str, text: str) -> tuple[int, ...]:
    data = f"{len(role)}:{role}{text}".encode()
    return tuple(np.frombuffer(hashlib.sha256(data).digest()[:16], "<u4").tolist())


def _encode_batches(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        roles = batch.column("role").to_pylist()
        texts = [text.decode() for text in batch.column("_utf8").to_pylist()]
        coded = [coder.encode(role, text) for role, text in zip(roles, texts, strict=True)]
        offsets = np.cumsum([0, *[len(tokens) for tokens, _, _ in coded]]).astype(np.int32)
        hashes = np.array([_hash_parts(r, t) for r, t in zip(roles, texts, strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                batch.column("role"),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([c[0] for c in coded]))),
                *[pa.array([c[k] for c in coded], pa.int32()) for k in (1, 2)],
                *[pa.array(hashes[:, k]) for k in range(len(_HASHES))],
            ],
            names=["conv_id", "turn", "role", "tokens", "loss_from", "loss_to", *_HASHES],
        )


def encoded_turns(conversations: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """A row per turn with its tokens, the text's span in them and hashes of role and text."""
    ranks = conversations.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode_batches(batches, Coder(ranks.value, pieces))

    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        "text",
    )
    return with_bytes(rows, "conv_id", "turn", "role").mapInArrow(task, TURNS)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth, *sums))


def beginnings(turns: DataFrame) -> DataFrame:
    """``conv_id, row, depth, n_tokens, position, node, parent`` per turn: the keys of the
    beginnings of its conversation with and without it, and the tokens before it."""
    light = turns.select("conv_id", "turn", *_HASHES, "row", F.size("tokens").cast("bigint").alias("n_tokens"))
    laid = lay_out(light, ["conv_id", "turn", *_HASHES, "row"], "turn-order")
    placed = numbered(laid, "number", ["conv_id"]).withColumn("depth", F.col("number") - 1)
    low = F.lit((1 << 32) - 1)
    first = F.xxhash64("depth", *_HASHES)
    second = F.xxhash64(F.lit(1), "depth", *_HASHES)
    parts = [first.bitwiseAND(low), F.shiftrightunsigned(first, 32)]
    parts += [second.bitwiseAND(low), F.shiftrightunsigned(second, 32)]
    mixed = placed.withColumns({f"m{i}": part for i, part in enumerate(parts)})
    sums = {s: f"m{i}" for i, s in enumerate(_SUMS)}
    rows = running_totals(mixed, ["conv_id"], {"position": "n_tokens", **sums})
    depth = F.col("depth")
    through = [F.col(s) + F.col(m) for s, m in sums.items()]
    parent = F.when(depth > 0, _key(depth - 1, [F.col(s) for s in _SUMS]))
    return written_once(
        rows.select(
            "conv_id", "row", "depth", "n_tokens", "position",
            _key(depth, through).alias("node"), parent.alias("parent"),
        ),
        "beginnings",
    )


class Packed(NamedTuple):
    """``segments``: the packed sequences, a row per segment. ``members``: ``conv_id,
    n_turns, tree, idx``, the last segment of each conversation."""

    segments: DataFrame
    members: DataFrame


def _nodes(rows: DataFrame) -> DataFrame:
    """Distinct beginnings with the conversations that pass them and one of their rows."""
    return written_once(
        rows.groupBy("node").agg(
            *[F.min(c).alias(c) for c in ("parent", "depth", "n_tokens", "position")],
            F.count("*").alias("conversations"),
            F.min(F.struct("row", "conv_id")).alias("at"),
        ),
        "nodes",
    )


def _ordered(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes in depth-first order with ``tree, idx, start`` and ``tops``: the nodes on
    the path that are no heaviest child, from the root (at most log2(conversations) + 1)."""
    heaviest = (
        nodes.filter("parent is not null")
        .groupBy("parent")
        .agg(F.max(F.struct("conversations", "node"))["node"].alias("node"))
    )
    top = written_once(nodes.join(heaviest, "node", "left_anti").select("node"), "tops")
    paths = (
        rows.select("conv_id", "depth", "node", "position")
        .join(top, "node", "left_semi")
        .groupBy(F.col("conv_id").alias("_conv"))
        .agg(F.sort_array(F.collect_list(F.struct("depth", "node", "position"))).alias("_tops"))
    )
    found = nodes.join(paths, F.col("at.conv_id").eqNullSafe(F.col("_conv")))
    tops = F.filter("_tops", lambda t: t["depth"] <= F.col("depth"))
    found = found.withColumn("tops", tops).select(
        F.col("tops")[0]["node"].alias("tree"),
        F.transform(F.expr("slice(tops, 2, size(tops))"), lambda t: F.struct(-t["depth"], t["node"])).alias("turns_off"),
        "depth", "node", "n_tokens", "position", "conversations", F.col("at.row").alias("row"), "tops",
    )
    laid = lay_out(written_once(found, "paths"), ["tree", "turns_off", "depth"], "depth-first")
    placed = running_totals(numbered(laid, "number", ["tree"]), ["tree"], {"start": "n_tokens"})
    return written_once(
        placed.withColumn("idx", F.col("number") - 1).drop("number", "turns_off"), "placed"
    )


def _interval(idx_from: Column, idx_to: Column, start: Column, end: Column) -> Column:
    return F.struct(
        idx_from.alias("first_segment"), idx_to.alias("end_segment"),
        start.alias("start"), end.alias("end"),
    )


def _with_ancestors(placed: DataFrame) -> DataFrame:
    """``attends``: the intervals of the sequence that hold a segment's ancestors. Along
    a path of heaviest children segments stand one after the other, so each top and the
    next one up the path bound one interval."""
    last = F.expr("element_at(tops, -1)")
    branches = placed.filter((F.col("node") == last["node"]) & (F.size("tops") > 1))
    steps = F.expr(
        "transform(sequence(1, size(tops) - 1), i -> struct(i as i, element_at(tops, i).node as top,"
        " element_at(tops, i + 1).depth - element_at(tops, i).depth as segments,"
        " element_at(tops, i + 1).position - element_at(tops, i).position as tokens))"
    )
    wanted = branches.select(F.col("node").alias("branch"), F.explode(steps).alias("s")).select("branch", "s.*")
    tops = placed.filter(F.col("node") == last["node"]).select(F.col("node").alias("top"), "idx", "start")
    idx, start = F.col("idx"), F.col("start")
    interval = _interval(idx, idx + F.col("segments"), start, start + F.col("tokens"))
    before = wanted.join(tops, "top").select("branch", F.struct("i", interval.alias("at")).alias("step"))
    before = before.groupBy("branch").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    before = written_once(before.select("branch", F.transform("steps", lambda s: s["at"]).alias("_above")), "branches")
    above = placed.withColumn("branch", last["node"]).join(before, "branch", "left")
    segments, tokens = F.col("depth") - last["depth"], F.col("position") - last["position"]
    own = F.when(segments > 0, F.array(_interval(idx - segments, idx, start - tokens, start)))
    none = F.array().cast("array<struct<first_segment: bigint, end_segment: bigint, start: bigint, end: bigint>>")
    attends = F.concat(F.coalesce("_above", none), F.coalesce(own, none))
    return above.withColumn("attends", attends).drop("branch", "_above", "tops")


def pack(conversations: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> Packed:
    """All conversations as packed sequences, written to the shared folder."""
    turns = encoded_turns(conversations, vocabulary, pieces)
    turns = written_once(turns.withColumn("row", F.monotonically_increasing_id()), "turns")
    rows = beginnings(turns)
    placed = _ordered(rows, _nodes(rows))
    content = turns.select("row", "role", "tokens", "loss_from", "loss_to")
    segments = _with_ancestors(placed).join(content, "row").select(
        "tree", "idx", "start", "n_tokens", "position", "depth", "conversations", "role",
        "tokens", "loss_from", "loss_to", "attends", "node",
    )
    segments = written_once(segments, "segments")
    ends = rows.groupBy("conv_id").agg(
        F.max_by("node", "depth").alias("node"), F.count("*").alias("n_turns")
    )
    ends = written_once(ends, "ends")
    members = ends.join(segments.select("node", "tree", "idx"), "node").drop("node")
    return Packed(segments.drop("node"), members)


def _read_batches(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("parts")
        parts, of_row = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
        columns = {c: pc.struct_field(parts, c) for c in ("role", "tokens", "loss_from", "loss_to")}
        tokens = columns["tokens"].flatten().to_numpy()
        of_part = np.cumsum([0, *columns["tokens"].value_lengths().to_pylist()])
        roles, begin, end = (columns[c].to_pylist() for c in ("role", "loss_from", "loss_to"))
        found = []
        for row in range(batch.num_rows):
            own = range(of_row[row], of_row[row + 1])
            base = of_part[own.start]
            data, ends = coder.decode(tokens[base : of_part[own.stop]])
            cuts = np.concatenate(([0], ends))
            learned = "".join(
                unescape(data[cuts[of_part[k] - base + begin[k]] : cuts[of_part[k] - base + end[k]]].decode())
                for k in own
                if roles[k] == LEARNED
            )
            formatted = data.decode()
            turns = parse(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            digests = [hashlib.sha256(text.encode()).hexdigest() for text in (said, learned)]
            found.append((len(turns), digests[0], len(learned), digests[1], len(formatted)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        names = [field.split()[0] for field in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("idx"), *columns], names=names)


def read_back(packed: Packed, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """Each conversation as it stands in the packed sequences: the segments that its last
    one attends to, and that one, decoded, split at the marks and unescaped."""
    segments = packed.segments
    ranks = segments.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_batches(batches, Coder(ranks.value, pieces))

    ends = packed.members.select("tree", F.col("idx").alias("end")).distinct()
    light = segments.select("tree", F.col("idx").alias("end"), "attends")
    above = F.flatten(
        F.transform("attends", lambda a: F.sequence(a["first_segment"], a["end_segment"] - 1))
    )
    wanted = ends.join(light, ["tree", "end"]).select(
        "tree", "end", F.explode(F.concat(above, F.array("end"))).alias("idx")
    )
    part = F.struct("depth", "role", "tokens", "loss_from", "loss_to")
    whole = (
        wanted.join(segments, ["tree", "idx"])
        .groupBy("tree", "end")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .select("tree", F.col("end").alias("idx"), "parts")
    )
    found = whole.mapInArrow(task, READ)
    return packed.members.select("conv_id", "tree", "idx").join(found, ["tree", "idx"]).drop("tree", "idx")
