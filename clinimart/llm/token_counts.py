"""Token counts of text sections by offset-mapped attribution.

A document is encoded once, whole. Each token stands for a span of characters, from
the code point of its first byte to that of its last; a token that ends inside a
character covers that character too. Token spans are interval-joined to the sections'
spans, which are sorted and do not overlap, and each token is given to one section:

    the section that holds most of its characters; of equal ones the first;
    a token that meets no section counts for none.

A section's ``n_crossing`` are those of its tokens that also meet another section or
none. Sections of a text are its lines with their line ends, numbered from 0, so
their tokens add up to the document's.

The tokenizer is a byte-pair vocabulary of ranks, read by the driver from
``vocabulary`` (about a megabyte) and sent to the tasks; it is never trained. Tokens
of special meaning are ordinary text here.

Nulls: a null or empty text has one empty section without tokens. A null doc_id is
kept. Repeated rows each give their rows. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import code_points, small_batches, with_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# White space as the pieces' \\s has it, and the length from which a run is encoded by itself.
SPACE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 1 << 16
SECTIONS = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pieces: str = PIECES):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]

    def ends(self, text: bytes) -> np.ndarray:
        """Last+1 byte of each token of the text."""
        parts = stretches(text.decode()) if len(text) >= LONG_RUN else [text.decode()]
        ids = [self.encoding.encode_to_numpy(part, disallowed_special=()) for part in parts]
        return np.cumsum(self.sizes[np.concatenate(ids)])


def stretches(text: str) -> list[str]:
    """The text cut around its long runs of white space, where it has a piece's bound
    anyway: before a run, and before the run's last character if a word follows. The
    search for pieces keeps a step back for each character of such a run, and fails on
    a million of them."""
    cuts = [0]
    for run in SPACE_RUN.finditer(text):
        if run.end() - run.start() >= LONG_RUN and run.end() < len(text):
            cuts += [run.start(), run.end() - 1]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]


def token_spans(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each token, end exclusive."""
    data = np.frombuffer(text, np.uint8)
    if not (data >= 128).any():
        return np.concatenate(([0], ends[:-1])), ends
    before = code_points(data)
    begin = np.concatenate(([0], ends[:-1]))
    # a token that starts inside a character starts where the character does
    first = before[begin] - ((data[begin] & 0xC0) == 0x80)
    return first, before[ends]


def line_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each line with its line end."""
    data = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero(data == 10) + 1
    if (data >= 128).any():
        counts = code_points(data)
        breaks, last = counts[breaks], counts[-1]
    else:
        last = len(data)
    starts = np.concatenate(([0], breaks)).astype(np.int64)
    return starts, np.concatenate((breaks, [last])).astype(np.int64)


def attribute(
    first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it reaches beyond it. Sections are
    sorted and do not overlap; tokens may meet several."""
    low = np.searchsorted(ends, first, "right")
    high = np.searchsorted(starts, last, "left")
    owner = np.full(len(first), -1)
    inside = np.zeros(len(first), np.int64)
    todo, at = np.arange(len(first)), low.copy()
    while len(todo):
        todo = todo[at[todo] < high[todo]]
        k = at[todo]
        shared = np.minimum(last[todo], ends[k]) - np.maximum(first[todo], starts[k])
        better = shared > inside[todo]
        owner[todo[better]], inside[todo[better]] = k[better], shared[better]
        at[todo] += 1
    return owner, inside < last - first


def count_batches(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        ids, parts = batch.column("doc_id").to_pylist(), []
        for doc_id, text in zip(ids, batch.column("_utf8").to_pylist(), strict=True):
            starts, ends = line_spans(text)
            if text:
                token_ends = encoder.ends(text)
                first, last = token_spans(text, token_ends)
                owner, crossing = attribute(first, last, starts, ends)
                tokens = np.bincount(owner[owner >= 0], minlength=len(starts))
                crossed = np.bincount(owner[crossing & (owner >= 0)], minlength=len(starts))
                total = len(token_ends)
            else:
                tokens = crossed = np.zeros(len(starts), np.int64)
                total = 0
            parts.append((doc_id, starts, ends, tokens, crossed, total))
        sizes = [len(p[1]) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p, n in zip(parts, sizes, strict=True) for _ in range(n)], pa.int64()),
                pa.array(np.concatenate([np.arange(n) for n in sizes])),
                *[pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in (1, 2, 3, 4)],
                pa.array(np.repeat([p[5] for p in parts], sizes).astype(np.int64)),
            ],
            names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
        )


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """A row per document and section: its span, its tokens, those of them that cross
    its bounds, and the tokens of the whole document."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_batches(batches, Encoder(ranks.value, pieces))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_bytes(rows, "doc_id").mapInArrow(task, SECTIONS)
