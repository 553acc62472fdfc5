"""Byte-level BPE encoding and decoding with a rank queue over whole batches of pre-tokens.

All pre-tokens of a batch lie behind one another as a doubly linked list of byte positions,
with breaks that never merge. The queue has one bucket per merge rank, holding the positions
at which a pair of that rank was seen. Which buckets are filled stands in a bitmap of three
levels of 64-bit words; find-first-set from the top gives the lowest rank. All positions of
that bucket merge in one numpy step; entries whose pair has changed since are stale and are
skipped, of overlapping pairs the leftmost merge. Since pre-tokens do not touch, taking ranks
in order over all of them gives what each alone would give. A pre-token of a million bytes
costs no more per byte than a million short ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, small_batches

#: Pre-tokens whose ids a task remembers, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


class RankQueue:
    """Buckets of positions by rank, with find-first-set over a bitmap of three levels."""

    def __init__(self, ranks: int):
        self.buckets: list[list] = [[] for _ in range(ranks)]
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        bucket.append(positions)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest filled rank with all its positions, ascending."""
        if not self.top:
            return None
        first = (self.top & -self.top).bit_length() - 1
        word = self.mid[first]
        second = (first << 6) | ((word & -word).bit_length() - 1)
        word = self.low[second]
        rank = (second << 6) | ((word & -word).bit_length() - 1)
        self.low[second] &= ~(1 << (rank & 63))
        if not self.low[second]:
            self.mid[first] &= ~(1 << (second & 63))
            if not self.mid[first]:
                self.top &= ~(1 << first)
        parts, self.buckets[rank] = self.buckets[rank], []
        return rank, (np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0])


class Vocabulary:
    """Ranks of byte strings. ``none`` stands for 'no such pair'."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.none = self.size
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        self.unordered: set[int] = set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
                    # A merge of this part may open a pair of lower rank than its own.
                    self.unordered.update(p for p in (left, right) if p > rank)
        keys = sorted(pairs)  # and one that no pair has, so that a search never runs out
        self.keys = np.array([*keys, self.size * self.size], np.int64)
        self.values = np.array([*(pairs[k] for k in keys), self.none], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], self.none)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, as little-endian 32-bit integers."""
        if not words:
            return []
        # A break of one position stands before each word and after the last.
        text = b"\0" + b"\0".join(words) + b"\0"
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        breaks = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids = self.of_byte[np.frombuffer(text, np.uint8)]
        ids[breaks] = -1
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        queue = RankQueue(self.size)

        def push(at: np.ndarray) -> None:
            at = at[(ids[at] >= 0) & (ids[after[at]] >= 0)]
            ranks = self.rank(ids[at], ids[after[at]])
            some = ranks < self.none
            at, ranks = at[some], ranks[some]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            ends = [*(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            begin = 0
            for end in ends:
                queue.push(int(ranks[begin]), at[begin:end])
                begin = end

        push(np.arange(1, max(n - 2, 1)))
        while (item := queue.pop()) is not None:
            rank, at = item
            right = after[at]
            live = (ids[at] >= 0) & (right < n)
            at, right = at[live], right[live]
            live = ids[right] >= 0
            at, right = at[live], right[live]
            live = self.rank(ids[at], ids[right]) == rank
            at, right = at[live], right[live]
            if not len(at):
                continue
            if rank in self.unordered:  # one merge per word, then look again
                word = np.searchsorted(breaks, at)
                first = np.ones(len(at), bool)
                first[1:] = word[1:] != word[:-1]
                if not first.all():
                    queue.push(rank, at[~first])
                at, right = at[first], right[first]
            else:
                overlap = np.zeros(len(at), bool)
                overlap[1:] = right[:-1] == at[1:]
                if overlap.any():  # in a chain of overlapping pairs every other one merges
                    index = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(overlap, 0, index))
                    keep = (index - head) % 2 == 0
                    at, right = at[keep], right[keep]
            ids[at] = rank
            ids[right] = -2
            beyond = after[right]
            after[at] = beyond
            before[beyond] = at
            previous = before[at]
            push(np.concatenate([previous[ids[previous] >= 0], at]))
        kept = np.flatnonzero(ids >= 0)
        out = ids[kept].astype("<u4")
        return np.split(out, np.searchsorted(kept, breaks[1:-1]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def parse_ranks(text: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in text.splitlines() if line)}


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    with open(path) as lines:
        return Vocabulary(parse_ranks(lines.read()))


class Encoder:
    """Encodes whole texts; the ids of short pre-tokens are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.known = vocabulary, {}
        self.find = regex.compile(pattern).findall

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.find(text) for text in texts]
        known = self.known
        fresh = list(set().union(*words).difference(known))
        for word, ids in zip(fresh, self.vocabulary.encode([w.encode() for w in fresh])):
            known[word] = ids.tobytes()
        out = [b"".join(map(known.__getitem__, found)) for found in words]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        else:
            for word in fresh:
                if len(word) > CACHE_CHARS:
                    del known[word]
        return out


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if ``ids``, the
    ``ids`` themselves, for the whole text of every row of ``docs``.

    ``path`` is the rank file, which every worker must be able to read. A null text is
    empty; empty texts have no ids. Repeated rows give repeated rows, null doc_ids stay.
    Further columns are dropped. No shuffle; a task holds one Arrow batch (at most 16 MB of
    text or one document) and its memory of at most ``CACHE_ENTRIES`` pre-tokens.
    """
    docs = apart(docs.select(F.col("doc_id").cast("bigint"), "text"))
    small_batches(docs.sparkSession, 1000)
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()),
              pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    kinds = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if ids:
        fields.append(pa.field("ids", pa.list_(pa.int64())))
        kinds += ", ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(path), pattern)  # its memory goes with the task
        decode = encoder.vocabulary.decode
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            packed = encoder.encode(texts)
            arrays = [np.frombuffer(p, "<u4") for p in packed]
            columns = [batch.column(0), pa.array([len(a) for a in arrays], pa.int64()),
                       pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                       pa.array([hashlib.sha256(decode(a)).hexdigest() for a in arrays])]
            if ids:
                columns.append(pa.array([a.astype(np.int64) for a in arrays],
                                        pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return docs.mapInArrow(run, kinds)


def bpe_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)
