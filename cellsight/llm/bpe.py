"""Byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be
merged over, so the text may be cut there for certain. Each piece of the
split pattern is cut at such pairs, the fragments are encoded on their own
(each distinct one once per worker, while the memo has room), and their ids
are concatenated. The vocabulary and merges (a file of bounded size) are read
on the driver and sent along with the tasks.

Defined results: null counts as the empty text, with no ids; special tokens
spelled out in a text become their own id, as the tokenizers library does;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm._common import small_batches, texts_of

# Fixed value: the split pattern of the published byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMO_LIMIT = 700_000       # distinct words remembered per worker (the first ones, so mostly the frequent ones)
MEMO_CHARS = 40            # longer words are encoded each time
SHORT_PIECE = 64           # bytes up to which a piece is cut without numpy
LONG_FRAGMENT = 256        # longer fragments are merged by a heap
NO_MERGE = 1 << 40


def byte_letters() -> dict[int, str]:
    """The published mapping of bytes to printable characters: printable Latin-1 stays, the rest moves to 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + n) for n, b in enumerate(rest)}


@dataclass
class ByteBPE:
    """Vocabulary, merge ranks and the table of byte pairs that occur inside tokens."""

    ids: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    special: dict[str, int]

    def __post_init__(self):
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.joined = np.zeros(1 << 16, bool)
        for token in self.ids:
            t = np.frombuffer(token, np.uint8).astype(np.int64)
            self.joined[t[:-1] << 8 | t[1:]] = True
        # As a flat set for short pieces: numpy costs more than it saves there.
        self.forced = {bytes((p >> 8, p & 255)) for p in np.flatnonzero(~self.joined)}
        self.split = regex.compile(PATTERN)
        self.specials = (regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
                         if self.special else None)
        self.text_of = {i: str(i) for i in self.bytes_of}
        self._words: dict[str, tuple[int, ...] | bool] = {}
        self._fragments: dict[bytes, list[int]] = {}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.pair_ranks = {self.ids[a] << 20 | self.ids[b]: rank for (a, b), rank in self.ranks.items()}
        self.new_ids = {rank: self.ids[a + b] for (a, b), rank in self.ranks.items()}

    @classmethod
    def from_json(cls, content: str) -> ByteBPE:
        """Read a ``tokenizer.json`` with a byte-level BPE model."""
        data = json.loads(content)
        letters = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        return cls(ids, {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}, special)

    def __getstate__(self):
        return {"ids": self.ids, "ranks": self.ranks, "special": self.special}

    def __setstate__(self, state):
        self.__init__(**state)

    def fragments(self, piece: bytes) -> list[bytes]:
        """Cut a piece wherever two neighbouring bytes occur together in no token."""
        if len(piece) > SHORT_PIECE:
            b = np.frombuffer(piece, np.uint8).astype(np.int64)
            cuts = np.flatnonzero(~self.joined[b[:-1] << 8 | b[1:]]) + 1
        else:
            cuts = [i + 1 for i in range(len(piece) - 1) if piece[i:i + 2] in self.forced]
        ends = [0, *cuts, len(piece)]
        return [piece[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _merge(self, fragment: bytes) -> list[int]:
        """Apply the merges to one fragment: lowest rank first, leftmost first."""
        part = list(map(self.byte_ids.__getitem__, fragment))
        if len(part) > LONG_FRAGMENT:
            return self._merge_long(part)
        get, new = self.pair_ranks.get, self.new_ids
        ranks = [get(a << 20 | b, NO_MERGE) for a, b in pairwise(part)]
        while ranks and (low := min(ranks)) != NO_MERGE:
            i = ranks.index(low)
            part[i:i + 2] = [new[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(part[i - 1] << 20 | part[i], NO_MERGE)
            if i < len(ranks):
                ranks[i] = get(part[i] << 20 | part[i + 1], NO_MERGE)
        return part

    def _merge_long(self, part: list) -> list[int]:
        """The same in O(n log n), by a heap over a linked list."""
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self.pair_ranks.get(part[i] << 20 | part[j])) is not None:
                heapq.heappush(heap, (rank, i, part[i], part[j]))

        for i in range(len(part)):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if part[i] != a or (j := after[i]) < 0 or part[j] != b:
                continue  # one side has been merged meanwhile
            part[i], part[j] = self.new_ids[rank], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in part if p is not None]

    def pieces(self, text: str) -> list[int]:
        """Ids of a text by the split pattern, without any memo."""
        ids: list[int] = []
        for piece in self.split.findall(text):
            for fragment in self.fragments(piece.encode("utf-8", "surrogatepass")):
                ids += self._merge(fragment)
        return ids

    def _learn(self, words: set[str]) -> dict[str, tuple[int, ...] | bool]:
        """Ids of a space and the word, for words not yet remembered; False where its ends are white space.

        All words are split, cut at forced boundaries and looked up together:
        the pattern starts a new piece at every single space, so they can
        stand in one string.
        """
        found: dict[str, tuple[int, ...] | bool] = {}
        whole = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        found.update(dict.fromkeys(words.difference(whole), False))
        if not whole:
            return found
        pieces = [p.encode("utf-8", "surrogatepass") for p in self.split.findall(" " + " ".join(whole))]
        data = b"".join(pieces)
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = ~self.joined[raw[:-1] << 8 | raw[1:]]
        cut[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))] = True
        ends = np.flatnonzero(cut).tolist()
        fragments = [data[a:b] for a, b in pairwise(ends)]
        memo = self._fragments
        for f in set(fragments).difference(memo):
            memo[f] = self._merge(f)
        ids = list(map(memo.__getitem__, fragments))
        # A word starts with each fragment that starts with a space.
        starts = [i for i, f in enumerate(fragments) if f[0] == 32]
        for word, a, b in zip(whole, starts, [*starts[1:], len(ids)], strict=True):
            found[word] = tuple(ids[a] if b == a + 1 else chain.from_iterable(ids[a:b]))
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        return found

    def _plain(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts without special tokens.

        A single space between two non-space characters always starts a new
        piece, so words cut there have the same ids in every text. A text
        with any other run of white space at such a place is encoded whole.
        """
        words = [t.split(" ") for t in texts]
        memo = self._words
        found = [list(map(memo.get, w[1:])) for w in words]
        missing = [i for i, f in enumerate(found) if None in f]
        new = self._learn({w for i in missing for w, ids in zip(words[i][1:], found[i], strict=True) if ids is None})
        for i in missing:
            found[i] = [new[w] if ids is None else ids for w, ids in zip(words[i][1:], found[i], strict=True)]
        if len(memo) < MEMO_LIMIT:
            memo.update((w, ids) for w, ids in new.items() if len(w) <= MEMO_CHARS)
        out = []
        for text, w, f in zip(texts, words, found, strict=True):
            if False in f or w[0][-1:].isspace() or (not w[0] and f):
                out.append(self.pieces(text))
            else:
                ids = self.pieces(w[0])
                ids.extend(chain.from_iterable(f))
                out.append(ids)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, special tokens included."""
        parts: list[list[str | int]] = []
        for text in texts:
            if not text or not any(s in text for s in self.special):
                parts.append([text or ""])
                continue
            part, at = [], 0
            for m in self.specials.finditer(text):
                part += [text[at:m.start()], self.special[m[0]]]
                at = m.end()
            parts.append([*part, text[at:]])
        plain = iter(self._plain([p for part in parts for p in part if isinstance(p, str)]))
        out = []
        for part in parts:
            ids = next(plain) if isinstance(part[0], str) else [part[0]]
            for p in part[1:]:
                ids = ids + (next(plain) if isinstance(p, str) else [p])
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def load(path: str) -> ByteBPE:
    """Read the vocabulary file on the driver."""
    with open(path, encoding="utf-8") as f:
        return ByteBPE.from_json(f.read())


def encode_documents(docs: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            ids = shared.value.encode_batch(texts_of(batch, "body"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, bpe: ByteBPE) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            out = [None if i is None else shared.value.decode(i) for i in texts_of(batch, "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, and hash both, in one pass.

    Ids and decoded text stay inside the task, so only digests are returned.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8 << 20):
            own, n, a, b = shared.value, [], [], []
            for ids in own.encode_batch(texts_of(batch, "body")):
                n.append(len(ids))
                a.append(sha256(",".join(map(own.text_of.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                                              pa.array(b, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
