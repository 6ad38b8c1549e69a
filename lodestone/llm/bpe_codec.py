"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding. A text is cut at places that no pre-token spans, each stretch into
pre-tokens, and each pre-token is merged. Short pre-tokens are merged at once. A
long one (no white space for pages) goes through a buffer: a token is emitted
once the bytes behind it are enough that nothing to come can change it, and
merging goes on from there, so memory does not grow with the pre-token.

How many bytes are enough is computed from the merge list (``lookahead``). A
token ``t`` ending at ``e`` can still change only if a token starting at ``e``
is merged into it, or into one it is made from, at its right end. For a merge
(v, z) that takes ``len(z)`` bytes, and further ones only through merges of
lower rank that disturb ``z`` at *its* right end. Ranks fall at each step, so
one pass over the merges in rank order gives the bound.

Decoding. Ids become bytes, and an incremental UTF-8 machine turns bytes into
text, holding back at most an unfinished character; bytes that are no UTF-8
become U+FFFD.

Defined results: null text is encoded as empty (no ids); very long texts are encoded
whole, in blocks; repeated rows give repeated rows; null doc_id stays null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-token pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_CHARS = 1 << 16
SHORT = 48
HELD_WORDS = 1 << 20


def byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return names | {chr(256 + k): b for k, b in enumerate(hidden)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token's end that settle it; see the module's docstring."""
    made: dict[bytes, tuple[bytes, bytes]] = {}
    need: dict[bytes, int] = {}  # by left part, over the merges seen so far
    for v, z in merges:
        reach, right = 0, z
        while right:
            reach = max(reach, need.get(right, 0))
            right = made[right][1] if right in made else b""
        need[v] = max(need.get(v, 0), len(z) + reach)
        made.setdefault(v + z, (v, z))
    return max(need.values(), default=0)


class Codec:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], specials: dict[str, int]):
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in specials.items()}
        self.first = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.rank_of = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.lookahead = lookahead(merges)
        self.longest = max(map(len, vocab), default=1)
        self.specials = specials
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile(r"(?<=\S)(?=\s)")
        self.words: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def load(path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        return Codec(vocab, [(raw(a), raw(b)) for a, b in merges], added)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one whole pre-token (or of a buffer of one)."""
        ids = [self.first[b] for b in raw]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, made, none = self.rank_of.get, self.made, len(self.made)
        ranks = list(map(get, zip(ids, ids[1:]), itertools.repeat(none)))
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k] = made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As merge(), with a heap of (rank, place) and a linked list."""
        n, get, made = len(ids), self.rank_of.get, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(got, k, ids[k], ids[k + 1]) for k in range(n - 1) if (got := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = made[best], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (got := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (got, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def stream(self, parts: Iterable[bytes], window: int = 1 << 12) -> Iterator[list[int]]:
        """Ids of one pre-token that comes in parts, each emitted once it is settled."""
        held = b""
        for part in parts:
            held += part
            while len(held) >= window + self.lookahead + self.longest:
                ids, end, settled = self.merge(held[: window + self.lookahead + self.longest]), 0, 0
                while settled < len(ids) and (to := end + len(self.bytes_of[ids[settled]])) <= window + self.longest:
                    end, settled = to, settled + 1
                yield ids[:settled]
                held = held[end:]
        yield self.merge(held)

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) > 1 << 13:
            return tuple(i for ids in self.stream([raw]) for i in ids)
        ids = tuple(self.merge(raw))
        if len(raw) <= 64:
            if len(self.words) >= HELD_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def blocks(self, text: str) -> Iterator[str]:
        """Stretches of about BLOCK_CHARS, cut where white space follows other text."""
        at = 0
        while len(text) - at > BLOCK_CHARS and (cut := self.cut.search(text, at + BLOCK_CHARS)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode_blocks(self, text: str) -> Iterator[list[int]]:
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        known, word = self.words.get, self._word
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.specials[part]]
                continue
            for block in self.blocks(part):
                out: list[int] = []
                for w in self.pattern.findall(block):
                    out += known(w) or word(w)
                yield out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_blocks(text) for i in ids]

    def decode_blocks(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        yield machine.decode(b"", final=True)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_blocks([ids]))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec.load(path)


def digest(text: str, own: Codec, names: dict[int, str] | None = None) -> tuple[int, str, str]:
    """Number of ids, sha256 of the ids joined by commas, sha256 of the text they decode to."""
    ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0

    def seen() -> Iterator[list[int]]:
        nonlocal n
        for ids in own.encode_blocks(text):
            if ids:
                ids_sha.update(("," if n else "").encode() + ",".join(map(str, ids) if names is None else map(names.__getitem__, ids)).encode())
                n += len(ids)
                yield ids

    for part in own.decode_blocks(seen()):
        text_sha.update(part.encode("utf-8", "surrogatepass"))
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def encode_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, ids array<int> in blocks joined, decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for doc_id, t in zip(batch.column(0), batch.column(1)):
                ids = own.encode(t.as_py() or "")
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id.as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32())), "decoded": pa.array([own.decode(ids)], pa.string())})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = {i: str(i) for i in own.bytes_of}
        for batch in batches:
            got = [digest(t.as_py() or "", own, names) for t in batch.column(1)]
            n, a, b = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
