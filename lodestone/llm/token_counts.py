"""Token counts: pieces once per distinct pre-token, joined to per-document counts.

Token ids are never made. Steps:

1. ``profile``: each task splits its documents into words, normalises and
   pre-tokenises every distinct word once, and packs, per chunk of about
   ``CHUNK_BYTES`` of text, the chunk's distinct pre-tokens and the pre-token
   frequencies of each document. The packed table is written once to the shared
   folder.
2. The chunks' pre-tokens are shuffled by pre-token, so each distinct one is
   met in one task, and its pieces are counted there once. A very frequent
   pre-token has one row a chunk, not one a document.
3. The counts go back to their chunks, are joined to the frequencies, and
   frequency times pieces is summed per document.

The tokenizer drops white space and never joins across it, so words may be
looked at one at a time. Special strings inside a text are one token each, as
the library does by default.

Defined results: null text counts as empty (0 bytes, 0 tokens); very long texts are
counted whole, in one chunk; repeated rows give repeated rows; null doc_id stays null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

CHUNK_BYTES = 16 << 20
_PROFILE = "chunk long, pretokens array<string>, doc_ids array<long>, n_bytes array<long>, ends array<long>, tokens binary, freqs binary"


@functools.lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None


def pretokens_of(word: str, tokenizer, specials) -> list[str]:
    """The pre-tokens of a stretch of text without white space."""
    if word.isascii() and word.isalpha():
        return [word.lower()]
    out = []
    for k, part in enumerate(specials.split(word) if specials and "<" in word else [word]):
        if k % 2:
            out.append(part)
        elif part:
            normal = tokenizer.normalizer.normalize_str(part) if tokenizer.normalizer else part
            out += [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
    return out


def pieces_in(pretoken: str, tokenizer, specials) -> int:
    if specials and specials.fullmatch(pretoken):
        return 1
    return len(tokenizer.model.tokenize(pretoken))


class _Chunk:
    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.doc_ids, self.n_bytes, self.size = [], [], 0
        self.word_no, self.count, self.doc_no = [], [], []

    def add(self, doc_id, text: str | None) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = self.words
        found = Counter(raw.split())
        self.word_no += [words.setdefault(w, len(words)) for w in found]
        self.count += found.values()
        self.doc_no.append(len(found))
        self.doc_ids.append(doc_id)
        self.n_bytes.append(len(raw))
        self.size += len(raw)

    def packed(self, number: int, tokenizer, specials) -> pa.RecordBatch:
        names: dict[str, int] = {}
        flat, lengths = [], np.zeros(len(self.words), np.int64)
        for k, w in enumerate(self.words):
            own = pretokens_of(w.decode("utf-8", "replace"), tokenizer, specials)
            lengths[k] = len(own)
            flat += [names.setdefault(p, len(names)) for p in own]
        flat = np.array(flat, np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        words, counts = np.array(self.word_no, np.int64), np.array(self.count, np.int64)
        docs = np.repeat(np.arange(len(self.doc_ids)), self.doc_no)
        # One entry per pre-token of each (document, word), then summed per (document, pre-token).
        n = lengths[words] if len(words) else np.zeros(0, np.int64)
        at = np.repeat(starts[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(words) else np.zeros(0, np.int64)
        key = np.repeat(docs, n) * max(len(names), 1) + flat[at]
        freq = np.repeat(counts, n)
        order = np.argsort(key, kind="stable")
        key, freq = key[order], freq[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        freq = np.add.reduceat(freq, first) if len(key) else freq
        key = key[first]
        doc, tok = key // max(len(names), 1), key % max(len(names), 1)
        # A frequency over 255 is written as several entries, so that each takes one byte.
        times = (freq + 254) // 255
        if len(times) and times.max() > 1:
            doc, tok = np.repeat(doc, times), np.repeat(tok, times)
            last = np.cumsum(times) - 1
            rest = freq - 255 * (times - 1)
            freq = np.full(len(doc), 255)
            freq[last] = rest
        ends = np.searchsorted(doc, np.arange(len(self.doc_ids)), side="right")
        wide = tok.astype(np.uint32).view(np.uint8).reshape(-1, 4) if len(tok) else np.zeros((0, 4), np.uint8)
        return pa.RecordBatch.from_pydict(
            {
                "chunk": [number],
                "pretokens": [list(names)],
                "doc_ids": [self.doc_ids],
                "n_bytes": [self.n_bytes],
                "ends": [ends.tolist()],
                "tokens": [np.ascontiguousarray(wide.T).tobytes()],
                "freqs": [freq.astype(np.uint8).tobytes()],
            },
            schema=pa.schema([("chunk", pa.int64()), ("pretokens", pa.list_(pa.string())), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("tokens", pa.binary()), ("freqs", pa.binary())]),
        )


def _profile(path: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, specials = load(path)
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(doc_id, text.as_py())
                if chunk.size >= chunk_bytes:
                    yield chunk.packed(number, tokenizer, specials)
                    number, chunk = number + 1, _Chunk()
        if chunk.doc_ids:
            yield chunk.packed(number, tokenizer, specials)

    return run


def _count_pieces(path: str, held: int = 1 << 20):
    """(chunk, at, pretoken) rows in; packed (chunk, places, pieces) rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, specials = load(path)
        known: dict[str, int] = {}
        chunks, places, pieces, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            chunk, place, piece = map(np.concatenate, (chunks, places, pieces))
            order = np.argsort(chunk, kind="stable")
            chunk, place, piece = chunk[order], place[order].astype(np.uint32), piece[order].astype(np.uint32)
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            pairs = list(zip(cuts, cuts[1:]))
            return pa.RecordBatch.from_pydict({"chunk": pa.array([int(chunk[a]) for a, _ in pairs], pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in pairs], pa.binary()), "pieces": pa.array([piece[a:b].tobytes() for a, b in pairs], pa.binary())})

        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for k, p in enumerate(batch.column(2).to_pylist()):
                got = known.get(p)
                if got is None:
                    if len(known) >= held:
                        known.clear()
                    got = known[p] = pieces_in(p, tokenizer, specials)
                out[k] = got
            chunks.append(batch.column(0).to_numpy())
            places.append(batch.column(1).to_numpy())
            pieces.append(out)
            n += batch.num_rows
            if n >= held:
                yield flush()
                chunks, places, pieces, n = [], [], [], 0
        if n:
            yield flush()

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            tok = np.frombuffer(row["tokens"], np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() if row["tokens"] else np.zeros(0, np.uint32)
            freq = np.frombuffer(row["freqs"], np.uint8).astype(np.int64)
            counts = np.zeros(int(row["n_pretokens"]), np.int64)
            for places, pieces in zip(row["places"] or [], row["pieces"] or []):
                counts[np.frombuffer(places, np.uint32)] = np.frombuffer(pieces, np.uint32)
            total = np.concatenate([[0], np.cumsum(counts[tok] * freq)])
            ends = np.array(row["ends"], np.int64)
            sums = total[ends] - total[np.concatenate([[0], ends[:-1]])]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(sums, pa.int64())})


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chunks = written(rows.mapInArrow(_profile(path, chunk_bytes), _PROFILE), "token-profile")
    listed = chunks.select("chunk", F.posexplode("pretokens").alias("at", "pretoken"))
    counted = listed.repartition("pretoken").mapInArrow(_count_pieces(path), "chunk long, places binary, pieces binary")
    counted = counted.groupBy("chunk").agg(F.collect_list(F.struct("places", "pieces")).alias("_c"))
    counted = counted.select("chunk", F.col("_c.places").alias("places"), F.col("_c.pieces").alias("pieces"))
    packed = chunks.select("chunk", "doc_ids", "n_bytes", "ends", "tokens", "freqs", F.size("pretokens").alias("n_pretokens"))
    joined = packed.join(counted, "chunk", "left").drop("chunk")
    return joined.mapInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
