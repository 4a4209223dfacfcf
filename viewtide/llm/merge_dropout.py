"""SentencePiece encoding with seeded merge-dropout, and decoding.

A pre-token's characters are merged as the model does it: the best-ranked merge first, the leftmost of equal ones. Each
candidate - what lies to the left, what to the right, and where - is skipped when its keyed hash falls below the dropout
rate; it comes back only as part of another candidate, after a neighbour was merged. The key is made of the seed, the doc_id
and the pre-token's number in the document, so one seed always gives a document the same pieces, and a word is segmented anew
wherever it occurs. A batch's pre-tokens are merged together, those of about a length at once as arrays (``merge_many``);
``merge_one`` walks an agenda for a single one, and serves long ones: time grows as n log n with a pre-token's n characters, and
it takes some 40 bytes for each. Both give the same pieces.

Characters outside the vocabulary become byte pieces, and so does U+2581 itself, which the library would turn into a space:
decoding gives back every text, code point by code point.

Defined results: a null text is empty and has no pieces; a null doc_id counts as -1 in the key; repeated rows are encoded
alike; other columns are ignored (``encoded`` keeps them); an empty table gives no rows; a text of megabytes is encoded whole,
also where it has no space.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import kept, rarely_collect, rows_of, text_batches
from .pieces import MARK, MODEL, Vocabulary, vocabulary

SEED, RATE = 42, 0.1
#: Pre-tokens that are merged together.
TOGETHER = 8192
#: Longer pre-tokens are merged alone.
ALONE = 48
#: Fixed odd numbers of the places' hash.
START, MIDDLE, END = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Here U+2581 is no space, unlike in the library.
PRE_TOKEN = re.compile(" +[^ ]*")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of integers, elementwise."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate of the characters start to middle with middle to end is skipped under key."""
    if rate <= 0:
        return np.zeros(start.shape, bool)
    with np.errstate(over="ignore"):
        place = (start.astype(np.uint64) * np.uint64(START)) ^ (middle.astype(np.uint64) * np.uint64(MIDDLE)) ^ (end.astype(np.uint64) * np.uint64(END))
        return mix(mix(key) ^ place) >> np.uint64(11) < np.uint64(int(rate * 2**53))


def occurrence_keys(doc_id: int | None, n: int, seed: int) -> np.ndarray:
    """The keys of a document's pre-tokens in turn."""
    key = hashlib.blake2b(f"{seed}:{-1 if doc_id is None else doc_id}".encode(), digest_size=8).digest()
    with np.errstate(over="ignore"):
        return mix(np.frombuffer(key, "<u8") + np.arange(n, dtype=np.uint64))


def characters(text: str, v: Vocabulary) -> np.ndarray:
    """Ids of the characters; -1 outside the vocabulary and for U+2581."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    ids = v.char_ids[codes]
    ids[codes == ord(MARK)] = -1
    ids[codes == 32] = v.chars[MARK]
    return ids


def with_bytes(ids: list[int], starts: list[int], token: str, v: Vocabulary) -> list[int]:
    """ids with byte pieces in place of each -1."""
    out: list[int] = []
    for i, at in zip(ids, starts, strict=True):
        out += [i] if i >= 0 else v.byte_ids[list(token[at].encode("utf-8", "replace"))].tolist()
    return out


def skip_test(key: int, rate: float) -> Callable[[int, int, int], bool]:
    """skipped() for single candidates under one key."""
    mask, limit = 2**64 - 1, int(rate * 2**53)
    with np.errstate(over="ignore"):
        mixed = int(mix(np.array([key], np.uint64))[0])

    def test(start: int, middle: int, end: int) -> bool:
        x = mixed ^ (start * START ^ middle * MIDDLE ^ end * END) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return (x ^ x >> 31) >> 11 < limit

    return test


def merge_one(token: str, key: int, rate: float, v: Vocabulary) -> list[int]:
    """A pre-token's pieces, by walking the agenda: (rank, place) of the first candidates in order, and of later ones in a heap."""
    found = characters(token, v)
    n, none = len(found), v.n
    # An id that is none pairs with nothing.
    ids = array("q", np.where(found < 0, -(1 << 60), found.astype(np.int64)).tobytes())
    after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
    place = np.arange(n - 1)
    ranks, merged = v.merge(found[:-1], found[1:])
    ranks[skipped(np.full(n - 1, key, np.uint64), place, place + 1, place + 2, rate)] = none
    rank, into = array("i", ranks.astype(np.int32).tobytes()), array("i", merged.astype(np.int32).tobytes())
    rank.append(none)
    into.append(0)
    some = np.flatnonzero(ranks < none)
    first = array("q", np.sort(ranks[some].astype(np.int64) << 32 | some).tobytes())
    later: list[int] = []
    merges, skip, at, size = v.merges(), skip_test(key, rate), 0, len(first)

    def offer(left: int, right: int) -> None:
        pair = merges.get(ids[left] * none + ids[right])
        if pair is None or skip(left, right, after[right]):
            rank[left] = none
        else:
            rank[left], into[left] = pair
            heapq.heappush(later, pair[0] << 32 | left)

    while at < size or later:
        if at < size and not (later and later[0] < first[at]):
            x, at = first[at], at + 1
        else:
            x = heapq.heappop(later)
        i = x & 0xFFFFFFFF
        # Either side may have been merged since.
        if rank[i] != x >> 32:
            continue
        j = after[i]
        end = after[j]
        ids[i], after[i] = into[i], end
        rank[i] = rank[j] = none
        if end < n:
            before[end] = i
            offer(i, end)
        if before[i] >= 0:
            offer(before[i], i)
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = after[at]
    return with_bytes([ids[s] for s in starts], starts, token, v)


def merge_many(tokens: list[str], keys: list[int] | np.ndarray, rate: float, v: Vocabulary) -> list[bytes]:
    """The pieces of pre-tokens of like lengths as little-endian integers of v.kind, merged all together."""
    n, lengths = len(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    width = int(lengths.max()) + 1
    key = np.array(keys, np.uint64)
    # A symbol is named by its row and where it begins; all tables are flat. The last place of a row is never a symbol.
    symbol = characters("".join([t.ljust(width, "\0") for t in tokens]), v)
    place = np.tile(np.arange(width), n)
    length = np.repeat(lengths, width)
    after, before = place + 1, place - 1
    alive = place < length
    rank, merged = np.full(n * width, v.n, np.int32), np.zeros(n * width, np.int32)

    def offer(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """The merges of the symbols at left (places in their rows) with those at right, which follow them."""
        base = row * width
        r, m = v.merge(symbol[base + left], symbol[base + right])
        some = np.flatnonzero(r < v.n)
        out = skipped(key[row[some]], left[some], right[some], after[base[some] + right[some]], rate)
        r[some[out]] = v.n
        rank[base + left], merged[base + left] = r, m

    at = np.flatnonzero(place + 1 < length)
    offer(at // width, place[at], place[at] + 1)
    row = np.arange(n)
    ranks = rank.reshape(n, width)
    while len(row):
        these = ranks[row]
        i = these.argmin(axis=1)
        go = these[np.arange(len(row)), i] < v.n
        row, i = row[go], i[go]
        base = row * width
        left = base + i
        j = after[left]
        end = after[base + j]
        symbol[left] = merged[left]
        after[left] = end
        alive[base + j] = False
        rank[base + j] = rank[left] = v.n
        more = end < lengths[row]
        before[(base + end)[more]] = i[more]
        offer(row[more], i[more], end[more])
        first = before[left]
        more = first >= 0
        offer(row[more], first[more], i[more])
    kept = np.flatnonzero(alive)
    found = symbol[kept]
    size = int(v.kind[2:])
    ends = np.cumsum(np.bincount(kept // width, minlength=n)) * size
    flat = found.astype(v.kind).tobytes()
    out = [flat[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    for k in np.unique(kept[found < 0] // width).tolist():
        mine = slice(int(ends[k - 1]) // size if k else 0, int(ends[k]) // size)
        out[k] = np.array(with_bytes(found[mine].tolist(), place[kept[mine]].tolist(), tokens[k], v), v.kind).tobytes()
    return out


class Encoder:
    """Encodes texts, each occurrence of a pre-token under its own key."""

    def __init__(self, model: str, seed: int, rate: float):
        rarely_collect()
        self.v, self.seed, self.rate = vocabulary(model), seed, rate
        self.kind = self.v.kind

    def encode(self, rows: list[tuple[int | None, str]]) -> list[bytes]:
        """The ids of each (doc_id, text) as little-endian integers of ``kind``."""
        tokens, keys, ends = [], [np.zeros(0, np.uint64)], [0]
        for doc_id, text in rows:
            mine = PRE_TOKEN.findall(" " + text) if text else []
            tokens += mine
            keys.append(occurrence_keys(doc_id, len(mine), self.seed))
            ends.append(len(tokens))
        key = np.concatenate(keys)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        order = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[order], ALONE, side="right"))
        found: list[bytes] = [b""] * len(tokens)
        for at in range(0, short, TOGETHER):
            part = order[at : min(at + TOGETHER, short)]
            places = part.tolist()
            for i, ids in zip(places, merge_many([tokens[i] for i in places], key[part], self.rate, self.v), strict=True):
                found[i] = ids
        for i in order[short:].tolist():
            found[i] = np.array(merge_one(tokens[i], int(key[i]), self.rate, self.v), self.kind).tobytes()
        return [b"".join(found[a:z]) for a, z in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: the pieces' text without the one space that encoding put before it."""
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, self.kind).tolist()))[1:]


def encoder(model: str, seed: int, rate: float) -> Encoder:
    return kept(("merge dropout", model, seed, rate), lambda: Encoder(model, seed, rate))


def round_trips(docs: DataFrame, model: str = MODEL, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """doc_id, n_bytes, n_pieces, n_byte_pieces, ids_crc32 (of little-endian ids, of 16 bits where the vocabulary fits, else 32), decoded_sha256, lossless."""
    import pyarrow as pa

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model, seed, rate)
        for batch in batches:
            rows = [(d, t or "") for d, t in rows_of(batch, "doc_id", "text")]
            out = []
            for (doc_id, text), ids in zip(rows, e.encode(rows), strict=True):
                plain, decoded = text.encode("utf-8", "replace"), e.decode(ids)
                pieces = np.frombuffer(ids, e.kind)
                n_byte = int(e.v.is_byte[pieces].sum())
                out.append((doc_id, len(plain), len(pieces), n_byte, zlib.crc32(ids), hashlib.sha256(decoded).hexdigest(), decoded == plain))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.bool_()]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def encoded(docs: DataFrame, model: str = MODEL, seed: int = SEED, rate: float = RATE, name: str = "piece_ids") -> DataFrame:
    """docs with a column of piece ids behind its own; a column that has its name already is replaced."""
    import pyarrow as pa
    from pyspark.sql import types as T

    text_batches(docs.sparkSession)
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model, seed, rate)
        for batch in batches:
            ids = e.encode([(d, t or "") for d, t in rows_of(batch, "doc_id", "text")])
            ends = np.cumsum([0, *(len(x) // int(e.kind[2:]) for x in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), e.kind).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))
