"""Quality rules: what public vocabularies make of a text.

For each document: words, symbols, repeated lines and repeated three-word windows, then the tokens that each of three public
vocabularies needs: characters per token, the share of tokens that are byte fallbacks, and the entropy of the tokens in bits. A
fallback is a byte piece where the vocabulary has such pieces, and a token that is no whole character where it is made of bytes.
Text that is not the language it is filed under, and text that is broken, lies outside the bands that its language's texts
keep to. A document is kept if the base rules pass and all three measures of all vocabularies lie within the bands of its
language, or of its script where the language has none. ``fit_bands`` fits bands to a bounded sample of labelled documents.

A text is cut at single spaces, which no vocabulary's token goes on behind, and each distinct part is encoded once per worker
in bounded tables; a text's tokens are joined from those.

Defined results: a null text has no words and fails; texts without tokens have null measures; a null or unknown lang takes
the bands of the script that most of its letters are of, the widest bands without letters; a null doc_id stays null; ties
of scripts go to the first in the table; repeated rows are repeated; other columns are ignored; no rows give no rows; a very
long text is measured whole, and one without a space is a single part.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, rarely_collect, rows_of, text_batches, tokenizer_file
from .pieces import MARK, MODEL, vocabulary

#: White space between words, and the symbols that are counted.
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Distinct parts that a worker's tables hold, and their ids under one vocabulary; beyond either the tables start anew.
TABLE_ROWS, TABLE_IDS = 100_000, 1_500_000
#: The vocabularies, and how their columns are named.
VOCABULARIES = {"piece": MODEL, "byte": "byte_bpe_50k.tiktoken", "multi": "byte_bpe_multi_50k.tiktoken"}


@dataclass(frozen=True)
class Band:
    """The least and most characters per token, the most byte fallbacks among tokens, the least and most bits of entropy."""

    chars_low: float
    chars_high: float
    bytes_high: float
    bits_low: float
    bits_high: float

    def holds(self, chars: float, byte_share: float, bits: float) -> bool:
        return self.chars_low <= chars <= self.chars_high and byte_share <= self.bytes_high and self.bits_low <= bits <= self.bits_high


#: Bands by language, then by script, of each vocabulary. Those of the four languages are fit_bands() of the 3,243 labelled good
#: documents among 10,000 that pass the base rules (3 of these lie outside, and 195 of 291 labelled bad ones that pass them); a
#: script's are set wide by hand, as its languages differ and the sample has none of them.
BANDS: dict[str, dict[str, Band]] = {
    lang: {v: Band(*ends) for v, ends in zip(VOCABULARIES, by_vocabulary, strict=True)}
    for lang, by_vocabulary in {
        "de": ((2.321, 6.5, 0.05, 5.62, 12.878), (2.155, 6.5, 0.086, 5.705, 12.912), (2.456, 6.5, 0.05, 5.691, 12.969)),
        "en": ((2.266, 6.5, 0.05, 5.547, 13.066), (2.385, 6.5, 0.05, 5.543, 13.143), (2.338, 6.5, 0.05, 5.618, 13.161)),
        "es": ((2.066, 6.5, 0.05, 5.619, 13.003), (1.897, 6.5, 0.154, 5.535, 12.906), (2.231, 6.5, 0.05, 5.552, 13.025)),
        "fr": ((1.926, 6.5, 0.05, 5.457, 12.936), (1.956, 6.5, 0.163, 5.521, 12.929), (2.067, 6.5, 0.05, 5.517, 12.989)),
        "Latin": ((1.2, 6.0, 0.1, 3.5, 14.0), (1.2, 6.0, 0.3, 3.5, 14.0), (1.2, 6.0, 0.15, 3.5, 14.0)),
        "Cyrillic": ((1.0, 6.0, 0.15, 3.5, 14.0), (0.4, 4.0, 0.9, 3.5, 14.0), (0.6, 6.0, 0.6, 3.5, 14.0)),
        "Greek": ((0.7, 4.0, 0.3, 3.5, 14.0), (0.3, 4.0, 0.95, 3.5, 14.0), (0.5, 6.0, 0.7, 3.5, 14.0)),
        "Arabic": ((0.6, 4.0, 0.4, 3.5, 14.0), (0.3, 4.0, 0.95, 3.5, 14.0), (0.5, 6.0, 0.7, 3.5, 14.0)),
        "Han": ((0.3, 3.0, 0.7, 3.0, 14.0), (0.2, 3.0, 0.98, 2.5, 14.0), (0.3, 3.0, 0.9, 2.5, 14.0)),
        "": ((0.3, 6.0, 0.7, 3.0, 14.0), (0.2, 6.0, 0.98, 2.5, 14.0), (0.3, 6.0, 0.9, 2.5, 14.0)),
    }.items()
}
SCRIPTS = {"Latin": re.compile("[A-Za-zÀ-ɏ]"), "Cyrillic": re.compile("[Ѐ-ӿ]"), "Greek": re.compile("[Ͱ-Ͽ]"), "Arabic": re.compile("[؀-ۿ]"), "Han": re.compile("[぀-ヿ一-鿿가-힯]")}


class Library:
    """A vocabulary: how it encodes parts, as little-endian integers of ``kind``, and which of its ids are byte fallbacks."""

    def __init__(self, model: str):
        if model.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(tokenizer_file(model), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encoding = tiktoken.Encoding(model, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.n = max(ranks.values()) + 1
            self.is_byte, self.lengths = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
            for token, i in ranks.items():
                self.lengths[i] = len(token)
                self.is_byte[i] = not whole_characters(token)
        else:
            self.vocabulary = v = vocabulary(model)
            self.encoding, self.n, self.is_byte, self.mark = None, v.n, v.is_byte, v.ids[MARK]
        self.kind = "<u2" if self.n <= 1 << 16 else "<u4"

    def first(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that begin a text, one after another, and where each part's end."""
        if self.encoding is None:
            return self.others(parts)
        found = list(map(self.encoding.encode_ordinary, parts))
        return np.fromiter(chain.from_iterable(found), self.kind), np.cumsum(list(map(len, found)), dtype=np.int64)

    def others(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts that follow a space."""
        if self.encoding is None:
            # The library puts a mark before each string, but none before an empty one.
            found = [ids or [self.mark] for ids in self.vocabulary.processor.encode(parts, num_threads=1)]
            return np.fromiter(chain.from_iterable(found), self.kind), np.cumsum(list(map(len, found)), dtype=np.int64)
        if not parts or any(p[-1:].isspace() for p in parts):
            return self.first([f" {p}" for p in parts])
        # Together they are a text that is cut at just these spaces, as none ends with white space.
        ids = self.encoding.encode_to_numpy(" " + " ".join(parts))
        ends = np.cumsum(list(map(len, map(str.encode, parts, repeat("utf-8"), repeat("replace")))), dtype=np.int64) + np.arange(1, len(parts) + 1)
        return ids.astype(self.kind), np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1


def whole_characters(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class TokenTables:
    """The ids of distinct parts under each vocabulary: a row for each part, all rows' ids one after another."""

    def __init__(self, models: tuple[str, ...]):
        rarely_collect()
        self.libraries = [Library(m) for m in models]
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids = [np.zeros(0, x.kind) for x in self.libraries]
        self.ends = [np.zeros(0, np.int64) for _ in self.libraries]

    def tokens(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each text the ids under each vocabulary."""
        if len(self.rows) > TABLE_ROWS or len(self.ids[0]) > TABLE_IDS:
            self.clear()
        cut = [parts(t) for t in texts]
        missing = list(set().union(*(c[1:] for c in cut)) - self.rows.keys())
        # A part that ends a text may end with white space, and is encoded alone.
        missing.sort(key=lambda p: p[-1:].isspace())
        plain = bisect_left(missing, True, key=lambda p: p[-1:].isspace())
        self.rows.update(zip(missing, range(len(self.rows), len(self.rows) + len(missing)), strict=True))
        sizes = np.array([len(c) for c in cut], np.int64)
        text_ends = np.cumsum(sizes)
        begins = (text_ends - sizes)[sizes > 0]
        # Rows of all texts' parts; those that begin a text have rows of their own behind the table's.
        at = np.empty(int(sizes.sum()), np.int64)
        behind = np.ones(len(at), bool)
        behind[begins] = False
        at[begins] = len(self.rows) + np.arange(len(begins))
        at[behind] = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(c[1:] for c in cut)), np.int64, len(at) - len(begins))
        out = []
        for k, library in enumerate(self.libraries):
            for some in (missing[:plain], missing[plain:]):
                ids, ends = library.others(some)
                self.ends[k] = np.concatenate([self.ends[k], ends + len(self.ids[k])])
                self.ids[k] = np.concatenate([self.ids[k], ids])
            ids, ends = library.first([c[0] for c in cut if c])
            every, stops = np.concatenate([self.ids[k], ids]), np.concatenate([[0], self.ends[k], ends + len(self.ids[k])])
            n = stops[at + 1] - stops[at]
            places = np.cumsum(n)
            tokens = every[np.repeat(stops[at] - (places - n), n) + np.arange(len(places) and places[-1])]
            cuts = np.concatenate([[0], places])[text_ends].tolist()
            out.append([tokens[a:z] for a, z in zip([0, *cuts], cuts, strict=False)])
        return [list(x) for x in zip(*out, strict=True)]


#: A single space between other characters than white space; U+2581 is a space to some vocabularies.
BETWEEN = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
ODD_SPACE = re.compile("[\\s▁] | [\\s▁]")


def parts(text: str) -> list[str]:
    """What lies between single spaces; none for an empty text."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or ODD_SPACE.search(text):
        return BETWEEN.split(text)
    return text.split(" ")


def token_tables(models: tuple[str, ...]) -> TokenTables:
    return kept(("fertility", models), lambda: TokenTables(models))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of width words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def band_of(lang: str | None, text: str, bands: dict[str, dict[str, Band]]) -> dict[str, Band]:
    """The bands, by vocabulary, of the language, or else of the text's script."""
    if lang in bands and lang not in SCRIPTS and lang:
        return bands[lang]
    counts = {name: len(letters.findall(text)) for name, letters in SCRIPTS.items() if name in bands}
    best = max(counts, key=counts.get, default="")
    return bands[best] if counts.get(best) else bands[""]


def measures(text: str, tokens: np.ndarray, is_byte: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """Characters per token, share of byte tokens, entropy of the tokens in bits."""
    n = len(tokens)
    if not n:
        return None, None, None
    ids, counts = np.unique(tokens, return_counts=True)
    share = counts / n
    return len(text) / n, float(counts[is_byte[ids]].sum() / n), float(-(share * np.log2(share)).sum()) + 0.0


def judge(text: str, lang: str | None, tokens: list[np.ndarray], tables: TokenTables, bands: dict[str, dict[str, Band]], min_words: int, max_repeated: float) -> tuple:
    """The result's columns for one text, but for doc_id."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    repeats = repeated_words(words)
    failed = n < min_words or repeats > max_repeated * n
    found = [measures(text, t, x.is_byte) for t, x in zip(tokens, tables.libraries, strict=True)]
    stays = not failed
    if stays:
        band = band_of(lang, text, bands)
        stays = all(m[0] is not None and band[name].holds(*m) for name, m in zip(VOCABULARIES, found, strict=True))
    spaces = sum(map(text.count, SPACES))
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed, stays, *(x for m in found for x in m)


MEASURES = ("chars_per_token", "byte_share", "entropy_bits")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"{v}_{m}" for v in VOCABULARIES for m in MEASURES))
KEPT = COLUMNS.index("kept")


def quality(docs: DataFrame, bands: dict[str, dict[str, Band]] | None = None, min_words: int = 50, max_repeated: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the measures of each vocabulary."""
    import pyarrow as pa

    text_batches(docs.sparkSession)
    bands = bands or BANDS
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * (len(COLUMNS) - 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = token_tables(tuple(VOCABULARIES.values()))
        for batch in batches:
            rows = [(d, t or "", x) for d, t, x in rows_of(batch, "doc_id", "text", "lang")]
            tokens = tables.tokens([t for _, t, _ in rows])
            out = [judge(t, x, k, tables, bands, min_words, max_repeated) for (_, t, x), k in zip(rows, tokens, strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *COLUMNS])

    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    schema = ", ".join(f"{n} {names[k]}" for n, k in zip(("doc_id", *COLUMNS), [pa.int64(), *kinds], strict=True))
    return docs.select("doc_id", "text", "lang").mapInArrow(run, schema)


def kept_documents(docs: DataFrame, bands: dict[str, dict[str, Band]] | None = None, min_words: int = 50, max_repeated: float = 0.5) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns. The verdict is taken on the row itself: nothing is joined."""
    import pyarrow as pa

    text_batches(docs.sparkSession)
    bands = bands or BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = token_tables(tuple(VOCABULARIES.values()))
        for batch in batches:
            rows = [(t or "", x) for t, x in rows_of(batch, "text", "lang")]
            keep = [judge(t, x, k, tables, bands, min_words, max_repeated)[KEPT] for (t, x), k in zip(rows, tables.tokens([t for t, _ in rows]), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_bands(measured: DataFrame, rows: int = 20_000, rare: float = 0.001, margin: float = 0.03) -> dict[str, dict[str, Band]]:
    """Bands by language and vocabulary, from measured (lang and the columns of quality(), of good documents only).

    At most ``rows`` documents, by hash of doc_id, are looked at; those that fail the base rules are left out. A band reaches
    from the quantile ``rare`` to 1 - rare, and beyond by the share ``margin`` of it, an entropy's upper end by 6 bits, as
    longer texts have more. A byte share may be 0.05 at least, for signs beside letters. Characters per token may be 6.5 at least: words that a
    vocabulary knows whole are no fault, and a sample of invented prose has few of them.
    """
    sample = measured.where("not base_failed and lang is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ends = [F.array(F.lit(rare), F.lit(1 - rare))]
    picks = [F.percentile(f"{v}_{m}", *ends).alias(f"{v}_{m}") for v in VOCABULARIES for m in MEASURES]
    out: dict[str, dict[str, Band]] = {}
    for r in sample.groupBy("lang").agg(*picks).orderBy("lang").collect():
        out[r["lang"]] = {}
        for v in VOCABULARIES:
            chars, share, bits = (r[f"{v}_{m}"] for m in MEASURES)
            out[r["lang"]][v] = Band(*(round(x, 3) for x in (chars[0] * (1 - margin), max(chars[1] * (1 + margin), 6.5), max(share[1] * (1 + margin), 0.05), bits[0] * (1 - margin), bits[1] + 6)))
    return out
