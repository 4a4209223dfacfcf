"""Token counts without token ids.

A text is cut into pre-tokens that no piece of the vocabulary crosses: a run of the space mark with what follows it. Each
distinct pre-token's pieces are counted once by the library, and every document's pre-token frequencies are joined with these
counts and summed.

The join has two parts. The most frequent pre-tokens, ``HEAD_ROWS`` at most, are found in a sample (one text in ``SAMPLE``, by
hash), counted and broadcast; where a pre-token is counted doesn't change how many pieces it has. A document's frequencies of
all others leave the pass as rows and are dealt out by pre-token, so each of these meets one task, which counts it once; the
products go back to their documents as sums. What is broadcast is bounded, and a pre-token that the sample hasn't got has few
rows. Pre-tokens of more than ``LONG`` characters aren't moved: they are counted where they stand.

Defined results: a null text counts as empty; an empty text has 0 bytes and 0 tokens; a null doc_id stays null;
repeated rows are counted one by one; other columns of the input are ignored; an empty table gives no rows; a very long text
is counted whole, and one without a space is a single pre-token.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, rows_of, text_batches, text_or_empty, tokenizer_file

MODEL = "piece_bpe_32k.model"
#: Pre-tokens whose counts are broadcast, at most, characters that a pre-token that is moved has, at most, and texts for each sampled one.
HEAD_ROWS, LONG, SAMPLE = 200_000, 64, 8
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHERED = 250_000
#: Distinct pre-tokens whose counts a worker keeps where a count is needed on the row itself.
KNOWN = 150_000
#: Space and U+2581 are the same mark to the model.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁]*")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens without their first mark, which the library puts before what it is given."""
    if not text:
        return []
    if "  " in text or "▁" in text or text[0] == " ":
        return [t[1:] for t in PRE_TOKEN.findall(" " + text)]
    return text.split(" ")


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model))


def count_pieces(tokens: list[str], model: str) -> list[int]:
    """Pieces of each pre-token. The library puts no mark before an empty string: a lone mark is one piece."""
    return [len(ids) if t else 1 for t, ids in zip(tokens, processor(model).encode(tokens, num_threads=1), strict=True)]


def count_texts(texts: list[str], model: str = MODEL) -> list[int]:
    """Pieces of each text, for operators that need a count on the row itself: each worker keeps a bounded table of pre-tokens."""
    table = kept(("token counts", model), dict)
    if len(table) > KNOWN:
        table.clear()
    cut_texts = [pre_tokens(t) for t in texts]
    missing = list(set().union(*cut_texts) - table.keys())
    table.update(zip(missing, count_pieces(missing, model), strict=True))
    counts = [sum(map(table.__getitem__, c)) for c in cut_texts]
    for token in missing:
        if len(token) > LONG:
            del table[token]
    return counts


def frequencies(docs: DataFrame) -> DataFrame:
    """token, times: the distinct pre-tokens of up to LONG characters."""
    import pyarrow as pa

    text_batches(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(t, n) for t, n in found.items() if len(t) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["token", "times"])

        for batch in batches:
            for (text,) in rows_of(batch, "text"):
                found.update(pre_tokens(text or ""))
            if len(found) > GATHERED:
                yield flush()
                found.clear()
        yield flush()

    return docs.select("text").mapInArrow(gather, "token string, times long").groupBy("token").agg(F.sum("times").alias("times"))


def head_of(table: DataFrame) -> list[str]:
    """The tokens of table (token, times) from the least power of two that no more than HEAD_ROWS of them reach."""
    by_size = {r["power"]: r["count"] for r in table.groupBy(F.floor(F.log2("times")).cast("int").alias("power")).count().collect()}
    total, least = 0, 63
    for power in range(62, -1, -1):
        total += by_size.get(power, 0)
        if total > HEAD_ROWS:
            break
        least = power
    return [r["token"] for r in table.where(F.col("times") >= 1 << least).select("token").toLocalIterator()]


def products(pairs: DataFrame, model: str) -> DataFrame:
    """pairs (token, row, times) -> row, n: times the token's pieces, each distinct token counted once."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, int] = (None, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(0).dictionary_encode()
            names = runs.dictionary.to_pylist()
            # Rows are in the order of their tokens, so only the first may have been counted.
            known = names[0] == last[0]
            counts = [last[1]] * known + count_pieces(names[known:], model)
            last = names[-1], counts[-1]
            n = np.array(counts, np.int64)[runs.indices.to_numpy()] * batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n)], ["row", "n"])

    return pairs.repartition("token").sortWithinPartitions("token").mapInArrow(run, "row long, n long")


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    import pyarrow as pa

    spark = docs.sparkSession
    sampled = docs.where(F.pmod(F.xxhash64(text_or_empty()), F.lit(SAMPLE)) == 0)
    frequent = head_of(cut(frequencies(sampled)))
    head = spark.sparkContext.broadcast(dict(zip(frequent, count_pieces(frequent, model), strict=True)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = head.value.get
        for batch in batches:
            names, times, ends, counts, sizes = [], [], [0], [], []
            for (text,) in rows_of(batch, "text"):
                text = text or ""
                freq = Counter(pre_tokens(text))
                pieces = list(map(get, freq))
                missing = [t for t, n in zip(freq, pieces, strict=True) if n is None]
                long = [t for t in missing if len(t) > LONG]
                rest = [t for t in missing if len(t) <= LONG] if long else missing
                names += rest
                times += map(freq.__getitem__, rest)
                ends.append(len(names))
                here = sum(n * freq[t] for t, n in zip(long, count_pieces(long, model), strict=True))
                counts.append(here + sum(map(mul, (n or 0 for n in pieces) if missing else pieces, freq.values())))
                sizes.append(len(text.encode("utf-8", "replace")))
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int32())], ["token", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), lists], ["row", "doc_id", "n_bytes", "n_head", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Row numbers hold from here on: the pass is run once.
    joined = cut(rows.mapInArrow(join, "row long, doc_id long, n_bytes long, n_head long, tail array<struct<token:string,times:int>>"))
    tail = joined.select("row", F.explode("tail").alias("t")).select("t.token", "row", "t.times")
    sums = products(tail, model).groupBy("row").agg(F.sum("n").alias("n_tail"))
    n_tokens = F.col("n_head") + F.coalesce("n_tail", F.lit(0))
    counted = joined.drop("tail").join(sums, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
