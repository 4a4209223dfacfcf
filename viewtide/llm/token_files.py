"""Token ids as flat binary files.

Format of a shard: ``NAME.ids`` holds the ids of its documents one after another as little-endian unsigned integers of 16
bits, or of 32 where the vocabulary has more ids than that (the report of a shard says which), ``NAME.off`` one more little-endian unsigned 64-bit integer than it has documents (where each begins, counted in ids, and
the end), ``NAME.doc`` the doc_ids as 64-bit integers (the smallest one stands for null). Shards hold ascending doc_id
ranges; a shard's base, the ids before it, is the prefix sum over the shards' sizes, so a document's place in the whole
is base + offset. Readers map the files into memory and touch only the pages they need.

A task writes its shard under a name of its own and reports it; only reported shards are read, so a task that ran twice or
died half-way leaves a file that nobody looks at. The reports, a row for each shard, are kept in the shared folder.

Where the vocabulary's file says that white space is dropped (``word_cut``), texts are cut into words at ASCII white space,
which no token crosses, and each distinct word is encoded once per worker; the table is bounded and starts anew when full. Texts
for any other vocabulary go to the library whole.

Defined results: a null text counts as empty, and an empty document has the end id alone; a null doc_id comes first;
repeated doc_ids keep the order of their texts; other columns are ignored; an empty table gives no shards and no rows; a very
long text is encoded whole, and its ids are written in one piece.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, kept, open_fs, rarely_collect, rows_of, shared_folder, text_batches, tokenizer_file

MODEL = "word_bpe_49k.json"
END_ID = 1
NO_DOC = -(2**63)
#: Words that a worker's table holds, and the longest word it keeps.
TABLE_ROWS = 800_000
TABLE_BYTES = 64


#: The settings of a vocabulary's file under which lower-cased words can be cut here, all but the cutting pattern.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
#: Words that are cut here have printable ASCII and Latin-1 letters only; what ``\\p{L}`` and ``\\p{N}`` are among those.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
LETTERS, DIGITS = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"


def word_cut(path: str) -> tuple[re.Pattern, list[str]] | None:
    """From a vocabulary's file: the pattern that cuts a normalised plain word, and the added tokens in lower case. None unless the file normalises and cuts by SPLIT and BYTE_LEVEL."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    cutters = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (cutters[0].get("pattern") or {}).get("Regex", "")
    added = [a["content"].lower() for a in d.get("added_tokens") or ()]
    as_known = (
        d.get("normalizer") == NORMALIZER and len(cutters) == 2 and cutters[0] == SPLIT | {"pattern": {"Regex": pattern}} and BYTE_LEVEL.items() <= cutters[1].items()
        and d["model"].get("type") == "BPE" and not d["model"].get("dropout") and not d.get("truncation") and not any(c.isspace() for a in added for c in a)
    )
    # Classes of characters are known only within brackets, and no match may hold white space.
    if not as_known or re.search(r"\\[pPsS]| ", re.sub(r"\[\^\\s[^]]*\]|\[(\\p\{\w+\})*\]", "", pattern)):
        return None
    return re.compile(pattern.replace(r"\p{L}", LETTERS).replace(r"\p{N}", DIGITS)), added


class WordIds:
    """word (UTF-8) -> its ids as little-endian integers of ``kind``, through the library.

    The library's own normalising and cutting are the slow part, so words of ASCII and Latin-1 letters are lower-cased and
    cut here, and what they are cut into goes to the library's model, once for each distinct piece of a word; all other
    words go through the whole library. Two bounded generations of tables keep what is frequent.
    """

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        rarely_collect()
        path = tokenizer_file(model)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_kind(model)
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.cuts: dict[str, bytes] = {}
        known = word_cut(path)
        self.by_words = known is not None
        self.pattern, self.added = known or (None, [])
        # What every added token has may be looked for first.
        self.hint = os.path.commonprefix(self.added) if self.added else "\n"

    def turn(self) -> None:
        if len(self.words) > TABLE_ROWS // 2:
            self.old_words, self.words = self.words, {}
        if len(self.cuts) > TABLE_ROWS // 2:
            self.cuts = {}

    def add(self, words: list[bytes]) -> None:
        slow, cuts, get, model, size = [], self.cuts, self.cuts.get, self.tokenizer.model, int(self.kind[2:])
        for word in words:
            text = word.decode()
            low = text.lower()
            if not PLAIN.fullmatch(text) or self.hint in low and any(a in low for a in self.added):
                slow.append(word)
                continue
            parts = self.pattern.findall(low)
            found = [get(p) for p in parts]
            for i, ids in enumerate(found):
                if ids is None:
                    p = parts[i]
                    tokens = model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS))
                    ids = b"".join([x.id.to_bytes(size, "little") for x in tokens])
                    found[i] = ids
                    if len(p) <= TABLE_BYTES:
                        cuts[p] = ids
            self.words[word] = b"".join(found)
        for at in range(0, len(slow), 4096):
            part = slow[at : at + 4096]
            for word, ids in zip(part, self.whole([w.decode() for w in part]), strict=True):
                self.words[word] = ids

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the library alone."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_chars() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


@lru_cache(maxsize=4)
def id_kind(model: str) -> str:
    """The smallest of 16 and 32 bits that holds the vocabulary's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_file(model)).get_vocab_size() <= 1 << 16 else "<u4"


def word_ids(model: str) -> WordIds:
    return kept(("token files", model), lambda: WordIds(model))


def encode_texts(texts: list[str], model: str = MODEL) -> list[bytes]:
    """The ids of each text as little-endian integers of id_kind(model), without an end id."""
    table = word_ids(model)
    if not table.by_words:
        return table.whole(texts)
    table.turn()
    # bytes.split() splits at ASCII white space, no more.
    words = [t.encode("utf-8", "replace").split() for t in texts]
    missing = set().union(*words) - table.words.keys()
    again = missing & table.old_words.keys()
    table.words.update(zip(again, map(table.old_words.__getitem__, again), strict=True))
    table.add(list(missing - again))
    out = [b"".join(map(table.words.__getitem__, w)) for w in words]
    for word in missing:
        if len(word) > TABLE_BYTES:
            del table.words[word]
    return out


def write_token_files(docs: DataFrame, model: str = MODEL, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes docs in ascending doc_id order. Returns a row for each shard: shard, path, n_docs, n_ids, base, folder, kind."""
    import pyarrow as pa

    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or shared_folder(spark, "token-ids")
    kind = id_kind(model)
    end = np.array([end_id], kind).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
        sizes, n_docs = [0], 0
        files = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(rows_of(batch, "doc_id", "text"))
            files = files or {x: fs.open_output_stream(f"{path}.{x}") for x in ("ids", "off", "doc")}
            for ids in encode_texts([t or "" for _, t in rows], model):
                files["ids"].write(ids)
                files["ids"].write(end)
                sizes.append(len(ids) // len(end) + 1)
            files["doc"].write(np.array([NO_DOC if d is None else d for d, _ in rows], "<i8").tobytes())
            n_docs += len(rows)
        if files:
            ends = np.cumsum(np.array(sizes, "<u8"))
            files["off"].write(ends.astype("<u8").tobytes())
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([int(ends[-1])], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = cut(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).withColumn("folder", F.lit(folder)).withColumn("kind", F.lit(kind))


class Integers:
    """A file's integers by slices: mapped where the file system is local, elsewhere read range by range."""

    def __init__(self, fs, path: str, kind: str):
        from pyarrow import fs as pafs

        self.kind, self.size = np.dtype(kind), fs.get_file_info(path).size // np.dtype(kind).itemsize
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = None if local else fs.open_input_file(path)
        self.map = np.memmap(path, kind, mode="r") if local and self.size else np.zeros(0, kind)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.file is None:
            return self.map[part]
        a, z, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at(max(0, z - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)


def read_token_files(shards: DataFrame, digest_only: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as 32-bit integers), and unless digest_only the ids."""
    import pyarrow as pa

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder, base, kind in rows_of(batch, "path", "folder", "base", "kind"):
                fs, _ = open_fs(folder)
                ids, off, doc = Integers(fs, f"{path}.ids", kind), Integers(fs, f"{path}.off", "<u8"), Integers(fs, f"{path}.doc", "<i8")
                for at in range(0, len(doc), 1000):
                    spans = list(zip(off[at : at + 1000].tolist(), off[at + 1 : at + 1001].tolist(), strict=False))
                    cols = [
                        pa.array([None if d == NO_DOC else d for d in doc[at : at + 1000].tolist()], pa.int64()),
                        pa.array([base + a for a, _ in spans], pa.int64()),
                        pa.array([z - a for a, z in spans], pa.int64()),
                        pa.array([zlib.crc32(ids[a:z].astype("<u4")) for a, z in spans], pa.int64()),
                    ]
                    if not digest_only:
                        cols.append(pa.array([ids[a:z].astype(np.int64) for a, z in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    # A task for each shard: the rows are few, what they stand for isn't.
    n = max(1, min(shards.count(), 10_000))
    return shards.repartition(n, "shard").mapInArrow(read, kinds)
