import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"

#: Texts that have gone wrong somewhere: empty, blank, one word, no white space, odd spaces, beyond the basic plane, U+2581.
ODD = ["", " ", "\n\n\t", "word", "a b", "x" * 20_000, "  two  spaces  ", "tab\tnew\nline\r\x0b\x0c", " no break ", "日本語 текст \U0001F600 é", "▁▁mark ▁ x", "<s></s><unk><|endoftext|> <0x41>", "ſecret: ABC İΣς K", "null \x00 byte"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents():
    """The small table's rows, odd texts, a null text, a null doc_id, a repeated row and a copy under another id."""
    d = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    rows = [(int(i), t, x, s) for i, t, x, s in zip(d.doc_id, d.text, d.lang, d.source, strict=True)]
    rows += [(100_000 + i, t, None, None) for i, t in enumerate(ODD)]
    rows += [(200_000, None, "en", "src1"), (None, "a text without an id, and token = abcdefgh1234", "en", "src1"), rows[3], (200_001, rows[3][1], "en", "src2")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    """documents as a DataFrame, with extra columns named as an operator's results are."""
    data = [(*r, len(r[1] or ""), "x", 1, "x", 1, "x", 1) for r in documents]
    extra = "fp string, spans int, near_dup_mark string, mix_copies int, scan_text string, extra_7_ int"
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
