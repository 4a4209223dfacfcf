"""The pipeline against the brute-force versions of its stages, one after another."""

import numpy as np

import corpus_pipeline
from tests.llm.test_texts import SECRETS, brute_similar, brute_spans
from viewtide.llm import fertility, merge_dropout, mixing
from viewtide.llm.queries import MIX

FILLER = " The river ran past an old stone mill where nobody had ground any corn for a hundred years, {0} and the children of the village {0} used to climb over its broken wheel on summer evenings to look for nests, coins and whatever else the {0} water left behind."


def clean(text):
    out, at, merged = "", 0, []
    for a, _, kind, z in brute_spans(text)[1]:
        if merged and merged[-1][1] > a:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z, kind])
    for a, z, kind in merged:
        out, at = f"{out}{text[at:a]}[{kind}]", z
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, documents, tmp_path):
    rows = documents + [(400_000 + i, FILLER.format(i) + t[:300], "en", f"src{i}") for i, t in enumerate(SECRETS)] + [(500_000, FILLER.format(0) + SECRETS[0], "en", "src0")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], columns)
    folder = f"file://{tmp_path}"
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    tables = fertility.token_tables(tuple(fertility.VOCABULARIES.values()))
    kept = [r for r in rows if fertility.judge(r[1] or "", r[2], tables.tokens([r[1] or ""])[0], tables, fertility.BANDS, 50, 0.5)[fertility.KEPT]]
    label = list(range(len(kept)))
    for i, j in brute_similar([t for _, t, *_ in kept]):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    least = {x: min((r[0] for r, y in zip(kept, label, strict=True) if y == x and r[0] is not None), default=None) for x in label}
    first, seen = [], set()
    for r, x in zip(kept, label, strict=True):
        if r[0] is None or (r[0] == least[x] and x not in seen):
            seen.add(x if r[0] is not None else None)
            first.append(r)
    safe = [(i, clean(t or ""), x, s, len(clean(t or ""))) for i, t, x, s in first]
    assert len(rows) > len(kept) > len(first) and any(f"[{k}]" in r[1] for r in safe for k in ("assign", "access"))
    # The mixture has its own brute-force test; here its choices are carried to the rows, which no doc_id tells apart from others.
    chosen = mixing.choices(spark.createDataFrame(safe, columns), tree=MIX).collect()
    copies = {r.doc_id: r.mix_copies for r in chosen}
    assert len(copies) == len(safe)
    wanted = sorted((r for r in safe for _ in range(copies[r[0]])), key=str)
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == wanted
    e = merge_dropout.Encoder(merge_dropout.MODEL, merge_dropout.SEED, merge_dropout.RATE)
    assert all(e.decode(np.array(r.piece_ids, "<u2").tobytes()).decode() == r.text for r in found)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixture", "encoding"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
