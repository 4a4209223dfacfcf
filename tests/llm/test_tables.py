"""Neighbours, mixing, URLs and archives against brute force."""

import gzip
import hashlib
import io
import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from viewtide.llm import mixing, nearest, url_filter, warc
from viewtide.llm.common import tokenizer_file
from viewtide.llm.queries import RULES

SF = "/root/testdata/sf0.001"


def product(v, w):
    total = 0.0
    for a, b in zip(v, w, strict=True):
        total += float(a) * float(b)
    return total


def brute_neighbours(rows, every, k):
    """rows: [(id, vector)], ids distinct."""
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = sorted((-product(v, w), j) for j, w in rows if j != i)
            out[i] = scored[:k]
    return out


def found_neighbours(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((-r.score, r.vec_id))
    return out


def recall(found, wanted):
    hits = sum(len({i for _, i in found[q]} & {i for _, i in w}) for q, w in wanted.items())
    return hits / sum(map(len, wanted.values()))


def test_neighbours_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    wanted = brute_neighbours(rows, 20, 20)
    found = found_neighbours(nearest.nearest(df, F.col("vec_id") % 20 == 0))
    assert found.keys() == wanted.keys() and recall(found, wanted) >= 0.9
    by_pair = {(q, i): s for q, w in brute_neighbours(rows, 20, len(rows)).items() for s, i in w}
    assert all(math.isclose(s, by_pair[q, i], abs_tol=1e-12) and len(v) == 20 for q, v in found.items() for s, i in v)


def test_a_search_meets_fewer_vectors_than_there_are():
    """Queries of the larger table: the distinct vectors in the leaves that they visit, and how many of the nearest are among them."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.unique(np.array(table.column("embedding").to_pylist(), np.float64), axis=0)
    n = len(x)
    forest = nearest.fit(x, n, 4, float(np.sqrt((x * x).sum(axis=1).max())), 7)
    ids = forest.leaf_of(x) + np.arange(forest.trees) * forest.leaves
    sizes = np.bincount(ids.ravel(), minlength=forest.trees * forest.leaves)
    queries = x[::20]
    paths = forest.walk(queries, sizes, min(4.0, nearest.share_to_visit(forest, x, 20, 0.93, n)) * n)
    met = [np.isin(ids, p).any(axis=1) for p in paths]
    best = np.argsort(-(queries @ x.T), axis=1)[:, :20]
    assert np.mean([m.sum() for m in met]) < 0.85 * n
    assert np.mean([m[b].mean() for m, b in zip(met, best, strict=True)]) >= 0.9


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).round(1).tolist()) for i in range(60)] + [(100 + i, [0.5] * 8) for i in range(40)] + [(200, [1000.0] * 8)]
    bad = [(300, None), (320, [0.0] * 8), (340, [1.0] * 7 + [None]), (360, [float("nan")] * 8), (380, [float("inf")] * 8), (400, [1.0] * 5), (420, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 0.1) for i, v in rows + bad + rows[:5]], "vec_id long, embedding array<double>, c string, score double")
    wanted = brute_neighbours(rows, 20, 20)
    found = found_neighbours(nearest.nearest(df, F.col("vec_id") % 20 == 0, recall=1.0))
    assert found.keys() == wanted.keys()
    for q, w in wanted.items():
        assert [i for _, i in found[q]] == [i for _, i in w]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert {q: len(v) for q, v in found_neighbours(nearest.nearest(few, F.lit(True))).items()} == {0: 2, 1: 2, 2: 2}
    assert nearest.nearest(df.where("false"), F.lit(True)).count() == 0
    assert nearest.nearest(df.where("vec_id = 320"), F.lit(True)).count() == 0


def test_groups_and_blocks(spark, monkeypatch):
    """Many small groups, parts of leaves and blocks of queries give what one gives."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, n in (("GROUP_MEMBERS", 20), ("GROUP_QUERIES", 4), ("MERGE", 2)):
        monkeypatch.setattr(nearest, name, n)
    wanted = brute_neighbours(rows, 20, 20)
    assert recall(found_neighbours(nearest.nearest(df, F.col("vec_id") % 20 == 0)), wanted) >= 0.9


def brute_shares(total, children):
    """children: {name: (weight, capacity)} -> budget, by filling up step by step."""
    got, open_ = dict.fromkeys(children, 0.0), set(children)
    while open_ and total > 1e-9:
        weights = sum(children[c][0] for c in open_)
        if not weights:
            break
        share = {c: total * children[c][0] / weights for c in open_}
        full = {c for c in open_ if got[c] + share[c] >= children[c][1]}
        if not full:
            for c in open_:
                got[c] += share[c]
            break
        for c in full:
            total -= children[c][1] - got[c]
            got[c] = children[c][1]
        open_ -= full
    return got


TREE = mixing.Tree(
    {"web": tuple(f"src{i}" for i in range(8)), "books": ("src8", "src9", "src10"), "none": ("src11",)},
    {("web",): 2.0, ("books",): 9.0, ("other",): 1.0, ("none",): 0.0, ("web", "en"): 3.0, ("web", "de"): 1.0, ("web", "en", "src3"): 1e9, ("other", "fr"): 0.0},
)


@pytest.mark.parametrize(("share", "epochs", "bits"), [(0.9, 2, 2), (0.3, 1, 10), (5.0, 3, 10)])
def test_mixing_equals_brute_force(spark, docs, documents, monkeypatch, share, epochs, bits):
    """Budgets by filling up, and every row's copies by its leaf's documents in the seeded order; doc_ids that several texts have."""
    import sentencepiece

    monkeypatch.setattr(mixing, "DIGIT_BITS", bits)
    monkeypatch.setattr(mixing, "ORDERED_ROWS", 3)
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    again = [(documents[0][0], "another text of the same id", "en", "src3"), (documents[0][0], "another text of the same id", "de", "src19"), (None, "no id", "en", "src3"), (None, "none either", "en", "src3")]
    rows = documents + again
    docs = docs.unionByName(spark.createDataFrame(again, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    domain = {s: d for d, sources in TREE.domains.items() for s in sources}
    path_of = [(domain.get(s or "?", "other"), x or "?", s or "?") for _, _, x, s in rows]
    size = [len(pieces.encode(t or "")) for _, t, *_ in rows]
    tokens = defaultdict(int)
    for p, k in zip(path_of, size, strict=True):
        tokens[p] += k
    below = lambda path: sum(v for p, v in tokens.items() if p[: len(path)] == path)
    weight = lambda path: TREE.weights.get(path, below(path) ** mixing.SMOOTHING)

    def capacity(path):
        if not weight(path):
            return 0
        return epochs * tokens[path] if len(path) == 3 else sum(capacity(c) for c in {p[: len(path) + 1] for p in tokens if p[: len(path)] == path})

    leaf = {}

    def down(path, total):
        if len(path) == 3:
            leaf[path] = math.floor(round(total, 3))
            return
        children = {p[: len(path) + 1] for p in tokens if p[: len(path)] == path}
        for c, got in brute_shares(total, {c: (weight(c) if capacity(c) else 0.0, capacity(c)) for c in children}).items():
            down(c, got)

    down((), share * sum(tokens.values()))
    full = {p: leaf[p] // tokens[p] if tokens[p] else 0 for p in tokens}
    keys = spark.createDataFrame([(i, full[p], d, t or "") for i, (p, (d, t, *_)) in enumerate(zip(path_of, rows, strict=True))], "i long, mix_epochs long, doc_id long, text string")
    order = {r.i: r.o for r in keys.withColumn("mix_text", F.xxhash64("text")).select("i", mixing.order_of(mixing.SEED).alias("o")).collect()}
    copies = [0] * len(rows)
    for p in tokens:
        mine = [i for i in range(len(rows)) if path_of[i] == p and size[i]]
        rest = leaf[p] - full[p] * tokens[p]
        for o in sorted({order[i] for i in mine}):
            same = [i for i in mine if order[i] == o]
            rest -= sum(size[i] for i in same)
            for i in same:
                copies[i] = full[p] + (rest >= 0)
    wanted = sorted(((d, *p, k, n) for (d, *_), p, k, n in zip(rows, path_of, size, copies, strict=True)), key=str)
    chosen = mixing.choices(docs, share, epochs, TREE)
    assert sorted(map(tuple, chosen.collect()), key=str) == wanted
    assert sorted(map(tuple, mixing.choices(docs.repartition(2), share, epochs, TREE).collect()), key=str) == wanted
    out = mixing.mixed(docs, share=share, max_epochs=epochs, tree=TREE)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.select("doc_id", "text", "lang", "source").collect()), key=str) == sorted((r for r, n in zip(rows, copies, strict=True) for _ in range(n)), key=str)
    assert 0 < sum(copies) and not sum(n for n, p in zip(copies, path_of, strict=True) if p[0] == "none" or p[:2] == ("other", "fr"))


def test_mixing_of_nothing(docs):
    assert mixing.choices(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).count() == 0


@pytest.mark.parametrize("total", [0.0, 5.0, 40.0, 333.3, 1e9])
def test_division_by_bins_equals_filling_up(spark, monkeypatch, total):
    """Many children in few bins, equal ratios, and weights of zero."""
    monkeypatch.setattr(mixing, "BINS", 1)
    rng = np.random.default_rng(4)
    children = {("p", i): (float(rng.choice([0, 0.5, 1, 1, 3, 7.7])), float(rng.choice([0, 1, 2, 5, 8.5, 100]))) for i in range(60)}
    frame = spark.createDataFrame([(k[0], k[1], *v, total) for k, v in children.items()], "p string, i long, mix_weight double, mix_capacity double, mix_total double")
    found = {("p", r.i): r.mix_budget for r in mixing.divide(frame, ["p"]).collect()}
    wanted = brute_shares(total, children)
    assert found.keys() == wanted.keys() and all(math.isclose(found[k], wanted[k], abs_tol=1e-6) for k in wanted)


def test_shortages_go_to_siblings_first(spark):
    """A leaf that has too little is made up for by its sibling, not by the other domain."""
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("b", "x", "3", 1000)], "mix_domain string, mix_lang string, mix_source string, mix_tokens long")
    w = {("a",): 1.0, ("b",): 1.0, ("a", "x"): 1.0, ("b", "x"): 1.0, ("a", "x", "1"): 1.0, ("a", "x", "2"): 1.0, ("b", "x", "3"): 1.0}
    got = {r.mix_source: r.mix_budget for r in mixing.budgets(leaves, 400 / 2010, 1, mixing.Tree(weights=w)).collect()}
    assert got == {"1": 10, "2": 190, "3": 200}
    got = {r.mix_source: r.mix_budget for r in mixing.budgets(leaves.where("mix_source <> '2'"), 400 / 1010, 1, mixing.Tree(weights=w)).collect()}
    assert got == {"1": 10, "3": 390}


URLS = [
    (1, "https://EN.Example.COM/en/7x"), (2, "http://a.com/en/1"), (3, "http://notexample.com/en/7"), (4, "ftp://x.net/de/"), (5, "http://example.net/de/81?q#f"), (6, "http://xexample.net/de/81"),
    (7, "http://a.org/es"), (8, "http://a.org/es/"), (9, None), (10, "no scheme"), (11, "http://h?x://y/z"), (12, "http://h#f"), (13, "http://a.org/p//"), (14, "https://A.org/p?x=1"), (15, "http://com/en/"),
    (16, "://host/p"), (17, "http://a.org/P"), (None, "http://a.org/p"), (14, "https://A.org/p?x=1"), (18, "http://a.org/new\nline"), (19, ""), (20, "http://a.org/" + "long/" * 300_000), (21, "x" * 1_000_000), (22, "http://" + "h" * 1_000_000),
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def test_urls_equal_brute_force(spark):
    extra = ("by_rule", "verdict", "host", "path", "rule", "listed", "block", "w0")
    pages = spark.createDataFrame([(*u, "x", *("y" for _ in extra)) for u in URLS], f"page_id long, url string, canonical string, {', '.join(f'{c} string' for c in extra)}").repartition(3)
    listed = url_filter.urls_of_hosts(pages, ["a", "net"])
    rows = url_filter.judge(pages, RULES, listed).collect()
    name = lambda h, p: h and h + p.rstrip("/")
    on = {name(*brute_url(u)) for _, u in URLS if {"a", "net"} & set(brute_url(u)[0].split("."))}
    wanted = []
    for i, u in URLS:
        host, path = brute_url(u)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        canonical = name(host, path)
        wanted.append((i, host, path, best and best.text, best.verdict if best else "block" if canonical in on else "allow", canonical))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))
    assert {r.verdict for r in rows} == {"allow", "block"}
    assert url_filter.judge(pages.where("false"), RULES, listed).count() == 0
    assert url_filter.judge(pages, [], listed.where("false")).where("verdict <> 'allow'").count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('host/', id) canonical")
    n = 3000 * url_filter.BITS_PER_URL // url_filter.BLOCK_BITS
    blocks = url_filter.bloom_blocks(listed, n).cache()
    asked = spark.range(13_000).selectExpr("concat('host/', id) canonical")
    passed = {r.canonical for r in url_filter.passes(asked, blocks, n).collect()}
    assert {f"host/{i}" for i in range(3000)} <= passed and len(passed) < 3200
    assert url_filter.on_list(asked, listed).count() == 3000


PAGES = [(5, "http://a", "x" * 150), (3, "http://b", "x" * 150), (9, None, "x" * 150), (1, "http://c", "short"), (2, "http://d", "short"), (4, "http://e\r\nEvil: 1", None), (None, "http://f", "x" * 150), (3, "http://b", "x" * 150), (7, "", "é" * 50), (8, "u", "é" * 50), (10, "v", "é" * 49), (11, "w", "<p>\r\n\r\nWARC/1.1\r\n" * 9000), (12, "w", ""), (5, "http://z", "y" * 200)]


def test_archives_equal_brute_force(spark):
    table = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    for pages in (PAGES, [(i + 100, u, h) for i, u, h in table]):
        df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
        rows = warc.read_archives(warc.write_archives(df)).collect()
        first = {}
        for i, _, h in pages:
            if i is not None and len((h or "").encode()) >= 100:
                first[h] = min(i, first.get(h, i))
        wanted = []
        for i, _, h in pages:
            body = (h or "").encode()
            to = first.get(h) if i is not None and h in first and i > first[h] else None
            wanted.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if to is not None else "response", to, None if to is not None else body))
        assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows])) == sorted(map(str, wanted))
    assert warc.read_archives(warc.write_archives(df.where("false"))).count() == 0


def test_reader_is_strict():
    good = warc.record_bytes(1, "u", b"p" * 300_000, None) + warc.record_bytes(2, "u", b"p", 1)
    assert gzip.decompress(good).count(b"WARC/1.1\r\n") == 2
    assert [h["WARC-Type"] for h, _ in warc.read_records(io.BytesIO(good))] == ["response", "revisit"]
    plain = gzip.decompress(warc.record_bytes(1, "u", b"payload", None))
    for bad in (plain.replace(b"payload", b"pay1oad"), plain + b"more", plain[:-6], plain.replace(b"WARC/1.1", b"WRAC/1.1"), plain.replace(b"Content-Length: ", b"Content-Length: 1"), plain.replace(b"Payload-Length: 7", b"Payload-Length: 8")):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(good[:-10])))


def test_revisits_are_held_against_their_responses(spark, tmp_path):
    """A revisit of a page that isn't there, or that has another payload."""
    folder = f"file://{tmp_path}"
    for name, records, fits in (
        ("good", [(1, b"p" * 100, None), (2, b"p" * 100, 1)], True),
        ("other", [(1, b"q" * 100, None), (2, b"p" * 100, 1)], False),
        ("none", [(3, b"p" * 100, None), (2, b"p" * 100, 1)], False),
    ):
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(warc.record_bytes(i, "u", body, to) for i, body, to in records))
        archives = spark.createDataFrame([(f"{tmp_path}/{name}.warc.gz", folder, 2)], "path string, folder string, n_records long")
        if fits:
            assert sorted(r.page_id for r in warc.read_archives(archives).collect()) == [1, 2]
        else:
            with pytest.raises(warc.BadRecord):
                warc.read_archives(archives)
