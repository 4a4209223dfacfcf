"""Secret scans with multipart credential linking, in DataFrame functions only.

Three kinds are always reported: assignments of secrets, access identifiers, and long hexadecimal runs. Three more are weak
on their own, and are reported only with a complementary part nearby: the name of an account (``ident``), an opaque run of
mixed characters (``opaque``), and an endpoint (``endpoint``). A part has a role - identifier (access, ident), secret
(assign, hex, opaque) or endpoint - and its scope reaches ``REACH`` code points to both sides within its document. A weak
identifier needs a secret in its scope, a weak secret an identifier or an endpoint, an endpoint a secret. Identifiers and
secrets must lie apart; an endpoint may hold the secret, and one with a user and a password before its host (``userinfo``,
which is a secret part but no kind of its own) is complete by itself. Parts meet in an interval join:
each is dealt to the cells of REACH code points that it covers, a weak one also to those that its scope covers, and cells are
joined by document and number before the intervals are compared. A cell holds few parts, however long the text.

A scan is one pass over the table: for each kind a test whether the pattern occurs at all, and where it does its matches and,
by splitting, what lies between them, so spans are running sums of lengths in code points. Only those lengths, for texts that
have a match, are kept, exploded and shuffled.

Defined results: a null text is empty, and texts without a span have an empty string and the digest of one; parts are
told apart by doc_id (null is one of its values) and a hash of the text, so repeated rows get equal results each; other
columns are ignored; an empty table gives no rows; a very long text is scanned whole, and its parts are linked by cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import around_extras, cut, text_or_empty

#: The patterns of the base kinds, as the contract states them.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The other two with the lengths that count: a shorter match fails, and none begins within another.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: The base kinds in their order, then the weak ones.
BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("ident", "opaque", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
#: What is looked for: the kinds, and a part that only completes others.
PART_KINDS = (*KINDS, "userinfo")
#: A run that begins and ends at a boundary and holds a digit, a capital and a small letter.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+"
IDENT = r"(?<![A-Za-z0-9])(?i:user(?:_?name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"
SCHEME = r"(?<![A-Za-z0-9])(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://"
ENDPOINT = SCHEME + r"[^\s\"'<>]+"
#: An endpoint up to the @ behind user:secret.
USERINFO = SCHEME + r"[^\s\"'<>/?#:@]*:[^\s\"'<>/?#]+@"
#: Code points to both sides within which parts belong together.
REACH = 256
#: Texts with spans that are broadcast for redaction, at most, with four times as many spans.
MARKS = 100_000
KEY = ["scan_doc", "scan_null", "scan_hash"]


def _cuts(text: Column, pattern: str, any_match: str, keep: Column | None = None, group: int = 0) -> Column:
    """Array of (gap before the match, its length, whether it counts), empty without a match. keep: a test of the group's text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), F.lit(True).alias("counts")))
    if keep is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        lengths = F.zip_with(lengths, values, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), keep(v).alias("counts")))
    empty = F.array().cast("array<struct<gap:int,size:int,counts:boolean>>")
    return F.when(F.regexp_like(text, F.lit(any_match)), lengths).otherwise(empty)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: the key, doc_id, and for each kind its cuts. This is the only pass over the texts."""
    text = text_or_empty()
    cuts = {
        "assign": _cuts(text, ASSIGN, ASSIGN, lambda v: F.char_length(v) >= 8, 2),
        "access": _cuts(text, ACCESS, ACCESS),
        "hex": _cuts(text, HEX, HEX),
        "ident": _cuts(text, IDENT, IDENT),
        "opaque": _cuts(text, OPAQUE, r"[A-Za-z0-9+/_-]{20}"),
        "endpoint": _cuts(text, ENDPOINT, "://"),
        "userinfo": _cuts(text, USERINFO, r"://[^\s@]*@"),
    }
    return docs.select("doc_id", *_key(text), *(cuts[k].alias(k) for k in PART_KINDS))


def _key(text: Column) -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).alias("scan_doc"), F.isnull("doc_id").alias("scan_null"), F.xxhash64(text).alias("scan_hash")]


def parts(scanned: DataFrame) -> DataFrame:
    """The parts of each distinct document: key, kind, rank (of the kind), start, end (code points)."""
    some = F.lit(False)
    for k in PART_KINDS:
        some = some | (F.size(k) > 0)
    kinds = F.array(*(F.struct(F.lit(i).alias("rank"), F.col(k).alias("cuts")) for i, k in enumerate(PART_KINDS)))
    rows = scanned.where(some).dropDuplicates(KEY).select(*KEY, F.explode(kinds).alias("k"))
    rows = rows.select(*KEY, F.col("k.rank").alias("rank"), F.posexplode("k.cuts").alias("at", "cut"))
    so_far = Window.partitionBy(*KEY, "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("cut.gap") + F.col("cut.size")).over(so_far)
    rows = rows.select(*KEY, "rank", "cut", end.alias("end")).where("cut.counts")
    return rows.select(*KEY, F.element_at(F.array(*map(F.lit, PART_KINDS)), F.col("rank") + 1).alias("kind"), "rank", (F.col("end") - F.col("cut.size")).alias("start"), "end")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts that have a complementary part in their scope."""
    role = F.when(F.col("kind").isin("access", "ident"), "id").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    found = found.withColumn("role", role)
    needs = F.when(F.col("role") == "secret", F.array(F.lit("id"), F.lit("endpoint"))).otherwise(F.array(F.lit("secret")))
    covered = F.explode(F.sequence(F.floor(F.col("from") / reach), F.floor((F.col("to") - 1) / reach)))
    other = found.select(*KEY, F.col("role").alias("needs"), F.col("rank").alias("other_rank"), F.col("start").alias("from"), F.col("end").alias("to")).withColumn("cell", covered)
    base = other.where(F.col("other_rank") < len(BASE_KINDS))
    weak = found.where(F.col("kind").isin(*WEAK_KINDS)).withColumn("needs", needs)
    # What overlaps a base part is that part in another pattern's eyes; an endpoint may hold it.
    weak = weak.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach))))
    over = [weak[c] == base[c] for c in (*KEY, "cell")] + [(base["from"] < weak["end"]) & (base["to"] > weak["start"])]
    seen = weak.where("role <> 'endpoint'").join(base, over, "left_semi").select(*KEY, "rank", "start").distinct()
    weak = weak.drop("cell").distinct().join(seen, [*KEY, "rank", "start"], "left_anti").withColumn("needs", F.explode("needs"))
    weak = weak.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))))
    same = [weak[c] == other[c] for c in (*KEY, "needs", "cell")]
    close = (other["from"] < weak["end"] + reach) & (other["to"] > weak["start"] - reach)
    apart = (other["from"] >= weak["end"]) | (other["to"] <= weak["start"])
    holds = (weak["role"] == "endpoint") & (other["from"] >= weak["start"]) & (other["to"] <= weak["end"])
    held = (weak["needs"] == "endpoint") & (other["from"] <= weak["start"]) & (other["to"] >= weak["end"])
    return weak.join(other, [*same, close, apart | holds | held], "left_semi").select(*KEY, "kind", "rank", "start", "end").distinct()


def spans(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """key -> spans: array of (start, rank, kind, end) in order, base kinds and linked weak ones, of documents that have one."""
    found = cut(parts(scanned))
    every = found.where(F.col("rank") < len(BASE_KINDS)).unionByName(linked(found, reach))
    return every.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, spans: array of (start, rank, kind, end), a row for each row of docs."""
    scanned = cut(scan(docs))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    joined = scanned.select("doc_id", *KEY).join(spans(scanned, reach), KEY, "left")
    return joined.select("doc_id", F.coalesce("spans", none).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The counts, the base spans' digest and the spans' text of find_secrets."""

    def text(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The rows of docs, their spans' text replaced by ``[kind]`` (the first kind of spans that overlap), n_chars adjusted where docs has it."""
    return around_extras(docs, {"doc_id", "text", "n_chars"}, lambda d: _redacted(d, reach))


def _redacted(docs: DataFrame, reach: int) -> DataFrame:
    scanned = cut(scan(docs))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"), F.element_at(done, -1)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
    )
    marks = cut(spans(scanned, reach).select(*(F.col(k).alias(f"{k}_") for k in KEY), merged.alias("scan_spans")))
    # Few marked texts with few spans go to the texts; else the texts go to them.
    size = marks.agg(F.count("*").alias("rows"), F.sum(F.size("scan_spans")).alias("spans")).first()
    if size["rows"] <= MARKS and (size["spans"] or 0) <= 4 * MARKS:
        marks = F.broadcast(marks)
    names = docs.columns
    text = F.col("text")
    rows = docs.select("*", *(c.alias(k) for c, k in zip(_key(text_or_empty()), KEY, strict=True)))
    rows = rows.join(marks, [F.col(k) == F.col(f"{k}_") for k in KEY], "left")
    n = F.size("scan_spans")
    after = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.concat(
            F.lit("["), F.element_at("scan_spans", i)["kind"], F.lit("]"),
            text.substr((F.element_at("scan_spans", i)["end"] + 1).cast("int"), F.when(i < n, (F.element_at("scan_spans", i + F.when(i < n, 1).otherwise(0))["start"] - F.element_at("scan_spans", i)["end"]).cast("int")).otherwise(F.lit(2**31 - 1))),
        ),
    )
    clean = F.concat(text.substr(F.lit(1), F.element_at("scan_spans", 1)["start"].cast("int")), F.array_join(after, ""))
    rows = rows.withColumn("scan_text", F.when(F.col("scan_spans").isNotNull(), clean).otherwise(text))
    keep = {"text": F.col("scan_text"), "n_chars": F.when(F.col("scan_spans").isNotNull(), F.char_length("scan_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in names else None}
    return rows.select(*(keep[c].alias(c) if c in keep else F.col(c) for c in names))
