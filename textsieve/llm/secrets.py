"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Candidates are what three patterns find (assign, access, hex) and mixed tokens (24 or more characters of
[A-Za-z0-9+/_=-] with a capital, a small letter and a digit). Every candidate's value is hashed; over the whole corpus
a hash has so many documents (distinct texts, in place of repositories) and so many sources (owners). A value in at most
`max_owners` sources is owner-specific and looks live, in however many documents these have it; one that more sources
have is an example. Documents are reported and do not decide.

Ownership decides what is added to the base spans: the value of each base candidate that looks live, as a span of kind
`live`, and each mixed token that looks live and lies in no base span, as kind `token`. So a widely copied example has its
base span alone.

Spans are kind:start:end in code points, end exclusive, by start, then by kind as listed in KINDS.

Defined cases: a null or empty text has no spans; a null source counts as one owner; repeated rows are documents of
their own and count once in the frequencies if text and source agree; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import Workspace, split_by_keys, texts

KINDS = ("assign", "access", "hex", "token", "live")
#: The patterns of the base kinds, group of the value, least length of that group.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "token": (r"[A-Za-z0-9+/_=-]{24,}", 0, 24),
}
#: A text without this cannot hold a match of the kind; tested first, as it is cheap.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{32}", "token": r"[A-Za-z0-9+/_=-]{24}"}


def found(text: Column, kind: str) -> Column:
    """array<struct<kind int, start, end, value>> of a kind's matches, in code points.

    The pieces between matches and the matches themselves take turns in the text, so running lengths give positions.
    """
    pattern, group, least = PATTERNS[kind]
    whole, value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    each = F.transform(F.arrays_zip(whole.alias("m"), value.alias("v"), F.transform(F.slice(gaps, 1, F.size(whole)), lambda g: F.length(g)).alias("g")), lambda x: F.struct(x["g"].alias("g"), F.length(x["m"]).alias("n"), x["v"].alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["v"].alias("value"))
        ok = F.length(x["v"]) >= least
        if kind == "token":
            ok = ok & x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]") & x["v"].rlike("[0-9]")
        return F.struct((start + x["n"]).alias("at"), F.when(ok, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return F.when(text.rlike(HINTS[kind]), F.aggregate(each, zero, step, lambda acc: acc["out"])).otherwise(none)


def scan_secrets(docs: DataFrame, max_owners: int = 1) -> DataFrame:
    """(doc_id, mark, spans array<struct<start, kind, end, value_hash, documents, owners, live, value_start>>) for every row of docs; mark is xxhash64 of the text."""
    work = Workspace(docs.sparkSession, "secrets")
    rows = texts(docs, "source").select("doc_id", F.xxhash64("text").alias("mark"), F.col("source").cast("string").alias("source"), *(found(F.col("text"), k).alias(k) for k in PATTERNS))
    rows = work.write(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "mark", "source", F.concat(*PATTERNS).alias("found")), "found")
    each = rows.where(F.size("found") > 0).select("rid", "mark", "source", F.explode("found").alias("f"))
    each = work.write(each.select("rid", "mark", "source", F.col("f.kind").alias("kind"), F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.sha2("f.value", 256).alias("value_hash"), (F.col("f.end") - F.length("f.value")).alias("value_start")), "each")
    # one row per value, source and text first, then per value and source, so that no value's rows meet at once
    per = each.groupBy("value_hash", "source", "mark").agg(F.lit(1).alias("one")).groupBy("value_hash", "source").agg(F.count(F.lit(1)).alias("documents"))
    frequency = work.write(per.groupBy("value_hash").agg(F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("owners")), "frequency")
    live = F.col("owners") <= max_owners
    judged = each.join(frequency, "value_hash").where(live | (F.col("kind") < KINDS.index("token")))
    one = F.struct("start", "kind", "end", "value_hash", "documents", "owners", live.alias("live"), "value_start")
    by_row = work.write(judged.groupBy("rid").agg(F.sort_array(F.collect_list(one)).alias("s")), "judged")
    base = F.filter("s", lambda x: x["kind"] < KINDS.index("token"))
    inside = lambda x: F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    spans = F.filter("s", lambda x: (x["kind"] < KINDS.index("token")) | ~inside(x))
    empty = F.array().cast(by_row.schema["s"].dataType)
    return rows.select("rid", "doc_id", "mark").join(by_row, "rid", "left").select("doc_id", "mark", F.coalesce(spans, empty).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["kind"] < KINDS.index("token"))
    plain = lambda x, start, kind: F.struct(start.alias("start"), kind.alias("kind"), x["end"].alias("end"))
    own = F.transform("spans", lambda x: plain(x, x["start"], x["kind"]))
    live = F.transform(F.filter(base, lambda x: x["live"]), lambda x: plain(x, x["value_start"], F.lit(KINDS.index("live"))))
    every = F.array_sort(F.concat(own, F.array_distinct(live)))  # one value may be found by two kinds
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return scanned.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"))


def redact(docs: DataFrame, instead: str = "[SECRET]", max_owners: int = 1) -> DataFrame:
    """docs with `instead` in place of every span that looks live; n_chars, if there is such a column, follows.

    Only rows that may have such spans are joined, by id and a hash of the text; the others' texts are not moved.
    """
    live = F.filter("spans", lambda x: x["live"])
    hits = scan_secrets(docs, max_owners).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), live.alias("_spans")).where(F.size("_spans") > 0)
    hits = Workspace(docs.sparkSession, "redact").write(hits.dropDuplicates(["_id", "_mark"]), "hits")
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))  # by position, so that no name can clash
    doc_id, own = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    others, maybe = split_by_keys(rows, F.xxhash64(doc_id.cast("long")), hits.select(F.xxhash64("_id").alias("k")))
    text = F.coalesce(own, F.lit(""))
    joined = maybe.join(hits, doc_id.cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_mark")), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(instead))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = F.col("_mark").isNotNull()
    columns = {c: F.col(f"c{k}") for k, c in enumerate(names)}
    columns["text"] = F.when(changed, cut).otherwise(own)
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length(cut)).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return others.toDF(*names).unionByName(joined.select(*(columns[c].alias(c) for c in names)))
