"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Candidates of a text: assignments, access keys and long hexadecimal runs, and beside them tokens that look random. Each
candidate's value is hashed, and over the whole corpus the documents (repositories) and sources (owners) that hold it
are counted. A value that many owners hold is an example that was copied; one that few hold looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import row_mark, stored

# Fixed patterns of the candidates.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RANDOM = r"[A-Za-z0-9+/_-]{24,}"
SPANS = "array<struct<start:int,end:int,place:int,kind:string,value:string>>"
KINDS = ("assign", "access", "hex", "random")
#: Owners from which on a value counts as a copied example.
WIDE_OWNERS = 3


def _matches(text: Column, pattern: str, kind: str, quick: Column, value: str | None = None, least: int = 1) -> Column:
    """Array of (start, end, kind's place, kind, value): leftmost matches that don't overlap, by code points.

    Splitting by the pattern gives what stands between the matches; with the matches' own lengths that gives places.
    quick is a cheap condition without which there is no match.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern)
    pairs = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), lambda x: F.length(x)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        end = at + F.length(x["hit"])
        held = F.regexp_extract(x["hit"], value, 1) if value else x["hit"]
        new = F.struct(at.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), held.alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(held) >= least, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    return F.when(quick, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))


def candidates(text: Column) -> Column:
    """All candidates of a text, by start and then kind as listed: an array of structs. Null text counts as empty.

    Random-looking tokens need a digit and letters of either case, and no overlap with another candidate.
    """
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    base = F.concat(_matches(t, ASSIGN, "assign", named & t.rlike(ASSIGN), ASSIGN_VALUE, 12), _matches(t, ACCESS, "access", t.contains("AKIA")), _matches(t, HEX, "hex", t.rlike(HEX)))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    random = F.filter(_matches(t, RANDOM, "random", t.rlike(RANDOM)), lambda x: mixed(x["value"]))
    return F.array_sort(F.concat(base, F.filter(random, lambda x: ~F.exists(base, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))))


def ownership(found: DataFrame, doc: str = "doc_id", owner: str = "source") -> DataFrame:
    """value_hash, documents, owners: over all candidates of found(doc, owner, spans). Null owners count as one owner.

    Copies of a row count once. Both counts aggregate in part before the shuffle: first distinct triples, then pairs.
    """
    rows = found.select(F.col(doc).alias("doc"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"), F.explode("spans").alias("span"))
    triples = rows.select(F.sha2("span.value", 256).alias("value_hash"), "owner", "doc").groupBy("value_hash", "owner", "doc").agg(F.lit(1).alias("one"))
    pairs = triples.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("documents"))
    return pairs.groupBy("value_hash").agg(F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("owners"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """mark, spans, live, of each document with candidates, once: live are hashes of the values that look live.

    A document is known by its id and text, so repeated rows share their verdict. Texts are searched once: the rows with
    candidates, few as a rule, are stored. A value that one owner repeats in many documents is counted there in parts.
    """
    found = docs.select(row_mark(id_col, text_col).alias("mark"), F.col(id_col).alias("doc_id"), F.col(owner_col).alias("source"), candidates(F.col(text_col)).alias("spans"))
    few = stored(found.where(F.size("spans") > 0), "secrets-found")
    # copies of a row under one mark may name several owners; each counts
    live = ownership(few.withColumn("doc_id", F.col("mark"))).where(F.col("owners") < wide_owners).select("value_hash")
    once = few.groupBy("mark").agg(F.first("spans").alias("spans"))
    held = once.select("mark", F.explode("spans").alias("span")).select("mark", F.sha2("span.value", 256).alias("value_hash")).distinct()
    verdicts = held.join(live, "value_hash").groupBy("mark").agg(F.collect_set("value_hash").alias("live"))
    return once.join(verdicts, "mark", "left")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, one row for each document row.

    Base spans are all there, whatever the ownership says; spans adds random-looking tokens whose value looks live.
    n_live and n_example part all candidates by ownership. Null and empty texts have no spans. Repeated rows stay. Ids
    may be of any type and null; a null owner counts as one owner. An empty table gives no rows.
    """
    none = F.array().cast(SPANS)
    found = judged(docs, id_col, text_col, owner_col, wide_owners)
    out = docs.select(F.col(id_col).alias("doc_id"), row_mark(id_col, text_col).alias("mark")).join(found, "mark", "left").withColumn("__spans", F.coalesce("spans", none)).drop("spans")
    lives = lambda x: F.coalesce(F.array_contains("live", F.sha2(x["value"], 256)), F.lit(False))
    base = F.filter("__spans", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("__spans", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.filter("__spans", lambda x: (x["kind"] != "random") | lives(x))).alias("spans"),
        F.size(F.filter("__spans", lives)).cast("long").alias("n_live"),
        F.size(F.filter("__spans", lambda x: ~lives(x))).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", wide_owners: int = WIDE_OWNERS, mask: str = "[secret]") -> DataFrame:
    """The rows with every live-looking value replaced by the mask, all other columns as they are; ``n_chars`` is counted anew.

    Rows without such a value pass unchanged, null and empty texts too. Only the value is masked, not the name that it is
    assigned to. Repeated rows stay and fare alike.
    """
    order = docs.columns
    found = judged(docs, id_col, text_col, owner_col, wide_owners).where("live IS NOT NULL")
    out = docs.withColumn("__mark", row_mark(id_col, text_col)).join(found.select(F.col("mark").alias("__mark"), F.col("spans").alias("__spans"), F.col("live").alias("__live")), "__mark", "left")
    spans = F.filter("__spans", lambda x: F.array_contains("__live", F.sha2(x["value"], 256)))
    # later spans first would move nothing; a fold from the left keeps where it stands and skips what a span before covers
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        begin = x["end"] - F.length(x["value"])
        grown = F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, begin - acc["at"]), F.lit(mask))
        return F.when(begin < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), grown.alias("text")))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    hit = F.col("__live").isNotNull()
    out = out.withColumn("__new", F.when(hit, done).otherwise(F.col(text_col)))
    if "n_chars" in order:
        out = out.withColumn("n_chars", F.when(hit, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn(text_col, F.col("__new")).select(*order)
