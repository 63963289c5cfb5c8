"""Secret scans with an incremental blob ledger (DataFrame operations only).

Every text is content-addressed by SHA-256.  A ledger has a row for each pair of blob and rule version that was ever scanned; a
run scans only pairs that the ledger lacks, each blob once however many documents hold it, adds them with its own run number, and
joins the findings back to all documents.  Rules come in sets, one version each, so that a new or changed set is scanned without
scanning the others again.

Spans are code points, end exclusive.  A pattern's spans come from the text's pieces between matches and the matches
themselves: both are cut by the same leftmost, non-overlapping search, so running sums of their lengths are positions.

Cases: a null text is empty and has no spans; repeated rows share one blob and each get its findings; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common

#: Kinds in listed order: the pattern that finds spans, and the test that a match must pass besides.
BASE_RULES = {
    "assign": r"""((?i)password|passwd|secret|token|api_?key(?-i))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
METHOD_RULES = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{10,}",
}
RULES = BASE_RULES | METHOD_RULES
#: Rule version -> the kinds of its set.
RULE_SETS = {"base-1": tuple(BASE_RULES), "method-3": tuple(METHOD_RULES)}
SMALL = 500_000
FINDINGS = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, kind: int, pattern: str) -> Column:
    """array<struct<start, kind, end>> of a pattern's leftmost non-overlapping matches."""
    empty = F.array().cast(FINDINGS)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    step = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), (F.length(F.regexp_extract(m, pattern, 2)) if kind == 0 else F.lit(99)).alias("value")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        one = F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["len"]).alias("end")))
        return F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.when(x["value"] >= 6, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(step, start, add, lambda acc: acc["out"])).otherwise(empty)


def scan(text: Column, kinds: tuple[str, ...]) -> Column:
    """Findings of some kinds in text, sorted by start, then kind as listed."""
    return F.array_sort(F.concat(*[spans(text, k, RULES[name]) for k, name in enumerate(RULES) if name in kinds]))


def with_blob(df: DataFrame) -> DataFrame:
    return common.documents(df).withColumn("blob", F.unhex(F.sha2("text", 256)))


def unseen_blobs(docs: DataFrame, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """(blob, text) of each blob that the ledger lacks at this rule version; rows equal in id and text may come more than once.

    Only hashes and ids are grouped.  Each blob's row of the least doc_id is the one that is scanned; where few rows are not, they
    are taken out by a broadcast and no text is shuffled, else texts meet their blobs in a join on (blob, doc_id), in which no
    key is hot.
    """
    ids = docs.select("blob", "doc_id")
    seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct() if ledger is not None else None
    owners = ids.groupBy("blob").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    owners = owners.join(seen.withColumn("seen", F.lit(True)), "blob", "left") if seen is not None else owners.withColumn("seen", F.lit(None).cast("boolean"))
    owners = common.materialize(owners.select(F.col("blob").alias("_blob"), "owner", "n", F.coalesce("seen", F.lit(False)).alias("seen")), "owners")
    if not owners.where(~F.col("seen")).limit(1).count():
        return docs.limit(0).select("blob", "text")
    at = F.col("blob") == F.col("_blob")
    odd = owners.where(F.col("seen") | (F.col("n") > 1))
    if not common.is_small(odd, SMALL):
        wanted = owners.where(~F.col("seen"))
        return docs.join(wanted, at & F.col("doc_id").eqNullSafe(F.col("owner")), "left_semi").select("blob", "text")
    # blobs of one row that weren't scanned need no look-up; a blob that was scanned keeps no row
    joined = docs.join(F.broadcast(odd), at, "left")
    return joined.where(F.col("_blob").isNull() | (~F.col("seen") & F.col("doc_id").eqNullSafe(F.col("owner")))).select("blob", "text")


def extend_ledger(df: DataFrame, ledger: DataFrame | None = None, rule_sets: dict[str, tuple[str, ...]] = RULE_SETS) -> DataFrame:
    """(blob, rule_version, run, findings): the ledger, and a row for each pair of a blob of df and a rule version that it lacked."""
    docs = with_blob(df)
    run = 1 if ledger is None else (ledger.agg(F.max("run")).first()[0] or 0) + 1
    columns = ["blob", "rule_version", "run", "findings"]
    parts = [] if ledger is None else [ledger.select(*columns)]
    for version, kinds in rule_sets.items():
        found = unseen_blobs(docs, ledger, version).select("blob", scan(F.col("text"), kinds).alias("findings")).dropDuplicates(["blob"])
        parts.append(found.select("blob", F.lit(version).alias("rule_version"), F.lit(run).alias("run"), "findings"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return common.materialize(every, "secret-ledger")


def known(ledger: DataFrame, rule_sets: dict[str, tuple[str, ...]] = RULE_SETS) -> DataFrame:
    """(blob, found): the findings of all rule versions asked for, of blobs that have any, sorted by start, then kind."""
    rows = ledger.where(F.col("rule_version").isin(*rule_sets) & (F.size("findings") > 0))
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("found"))


def findings(df: DataFrame, ledger: DataFrame, rule_sets: dict[str, tuple[str, ...]] = RULE_SETS) -> DataFrame:
    """(doc_id, blob, findings) for every row of df."""
    rows = with_blob(df).select("doc_id", "blob").join(known(ledger, rule_sets), "blob", "left")
    return rows.select("doc_id", "blob", F.coalesce("found", F.array().cast(FINDINGS)).alias("findings"))


def span_string(found: Column, names: list[str]) -> Column:
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, ledger: DataFrame, rule_sets: dict[str, tuple[str, ...]] = RULE_SETS, mark: str = "[secret]") -> DataFrame:
    """df with each run of overlapping spans in text replaced by mark; n_chars, where present, follows.

    Few blobs with findings go out as a broadcast; else the rows that hold one are found by id, and texts meet their findings in
    a join on (blob, doc_id), so that a text of many copies isn't one task.
    """
    few = common.materialize(known(ledger, rule_sets), "secrets")
    rows = common.carry(df).withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    if common.is_small(few, SMALL // 5):
        joined = rows.join(F.broadcast(few), "blob", "left")
    else:
        held = rows.select("blob", "doc_id").distinct().join(few, "blob").select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_id"), "found")
        joined = rows.join(held, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text = F.col("text")
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # a span that starts before the last one's end only moves that end
        piece = F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("found", seed, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return common.restore(joined, df.columns, clean, F.col("found").isNotNull())


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of the base rules is extended by the method's: the second run scans no pair of the first again."""
    docs = common.read(spark, sf_dir, "documents")
    base = next(iter(RULE_SETS))
    ledger = extend_ledger(docs, extend_ledger(docs, None, {base: RULE_SETS[base]}))
    rows = findings(docs, ledger)
    names = list(RULES)
    base = F.filter("findings", lambda x: x["kind"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_string(base, names), 256).alias("base_sha256"),
        span_string(F.col("findings"), names).alias("spans"),
    )
