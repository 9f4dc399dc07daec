"""Secret scans over an incremental ledger of content-addressed blobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridwarden.llm.shared import cut, find_spans, no_spans, whole

_ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
           r"([A-Za-z0-9+/_.=-]+)")

#: The rules, in the order of their kinds. Per kind its version, what a text must
#: hold for a search, the pattern, and the length that a match (of its group) has at least.
RULES = {
    "assign": (1, r"(?i)password|passwd|secret|token|api_?key", _ASSIGN, 12),
    "access": (1, r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", 18),
    "hex": (1, r"[0-9a-f]{16}", r"[0-9a-f]{16,}", 16),
    "pem": (1, r"PRIVATE KEY-----", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+"
            r"(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?", 0),
    "jwt": (1, r"eyJ", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0),
    "github": (1, r"gh[pousr]_", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    "slack": (1, r"xox[abpr]-", r"xox[abpr]-[A-Za-z0-9-]{10,}", 0),
}
BASE = ("assign", "access", "hex")
MARK = "[SECRET]"

_FINDING = "struct<rule:string,version:int,start:bigint,end:bigint,value:string>"
_LEDGER = f"blob string, scanned array<string>, findings array<{_FINDING}>"


def _search(text, rule):
    version, hint, pattern, least = RULES[rule]
    spans = F.when(text.rlike(hint), find_spans(text, pattern)).otherwise(no_spans())
    if least:
        held = (lambda v: F.regexp_extract(v, pattern, 1)) if "assign" == rule else (lambda v: v)
        spans = F.filter(spans, lambda s: F.char_length(held(s["value"])) >= least)
    return F.transform(spans, lambda s: F.struct(
        F.lit(rule).alias("rule"), F.lit(version).alias("version"), s["start"].alias("start"),
        s["end"].alias("end"), s["value"].alias("value")))


def blob_id(text):
    return F.sha2(whole(text), 256)


def read_ledger(spark, path) -> DataFrame:
    """blob, scanned (rule@version) and findings, a row per blob; empty before the first scan."""
    try:
        rows = spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _LEDGER)
    return rows.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"),
        F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))


def scan(docs: DataFrame, ledger, rules=tuple(RULES)) -> int:
    """Scans what the ledger has not seen, appends it there and returns how many blobs it was.

    docs: doc_id, text; every historical version of a path is a row. A version is addressed by
    its SHA-256, so a blob under many paths is scanned once. Each blob meets the rules whose
    present version it has not met; one that has met all is left alone. A blob's text comes
    from its row with the smallest doc_id.
    """
    spark = docs.sparkSession
    current = F.array(*[F.lit(f"{r}@{RULES[r][0]}") for r in rules])
    rows = docs.select("doc_id", blob_id(F.col("text")).alias("blob"),
                       whole(F.col("text")).alias("text"))
    seen = read_ledger(spark, ledger).select("blob", "scanned")
    todo = rows.groupBy("blob").agg(F.min("doc_id").alias("first")).join(seen, "blob", "left")
    todo = todo.select(F.col("blob").alias("wanted"), "first", F.array_except(
        current, F.coalesce("scanned", F.array().cast("array<string>"))).alias("scanned")).where(
        F.size("scanned") > 0)
    unseen = rows.join(todo.hint("shuffle_hash"), [
        F.col("blob") == F.col("wanted"), F.col("doc_id").eqNullSafe(F.col("first"))]).select(
        "blob", "text", "scanned")
    findings = F.concat(*[F.when(
        F.array_contains("scanned", f"{r}@{RULES[r][0]}"), _search(F.col("text"), r)).otherwise(
        F.array().cast(f"array<{_FINDING}>")) for r in rules])
    found = cut(unseen.select("blob", "scanned", findings.alias("findings"))
                .dropDuplicates(["blob"]))
    found.write.mode("append").parquet(ledger)
    return found.count()


def known_findings(spark, ledger, rules=tuple(RULES)) -> DataFrame:
    """blob and spans (rule, start, end, value; by start, then in the rules' order) of the
    ledger's blobs that have any. Findings of earlier rule versions are left out."""
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r), F.lit(i))])
    valid = [f"{r}@{RULES[r][0]}" for r in rules]
    met = read_ledger(spark, ledger).select("blob", F.filter("findings", lambda f: F.concat_ws(
        "@", f["rule"], f["version"].cast("string")).isin(valid)).alias("found"))
    ordered = F.sort_array(F.transform("found", lambda f: F.struct(
        f["start"].alias("start"), number[f["rule"]].alias("at"), f["end"].alias("end"),
        f["rule"].alias("rule"), f["value"].alias("value"))))
    return met.where(F.size("found") > 0).select("blob", F.transform(ordered, lambda s: F.struct(
        s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"),
        s["value"].alias("value"))).alias("spans"))


def findings(docs: DataFrame, ledger, rules=tuple(RULES)) -> DataFrame:
    """doc_id, blob and spans of every row, after a scan of what is new.

    Only blobs with a finding are joined back. Equal rows are each returned; a null text is an
    empty blob without findings; other columns are ignored.
    """
    scan(docs, ledger, rules)
    rows = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    none = F.array().cast("array<struct<rule:string,start:bigint,end:bigint,value:string>>")
    return rows.join(known_findings(docs.sparkSession, ledger, rules), "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, ledger, rules=tuple(RULES), mark=MARK) -> DataFrame:
    """docs with each secret in the text replaced by ``mark`` and n_chars, if there, counted
    anew. Overlapping spans become one mark; rows without a finding stay as they are."""
    scan(docs, ledger, rules)
    found = known_findings(docs.sparkSession, ledger, rules).select(
        F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    text = F.col("text")

    def step(state, span):
        new = span["start"] >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"),
                          (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(new, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
            .alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", start, step, lambda s: F.concat(
        s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text))))
    met = docs.join(found, blob_id(text) == F.col("_blob"), "left")
    new = F.when(F.col("_spans").isNotNull(), clean).otherwise(text)
    met = met.withColumn("text", new)
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(
            F.col("_spans").isNotNull(), F.char_length("text").cast("bigint")).otherwise(
            F.col("n_chars")))
    return met.select(*docs.columns)
