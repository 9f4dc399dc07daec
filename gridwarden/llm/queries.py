"""The operators as registered queries over the given tables."""

from pyspark.sql import functions as F

from gridwarden.llm import (decontaminate, importance, language, middle, packing, pieces, pii,
                            quality, rules, secrets, sharding, simhash, warc)
from gridwarden.llm.shared import cut, whole
from gridwarden.session import fresh_path

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return keep


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(values):
    """Lower-case hex SHA-256 of the joined strings."""
    return F.sha2(F.array_join(values, ","), 256)


def remainder(column, divisor):
    return F.crc32(column.cast("string").cast("binary")) % divisor


def listed(spans, kind):
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(
        ":", s[kind], s["start"].cast("string"), s["end"].cast("string")))


def counted(spans, field, kind):
    return F.size(F.filter(spans, lambda s: s[field] == kind)).cast("bigint").alias(f"n_{kind}")


def contamination(docs, items):
    return decontaminate.contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", digest(F.col("items")).alias("items_sha256"),
        "contaminated")


@query("op1_decontamination", r"""
WITH items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT w[i:i + 12] AS words, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
          FROM items WHERE len(w) > 0) GROUP BY 1),
docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
places AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
           unnest(list_transform(range(1, len(w) - n + 2), lambda k: w[k:k + n - 1])) AS words
    FROM docs, (SELECT DISTINCT len(words) AS n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, ids FROM places JOIN windows USING (words)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, list(DISTINCT id ORDER BY id) AS ids
    FROM (SELECT doc_id, unnest(ids) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       CAST(coalesce(len(t.ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(t.ids, ','), '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs AS d LEFT JOIN hit_words AS h USING (doc_id) LEFT JOIN hit_items AS t USING (doc_id)
""")
def op1_decontamination(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def packed(docs):
    pieces = packing.cut_documents(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack_pieces(pieces)


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return packed(read(spark, sf_dir, "documents"))


@query("op3_personal_data")
def op3_personal_data(spark, sf_dir):
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["strict"])
    return found.withColumn("base", base).select(
        "doc_id", *[counted("base", "kind", k) for k in pii.KINDS],
        digest(listed("base", "kind")).alias("base_sha256"),
        F.array_join(listed("spans", "kind"), ",").alias("spans"))


def spans_sql(kinds):
    """SQL of (doc_id, place, kind, begins, ends, value) over documents: all matches of each
    (kind, pattern), placed by the lengths of the texts between them and of the matches."""
    return " UNION ALL ".join(f"""
    SELECT doc_id, {place} AS place, '{kind}' AS kind, begins, begins + length(value) AS ends, value FROM (
        SELECT doc_id, hits[i] AS value, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT)
               AS begins
        FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits,
                   regexp_split_to_array(text, '{pattern}') AS gaps FROM documents
            WHERE regexp_matches(text, '{pattern}'))))"""
        for place, (kind, pattern) in enumerate((k, p.replace("'", "''")) for k, p in kinds))


def listed_sql(base):
    """SQL of each document's counts and digest of its ``base`` kinds, and of all its spans,
    from a CTE ``kept`` with the columns of ``spans_sql``."""
    listed = "string_agg(kind || ':' || begins || ':' || ends, ',' ORDER BY begins, place)"
    of_base = f"kind IN ({', '.join(repr(k) for k in base)})"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)},
       sha256(coalesce(strict, '')) AS base_sha256, coalesce(every, '') AS spans
FROM documents LEFT JOIN (
    SELECT doc_id, {counts}, {listed} FILTER ({of_base}) AS strict, {listed} AS every
    FROM kept GROUP BY 1) USING (doc_id)"""


#: The base patterns as the contract has them, and the added rules.
_SECRETS_SQL = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
               r"([A-Za-z0-9+/_.=-]+)"),
    ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*"
            r"(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}"), ("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"))


@query("op4_secrets", f"""
WITH found AS ({spans_sql(_SECRETS_SQL)}),
kept AS (SELECT * FROM found WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(value, '{_SECRETS_SQL[0][1].replace("'", "''")}', 2)) >= 12
    WHEN 'access' THEN length(value) >= 18 WHEN 'hex' THEN length(value) >= 16 ELSE true END)
{listed_sql(("assign", "access", "hex"))}
""")
def op4_secrets(spark, sf_dir):
    found = secrets.findings(read(spark, sf_dir, "documents"), fresh_path(spark, "secret-ledger"))
    base = F.filter("spans", lambda s: s["rule"].isin(*secrets.BASE))
    return found.withColumn("base", base).select(
        "doc_id", *[counted("base", "rule", k) for k in secrets.BASE],
        digest(listed("base", "rule")).alias("base_sha256"),
        F.array_join(listed("spans", "rule"), ",").alias("spans"))


@query("op5_sharding")
def op5_sharding(spark, sf_dir):
    text = whole(F.col("text"))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.hilbert_shards(
        rows, ("source", "lang", "size"), ("text_crc32", "doc_id")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    return simhash.classes(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id")


@query("op7_language")
def op7_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    part = remainder(F.col("doc_id"), 3)
    model = language.fit(docs.where((part != 1) & F.col("lang").isNotNull()).select(
        "lang", "text", F.struct(F.xxhash64("doc_id"), F.col("doc_id")).alias("order")))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def scored(docs, labels):
    """docs with score and predicted, learnt from the labelled part of docs."""
    learnt = quality.fit(docs.where(remainder(F.col("doc_id"), 5) != 0), labels)
    return quality.score(docs, learnt).withColumn(
        "predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op9_warc", """
WITH bodies AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM bodies WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM bodies LEFT JOIN firsts USING (digest)
""")
def op9_warc(spark, sf_dir):
    path = fresh_path(spark, "archives")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.archived_pages(spark, path)


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rules.verdict(cut(rules.measure(docs).drop("text"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query("op11_sentencepiece")
def op11_sentencepiece(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, decoded=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_fill_in_middle", r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM documents),
numbers AS (
    SELECT doc_id, t, lines, CAST(len(lines) AS BIGINT) AS n,
           CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS a,
           CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed),
parts AS (
    SELECT doc_id, t, n, form,
           coalesce(array_to_string(lines[1:least(a, b)], ''), '') AS p,
           coalesce(array_to_string(lines[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
           coalesce(array_to_string(lines[greatest(a, b) + 1:], ''), '') AS s FROM numbers)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""")
def op12_fill_in_middle(spark, sf_dir):
    path = fresh_path(spark, "texts")
    middle.store_texts(read(spark, sf_dir, "documents"), path)
    made = middle.fill_in_middle(spark.read.parquet(path))
    return middle.digests(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


_CRC_SQL = """
steps AS MATERIALIZED (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
           xor(c >> 1, 3988292384 * (c & 1)), CAST(b AS BIGINT))) AS step),
hashed AS MATERIALIZED (
    SELECT f, xor(list_reduce(list_transform(range(CAST(strlen(f) AS BIGINT)), lambda i:
               CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT)), lambda c, b:
               xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT f FROM features UNION SELECT f FROM aims), steps)"""


@query("op13_importance", rf"""
WITH words AS MATERIALIZED (
    SELECT doc_id, false AS aim, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 0, true, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS MATERIALIZED (
    SELECT doc_id, aim, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i:
           w[i] || ' ' || w[i + 1]))) AS f FROM words),
features AS MATERIALIZED (SELECT doc_id, f, count(*) AS k FROM runs WHERE NOT aim GROUP BY 1, 2),
aims AS MATERIALIZED (SELECT f, count(*) AS k FROM runs WHERE aim GROUP BY 1),{_CRC_SQL},
counts AS (
    SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
        SELECT bucket, k AS s, 0 AS t FROM features JOIN hashed USING (f) UNION ALL
        SELECT bucket, 0, k FROM aims JOIN hashed USING (f)) GROUP BY 1),
gain AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((t + 1) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
           / ((s + 1) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS g FROM counts),
weights AS (
    SELECT doc_id, sum(k) AS n, floor(sum(k * g) / sum(k)) AS w
    FROM features JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY 1),
scores AS (
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
           CAST(coalesce(w, 0) AS BIGINT) AS weight,
           CAST(coalesce(w, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(
               '7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM documents AS d LEFT JOIN weights USING (doc_id)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 39
                                 ORDER BY score DESC, doc_id) AS place,
           count(*) FILTER (n_features >= 39) OVER () AS able FROM scores)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 39 AND place <= (25 * able) // 100 THEN place END AS rank
FROM ranked
""")
def op13_importance(spark, sf_dir):
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# -- base columns that have SQL where the whole result has none -----------------------------

_PERSONAL_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


@query("base_personal_data", f"""
WITH found AS (
    SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM ({spans_sql(_PERSONAL_SQL)})),
kept AS (SELECT * FROM found WHERE CASE kind
    WHEN 'ip' THEN list_max(list_transform(string_split(value, '.'),
        lambda x: coalesce(try_cast(x AS BIGINT), 256))) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(
        range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(digits[-i - 1] AS BIGINT)
        ELSE CAST(digits[-i - 1] AS BIGINT) * 2 - 9 * CAST(CAST(digits[-i - 1] AS BIGINT) > 4 AS BIGINT)
        END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15 ELSE true END)
SELECT * EXCLUDE (spans) FROM ({listed_sql(("email", "ip", "card", "phone"))})
""")
def base_personal_data(spark, sf_dir):
    """What op3 finds by its base patterns, without what its method adds."""
    return op3_personal_data(spark, sf_dir).drop("spans")


@query("base_quality_rules", r"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)),
               lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 6)) AS i,
           unnest(list_transform(range(1, len(w) - 6), lambda k: w[k:k + 7])) AS words
    FROM split WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, words) > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n
    FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM again) GROUP BY 1),
figures AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(n, 0) AS n_repeat_words
    FROM split LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures
""")
def base_quality_rules(spark, sf_dir):
    """The figures and base rules of op10, without its method's verdict."""
    return op10_quality_rules(spark, sf_dir).drop("kept")
