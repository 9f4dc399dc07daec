"""Queries over text, vector and match joins."""

from pyspark.sql import functions as F, Window as W

from gridwarden import sinks
from gridwarden.functions import constants as K
from gridwarden.operators import analytics, correlate, fuzzy, vectors
from gridwarden.plans import adapters as A, sql as S
from gridwarden.plans.registry import query
from gridwarden.session import fresh_path, materialize
from gridwarden.sources import flatten_nvd, load_nvd, read_snapshot

DIM = 64
RUN_TS = "2024-02-01T00:00:00"
ENCODER = vectors.hashing_encoder(DIM)


# -- vectors ------------------------------------------------------------------------------

_PAIRS = """SELECT a.vec_id AS query_id, b.vec_id AS ref_id,
    round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)
    + 0.0 AS d FROM embeddings a, embeddings b"""


def _nearest_sql(k):
    return f"""SELECT query_id, ref_id, round(d, 6) + 0.0 AS distance, CAST(rank AS INTEGER)
        AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id)
        AS rank FROM ({_PAIRS})) WHERE rank <= {k}"""


def _rounded(found):
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(_nearest_sql(3))
def nearest_vectors(spark, sf):
    refs = A.vectors(spark, sf)
    return _rounded(vectors.nearest(refs, refs, 3))


@query(_nearest_sql(1))
def nearest_vector(spark, sf):
    refs = A.vectors(spark, sf)
    return _rounded(vectors.nearest(refs, refs, 1))


@query(_nearest_sql(3))
def nearest_vectors_by_cell(spark, sf):
    """The same over many cells, cut into small pieces."""
    refs = A.vectors(spark, sf)
    return _rounded(vectors.nearest(refs, refs, 3, cells=16, left_rows=128, right_rows=128))


@query(f"""SELECT text, {S.vector('text', DIM)} AS embedding
    FROM (SELECT DISTINCT text FROM benchmark)""")
def embedded_texts(spark, sf):
    rows = vectors.embed_texts(A.table(spark, sf, "benchmark"), ENCODER)
    return rows.withColumn("embedding", F.col("embedding").cast("array<double>"))


@query(f"""WITH slots AS (SELECT text, {S.vector('text', DIM)} AS n FROM benchmark),
    weights AS (SELECT list(w ORDER BY i) AS ws FROM (SELECT i,
        ln((count(*) + 1.0::DOUBLE) / (count(*) FILTER (n[i] > 0) + 1)) AS w
        FROM slots, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY i)),
    weighted AS (SELECT DISTINCT text, list_transform(range(1, {DIM + 1}), lambda i:
        n[i] * ws[i]) AS v FROM slots, weights)
    SELECT text, list_transform(v, lambda x: CASE WHEN list_sum(list_transform(v, lambda y: y * y))
        > 0 THEN round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 5) ELSE 0 END)
        AS embedding FROM weighted""")
def weighted_texts(spark, sf):
    """Slots that few texts fall into weigh more."""
    texts = A.table(spark, sf, "benchmark")
    found = vectors.embed_texts(texts, vectors.weighted_encoder(texts, DIM))
    return found.withColumn("embedding", F.transform(
        "embedding", lambda x: F.round(x.cast("double"), 5) + F.lit(0.0)))


@query(f"""SELECT text, {S.vector('text', DIM)} AS embedding, min(item_id % 2) AS encoded_by
    FROM benchmark GROUP BY text""")
def cached_vectors(spark, sf):
    """Half of the texts, then all: the second call encodes only what the first has not."""
    path, texts = fresh_path(spark, "vectors"), A.table(spark, sf, "benchmark")
    vectors.embed_cached(texts.where("item_id % 2 = 0"), ENCODER, path)
    first = spark.read.parquet(path).select("text_id", F.lit(0).cast("long").alias("encoded_by"))
    found = vectors.embed_cached(texts, ENCODER, path)
    return _wide(found.withColumn("text_id", F.sha2("text", 256)).join(
        first, "text_id", "left").fillna({"encoded_by": 1}).drop("text_id"))


# -- reference tables -----------------------------------------------------------------------

_CVE_LISTED = """SELECT p_partkey AS pos, 'CVE-' || (p_partkey % 97) AS cve_id,
    p_name AS keyword, CASE WHEN p_size % 9 = 0 THEN '' ELSE 'Flaw in ' || p_name || ' ' || p_type
    END AS description, CASE WHEN p_size % 4 = 0 THEN NULL
    ELSE round(p_retailprice / 100, 1) END AS cvss_score FROM part"""


def _cve_listed(spark, sf):
    """Parts as a list with repeated ids, empty descriptions and missing scores."""
    return A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("CVE-"), F.col("p_partkey") % 97)
        .alias("cve_id"), F.col("p_name").alias("keyword"),
        F.expr("CASE WHEN p_size % 9 = 0 THEN '' ELSE concat('Flaw in ', p_name, ' ', p_type) END")
        .alias("description"),
        F.expr("CASE WHEN p_size % 4 = 0 THEN NULL ELSE round(p_retailprice / 100, 1) END")
        .alias("cvss_score"))


def _wide(df):
    return df.withColumn("embedding", F.col("embedding").cast("array<double>"))


@query(f"""SELECT cve_id, r.description AS description, r.keyword AS keyword,
    CAST(coalesce(r.cvss_score, 0) AS FLOAT) AS cvss_score,
    {S.vector('r.description', DIM)} AS embedding
    FROM (SELECT cve_id, max(struct_pack(pos := pos, description := description,
        keyword := keyword, cvss_score := cvss_score)) AS r FROM ({_CVE_LISTED})
        WHERE description <> '' GROUP BY cve_id)""")
def cve_reference(spark, sf):
    return _wide(correlate.build_cve_reference(_cve_listed(spark, sf), ENCODER))


_TECHNIQUES = f"""SELECT technique_id, description, name, tactic,
    {S.vector('description', DIM)} AS embedding FROM technique_items"""


@query(S.cte("technique_items") + _TECHNIQUES)
def technique_reference(spark, sf):
    return _wide(correlate.build_technique_reference(A.technique_items(spark, sf), ENCODER))


# -- software and vulnerabilities -------------------------------------------------------------

_SOFTWARE = """installed AS (SELECT host, name, trim(name || ' ' || unparsed_version) AS software,
    min(id) AS id FROM software GROUP BY ALL)"""

# Windows of the longer text against the shorter one, for every distinct pair of lengths
# that occur; the LCS of a window is the number of cleared bits after the fold.
_SCORES = """texts AS (SELECT DISTINCT lower(software) AS text FROM installed),
    keywords AS (SELECT DISTINCT lower(keyword) AS keyword FROM cve_items),
    pairs AS (SELECT text, keyword, text AS t, keyword AS s FROM texts, keywords
        WHERE length(keyword) <= length(text)
        UNION ALL SELECT text, keyword, keyword, text FROM texts, keywords
        WHERE length(keyword) >= length(text)),
    windows AS (SELECT DISTINCT s, w FROM (SELECT s, unnest(
        list_transform(range(1, length(t) - length(s) + 2), lambda i: substr(t, i, length(s)))
        || list_transform(range(1, length(s)), lambda n: substr(t, 1, n))
        || list_transform(range(1, length(s)), lambda n: right(t, n))) AS w FROM pairs)),
    masks AS (SELECT s, c, CAST(sum(CAST(1 AS BIGINT) << (p - 1)) AS BIGINT) AS m
        FROM (SELECT s, unnest(range(1, length(s) + 1)) AS p, substr(s, p, 1) AS c
              FROM (SELECT DISTINCT s FROM pairs)) GROUP BY s, c),
    alphabet AS (SELECT s, map_from_entries(list((c, m))) AS ms,
        (CAST(1 AS BIGINT) << length(s)) - 1 AS f FROM masks GROUP BY s),
    lcs AS (SELECT s, w, length(s) - bit_count(list_reduce(string_split(w, ''),
        lambda v, c: ((v + (v & coalesce(ms[c], 0))) | (v - (v & coalesce(ms[c], 0)))) & f, f))
        AS n FROM windows JOIN alphabet USING (s)),
    spans AS (SELECT text, keyword, s, unnest(
        list_transform(range(1, length(t) - length(s) + 2), lambda i: substr(t, i, length(s)))
        || list_transform(range(1, length(s)), lambda n: substr(t, 1, n))
        || list_transform(range(1, length(s)), lambda n: right(t, n))) AS w FROM pairs),
    scores AS (SELECT text, keyword, max(200.0 * n / (length(s) + length(w))) AS score
        FROM spans JOIN lcs USING (s, w) GROUP BY text, keyword)"""

_FIRST = """firsts AS (SELECT text, cve_id, min(struct_pack(pos := pos, cvss_score := cvss_score,
    description := description, score := score)) AS c
    FROM scores JOIN cve_items ON lower(cve_items.keyword) = scores.keyword
    WHERE score >= {threshold} GROUP BY text, cve_id),
    fuzzy AS (SELECT id, host, name, software, cve_id, c.cvss_score AS cvss_score,
        c.description AS description, c.score AS score, c.pos AS pos, 'fuzzy' AS match_type
        FROM installed JOIN firsts ON firsts.text = lower(software))"""

_SEMANTIC = f"""svec AS (SELECT software, {S.vector('software', DIM)} AS v
        FROM (SELECT DISTINCT software FROM installed)),
    rvec AS (SELECT cve_id, description, CAST(cvss_score AS FLOAT) AS cvss_score,
        {S.vector('description', DIM)} AS v FROM cve_items),
    ranked AS (SELECT software, cve_id, cvss_score, description,
        round(list_cosine_distance(svec.v, rvec.v), 9) + 0.0 AS distance, row_number() OVER (
        PARTITION BY software ORDER BY round(list_cosine_distance(svec.v, rvec.v), 9), cve_id)
        AS pos FROM svec, rvec),
    semantic AS (SELECT i.id, i.host, i.name, i.software, r.cve_id, r.cvss_score,
        r.description, r.distance, r.pos,
        'semantic' AS match_type FROM installed i JOIN ranked r USING (software)
        WHERE pos <= {K.NEIGHBOURS} AND distance <= {K.MAX_COSINE_DISTANCE})"""


def _cves(spark, sf):
    return A.cve_items(spark, sf)


_BASE = S.cte("software", "cve_items").rstrip() + ",\n" + _SOFTWARE


@query(_BASE + ",\n" + _SCORES + f""" SELECT text, keyword, round(score, 6) AS score FROM scores
    WHERE score >= {K.FUZZY_THRESHOLD}""")
def fuzzy_scores(spark, sf):
    texts = A.software(spark, sf).select(correlate.software_text(
        F.col("name"), F.col("unparsed_version")).alias("text"))
    return fuzzy.fuzzy_scores(texts, _cves(spark, sf)).withColumn("score", F.round("score", 6))


@query(_BASE + ",\n" + _SCORES + f""" SELECT text, keyword, round(score, 6) AS score FROM scores
    WHERE score >= {K.FUZZY_THRESHOLD}""")
def fuzzy_scores_by_block(spark, sf):
    """The way taken when the keywords are too many to broadcast."""
    texts = A.software(spark, sf).select(correlate.software_text(
        F.col("name"), F.col("unparsed_version")).alias("text"))
    return fuzzy.fuzzy_scores(
        texts, _cves(spark, sf), broadcast_keywords=0, left_rows=256, right_rows=32,
    ).withColumn("score", F.round("score", 6))


_FUZZY = ",\n".join([_BASE, _SCORES, _FIRST.format(threshold=K.FUZZY_THRESHOLD)])


_ONE_PER_KEY = "QUALIFY row_number() OVER (PARTITION BY host, name, cve_id ORDER BY id, pos) = 1"


@query(_FUZZY + f""" SELECT host, name, cve_id, id, pos, software, round(score, 6) AS score
    FROM fuzzy {_ONE_PER_KEY}""")
def fuzzy_matches(spark, sf):
    rows = correlate.fuzzy_match(A.software(spark, sf), _cves(spark, sf))
    return rows.withColumn("score", F.round("score", 6))


@query(_BASE + f""" SELECT i.host, i.name, c.cve_id, i.id, c.pos, i.software,
    CAST(100 AS DOUBLE) AS score FROM installed i JOIN cve_items c
    ON contains(lower(i.software), lower(c.keyword)) {_ONE_PER_KEY}""")
def contained_keywords(spark, sf):
    """A full score means that the keyword occurs in the software text."""
    return correlate.fuzzy_match(A.software(spark, sf), _cves(spark, sf), threshold=100)


def _reference(spark, sf):
    """The stored reference table, as the matching jobs read it."""
    root = fresh_path(spark, "store")
    rows = correlate.build_cve_reference(_cves(spark, sf), ENCODER)
    sinks.replace(rows, root, "cve_descriptions")
    return read_snapshot(spark, root, "cve_descriptions")


@query(_BASE + ",\n" + _SEMANTIC + f""" SELECT host, name, cve_id, id, pos, software,
    round(distance, 6) + 0.0 AS distance FROM semantic {_ONE_PER_KEY}""")
def semantic_matches(spark, sf):
    return _rounded(correlate.semantic_match(
        A.software(spark, sf), _reference(spark, sf), ENCODER))


_MATCHES = f""", both_kinds AS (
    SELECT host, name, cve_id, id, 0 AS match_rank, pos, software,
        CAST(cvss_score AS FLOAT) AS cvss_score, description, match_type FROM fuzzy
    UNION ALL SELECT host, name, cve_id, id, 1, pos, software, cvss_score, description,
        match_type FROM semantic),
    first_match AS (SELECT *, row_number() OVER (PARTITION BY host, name, cve_id
        ORDER BY id, match_rank, pos) AS place FROM both_kinds)
    SELECT 'cve_' || {S.digest('host', 'name', 'cve_id')} AS id,
        host || '|' || name || '|' || cve_id AS source_key, host, software, cve_id, cvss_score,
        description, match_type, '{RUN_TS}' AS ts FROM first_match WHERE place = 1"""
CVE_MATCHES_SQL = _FUZZY + ",\n" + _SEMANTIC + _MATCHES


@query(CVE_MATCHES_SQL)
def cve_matches(spark, sf):
    return correlate.match_software(
        A.software(spark, sf), _cves(spark, sf), _reference(spark, sf), ENCODER, RUN_TS)


# Every vulnerability is on a page found by the product's name and, with another score and text,
# on one found by the first word of it. Pages of a keyword hold up to ten items.
_PAGED = """found AS (SELECT keyword, cve_id, description, cvss_score, pos FROM cve_items
        UNION ALL SELECT split_part(keyword, ' ', 1), cve_id,
        'Again ' || description, round(cvss_score / 2, 1), pos FROM cve_items),
    paged AS (SELECT row_number() OVER (ORDER BY replace(keyword, ' ', '%20') || '/', pos) - 1
        AS pos, keyword, cve_id, description, cvss_score FROM found),
    last_listed AS (SELECT cve_id, arg_max(description, pos) AS description,
        arg_max(cvss_score, pos) AS cvss_score FROM paged GROUP BY cve_id)"""


def _write_pages(spark, sf, path):
    """Pages as they are downloaded, a folder per keyword."""
    items = _cves(spark, sf)
    found = items.unionByName(items.select(
        "pos", "cve_id", F.split_part("keyword", F.lit(" "), F.lit(1)).alias("keyword"),
        F.concat(F.lit("Again "), "description").alias("description"),
        F.round(F.col("cvss_score") / 2, 1).alias("cvss_score")))
    place = F.row_number().over(W.partitionBy("keyword").orderBy("pos"))
    pages = found.withColumn("page", F.floor((place - 1) / 10)).withColumn("item", F.expr("""
        named_struct('cve', named_struct('id', cve_id,
            'descriptions', array(named_struct('lang', 'en', 'value', description)),
            'metrics', named_struct('cvssMetricV31', array(named_struct(
                'cvssData', named_struct('baseScore', cvss_score))))))""")).groupBy(
        "keyword", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))),
                                           lambda x: x["item"]).alias("vulnerabilities"))
    pages.repartitionByRange("keyword", "page").sortWithinPartitions("keyword", "page").select(
        "keyword", "vulnerabilities").write.partitionBy("keyword").json(path)


@query(",\n".join([_BASE, _PAGED, _SCORES, _FIRST.format(threshold=K.FUZZY_THRESHOLD),
                   _SEMANTIC]).replace("DISTINCT lower(keyword) AS keyword FROM cve_items",
                                       "DISTINCT lower(keyword) AS keyword FROM paged")
       .replace("JOIN cve_items ON lower(cve_items.keyword)", "JOIN paged ON lower(paged.keyword)")
       .replace("AS v FROM cve_items)", "AS v FROM last_listed)") + _MATCHES)
def cve_matches_from_pages(spark, sf):
    """From downloaded pages to matches: a vulnerability's place in the list decides which of its
    listings counts."""
    path = fresh_path(spark, "pages")
    _write_pages(spark, sf, path)
    pages = load_nvd(spark, path, lines=True, positions=True)
    listed = materialize(flatten_nvd(pages, F.col("keyword")), "list")
    reference = correlate.build_cve_reference(listed, ENCODER)
    return correlate.match_software(A.software(spark, sf), listed, reference, ENCODER, RUN_TS)


# -- alerts and techniques ----------------------------------------------------------------------

TECHNIQUE_MATCHES_SQL = S.cte("alerts", "technique_items").rstrip() + f""",
    severe AS (SELECT *, note_type || ': ' || message AS text FROM alerts
        WHERE lower(severity) IN ('high', 'critical')),
    tvec AS (SELECT text, {S.vector('text', DIM)} AS v FROM (SELECT DISTINCT text FROM severe)),
    refs AS ({_TECHNIQUES}),
    ranked AS (SELECT text, technique_id, name, tactic,
        round(list_cosine_distance(v, embedding), 9) AS d, row_number() OVER (PARTITION BY text
        ORDER BY round(list_cosine_distance(v, embedding), 9), technique_id) AS place
        FROM tvec, refs)
    SELECT 'mitre_' || {S.digest('id', 'technique_id')} AS id,
        id || '|' || technique_id AS source_key, note_type AS alert_note_type,
        message AS alert_message, severity AS alert_severity, technique_id,
        name AS technique_name, tactic,
        CAST(round(1 - least(d, 1.0::DOUBLE), 3) AS FLOAT) AS similarity, '{RUN_TS}' AS ts
    FROM severe JOIN ranked USING (text) WHERE place = 1"""


@query(TECHNIQUE_MATCHES_SQL)
def technique_matches(spark, sf):
    root = fresh_path(spark, "store")
    rows = correlate.build_technique_reference(A.technique_items(spark, sf), ENCODER)
    sinks.replace(rows, root, "mitre_attack")
    reference = read_snapshot(spark, root, "mitre_attack")
    return correlate.match_techniques(A.alerts(spark, sf), reference, ENCODER, RUN_TS)


@query(f"SELECT source_key, similarity FROM ({TECHNIQUE_MATCHES_SQL}) "
       "ORDER BY similarity DESC NULLS LAST, source_key")
def closest_techniques(spark, sf):
    """The technique matches by similarity."""
    rows = technique_matches(spark, sf).select("source_key", "similarity")
    return analytics.by_score(rows, "similarity")


# The documents' texts in all their languages as alerts' messages, some without a word.
_TEXT_ALERTS = """text_alerts AS (SELECT CAST(doc_id AS VARCHAR) AS id, '' AS note_type,
    CASE WHEN doc_id % 10 = 0 THEN '...' ELSE coalesce(text, '') END AS message,
    'high' AS severity FROM documents)"""


def _text_matches(spark, sf):
    alerts = A.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("").alias("note_type"),
        F.when(F.col("doc_id") % 10 == 0, "...").otherwise(F.coalesce("text", F.lit("")))
        .alias("message"), F.lit("high").alias("severity"))
    reference = correlate.build_technique_reference(A.technique_items(spark, sf), ENCODER)
    return correlate.match_techniques(alerts, reference, ENCODER, RUN_TS)


@query(f"""WITH {_TEXT_ALERTS} SELECT id, severity, message = '...' AS wordless
    FROM text_alerts""")
def techniques_of_texts(spark, sf):
    """Every severe alert gets a technique, whatever its script."""
    return _text_matches(spark, sf).select(
        F.split_part("source_key", F.lit("|"), F.lit(1)).alias("id"),
        F.col("alert_severity").alias("severity"),
        (F.col("alert_message") == "...").alias("wordless"))


@query(S.cte("technique_items").rstrip() + f""", {_TEXT_ALERTS},
    texts AS (SELECT id, ': ' || message AS text FROM text_alerts),
    tvec AS (SELECT text, {S.vector('text', DIM)} AS v FROM (SELECT DISTINCT text FROM texts)),
    refs AS ({_TECHNIQUES}),
    ranked AS (SELECT text, technique_id, round(list_cosine_distance(v, embedding), 9) AS d,
        row_number() OVER (PARTITION BY text ORDER BY round(list_cosine_distance(v, embedding), 9),
        technique_id) AS place FROM tvec, refs WHERE list_sum(v) > 0 AND list_sum(embedding) > 0)
    SELECT id, coalesce(technique_id, (SELECT min(technique_id) FROM refs)) AS technique_id,
        CAST(coalesce(round(1 - least(d, 1.0::DOUBLE), 3), 0) AS FLOAT) AS similarity
    FROM texts LEFT JOIN (SELECT * FROM ranked WHERE place = 1) USING (text)""")
def technique_of_each_text(spark, sf):
    """Which technique each of these alerts gets, and how similar it is."""
    return _text_matches(spark, sf).select(
        F.split_part("source_key", F.lit("|"), F.lit(1)).alias("id"), "technique_id",
        "similarity")
