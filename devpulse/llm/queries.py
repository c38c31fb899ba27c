"""The registered queries of this subpackage, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devpulse.llm import decontamination, divergence, embedding_dedup, embedding_whitening, html_text, language_id, lm_scoring, mixing, near_dedup, substring_dedup, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


RULES = [
    url_filter.rule("block", "net/"),
    url_filter.rule("allow", "example.net/en/"),
    url_filter.rule("block", "example.com/de/"),
    url_filter.rule("allow", "org/fr/"),
]
_FITS = {
    r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    for r in sorted(RULES, key=lambda r: -len(r.text))
}
_TERMS = " + ".join(
    f"(CASE WHEN regexp_matches(lowered, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END)" for t, w in url_filter.VOCABULARY.items()
)


@query(
    "op1_embedding_near_dedup",
    """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.vec_id WHERE r.c < l.b),
least_id AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM embeddings v LEFT JOIN counts c USING (vec_id) JOIN least_id m USING (vec_id)""",
)
def _(spark, sf_dir):
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query(
    "op2_substring_dedup",
    r"""
WITH doc_words AS (SELECT doc_id, coalesce([x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''], []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM doc_words WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM starts),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM ranked WHERE k > 1),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(d.w) AS n, coalesce(len(l.ps), 0) AS m,
    CASE WHEN l.ps IS NULL THEN d.w ELSE coalesce(k.w, []) END AS w
  FROM doc_words d LEFT JOIN lists l USING (doc_id)
  LEFT JOIN (
    SELECT x.doc_id, list(x.word ORDER BY x.p) AS w
    FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM doc_words) x
    ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id) k ON k.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(w, ' ')) AS kept_sha256 FROM kept""",
)
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.kept_digests(docs, substring_dedup.repeated_passages(docs))


@query(
    "op3_url_filter",
    rf"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
  FROM pages)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {fit} THEN '{r.text}'" for r, fit in _FITS.items())} END AS rule,
  CASE {" ".join(f"WHEN {fit} THEN '{r.verdict}'" for r, fit in _FITS.items())}
    WHEN {_TERMS} >= 1 THEN 'block' ELSE 'allow' END AS verdict
FROM parts""",
)
def _(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op4_benchmark_decontamination",
    r"""
WITH item_words AS (
  SELECT item_id, [x for x in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') for i in generate_series(1, len(w) - least(len(w), 10) + 1)]) AS win
  FROM item_words WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, coalesce([x for x in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''], []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, w, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc_words CROSS JOIN sizes WHERE len(w) >= size),
met AS (
  SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON x.size = p.size AND x.win = array_to_string(p.w[p.i:p.i + p.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)""",
)
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_spans(docs, _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.col("found.items").cast("array<string>"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


@query("op5_html_extraction")
def _(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "text")


@query("op6_lm_scoring")
def _(spark, sf_dir):
    return lm_scoring.score(_table(spark, sf_dir, "documents"), ~language_id.held_out("doc_id", 5, 1))


@query("op7_language_id")
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out("doc_id", 3, 1)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.profiles(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


#: how far the shares of each dimension are evened out: sources fully, languages and topics in part
MIX = {"source": 0.0, "lang": 0.7, "topic": 0.7}


@query("op8_mixing")
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.topic().alias("topic"), mixing.n_tokens().alias("n_tokens"))
    return mixing.mixed(docs, MIX)


@query("op9_toxicity")
def _(spark, sf_dir):
    docs, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    out = language_id.held_out("doc_id", 5, 0)
    terms = toxicity.fit(docs, labels.where(~out))
    return toxicity.score(docs.select("doc_id", "text"), terms).select("doc_id", out.alias("held_out"), "score", "predicted")


@query(
    "op10_minhash_near_dedup",
    r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, coalesce([x for x in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''], []) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') for i in generate_series(1, len(w) - least(len(w), 5) + 1)]) AS s
  FROM doc_words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM doc_words UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.c < l.b),
least_id AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM doc_words d LEFT JOIN sizes z USING (doc_id) JOIN least_id m USING (doc_id)""",
)
def _(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def _(spark, sf_dir):
    found = embedding_whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


#: the tokenizer whose tokens are counted
TOKENIZER = "byte_bpe_50k.json"


@query("op12_token_counts")
def _(spark, sf_dir):
    import public_tokenizers  # the files' place on this machine; the driver alone reads one

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query(
    "op13_source_divergence",
    r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
  FROM documents),
occurring AS (
  SELECT row_no, lang, source, unnest([x for x in string_split_regex(lowered, '[\x00-\x40\x5B-\x60\x7B-\x7F]+') if x <> '']) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM occurring GROUP BY ALL HAVING count(DISTINCT row_no) >= 30),
here AS (SELECT lang, source, term, count(*) AS n FROM occurring GROUP BY ALL),
all_groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(h.n, 0) AS n
  FROM all_groups g JOIN kept k ON k.lang = g.lang LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000 * (CAST(n AS HUGEINT) + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
    1 + (1000000000 * (CAST(lang_n AS HUGEINT) + 5)) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS total
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.total, 0) AS BIGINT) AS value
  FROM all_groups a JOIN all_groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
)
def _(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))
