"""The queries of the numbered operators and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.llm.centroid_clusters import cluster
from sessionlore.llm.decontaminate import match_benchmark
from sessionlore.llm.hyperminhash import near_duplicates
from sessionlore.llm.language_id import identify, train
from sessionlore.llm.license_scan import scan_licenses
from sessionlore.llm.line_dedup import mark_lines
from sessionlore.llm.lm_score import score_documents
from sessionlore.llm.passage_dedup import remove_passages
from sessionlore.llm.piece_codec import encode_decode
from sessionlore.llm.secret_scan import BASE, RULES, scan, spans_text
from sessionlore.llm.token_counts import count_tokens
from sessionlore.llm.vector_dedup import link_vectors
from sessionlore.llm.whitening import whiten
from sessionlore.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def session(spark: SparkSession) -> SparkSession:
    """Settings of the library, and Arrow batches of few rows: texts can be long."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, folder: function(Source(session(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


class Source:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet").select(*columns)

    @property
    def documents(self) -> DataFrame:
        return self.read("documents", "doc_id", "text")


def _held_out(parts: int):
    """Documents kept away from learning: the remainder of crc32(doc_id as text) is 2."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(key, F.lit(parts)) == 2, F.lit(False)).alias("held_out")


@query("op1_lm_score")
def lm_score(source: Source) -> DataFrame:
    rows = source.read("documents", "doc_id", "text", "lang")
    found = score_documents(rows, public_tokenizers.path("piece_bpe_32k.model"), learn=~_held_out(7), kind="lang")
    return found.select("doc_id", _held_out(7), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_token_counts")
def token_counts(source: Source) -> DataFrame:
    found = count_tokens(source.documents, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


COMPONENTS = """
reach AS (SELECT u AS a, v AS b FROM link UNION SELECT v, u FROM link
          UNION SELECT reach.a, l.b FROM reach JOIN (SELECT u AS x, v AS b FROM link UNION ALL SELECT v, u FROM link) l
                ON reach.b = l.x),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""


@query("op4_vector_dedup", f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM e
         WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
               AND len(list_filter(x, lambda y: y <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id < b.vec_id
         WHERE len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) >= 0.9 * a.n * b.n),
{COMPONENTS},
n AS (SELECT a, count(*) AS n FROM (SELECT u AS a FROM link UNION ALL SELECT v FROM link) GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, low.b) AS component_id,
       e.vec_id = least(e.vec_id, low.b) AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
""")
def vector_dedup(source: Source) -> DataFrame:
    return link_vectors(source.read("embeddings", "vec_id", "embedding"))


@query("op6_hyperminhash", f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")},
                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT p.doc_id AS u, q.doc_id AS v, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id
           GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
{COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, low.b) AS component_id,
       d.doc_id = least(d.doc_id, low.b) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
""")
def hyperminhash(source: Source) -> DataFrame:
    return near_duplicates(source.documents)


def _spans_sql(order: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, m, g, v FROM (SELECT doc_id,
        list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS m,
        list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS g,
        list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS v FROM d)"""


def _secrets_sql() -> str:
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(RULES))}),
each AS (SELECT doc_id, o, kind, m, g, v, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (SELECT doc_id, o, kind, (list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0))::BIGINT AS a, m[i] AS size
           FROM each WHERE v[i] >= CASE o {least} END),
named AS (SELECT doc_id, o, kind, a, kind || ':' || a || ':' || (a + size) AS s FROM placed),
total AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access,
                 count(*) FILTER (o = 2) AS n_hex, string_agg(s, ',' ORDER BY a, o) FILTER (o < 3) AS base,
                 string_agg(s, ',' ORDER BY a, o) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN total ON d.doc_id = total.doc_id"""


@query("op7_secret_scan", _secrets_sql())
def secret_scan(source: Source) -> DataFrame:
    found = scan(source.documents)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


@query("op8_line_dedup", """
WITH line AS (SELECT doc_id, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
              FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i
                    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT k, max(doc_id) AS keeper FROM line WHERE length(k) >= 20
           GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, x, coalesce(doc_id < keeper, false) AS gone FROM line LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def line_dedup(source: Source) -> DataFrame:
    found = mark_lines(source.documents)
    n, kept = F.size("all_lines").cast("long"), F.array_join("kept_lines", "\n")
    return found.select("row.doc_id", n.alias("n_lines"), (n - F.size("kept_lines")).alias("n_dropped"),
                        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


@query("op5_passage_dedup", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 48))) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM place),
low AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p
         FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM win JOIN low USING (h) WHERE doc_id > lo)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS body
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
""")
def passage_dedup(source: Source) -> DataFrame:
    found = remove_passages(source.documents)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_language_id")
def language_id(source: Source) -> DataFrame:
    model = train(source.read("documents", "doc_id", "text", "lang").where(~_held_out(4)))
    return identify(source.documents, model).select(
        "doc_id", _held_out(4), "lang_pred", "score", "n_words", "n_switches")


@query("op9_piece_codec")
def piece_codec(source: Source) -> DataFrame:
    found = encode_decode(source.documents, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_decontaminate", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")},
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")},
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
        FROM item),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
cut AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM place, sizes WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, n, item_id FROM cut JOIN win USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit
            FROM (SELECT DISTINCT doc_id, i, n, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""")
def decontaminate(source: Source) -> DataFrame:
    found = match_benchmark(source.documents, source.read("benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op11_license_scan")
def license_scan(source: Source) -> DataFrame:
    found = scan_licenses(source.documents)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _clusters_sql(count: int = 40, rounds: int = 5) -> str:
    parts = [f"""
WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1)::INTEGER AS k, q FROM e
       QUALIFY k < {count})"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min({{'d': far, 'k': k}}) AS best FROM (
       SELECT e.vec_id, e.q, c.k, list_sum(list_transform(list_zip(e.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far
       FROM e CROSS JOIN c{i} c) GROUP BY vec_id)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (SELECT k, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY d) AS q FROM (
       SELECT k, d, sum(v)::BIGINT AS s, count(*) AS n FROM (
         SELECT best.k AS k, unnest(q) AS v, generate_subscripts(q, 1) AS d FROM a{i}) GROUP BY k, d) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)""")
    return ",".join(parts) + f"""
SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.k = best.k"""


@query("op12_centroid_clusters", _clusters_sql())
def centroid_clusters(source: Source) -> DataFrame:
    return cluster(source.read("embeddings", "vec_id", "embedding"))


@query("op13_whitening")
def whitening(source: Source) -> DataFrame:
    found = whiten(source.read("embeddings", "vec_id", "embedding"))
    each = found.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                       F.get("explained", F.col("i")).alias("explained"), "identity_error")
