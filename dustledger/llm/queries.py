"""The registered queries of the corpus operators and of the pipeline, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from dustledger.llm import (
    decontaminate, language, lexical_search, line_dedup, merkle, mixing, ngram_join, piece_codec, quality, secret_scan, sharding, url_reputation,
    vector_dedup,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def wrap(fn):
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_digest(ids) -> F.Column:
    """Lower-case sha256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ","), 256)


@_query("op1_longest_first_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"), shards=40)


@_query("op2_winnowed_line_runs")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated_runs(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", spans.alias("spans"), F.sha2("text", 256).alias("text_sha256"))


@_query("op3_host_reputation", r"""
WITH split AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT s.*, (SELECT rhost || rpath || ' ' || verdict FROM rules
               WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS fit FROM split s),
outcomes AS (
  SELECT s.host, CASE WHEN l.quality = 1 AND coalesce(l.toxic, 0) <> 1 THEN 1 ELSE 0 END AS good
  FROM split s JOIN labels l ON TRY_CAST(nullif(regexp_extract(s.path, '/([0-9]{1,18})(?:[/.]|$)', 1), '') AS BIGINT) = l.doc_id WHERE l.quality IS NOT NULL),
host AS (
  SELECT host, CASE WHEN list_slice(string_split(host, '.'), -2, -1) IN (['co', 'uk'], ['com', 'au']) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')
                    ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain,
         string_split(host, '.')[-1] AS suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM outcomes GROUP BY host),
domain AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM host GROUP BY ALL),
suffix AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domain GROUP BY ALL),
whole AS (SELECT (coalesce(sum(good), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS prior FROM suffix),
s1 AS (SELECT s.*, w.prior FROM suffix s, whole w),
m1 AS (SELECT (1 - r) / r AS m FROM (SELECT greatest(0.0001, least(0.9999, CASE WHEN sum(n - 1) > 0 THEN (round(sum(CASE WHEN prior * (1 - prior) > 0 THEN pow(good / n - prior, 2) * n / (prior * (1 - prior)) ELSE 1 END), 6) - count(*)) / sum(n - 1) ELSE 0.0001 END)) AS r FROM s1)),
p1 AS (SELECT suffix, (m * prior + good) / (m + n) AS mean FROM s1, m1),
s2 AS (SELECT d.*, p.mean AS prior FROM domain d JOIN p1 p USING (suffix)),
m2 AS (SELECT (1 - r) / r AS m FROM (SELECT greatest(0.0001, least(0.9999, CASE WHEN sum(n - 1) > 0 THEN (round(sum(CASE WHEN prior * (1 - prior) > 0 THEN pow(good / n - prior, 2) * n / (prior * (1 - prior)) ELSE 1 END), 6) - count(*)) / sum(n - 1) ELSE 0.0001 END)) AS r FROM s2)),
p2 AS (SELECT domain, (m * prior + good) / (m + n) AS mean FROM s2, m2),
s3 AS (SELECT h.*, p.mean AS prior FROM host h JOIN p2 p USING (domain)),
m3 AS (SELECT (1 - r) / r AS m FROM (SELECT greatest(0.0001, least(0.9999, CASE WHEN sum(n - 1) > 0 THEN (round(sum(CASE WHEN prior * (1 - prior) > 0 THEN pow(good / n - prior, 2) * n / (prior * (1 - prior)) ELSE 1 END), 6) - count(*)) / sum(n - 1) ELSE 0.0001 END)) AS r FROM s3)),
ab AS (SELECT host, n, m * prior + good AS a, m * (1 - prior) + n - good AS b FROM s3, m3),
p3 AS (SELECT host, n, a / (a + b) AS mean, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS high FROM ab),
asked AS (
  SELECT host, CASE WHEN list_slice(string_split(host, '.'), -2, -1) IN (['co', 'uk'], ['com', 'au']) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')
                    ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain,
         string_split(host, '.')[-1] AS suffix FROM (SELECT DISTINCT host FROM split WHERE host <> '') s),
told AS (
  SELECT a.host, coalesce(p.n, 0)::BIGINT AS n, coalesce(p.mean, d.mean, s.mean, w.prior) AS mean,
         CASE WHEN p.mean IS NOT NULL THEN p.high WHEN d.mean IS NOT NULL THEN d.mean + 1.645 * sqrt(d.mean * (1 - d.mean) / (m3.m + 1))
              WHEN s.mean IS NOT NULL THEN s.mean + 1.645 * sqrt(s.mean * (1 - s.mean) / (m2.m + 1)) ELSE w.prior + 1.645 * sqrt(w.prior * (1 - w.prior) / (m1.m + 1)) END AS high
  FROM asked a LEFT JOIN p3 p ON a.host = p.host LEFT JOIN p2 d ON a.domain = d.domain LEFT JOIN p1 s ON a.suffix = s.suffix, m1, m2, m3, whole w)
SELECT f.page_id, f.host, f.path, split_part(f.fit, ' ', 1) AS rule, CASE WHEN f.fit IS NOT NULL THEN split_part(f.fit, ' ', 2) WHEN p.high < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(p.n, 0)::BIGINT AS n_outcomes, round(p.mean, 6) AS reputation, round(p.high, 6) AS bound
FROM fits f LEFT JOIN told p ON f.host = p.host""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_reputation.page_verdicts(pages, url_reputation.labelled_outcomes(pages, _table(spark, sf_dir, "labels")))


@_query("op4_markov_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.document_secrets(_table(spark, sf_dir, "documents"))


@_query("op5_pivot_permutations")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op6_temperature_mix", """
WITH RECURSIVE units AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, source,
         any_value(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))) * count(*) AS tokens
  FROM documents GROUP BY doc_id, digest, source),
keyed AS (
  SELECT *, concat_ws('|', coalesce(doc_id::VARCHAR, '-'), digest, coalesce('=' || source, '-')) AS key FROM units),
sources AS (SELECT source, sum(tokens)::DOUBLE AS tokens, count(*) AS docs FROM units GROUP BY source HAVING sum(tokens) > 0),
whole AS (SELECT sum(tokens) AS total, list(tokens) AS each, 0.95::DOUBLE * ln(count(*)) AS target FROM sources),
logs AS (SELECT total, target, list_transform(each, lambda t: ln(t / total)) AS l FROM whole),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN e > target THEN (low + high) / 2 ELSE low END, CASE WHEN e > target THEN high ELSE (low + high) / 2 END
  FROM (SELECT b.*, g.target,
               ln(list_sum(list_transform(g.l, lambda y: exp(y * (b.low + b.high) / 2))))
               - list_sum(list_transform(g.l, lambda y: exp(y * (b.low + b.high) / 2) * y * (b.low + b.high) / 2))
                 / list_sum(list_transform(g.l, lambda y: exp(y * (b.low + b.high) / 2))) AS e
        FROM bisect b, logs g WHERE b.step < 40)),
ends AS (
  SELECT ln(len(l)) AS flat, ln(list_sum(list_transform(l, lambda y: exp(y)))) - list_sum(list_transform(l, lambda y: exp(y) * y))
         / list_sum(list_transform(l, lambda y: exp(y))) AS raw, target FROM logs),
exponent AS (
  SELECT CASE WHEN e.target >= e.flat THEN 0.0 WHEN e.target <= e.raw THEN 1.0 ELSE round((b.low + b.high) / 2, 6) END AS x
  FROM ends e, bisect b WHERE b.step = 40),
raised AS (SELECT s.*, exp(ln(s.tokens / w.total) * x.x) AS r, w.total FROM sources s, whole w, exponent x),
plan AS (
  SELECT source, tokens::BIGINT AS volume, ceil(sqrt(docs))::BIGINT AS blocks,
         floor(r / (SELECT sum(r) FROM raised) * total + 0.5)::BIGINT AS budget FROM raised),
passes AS (SELECT *, budget // volume AS passes, budget - (budget // volume) * volume AS rest FROM plan),
known AS (
  SELECT k.source, k.key, k.doc_id, k.tokens, p.passes, p.rest, p.volume, p.budget,
         ('0x' || substr(md5(k.key), 1, 8))::BIGINT % p.blocks AS block
  FROM keyed k JOIN passes p ON k.source IS NOT DISTINCT FROM p.source),
totals AS (SELECT source, block, passes, rest, sum(tokens) AS mass FROM known GROUP BY ALL),
drawn AS (SELECT *, unnest(range(0, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM totals),
placed AS (
  SELECT *, coalesce(sum(mass) OVER (PARTITION BY source, epoch ORDER BY md5(concat_ws('|', '0', coalesce(source, ''), epoch::VARCHAR, block::VARCHAR)), block
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM drawn),
readable AS (SELECT * FROM placed WHERE epoch < passes OR start < rest),
spot AS (
  SELECT k.*, r.epoch, r.start + coalesce(sum(k.tokens) OVER (PARTITION BY k.source, k.block, r.epoch ORDER BY md5(concat_ws('|', '0', r.epoch::VARCHAR, k.key)), k.key
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM known k JOIN readable r ON k.source IS NOT DISTINCT FROM r.source AND k.block = r.block)
SELECT doc_id, source, epoch::BIGINT AS epoch, block::BIGINT AS block, (epoch * volume + pos)::BIGINT AS position, tokens::BIGINT AS tokens,
       (epoch * volume + pos)::DOUBLE / budget AS share
FROM spot WHERE epoch < passes OR pos < rest""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(_table(spark, sf_dir, "documents"), entropy=0.95, budget="corpus")


@_query("op7_quadratic_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op8_family_then_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(_table(spark, sf_dir, "documents"))


@_query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op10_benchmark_windows", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_words", "n_hit", "n_items", _id_digest(F.col("items")).alias("items_sha256"), "contaminated")


@_query("op11_content_addressed_descent", r"""
WITH RECURSIVE shown AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS grp, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         CASE WHEN list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                               lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END) % 2 = 1
              THEN replace(text, chr(10), '') ELSE text END AS altered FROM documents),
hashed AS (
  SELECT rid, doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS altered_leaf FROM shown),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id ASC NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS n FROM hashed),
tree(grp, lvl, idx, n, digest) AS (
  SELECT grp, 0, rank, n, leaf FROM leaves UNION ALL
  SELECT grp, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY grp, lvl, idx // 3, n),
sources AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree(lvl, idx, n, digest) AS (
  SELECT 0, rank, n, subroot FROM sources UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper_tree WHERE n > 1 GROUP BY lvl, idx // 3, n),
places AS (
  SELECT l.rid, t.lvl, t.idx, l.rank // (3 ** t.lvl)::BIGINT AS own, t.digest
  FROM leaves l JOIN tree t ON l.grp = t.grp AND t.n > 1 AND t.idx // 3 = l.rank // (3 ** (t.lvl + 1))::BIGINT
  UNION ALL
  SELECT l.rid, 100 + t.lvl, t.idx, s.rank // (3 ** t.lvl)::BIGINT, t.digest
  FROM leaves l JOIN sources s ON l.grp = s.grp JOIN upper_tree t ON t.n > 1 AND t.idx // 3 = s.rank // (3 ** (t.lvl + 1))::BIGINT),
steps AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS k, lhs, rhs
  FROM (SELECT rid, lvl, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS lhs,
               coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS rhs FROM places GROUP BY rid, lvl) p),
folded(rid, k, digest) AS (
  SELECT rid, 0::BIGINT, altered_leaf FROM leaves UNION ALL
  SELECT f.rid, s.k, sha256(s.lhs || f.digest || s.rhs) FROM folded f JOIN steps s ON f.rid = s.rid AND s.k = f.k + 1),
proofs AS (SELECT rid, sha256(string_agg(lhs || rhs, '' ORDER BY k)) AS proof FROM steps GROUP BY rid),
ends AS (SELECT rid, arg_max(digest, k) AS digest FROM folded GROUP BY rid)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM leaves l JOIN sources s ON l.grp = s.grp JOIN ends e ON l.rid = e.rid LEFT JOIN proofs p ON l.rid = p.rid, (SELECT digest FROM upper_tree WHERE n = 1) r""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    altered = F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    told = merkle.manifest_proofs(docs, altered)
    proven = told.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"),
                         merkle.fold(F.col("altered_leaf"), F.col("path")).alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


@_query("op12_presence_mask_search", r"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL) d),
counted AS (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sized AS (SELECT rid, sum(tf)::BIGINT AS n FROM counted GROUP BY rid),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sized),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted WHERE term IN (SELECT term FROM items) GROUP BY term) t, whole),
worth AS (
  SELECT c.rid, c.doc_id, c.term, q.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * s.n * whole.docs) // whole.total))) AS part
  FROM counted c JOIN wanted q ON c.term = q.term JOIN sized s ON c.rid = s.rid, whole),
scored AS (SELECT i.item_id, w.rid, w.doc_id, sum(w.part)::BIGINT AS score FROM items i JOIN worth w ON i.term = w.term GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)


@_query("op13_piece_backtracking")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = piece_codec.SharedCodec(spark, public_tokenizers.path("piece_bpe_32k.model"))
    coded = _table(spark, sf_dir, "documents").select("doc_id", codec.round_trip(F.col("text")).alias("coded"))
    listed = F.array_join(F.col("coded.ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("coded.ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("coded.text", 256).alias("decoded_sha256"))


LLM_QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
