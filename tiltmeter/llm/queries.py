"""The registered queries of this folder, each over whole tables, and check SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, classifier, fingerprints, language_id, near_duplicates, packing, periodic_runs, pieces_sampling, quality_rules, sharding, source_divergence, suffix_dedup, token_counts

Q: dict = {}
O: dict = {}


def q(name, oracle=None):
    def add(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = oracle
        return fn
    return add


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name):
    """A vocabulary file of the package that every node has installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


@q("op1_best_fit_packing")
def op1(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@q("op2_quality_rules")
def op2(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", quality_rules.quality_rules("text").alias("r")).select("doc_id", "r.*")


@q("op3_chat_format", """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (SELECT *, concat(turn, chr(1), coalesce(role, chr(2)), chr(1), coalesce(text, chr(2)), chr(3)) AS said FROM t),
p AS (SELECT conv_id, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text)) AS pre,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM s),
w AS (SELECT min(conv_id) AS conv_id, pre, n FROM p WHERE k = n GROUP BY pre, n),
m AS (SELECT conv_id, n FROM w WHERE pre NOT IN (SELECT pre FROM p WHERE k < n))
SELECT t.conv_id, CAST(turn // 256 AS BIGINT) AS part, CAST(any_value(m.n) AS BIGINT) AS n_turns,
  string_agg(concat('<|im_start|>', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)), '' ORDER BY turn, role, text) AS text
FROM t JOIN m ON t.conv_id = m.conv_id GROUP BY t.conv_id, turn // 256""")
def op3(spark, sf_dir):
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@q("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


@q("op5_suffix_dedup", """
WITH RECURSIVE d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes FROM d),
w AS (SELECT doc_id, s, substr(h, CAST(2*s+1 AS BIGINT), 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n_bytes-99)) AS s FROM n WHERE n_bytes >= 100)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
e AS (SELECT doc_id, s, max(s+100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT doc_id, s, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM e),
p AS (SELECT doc_id, min(s) AS a, max(s)+100 AS b FROM i GROUP BY doc_id, island),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM p),
k AS (SELECT g.doc_id, CAST(sum(b-a) AS BIGINT) AS n_removed, count(*) AS n_spans,
  string_agg(substr(h, CAST(2*before+1 AS BIGINT), CAST(2*(a-before) AS BIGINT)), '' ORDER BY a) || coalesce(max(CASE WHEN after IS NULL THEN substr(h, CAST(2*b+1 AS BIGINT)) END), '') AS kept
  FROM g JOIN n ON g.doc_id = n.doc_id GROUP BY g.doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN k ON n.doc_id = k.doc_id""")
def op5(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "repeats.*")


@q("op6_document_fingerprints")
def op6(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


@q("op7_sharding")
def op7(spark, sf_dir):
    return sharding.shard_by_bytes(documents(spark, sf_dir), 24)


@q("op8_quality_classifier")
def op8(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return classifier.classify(docs, classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@q("op9_minhash_near_dedup", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
c AS (SELECT min(doc_id) AS rep, n, list(doc_id) AS ids, any_value(s) AS s FROM (SELECT doc_id, s, len(s) AS n, md5(list_sort(s)::VARCHAR) AS m FROM s WHERE len(s) > 0) GROUP BY n, m),
x AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100*a.n >= 80*b.n AND 100*b.n >= 80*a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100*count(*) >= 80*(a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a),
o AS (SELECT unnest(ids) AS doc_id, rep FROM c)
SELECT n.doc_id, n_shingles, coalesce(component, n.doc_id) AS component_id, coalesce(component, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN o ON n.doc_id = o.doc_id LEFT JOIN m ON o.rep = m.rep""")
def op9(spark, sf_dir):
    return near_duplicates.near_duplicates(documents(spark, sf_dir), shingle_words=2)


@q("op10_sentencepiece_sampling")
def op10(spark, sf_dir):
    made = pieces_sampling.sampled_segmentations(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
                       F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


@q("op11_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS m FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, sum(m) AS total, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
x AS (SELECT g.lang, g.source, k.term, k.m, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (t.total + 5 * v) AS BIGINT) AS p,
  CAST(1 + (CAST(1000000000 AS HUGEINT) * (m + 5)) // (l.total + 5 * v) AS BIGINT) AS q
  FROM x JOIN t ON x.lang = t.lang AND x.source = t.source JOIN l ON x.lang = l.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f) WHERE part = 'pair' OR rank <= 50""")
def op11(spark, sf_dir):
    return source_divergence.divergence(documents(spark, sf_dir))


@q("op12_language_id")
def op12(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language_id.language_of(docs, language_id.fit(docs))


@q("op13_periodic_runs")
def op13(spark, sf_dir):
    return periodic_runs.run_report(documents(spark, sf_dir), text=periodic_runs.repeated_tail(F.col("text"), F.col("doc_id")))


def queries():
    return dict(Q)


def oracle_sql():
    return dict(O)
