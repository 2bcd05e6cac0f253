"""The queries of this subpackage, by their registered names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, hmm, language, main_text, packing, prefix_trie, quality, secret_grammar, sharding, shingle_join, spotsigs, surrogates, threshold_search
from tessera.plans.workspace import Workspace


#: For the queries only: real data need a key of their own, kept secret.
SURROGATE_KEY = "example"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_documents(spark, sf_dir), 24)
    return found.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "op2")
    found = shingle_join.shingle_components(_documents(spark, sf_dir).select("doc_id", "text"), k=4, threshold=85, workspace=workspace)
    # both sides are written first, so that the join's shuffles are its own and AQE can split a large component
    found = workspace.save(found.select("doc_id", "n_shingles", "component"))
    least = workspace.save(found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")))
    return found.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = language.learn(docs.where(language.teaching() != 0))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(language.teaching() == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return spotsigs.grouped(spotsigs.fingerprints(docs), docs)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_documents(spark, sf_dir), key=SURROGATE_KEY)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.apply_rules(docs, trees).drop("text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = hmm.score(docs, part != 2)
    return found.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text.extract(pages, main_text.fit(pages))


def op11_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return secret_grammar.scan(docs, secret_grammar.learn(docs)).drop("text")


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_shingle_join": op2_shingle_join,
    "op3_language": op3_language,
    "op4_spotsigs": op4_spotsigs,
    "op5_surrogates": op5_surrogates,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_hmm": op9_hmm,
    "op10_main_text": op10_main_text,
    "op11_secret_grammar": op11_secret_grammar,
    "op12_threshold_search": op12_threshold_search,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of a number's decimal digits, bit by bit.
_CRC_OF = """xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)), lambda crc, b:
  list_reduce([1, 1, 1, 1, 1, 1, 1, 1]::UBIGINT[], lambda x, one: xor(x >> 1, (x & one) * 3988292384::UBIGINT), xor(crc, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""
_CRC = _CRC_OF.format("doc_id")
SQL: dict[str, str] = {
    "op2_shingle_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, least) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM both_ways GROUP BY a
  UNION SELECT b, min(r.least) FROM reach r JOIN both_ways ON r.node = a JOIN recurring.reach o ON o.node = b WHERE r.least < o.least GROUP BY b)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, documents.doc_id) AS component_id FROM documents LEFT JOIN sizes ON sizes.doc_id = documents.doc_id LEFT JOIN reach ON node = documents.doc_id""",
    "op3_language": rf"""WITH d AS (SELECT doc_id, lang, {_CRC} % 5 = 0 AS held_out, string_split(chr(1) || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', chr(1), 'g'), chr(1)) || chr(1), '') AS c FROM documents),
e AS (SELECT doc_id, lang, held_out, c, unnest(range(1, len(c) + 1)) AS i FROM d WHERE len(c) > 2),
g AS (SELECT doc_id, lang, held_out, c[i] AS g FROM e WHERE c[i] <> chr(1) UNION ALL SELECT doc_id, lang, held_out, c[i] || c[i + 1] FROM e WHERE i < len(c)
  UNION ALL SELECT doc_id, lang, held_out, c[i] || c[i + 1] || c[i + 2] FROM e WHERE i < len(c) - 1 AND c[i + 1] <> chr(1)),
own AS MATERIALIZED (SELECT doc_id, any_value(lang) AS lang, any_value(held_out) AS held_out, g, count(*) AS n FROM g GROUP BY doc_id, g),
profile AS MATERIALIZED (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS rank FROM own WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY rank < 300),
ranked AS MATERIALIZED (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS rank FROM own QUALIFY rank < 300),
scored AS (SELECT doc_id, l.lang, 1 - sum(CASE WHEN p.rank IS NULL THEN 300 ELSE abs(p.rank - r.rank) END)::DOUBLE / (300 * count(*)) AS score
  FROM ranked r CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = r.g GROUP BY doc_id, l.lang),
best AS (SELECT doc_id, lang, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0) AS score FROM d LEFT JOIN best USING (doc_id)""",
    "op12_threshold_search": rf"""WITH words AS (SELECT doc_id, unnest(list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM documents),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
asked AS MATERIALIZED (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sums GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // sums.words))))::BIGINT AS score FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), sums GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10""",
    "op13_prefix_trie": f"""WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT DISTINCT conv_id, {_CRC_OF.format("conv_id")} % 6 AS h FROM t),
rebuilt AS (SELECT c.conv_id, false AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h UNION ALL SELECT c.conv_id, true, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
paths AS MATERIALIZED (SELECT conv_id, row_number() OVER w AS depth, length(text) AS size, list(md5(role) || md5(text)) OVER w AS node FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM c),
nodes AS MATERIALIZED (SELECT node, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY node, depth),
below AS MATERIALIZED (SELECT DISTINCT a.node AS node, b.node AS lower FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
children AS MATERIALIZED (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (SELECT below.node, count(*) FILTER (children.n IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM below JOIN nodes ON nodes.node = lower LEFT JOIN children ON children.node = lower GROUP BY below.node),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id) USING (conv_id, depth) GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(children.n, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = list_slice(n.node, 1, n.depth - 1)""",
}
