"""The operators as queries over the given tables: op<N>_<name>, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import decontaminate, exact_dedup, lexical_packing, minhash, mixing, periodic_runs, secrets, sharding, token_files, toxicity, url_filters, vector_codes, warc

TOKENIZER = "byte_bpe_50k.json"
PACKED_TOKENIZER = "word_bpe_49k.json"
SHARDS = 8
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Where no host rule fits.
PATTERN_RULES = (
    (r"://[^/]*\.(gov|edu)(/|$)", "allow"),
    (r"cheap-?pills", "block"),
    (r"spam-?farm", "block"),
    (r"://[^/]*(casino|viagra|torrent)", "block"),
    (r"/(login|signin|checkout)(/|\?|$)", "block"),
    (r"[?&](sessionid|phpsessid)=", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op2_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    told = [F.size("items").cast("long").alias("n_items"), decontaminate.items_sha256().alias("items_sha256"), decontaminate.contaminated().alias("contaminated")]
    return found.select("row.doc_id", "n_words", "n_hit", *told)


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(documents, table(spark, sf_dir, "labels")))
    out = model.score(documents, "text", "score")
    return out.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, plan = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, MOST)
    out = mixing.attach(sized, plan, "key", "n")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * mixing.copies()).alias("taken"))


def op8_fuse_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the ids is the snapshot; the others are the batch that comes in."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ends = documents.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    old = F.coalesce(F.col("doc_id") < ((ends["a"] or 0) + (ends["b"] or 0) + 1) // 2, F.lit(False))
    return exact_dedup.exact_dedup(documents.where(old), documents.where(~old))


def op9_rarest_literal_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages"), HOST_RULES, PATTERN_RULES)
    return judged.select(*url_filters.columns(judged))


def op10_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lexical_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKED_TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_difference_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(table(spark, sf_dir, "documents"), order=periodic_runs.made_periodic))


def op13_anchor_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = vector_codes.train(table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_error(vector_codes.encode(trained))
    return out.select("vec_id", "code", "error", "label_error", F.lit(trained.sha256()).alias("codebooks_sha256"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * k AS INT)) % 32 + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN original IS NULL OR page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM m
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS window
  FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS s, w FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.size, bw.item FROM dw JOIN bw ON dw.size = bw.size AND array_to_string(dw.w[dw.s:dw.s + dw.size - 1], ' ') = bw.window),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 14) AS BIGINT) AS hash
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
      row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM sums),
plan AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM levels WHERE level * weight <= cap ORDER BY place LIMIT 1)) AS target
  FROM levels),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS q FROM plan),
run AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.q, p.target - p.q * p.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto
  FROM sized d JOIN split p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (q + CASE WHEN need > 0 AND (upto < need OR (upto - size < need AND 2 * (need - (upto - size)) > size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""

OP8_SQL = f"""
WITH n AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT u AS doc_id, v AS other FROM links UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.other, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(least.other, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT page_id, url, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
m AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(url, '(?i)://[^/]*\.(gov|edu)(/|$)') THEN '://[^/]*\.(gov|edu)(/|$)'
    WHEN regexp_matches(url, '(?i)cheap-?pills') THEN 'cheap-?pills'
    WHEN regexp_matches(url, '(?i)spam-?farm') THEN 'spam-?farm'
    WHEN regexp_matches(url, '(?i)://[^/]*(casino|viagra|torrent)') THEN '://[^/]*(casino|viagra|torrent)'
    WHEN regexp_matches(url, '(?i)/(login|signin|checkout)(/|\?|$)') THEN '/(login|signin|checkout)(/|\?|$)'
    WHEN regexp_matches(url, '(?i)[?&](sessionid|phpsessid)=') THEN '[?&](sessionid|phpsessid)=' END AS pattern FROM r)
SELECT page_id, host, path, rule, pattern, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN pattern IS NULL OR contains(pattern, 'gov') THEN 'allow' ELSE 'block' END AS verdict
FROM m
"""


def assigned(rounds: int) -> str:
    """The nearest entries of codebook c<rounds>, and the codebook of the next round."""
    k = rounds
    return f"""
a{k} AS (
  SELECT row_no, part, arg_min(entry, [far, entry]) AS entry, min(far) AS far
  FROM (SELECT p.row_no, p.part, entry, CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda v: (v[1] - v[2]) * (v[1] - v[2]))) AS BIGINT) AS far
        FROM p JOIN c{k} c ON c.part = p.part) GROUP BY 1, 2),
m{k} AS (
  SELECT part, entry, list(mean ORDER BY place) AS x
  FROM (SELECT a.part, a.entry, place, CAST(floor(sum(p.x[place]) / count(*)::DOUBLE) AS BIGINT) AS mean
        FROM a{k} a JOIN p USING (row_no, part), unnest(range(1, (SELECT width // 16 FROM size) + 1)) AS u(place) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""


OP13_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
size AS (SELECT CAST(ceil(max(len(x)) / 16.0) * 16 AS BIGINT) AS width FROM k),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS row_no FROM k),
p AS (SELECT row_no, part, list_transform(x, lambda v: v)[part * (SELECT width // 16 FROM size) + 1 : (part + 1) * (SELECT width // 16 FROM size)] AS x FROM n, unnest(range(16)) AS u(part)),
c0 AS (SELECT part, row_no AS entry, x FROM p WHERE row_no < 64),
{assigned(0)}, {assigned(1)}, {assigned(2)},
coded AS (SELECT row_no, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY 1),
books AS (SELECT sha256(string_agg(CAST(x[place] AS VARCHAR), ',' ORDER BY part, entry, place)) AS h FROM c2, unnest(range(1, (SELECT width // 16 FROM size) + 1)) AS u(place))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM n JOIN coded USING (row_no)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_vector_bin_packing, op2_guess_cost_secrets, op3_warc_boundary_chain, op4_prefix_filtered_decontamination, op5_counterfactual_toxicity, op6_token_files, op7_hash_threshold_mix, op8_fuse_filter_dedup, op9_rarest_literal_url_rules, op10_minhash_components, op11_lexical_packing, op12_difference_cover_runs, op13_anchor_tree_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_boundary_chain": OP3_SQL, "op4_prefix_filtered_decontamination": OP4_SQL, "op7_hash_threshold_mix": OP7_SQL, "op8_fuse_filter_dedup": OP8_SQL, "op9_rarest_literal_url_rules": OP9_SQL, "op10_minhash_components": OP10_SQL, "op13_anchor_tree_codes": OP13_SQL}
