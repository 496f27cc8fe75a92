"""The registered queries of the training-data operators, on whole tables with production parameters."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import ann, bpe, dedup, filteraudit, htmltext, packing, pii, secretscan, shards, tokenfiles, toxicity, turns, winnow
from trailweave.session import materialize, scratch_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; digests of the ids and of the decoded bytes."""
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), RANKS), RANKS)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens, a row per piece."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_FILE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op4_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans by kind and the spans that the classifier adds."""
    return pii.report(pii.find(table(spark, sf_dir, "documents"))[0])


@query
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    pairs = winnow.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.as_text(F.col("positions"), F.col("hashes")).alias("fingerprint"),
        winnow.as_text(F.col("edited_positions"), F.col("edited_hashes")).alias("edited_fingerprint"),
        winnow.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), winnow.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))


@query
def op6_block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query
def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by at least 85 % shared five-word shingles."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as flat token files and read back."""
    folder = scratch_dir(spark)
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), BYTE_FILE, folder)
    return tokenfiles.read(spark, manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


#: Bytes a shard may hold.
SHARD_BYTES = 64 << 20


@query
def op9_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by hash prefixes of its id, with at most 64 MiB of text a shard."""
    sizes = materialize(table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")))
    return shards.assign(sizes, SHARD_BYTES, F.col("doc_id"), F.col("n_bytes")).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


ORACLES["op9_extendible_hashing"] = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, row_number() OVER () AS r FROM documents),
lv AS (SELECT unnest(range(0, 61))::BIGINT AS depth),
probe AS (SELECT r, n_bytes, h, depth, h >> (60 - depth) AS bucket FROM d, lv),
nodes AS (SELECT depth, bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM probe GROUP BY ALL),
leaf AS (SELECT a.r, min(a.depth) AS depth FROM probe a JOIN nodes USING (depth, bucket) WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1 OR depth = 60 GROUP BY ALL)
SELECT d.doc_id, d.n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(n.bucket), 60, '0'), depth::INT) END AS shard, depth::INT AS depth, shard_bytes, shard_docs
FROM d JOIN leaf USING (r) JOIN nodes n USING (depth) WHERE n.bucket = d.h >> (60 - depth)
"""


@query
def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_min_plus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters: what each step keeps, removes and would have removed, in every source."""
    return filteraudit.audit(filteraudit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


ORACLES["op12_min_plus_audit"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o(s) AS (SELECT '' UNION ALL SELECT s || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(s, x)),
p AS (SELECT s AS filter_order, step::INT AS step, substr(s, step::INT, 1) AS x FROM o, range(1, 6) r(step) WHERE len(s) = 5),
m AS (SELECT g.*, filter_order, step, x, CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS failures FROM g, p),
r AS (SELECT *, coalesce(bool_or(fails) OVER (PARTITION BY part, a, b, c, d, e, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM m),
k AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failures = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM k
"""


@query
def op11_ida_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule and repaired: its faults, the cheapest edits and the repaired text's digest."""
    return turns.audit(turns.damage(table(spark, sf_dir, "conversations")))


@query
def op13_randomness_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: base spans by pattern and the strings that the randomness tests add."""
    return secretscan.report(secretscan.find(table(spark, sf_dir, "documents")))
