"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.llm.common import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, equal texts together."""
    from estima.llm.sharding import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


ORACLE["op3_warc"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, octet_length(encode(body)) AS n, sha1(body) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, url AS target_uri
FROM m
"""


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, equal payloads as revisits, read back by byte ranges."""
    from estima.llm.warc import round_trip
    return round_trip(table(spark, sf_dir, "pages"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids."""
    from estima.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"))


def held_out(modulus: int, held: int):
    from estima.llm.common import crc32_text
    return crc32_text(F.col("doc_id")) % modulus == held


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic; labels of crc32 mod 5 = 0 are held out."""
    from estima.llm.toxicity import score_documents, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"), modulus=5, held=0)
    return score_documents(docs, machine).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being good; labels of crc32 mod 3 = 1 are held out."""
    from estima.llm.quality import score_documents, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors, net = train(docs, table(spark, sf_dir, "labels"), modulus=3, held=1)
    return score_documents(docs, vectors, net).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class (weighted Jaccard of five-word shingles >= 0.8)."""
    from estima.llm.minhash import duplicate_classes
    found = duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


@query
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th vector, by an inverted multi-index."""
    from estima.llm.neighbours import nearest_neighbours
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query
def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links (cosine >= 0.93 within its label) and component."""
    from estima.llm.embed_dedup import duplicate_vectors
    return duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base identifiers and those that learned contexts add."""
    from estima.llm.pii import find_pii
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document as ids, with inclusion scores."""
    from estima.llm.segment import sampled_segmentations
    return sampled_segmentations(table(spark, sf_dir, "documents"), k=2)


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents: proofs by descent, and an audit with tampered texts."""
    from estima.llm.merkle import merkle_proofs
    return merkle_proofs(table(spark, sf_dir, "documents"))


def _merkle_sql(height: int = 7) -> str:
    """SQL of op13: ``height`` levels within a source and over the sources, up to 16 ** height nodes."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    first = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # the table of crc32, bit by bit
    steps = ["SELECT i, i AS c FROM range(256) t(i)"]
    for _ in range(8):
        steps.append(f"SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM ({steps[-1]})")
    sql = [f"crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM ({steps[-1]}))",
           "ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)",
           """crcs AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc FROM ids, crc)""",
           f"""leaves AS (SELECT d.doc_id, d.source AS tree, sha256({first} || {field('text')}) AS leaf,
             CASE WHEN c.crc % 5 = 0 THEN sha256({first} || {field(lower)}) END AS altered FROM documents d LEFT JOIN crcs c USING (doc_id))""",
           """placed AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS row_id
             FROM leaves WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf))""",
           "n0 AS (SELECT tree, idx, leaf AS digest, n AS left_over FROM placed)"]
    for k in range(height):
        sql.append(f"""r{k} AS (SELECT tree, idx // 16 AS run, list(digest ORDER BY idx) AS kids, left_over FROM n{k}
          GROUP BY tree, idx // 16, left_over)""")
        sql.append(f"""n{k + 1} AS (SELECT tree, run AS idx, CASE WHEN left_over = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS digest,
          (left_over + 15) // 16 AS left_over FROM r{k})""")
    sql.append(f"""p0 AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS left_over
      FROM n{height})""")
    sql.append("t0 AS (SELECT idx, subroot AS digest, left_over FROM p0)")
    for k in range(height):
        sql.append(f"s{k} AS (SELECT idx // 16 AS run, list(digest ORDER BY idx) AS kids, left_over FROM t{k} GROUP BY idx // 16, left_over)")
        sql.append(f"""t{k + 1} AS (SELECT run AS idx, CASE WHEN left_over = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS digest,
          (left_over + 15) // 16 AS left_over FROM s{k})""")
    sql.append("f0 AS (SELECT l.*, p.subroot, p.idx AS place, '' AS proof, coalesce(altered, leaf) AS fold FROM placed l JOIN p0 p ON l.tree IS NOT DISTINCT FROM p.tree)")
    at = 0
    for prefix, on, place in (("r", "f.tree IS NOT DISTINCT FROM r.tree AND", "idx"), ("s", "", "place")):
        for k in range(height):
            pos = f"((f.{place} // {16 ** k}) % 16)"
            left, right = f"array_to_string(kids[1:{pos}], '')", f"array_to_string(kids[{pos} + 2:], '')"
            sql.append(f"""f{at + 1} AS (SELECT f.* REPLACE (CASE WHEN left_over = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
              CASE WHEN left_over = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold)
              FROM f{at} f JOIN {prefix}{k} r ON {on} f.{place} // {16 ** (k + 1)} = r.run)""")
            at += 1
    return "WITH " + ",\n".join(sql) + f"""
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.digest AS verified
FROM f{at}, t{height} t"""


ORACLE["op13_merkle"] = _merkle_sql()


@query
def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by a log-frequency Bloom filter; crc32 mod 7 = 2 is held out."""
    from estima.llm.lm import language_model_scores
    return language_model_scores(table(spark, sf_dir, "documents"), modulus=7, held=2)


@query
def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, by dual trees."""
    from estima.llm.ranking import ranked_documents
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE["op12_ranking"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT r, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
i AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
it AS (SELECT i, item_id, term, count(*) AS reps FROM (SELECT i, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT i, item_id, tf.r, doc_id, CAST(sum(reps * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM it JOIN tf USING (term) JOIN df USING (term) JOIN n ON n.r = tf.r, s GROUP BY i, item_id, tf.r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM sc WHERE score > 0)
WHERE rank <= 20
"""
