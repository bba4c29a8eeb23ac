"""The thin queries that apply each operator to its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, lexical_search, line_dedup, matroska, merkle, mixing, near_dedup, pieces, quality, secret_scan, substring_dedup, suffix_dedup, token_store

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SOURCE_WEIGHTS = [3.0, 1.0, 2.0]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _documents(spark, sf_dir).select("doc_id", raw.alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    padded = (F.greatest(F.ceil(F.col("n_bytes") / 64), F.lit(1)) * 64).cast("int")
    payload = docs.select("doc_id", "n_bytes", F.rpad("raw", padded, F.lit(b"\0")).alias("payload"))
    media = matroska.mux_column(payload).drop("payload")
    read = matroska.read_samples(media)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), width=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["via"] == "")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["via"] == "") & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle=2, threshold=0.8).select("doc_id", "n_shingles", "component_id", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_plan(_documents(spark, sf_dir), SOURCE_WEIGHTS, ["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = pieces.encode_decode(docs, PIECE_MODEL, outputs=("n_tokens", "ids_text", "decoded"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), width=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(doc: str = "doc_id"):
    return F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select(*merkle.FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = merkle.leaf_digest([F.translate("text", "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS])
    tree = merkle.manifest(docs, carry={"tampered": F.when(changed, tampered)})
    checked = merkle.verify(tree.withColumn("now", F.coalesce("tampered", "leaf")), "now")
    return checked.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, listed = token_store.store(_documents(spark, sf_dir).select("doc_id", "text"), WORD_TOKENIZER, end_id=2)
    read = token_store.read_back(listed, folder)
    return read.select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))


def matroska_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can tell: what is read back from the media."""
    return op1_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_pieces": op7_pieces,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle": op11_merkle,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_store": op13_token_store,
    "matroska_payload": matroska_payload,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}::VARCHAR)) || ':' || {f}, '-')" for f in _FIELDS) + ")"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), c -> ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)".replace("c -> ", "lambda c: ")

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS nd, sum(len(t))::BIGINT AS nt FROM d),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY i, item_id, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, nd),
s AS (SELECT q.item_id, d.doc_id, d.r, sum(q.k * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * len(d.t) * c.nd) // c.nt))))::BIGINT AS score
 FROM q JOIN p USING (t) JOIN w USING (t) JOIN d ON d.r = p.r, c GROUP BY q.item_id, d.doc_id, d.r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op11_merkle": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, {_LEAF} AS leaf, {_LEAF.replace("(text::", "(replace(text, chr(10), '')::").replace("|| text", "|| replace(text, chr(10), '')")} AS other, {_CRC} AS crc FROM documents),
o AS (SELECT *, CASE WHEN crc % 2 = 0 THEN other ELSE leaf END AS now, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t(g, level, i, h, n) AS (SELECT g, 0, i, leaf, count(*) OVER (PARTITION BY g) FROM o UNION ALL SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY g, level, i // 3, n),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, i, h, n) AS (SELECT 0, i, h, n FROM s UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3, n),
p AS (SELECT o.r, t.level AS step, o.i // pow(3, t.level)::BIGINT AS own, t.i, t.h FROM o JOIN t ON t.g = o.g AND t.n > 1 AND t.i // 3 = o.i // pow(3, t.level + 1)::BIGINT
 UNION ALL SELECT o.r, 100 + u.level, s.i // pow(3, u.level)::BIGINT, u.i, u.h FROM o JOIN s ON s.g = o.g JOIN u ON u.n > 1 AND u.i // 3 = s.i // pow(3, u.level + 1)::BIGINT),
q AS (SELECT r, step, struct_pack(l := coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), ''), r := coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '')) AS x FROM p GROUP BY r, step),
w AS (SELECT r, list(x ORDER BY step) AS xs FROM q GROUP BY r),
f AS (SELECT o.doc_id, o.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(list_aggregate(list_transform(w.xs, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256,
 (list_reduce([struct_pack(l := o.now, r := '')] || coalesce(w.xs, []), lambda a, x: struct_pack(l := sha256(x.l || a.l || x.r), r := ''))).l AS folded_root FROM o JOIN s ON s.g = o.g LEFT JOIN w ON w.r = o.r)
SELECT *, folded_root = root AS verified FROM f""",
    "op2_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
g AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS at FROM h JOIN f USING (k) WHERE first < doc_id),
t AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(g.at) AS n_removed,
       sha256(coalesce(string_agg(t.word, ' ' ORDER BY t.at) FILTER (WHERE g.at IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN t ON t.r = d.r LEFT JOIN g ON g.r = t.r AND g.at = t.at GROUP BY d.r, d.doc_id, d.w""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.other)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, min(c.other) AS component_id, min(c.other) = c.vec_id AS kept FROM c GROUP BY c.vec_id""",
    "op5_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT m.a, m.b FROM m JOIN n p ON p.doc_id = m.a JOIN n q ON q.doc_id = m.b WHERE 100 * k >= 80 * (p.n + q.n - k)),
c(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.other)
SELECT c.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c.other) AS component_id, min(c.other) = c.doc_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(doc_id::VARCHAR, 'text:' || text, '') AS id FROM documents),
e AS (SELECT *, least(1000, length(bin(size)))::BIGINT AS w, (('0x' || substr(md5('17:' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM e GROUP BY source),
k AS (SELECT *, ([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER])::DOUBLE AS wt FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - 2::DOUBLE * coalesce(sum(n) OVER (ORDER BY n / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(wt) OVER (ORDER BY n / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM k),
t AS (SELECT source, n AS source_size, CASE WHEN n * 2 <= level * wt THEN n * 2 ELSE (SELECT max(level) FROM l WHERE n * 2 > level * wt) * wt END AS target FROM l),
c AS (SELECT e.source, w, sum(size)::DOUBLE AS n, any_value(source_size) AS source_size, any_value(target) AS target FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source GROUP BY e.source, w),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(w * n) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM c),
v AS (SELECT *, CASE WHEN below > 0 THEN (target - 2 * above) / below END AS level FROM b),
x AS (SELECT *, max(CASE WHEN level * w <= 2 THEN w END) OVER (PARTITION BY source) AS fw FROM v),
y AS (SELECT *, max(CASE WHEN w = fw THEN level END) OVER (PARTITION BY source) AS fl FROM x),
z AS (SELECT *, least(CASE WHEN source_size = 0 THEN 0::DOUBLE WHEN w <= fw THEN fl * w ELSE 2::DOUBLE END, 2::DOUBLE) AS times FROM y),
q AS (SELECT *, floor(times) AS whole, times - floor(times) AS pi, target - sum(floor(times) * n) OVER (PARTITION BY source) AS rest FROM z),
f AS (SELECT e.doc_id, e.source, e.id, e.size, q.source_size, q.target, q.whole, q.pi, q.rest, (u / (1 - u)) / (q.pi / (1 - q.pi)) AS rank FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source AND e.w = q.w),
g AS (SELECT *, sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN pi > 0 THEN floor(rank / (1 + rank) * 4503599627370496) END NULLS LAST, id, size ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (whole + CASE WHEN pi > 0 AND (upto <= rest OR (rest > upto - size AND rest - (upto - size) >= size / 2)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM g""",
    "op10_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
p AS (SELECT r, i, md5(array_slice(x, i, i + 199)) AS k FROM (SELECT r, x, unnest(range(1, octet_length(x) - 198)) AS i FROM d WHERE octet_length(x) >= 200)),
c AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
h AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p JOIN c USING (k)),
n AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM h),
s AS (SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY r, span),
g AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS z FROM s),
t AS (SELECT r, sum(b - a)::BIGINT AS removed, count(*) AS spans, max(b) AS last FROM s GROUP BY r),
k AS (SELECT g.r, string_agg(CASE WHEN a > z THEN hex(array_slice(x, z, a - 1)) ELSE '' END, '' ORDER BY a) AS kept FROM g JOIN d USING (r) GROUP BY g.r)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN x ELSE unhex(kept || CASE WHEN last <= octet_length(x) THEN hex(array_slice(x, last, octet_length(x))) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN k USING (r)""",
    "matroska_payload": """
WITH p AS (SELECT doc_id, coalesce(text, '') AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
q AS (SELECT doc_id, n, greatest(1, (n + 63) // 64) * 64 AS m, x FROM p)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(x || repeat(chr(0), (m - n)::BIGINT)) AS payload_sha256 FROM q""",
    "op9_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS drop FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
}
