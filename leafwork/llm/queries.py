"""The queries of this package, with production parameters, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lexical, lmscore, manifest, minhash, mixing, quality, secrets, sharding, simhash, substring, topk, urls

MIX_WEIGHTS = {"src0": 12, "src1": 6, "src2": 6, "src3": 4, "src4": 4, "src5": 3, "src6": 3, "src7": 2, "src8": 2, "src9": 2} | {f"src{i}": 1 for i in range(10, 20)}
MIX_OTHER, MIX_BLOCK = 2, 64

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK).select("doc_id", "source", "mix_source", "block", "slot", "position")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(_read(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the test items that it holds; clean ones have none."""
    out = decontam.with_matches(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min(F.transform("matches", lambda m: m["distance"])).alias("distance"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"), budget=3, width=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_read(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_read(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_read(spark, sf_dir, "documents"), width=35).drop("kept_text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its proof, and whether the proof still holds for the row as it may have been changed since."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    seen = manifest.leaf_digest([changed if c == "n_chars" else F.col(c) for c in manifest.FIELDS])
    out = manifest.manifest(_read(spark, sf_dir, "documents"), keep={"seen": seen})
    proof = F.sha2(F.concat_ws("", "path", "upper_path").cast("binary"), 256)
    folded = manifest.fold(manifest.fold(F.col("seen"), F.col("i"), F.col("path")), F.col("g"), F.col("upper_path"))
    out = out.withColumns({"proof_sha256": proof, "folded_root": folded})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the class of near copies that each document is in."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.with_edits(docs, minhash.near_copies(docs, least=0.8))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict:
    return {"op1_mix": op1_mix, "op2_urls": op2_urls, "op3_topk": op3_topk, "op4_secrets": op4_secrets, "op5_quality": op5_quality, "op6_decontaminate": op6_decontaminate, "op7_simhash": op7_simhash, "op8_shard": op8_shard, "op9_lmscore": op9_lmscore, "op10_substring": op10_substring, "op11_merkle": op11_merkle, "op12_minhash": op12_minhash, "op13_lexical": op13_lexical}


def _op1_sql() -> str:
    """Earliest deadline first over one period, slot by slot, then block by block."""
    names, w = [*MIX_WEIGHTS, mixing.OTHER], [*MIX_WEIGHTS.values(), MIX_OTHER]
    groups = ", ".join(f"({i}, '{n}', {x})" for i, (n, x) in enumerate(zip(names, w)))
    known, total = ", ".join(f"'{n}'" for n in MIX_WEIGHTS), sum(w)
    jobs = f"SELECT g, name, w, k, k * {total} // w AS release, ((k + 1) * {total} + w - 1) // w AS deadline FROM groups, range({total}) r(k) WHERE k < w"
    return f"""
WITH RECURSIVE groups(g, name, w) AS (VALUES {groups}),
jobs AS ({jobs}),
listed AS (SELECT list(struct_pack(d := deadline, g := g, k := k, r := release) ORDER BY deadline, g, k) AS js FROM jobs),
sched(t, js, g, k) AS (
  SELECT -1, js, NULL::INT, NULL::BIGINT FROM listed
  UNION ALL
  SELECT t + 1, list_filter(js, lambda x: NOT (x.g = p.g AND x.k = p.k)), p.g, p.k
  FROM (SELECT t, js, list_filter(js, lambda x: x.r <= t + 1)[1] AS p FROM sched WHERE t + 1 < {total})),
slots AS (SELECT s.t, s.k, groups.name, groups.w FROM sched s JOIN groups USING (g) WHERE s.t >= 0),
r AS (SELECT doc_id, source, CASE WHEN source IN ({known}) THEN source ELSE '{mixing.OTHER}' END AS mix_source FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY mix_source ORDER BY md5(doc_id::VARCHAR)) - 1 AS i FROM r),
b AS (SELECT *, i // {MIX_BLOCK} AS block FROM n),
p AS (SELECT b.*, (block // slots.w) * {total} + slots.t AS slot FROM b JOIN slots ON slots.name = b.mix_source AND slots.k = b.block % slots.w)
SELECT doc_id, source, mix_source, block::BIGINT AS block, slot::BIGINT AS slot, (row_number() OVER (ORDER BY slot, i) - 1)::BIGINT AS position FROM p"""


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""


#: CRC-32 byte by byte from its table, then best-fit decreasing group by group.
OP8_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([i::BIGINT], list_transform(range(8), lambda z: z::BIGINT)), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, octet_length(encode(text)) + 16 AS size, md5(text) AS same,
  xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS crc FROM d, crc_table),
g AS (SELECT same, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY sum(size) DESC, md5(upper(same))) AS i FROM b GROUP BY same),
alone AS (
  SELECT 0::BIGINT AS i, (SELECT sum(total) FROM g)::BIGINT AS rest, 40 AS bins
  UNION ALL
  SELECT g.i, rest - g.total, bins - 1 FROM alone JOIN g ON g.i = alone.i + 1 WHERE bins > 1 AND g.total * bins > rest),
start AS (SELECT max(i) AS n, arg_max(rest, i) AS rest, arg_max(bins, i) AS bins FROM alone),
pack AS (
  SELECT n AS i, NULL::BIGINT AS shard, list_transform(range(n, 40), lambda k: {'room': (rest + bins - 1) // bins, 'b': k}) AS free FROM start
  UNION ALL
  SELECT i, pick.b, list_transform(free, lambda x: CASE WHEN x.b = pick.b THEN {'room': x.room - total, 'b': x.b} ELSE x END)
  FROM (SELECT g.i, g.total, free, coalesce(list_sort(list_filter(free, lambda x: x.room >= g.total))[1], list_sort(list_filter(free, lambda x: x.room = list_max(list_transform(free, lambda y: y.room))))[1]) AS pick FROM pack JOIN g ON g.i = pack.i + 1)),
placed AS (SELECT same, CASE WHEN g.i <= n THEN g.i - 1 ELSE pack.shard END AS shard FROM g CROSS JOIN start LEFT JOIN pack ON pack.i = g.i)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), crc, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM b JOIN placed USING (same)"""

#: Windows as texts, counted, and the words that repeated ones cover.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
k AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS seq FROM s),
rep AS (SELECT seq FROM k GROUP BY seq HAVING count(*) > 1),
gone AS (SELECT r, unnest(range(i, i + 35)) AS p FROM k JOIN rep USING (seq)),
cut AS (SELECT r, list(DISTINCT p) AS ps FROM gone GROUP BY r),
m AS (SELECT d.r, doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, ps, ws FROM d LEFT JOIN cut ON cut.r = d.r),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM m WHERE n_removed > 0),
kept AS (SELECT w.r, string_agg(w.w, ' ' ORDER BY w.p) AS text FROM w LEFT JOIN (SELECT DISTINCT r, p FROM gone) g ON g.r = w.r AND g.p = w.p WHERE g.p IS NULL GROUP BY w.r)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(CASE WHEN n_removed = 0 THEN array_to_string(ws, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256 FROM m LEFT JOIN kept ON kept.r = m.r"""


_CRC = "list_reduce(list_concat([i::BIGINT], list_transform(range(8), lambda z: z::BIGINT)), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)"


def _op11_sql() -> str:
    """Level by level from the leaves, then the siblings of each leaf joined by place."""
    put = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(({x})::VARCHAR))::VARCHAR || ':' || ({x})::VARCHAR END"
    leaf = lambda n: "sha256(" + " || ".join(put(n if c == "n_chars" else c) for c in manifest.FIELDS) + ")"
    step = "CASE WHEN o.h IS NULL THEN '-' WHEN (x.i >> s.l) % 2 = 1 THEN 'L' || o.h ELSE 'R' || o.h END"
    return f"""
WITH RECURSIVE crc_table AS (SELECT list({_CRC} ORDER BY i) AS t FROM range(256) r(i)),
c AS (SELECT d.*, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS crc FROM documents d, crc_table),
f AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, {leaf('CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END')} AS seen FROM c),
p AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f),
lv(lang, l, i, h, n) AS (
  SELECT lang, 0::BIGINT, i, leaf, n FROM p
  UNION ALL
  SELECT lang, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY lang, l, i // 2, n),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
up(l, i, h, n) AS (
  SELECT 0::BIGINT, i, subroot, n FROM sub
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY l, i // 2, n),
low AS (SELECT x.r, list({step} ORDER BY s.l) AS path FROM p x JOIN (SELECT DISTINCT lang, l FROM lv WHERE n > 1) s ON s.lang IS NOT DISTINCT FROM x.lang
  LEFT JOIN lv o ON o.lang IS NOT DISTINCT FROM x.lang AND o.l = s.l AND o.i = xor(x.i >> s.l, 1) GROUP BY x.r),
high AS (SELECT x.lang, list({step} ORDER BY s.l) AS path FROM sub x JOIN (SELECT DISTINCT l FROM up WHERE n > 1) s ON true LEFT JOIN up o ON o.l = s.l AND o.i = xor(x.i >> s.l, 1) GROUP BY x.lang),
w AS (SELECT p.doc_id, p.leaf, p.seen, sub.subroot, (SELECT h FROM up WHERE n = 1) AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang LEFT JOIN low ON low.r = p.r LEFT JOIN high ON high.lang IS NOT DISTINCT FROM p.lang),
z AS (SELECT *, list_reduce(list_concat([seen], path), lambda a, x: CASE WHEN x = '-' THEN sha256(a) WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda x: x <> '-'), lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z"""


#: Every document against every item.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
e AS (SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM e),
x AS (SELECT r, unnest(ts) AS t FROM e),
tf AS (SELECT r, t, count(*) AS tf FROM x GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * docs::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w FROM tf, s GROUP BY t, docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT item_id, e.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN e ON e.r = tf.r, s GROUP BY item_id, e.r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": _op1_sql(), "op3_topk": OP3_SQL, "op8_shard": OP8_SQL, "op10_substring": OP10_SQL, "op11_merkle": _op11_sql(), "op13_lexical": OP13_SQL}
