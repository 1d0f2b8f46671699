"""The registered queries of this folder: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dartminhash, decontam, hnsw, langid, linededup, mixing, quality, rangecoder, runs, toolcalls, vectorcodes, warc, wrapper
from ..functions.joins import checked_broadcast
from .common import write_table
from .registry import ORACLE, QUERIES, query  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source) AS k FROM w),
r AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rate FROM o),
c AS (SELECT *, (2 * source_size)::DOUBLE <= rate * weight AS stops FROM r),
t AS (SELECT source, source_size, CASE WHEN stops THEN (2 * source_size)::DOUBLE
        ELSE (SELECT rate FROM c WHERE NOT stops ORDER BY k LIMIT 1) * weight END AS target FROM c),
b AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
x AS (SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || b.epochs::VARCHAR), d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM x
"""


@query("op8_mix_sources", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_dart_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_spaced_seed_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_ordinal_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on_sample(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.score_quality(docs, model).drop("row_")


@query("op4_range_coded_ids")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = rangecoder.write_ids(table(spark, sf_dir, "documents"), rangecoder.default_tokenizer())
    return rangecoder.read_ids(manifest).drop("ids")


@query("op3_viterbi_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit_languages(docs.where(fold != 2))
    return langid.identify(docs, model).select(
        "doc_id", (F.coalesce(fold, F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "n_spans")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""


@query("op10_warc_archive", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_pages(table(spark, sf_dir, "pages"))
    # two scans with the record type pushed down: payloads of revisits are sought past
    full = spark.read.format("warc").option("path", path).load().where("record_type = 'response'")
    again = spark.read.format("warc").option("path", path).option("payload", "false").load().where("record_type = 'revisit'")
    ids = [warc.page_id_of("record_id").alias("page_id")], ["record_type", warc.page_id_of("refers_to").alias("refers_to")]
    return full.select(*ids[0], F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), *ids[1]).unionAll(
        again.select(*ids[0], "payload_bytes", "payload_digest", *ids[1]))


@query("op6_hnsw_components")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_wrapper_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT * FROM m WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn - 1 AS turn, text FROM m WHERE role = 'assistant'),
e AS (SELECT a.conv_id, a.turn, b.turn AS dep FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)),
p(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0::BIGINT FROM c WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM e)
  UNION SELECT e.conv_id, e.turn, p.level + 1 FROM p JOIN e ON p.conv_id = e.conv_id AND e.dep = p.turn),
l AS (SELECT conv_id, turn, max(level) AS level FROM p GROUP BY ALL),
d AS (SELECT conv_id, turn, to_json(list_sort(list('turn-' || dep))) AS deps FROM e GROUP BY ALL)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, 'turn-' || coalesce(c.turn, r.turn) AS call_id,
       coalesce(c.turn, r.turn + 1) AS turn, l.level,
       CASE WHEN c.conv_id IS NULL THEN 'orphan_result' WHEN r.conv_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
       CASE WHEN c.conv_id IS NOT NULL AND c.text IS NULL THEN 'type:text' ELSE '' END AS errors,
       '{"arguments":' || CASE WHEN c.conv_id IS NULL THEN 'null' ELSE to_json({'text': c.text, 'turn': c.turn}) END
       || ',"depends_on":' || coalesce(d.deps, '[]') || ',"id":"turn-' || coalesce(c.turn, r.turn) || '","name":'
       || CASE c.role WHEN 'user' THEN '"reply"' WHEN 'system' THEN '"set_system"' ELSE 'null' END
       || ',"result":' || CASE WHEN r.conv_id IS NULL THEN 'null' ELSE to_json({'text': r.text}) END || '}' AS json
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn
LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn
"""


@query("op1_tool_call_links", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toolcalls.format_conversations(table(spark, sf_dir, "conversations"))
    return out.withColumn("errors", F.array_join("errors", ","))


OP11_SQL = """
WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
           FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT doc_id, i, line, coalesce(doc_id <> first_id, false) AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op11_line_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _op12_sql() -> str:
    """Four rounds as a chain of materialised steps over (vec_id, part, position) rows."""
    steps = ["""
WITH ok AS (SELECT vec_id, label, embedding FROM documents_or_embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p AS part, list_transform(embedding[p * len(embedding) // 4 + 1 : (p + 1) * len(embedding) // 4],
                          lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM ok, range(4) r(p)),
b0 AS MATERIALIZED (SELECT part, k, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k FROM v) WHERE k < 256)"""
             .replace("documents_or_embeddings", "embeddings")]
    for r in range(5):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(k, d * 256 + k) AS k, min(d) AS d
  FROM (SELECT v.vec_id, v.part, b.k, list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM v JOIN b{r} b USING (part)) GROUP BY vec_id, part)""")
        if r < 4:
            steps.append(f"""m{r} AS (SELECT part, k, list(f ORDER BY i) AS c FROM (
  SELECT part, k, i, (sum(e)::BIGINT - ((sum(e)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS f
  FROM (SELECT a.part, a.k, unnest(v.x) AS e, unnest(range(len(v.x))) AS i FROM a{r} a JOIN v USING (vec_id, part)) GROUP BY ALL) GROUP BY part, k),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.k, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (part, k))""")
    return ",\n".join(steps) + """,
f AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id),
s AS (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY part, k), '')) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM f JOIN ok USING (vec_id), s
"""


@query("op12_limb_vector_codes", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcodes.encode_vectors(table(spark, sf_dir, "embeddings"))
    codes = write_table(codes, "vector-codes")
    sums = codes.groupBy(F.col("label_").alias("of_")).agg(F.try_sum("error").alias("label_error"))
    out = codes.join(checked_broadcast(sums), F.col("label_").eqNullSafe(F.col("of_")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


OP13_SQL = r"""
WITH RECURSIVE z(n, c, s) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) g(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM z WHERE s < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM z WHERE s = 8),
h AS (SELECT doc_id, text, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS h FROM documents, crc),
d AS (SELECT doc_id, h, h // 10 AS g, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM h),
o AS (SELECT doc_id, words, len(words)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN g % len(words) ELSE len(words) END AS a, g FROM d),
w AS MATERIALIZED (SELECT doc_id, n, i, words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word
                   FROM (SELECT *, unnest(range(n)) AS i FROM o)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS MATERIALIZED (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e)
      GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND s.q % t.q = 0
      AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := q), (-length, start, q)) AS best,
             string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Rows of the contract's texts: where crc32 of the decimal id divides by
    ten, the words from one on repeat with a period that the same number gives."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    cut = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("words"))
    n = F.size("words")
    at = cut.select("*", n.alias("n"), F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    at = at.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), again)
    return at.select("doc_id", F.when(F.col("p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    out = out.select("*", best.alias("best"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.m")).alias("length"),
                      F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.m") / F.col("best.period")).alias("exponent_milli"),
                      F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
