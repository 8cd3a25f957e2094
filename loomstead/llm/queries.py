"""The registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import audit, bpe, html, importance, media, mixing, packing, quality, secrets, simhash, tokens, toxicity, warc
from loomstead.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), warc.new_folder(spark)
    index = warc.write_archive(pages, folder)
    kind = pages.schema["page_id"].dataType
    read = warc.read_records(index, folder)
    return read.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.stored_features(media.text_tiles(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity.tag(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    counted = tokens.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    fits = tokens.longest_within(F.col("prefix_counts"), F.lit(limit).cast("long"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), fits.alias("chars_within_limit"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE)
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents, the last one -> packed pieces.


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the field is trained on those labelled among ``docs``."""
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the text."""
    out = secrets.mask_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", keep_civil), ("quality_rules", keep_quality), ("simhash_near_dedup", keep_first), ("secret_scans", mask_secrets), ("packing", pack_documents)]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_warc, op3_media, op4_html, op5_toxicity, op6_quality, op7_token_counts, op8_simhash, op9_secrets, op10_bpe, op11_importance, op12_audit, op13_mixing)} | {"pipeline": pipeline}

BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1, 1)), '')"

#: Documents with the five verdicts as bits, then every order's steps with the filters before as bits.
AUDIT = """WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS words FROM documents),
 f AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x))::INT
  + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)::INT AS bits FROM w),
 l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
 m AS (SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
 o AS (SELECT '' AS filter_order, 0 AS used UNION ALL SELECT filter_order || substr('ABCDE', k::INT + 1, 1), used | (1 << k::INT) FROM o, range(5) r(k) WHERE used & (1 << k::INT) = 0),
 s AS (SELECT filter_order, step::INT AS step, 1 << (instr('ABCDE', substr(filter_order, step::INT, 1)) - 1)::INT AS own, list_sum(list_transform(string_split(substr(filter_order, 1, step::INT - 1), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (instr('ABCDE', c) - 1)::INT END))::INT AS before FROM o, range(1, 6) t(step) WHERE used = 31),
 r AS (SELECT part, filter_order, step, own, sum(n) FILTER (bits & (before | own) = 0) AS kept, sum(n) FILTER (bits & own > 0 AND bits & before = 0) AS removed, sum(n) FILTER (bits & own > 0 AND bits & before > 0) AS redundant,
  sum(n) FILTER (bits = own) AS unique_fails, sum(good) FILTER (bits & own > 0 AND bits & before = 0) AS good_lost, sum(toxic) FILTER (bits & own > 0 AND bits & before = 0) AS toxic_lost FROM m, (SELECT filter_order, step, own, coalesce(before, 0) AS before FROM s) GROUP BY ALL)
 SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r"""

#: CRC-32 of every different feature by bytes: what a byte leaves in the register so many bytes before the end
#: (``t``), and what the register's first value leaves (``z``), all combined by exclusive or.
IMPORTANCE = """WITH RECURSIVE q(v, c, n) AS (SELECT v, v, 0 FROM range(256) r(v) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM q WHERE n < 8),
 step AS (SELECT v, c FROM q WHERE n = 8),
 d AS (SELECT doc_id, NULL::BIGINT AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT NULL::BIGINT, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
 g AS (SELECT doc_id, item, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM d),
 u AS (SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM g)),
 t(k, v, c) AS (SELECT 0, v, c FROM step UNION ALL SELECT k + 1, t.v, xor(t.c >> 8, step.c) FROM t JOIN step ON step.v = t.c & 255 WHERE k < (SELECT max(n) FROM u)),
 z(k, c) AS (SELECT 0, 4294967295 UNION ALL SELECT k + 1, xor(z.c >> 8, step.c) FROM z JOIN step ON step.v = z.c & 255 WHERE k < (SELECT max(n) FROM u)),
 b AS (SELECT f, n, n - i - 1 AS k, ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT AS v FROM (SELECT f, x, n, unnest(range(n)) AS i FROM u)),
 h AS (SELECT f, xor(xor(bit_xor(t.c), any_value(z.c)), 4294967295) % 10000 AS bucket FROM b JOIN t USING (k, v) JOIN z ON z.k = b.n GROUP BY f),
 e AS (SELECT doc_id, item, bucket, count(*) AS n FROM g JOIN h USING (f) GROUP BY ALL),
 a AS (SELECT bucket, coalesce(sum(n) FILTER (item IS NULL), 0)::BIGINT AS s, coalesce(sum(n) FILTER (item IS NOT NULL), 0)::BIGINT AS t FROM e GROUP BY 1),
 n AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM a),
 gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM a, n),
 weight AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM e JOIN gain USING (bucket) WHERE item IS NULL GROUP BY 1),
 scored AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weight ON weight.doc_id = d.doc_id WHERE item IS NULL),
 ranked AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id) AS place FROM scored)
 SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END::BIGINT AS rank FROM ranked"""

ORACLES: dict[str, str] = {
    "op11_importance": IMPORTANCE,
    "op12_audit": AUDIT,
    "op2_warc": f"WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages), r AS (SELECT h, max(page_id) AS first FROM p GROUP BY h) "
    f"SELECT page_id, n AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN r USING (h)",
}
