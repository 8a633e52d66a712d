"""The registered queries of the operators, with production parameters over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import token_counts as tc
from calibrant.llm.bpe import encode_bpe
from calibrant.llm.change_applier import apply_changes
from calibrant.llm.common import BROADCAST_IDS, learning_rows, shared_path, stored, table
from calibrant.llm.decontaminate import contamination
from calibrant.llm.exact_dedup import exact_dedup
from calibrant.llm.fill_middle import fill_in_middle
from calibrant.llm.licences import licence_scan
from calibrant.llm.near_dedup import near_components
from calibrant.llm.quality import quality
from calibrant.llm.secrets import secret_scan
from calibrant.llm.sharding import kd_shards
from calibrant.llm.toxicity import toxicity
from calibrant.llm.warc import read_warc, write_warc

#: Vocabulary files, which lie at one path on every executor.
BYTE_BPE = vocabulary("byte_bpe_50k.json")
VERSIONS = {"v1": vocabulary("byte_bpe_50k.tiktoken"), "v2": vocabulary("byte_bpe_multi_50k.tiktoken")}


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents; digests of ids and of the decoded text."""
    return encode_bpe(table(spark, sf_dir, "documents"), BYTE_BPE, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxicity severity of every document; labels.toxic of the held-out quarter is not learned from."""
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=learning_rows())
    return scored.select("doc_id", (~learning_rows()).alias("held_out"), "expected_severity", "grade", "p_toxic", "toxic")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over documents: tokens of two vocabularies are inserted, those of the first with an
    end-of-text token a document; the first are revised to leave it out; copies of a text but the one with the largest id
    are deleted. Two batches are sent again, which changes nothing."""
    docs = table(spark, sf_dir, "documents").withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    counted = tc.token_counts(docs, VERSIONS, keys=("doc_id", "source", "lang", "sha"))
    rows = stored(counted.withColumn("v1_end", F.col("v1") + 1), "token-counts")
    copies = stored(rows.groupBy("sha").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep"), "token-copies")
    few = copies.count() <= BROADCAST_IDS // 4  # 20 MB
    gone = stored(rows.join(F.broadcast(copies) if few else copies, "sha").where("doc_id < keep").select("source", "lang", "v1", "v2"), "token-gone")
    ledger = tc.TokenLedger(spark, shared_path(spark, "token-ledger"))
    version_2, revised = tc.inserts(rows, "byte_bpe_multi@1", "v2"), tc.revisions(rows, "byte_bpe@1", "v1_end", "v1")
    ledger.commit("1-insert", tc.inserts(rows, "byte_bpe@1", "v1_end"))
    ledger.commit("2-insert", version_2)
    ledger.commit("3-revise", revised)
    ledger.commit("2-insert", version_2)
    ledger.fold()
    ledger.commit("4-delete", tc.deletes(gone, "byte_bpe@1", "v1").union(tc.deletes(gone, "byte_bpe_multi@1", "v2")))
    ledger.commit("3-revise", revised)
    return ledger.totals()


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_components(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of documents; the largest doc_id of each stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every document by its paragraphs."""
    return licence_scan(table(spark, sf_dir, "documents")).withColumn("families", F.concat_ws(",", "families"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all documents into 24 shards of equal bytes."""
    return kd_shards(table(spark, sf_dir, "documents"), shards=24)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 13-word windows of benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=13)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels.quality of the held-out quarter is not learned from."""
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~learning_rows()).alias("held_out"), "score", "predicted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives and read all records back through the index."""
    records = read_warc(write_warc(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of clients, applied in order of their numbers by ten starts of a stateful stream."""
    changes = table(spark, sf_dir, "client_changes")
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary"))
    day = F.datediff(F.to_date("valid_at"), F.lit("1970-01-01").cast("date")) + 5 * (h % 4)
    batch = F.least(F.lit(10), 1 + F.floor((day - 19723) * 10 / 160))
    got = apply_changes(changes, day, batch, F.col("valid_at").isNotNull() & (h % 11 != 0), 10)
    cents = F.floor(100 * F.col("balance") + 0.5).cast("bigint")
    return got.select("change_id", "client_id", "status", "batch", "missed", "city", cents.alias("cents"), "current")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document by patterns and by novelty; the dictionary is of the documents' own words."""
    found = secret_scan(table(spark, sf_dir, "documents"), outputs=("n_assign", "n_access", "n_hex", "base_sha256", "spans_text", "n_novel"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("spans_text").alias("spans"), "n_novel")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and its text rebuilt from that."""
    outputs = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return fill_in_middle(table(spark, sf_dir, "documents"), outputs=outputs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_licences": op6_licences,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_changes": op11_changes,
    "op12_secrets": op12_secrets,
    "op13_fill_middle": op13_fill_middle,
}

ASCII_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op13_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM documents),
        h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || hx[1:8] AS BIGINT) AS h1, CAST('0x' || hx[9:16] AS BIGINT) AS h2,
                     CAST('0x' || hx[17:24] AS BIGINT) AS h3, CAST('0x' || hx[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {ASCII_LOWER.format("text")} AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        k AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS keep,
                     CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p)
        SELECT page_id,
               CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
                     + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
                     + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
        FROM k""",
    "op4_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, ws[k : k + 3] AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op8_decontamination": r"""
        WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        w AS (SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM t),
        win AS (SELECT DISTINCT id AS item, ws[s : s + least(len(ws), 13) - 1] AS g FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s FROM w WHERE kind = 'i' AND len(ws) > 0)),
        lens AS (SELECT DISTINCT len(g) AS n FROM win),
        grams AS (SELECT id AS doc_id, s, n, ws[s : s + n - 1] AS g FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, lens WHERE kind = 'd' AND len(ws) >= n)),
        hit AS (SELECT doc_id, s, n, item FROM grams JOIN win USING (g)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
        SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
               sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM w LEFT JOIN pos ON pos.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE kind = 'd'""",
}
