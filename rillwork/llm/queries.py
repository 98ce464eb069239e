"""One query for each operator over its whole table, and SQL answers where SQL can give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import (byte_bpe, chat, fingerprints, lm_scoring, lookup_clusters, manifest, mixing, neighbours, packing,
                          passages, private_data, simhash, toxicity)
from rillwork.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality; background: all others. No document is judged by its own counts."""
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), target, leave_own_out=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_text(F.col("fp")).alias("fingerprint"), "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema))
    # the same rows in three layouts, one with fields that no mapping asks for
    whole = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct("role", "text", F.lit("x").alias("source")), whole)
    chat_like = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")), whole)
    spoken = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("speaker"), "text")).alias("turns")), whole)
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    records = rows.select("conv_id", "turn", F.when(kind == 0, plain).when(kind == 1, chat_like).otherwise(spoken).alias("record"))
    turns = chat.canonical_turns(records, "conv_id", "turn", "record", aliases={})
    return chat.read_back(chat.format_turns(turns)).withColumnRenamed("key", "conv_id")


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next")


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private(table(spark, sf_dir, "documents"))
    counts = [private_data.kind_count(F.col("base"), n).alias(f"n_{k}") for n, k in enumerate(private_data.KINDS)]
    return found.select("doc_id", *counts, F.sha2(private_data.span_text(F.col("base")), 256).alias("base_sha256"),
                        private_data.span_text(F.col("spans")).alias("spans"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    return byte_bpe.decode_documents(encoded, ranks, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering adds 1 to ``n_chars`` where 7 divides the CRC of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.when(hit, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in manifest.FIELDS]
    rows = manifest.dataset_manifest(table(spark, sf_dir, "documents"), extra={"tampered": manifest.leaf_hash(fields)})
    folded = rows.withColumn("folded_root", manifest.fold(F.col("tampered"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_source_mixing, op3_repeated_passages, op4_projection_forest, op5_cross_entropy_difference,
    op6_toxicity, op7_simhash, op8_chat_format, op9_merkle_fingerprints, op10_private_data, op11_byte_bpe,
    op12_merkle_manifest, op13_lookup_clusters)}

def _lloyd_sql(k: int, rounds: int) -> str:
    """Assignments and floor means in plain SQL, one pair of steps a round."""
    steps = [f"""whole AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        parts AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS d FROM whole),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v
            FROM whole ORDER BY sha256('2:' || vec_id) LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, min((distance, cluster)) AS best FROM (
            SELECT vec_id, cluster, sum((x - y) * (x - y))::BIGINT AS distance
            FROM parts JOIN (SELECT cluster, unnest(v) AS y, unnest(range(64)) AS d FROM c{r}) USING (d) GROUP BY vec_id, cluster) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
            SELECT cluster, list(mean ORDER BY d) AS v FROM (
                SELECT best[2] AS cluster, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean
                FROM a{r} JOIN parts USING (vec_id) GROUP BY 1, 2) GROUP BY cluster) m USING (cluster))""")
    return "WITH " + ",\n        ".join(steps) + f"""
        SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
            (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON cluster = best[2]"""


ORACLES = {
    "op3_repeated_passages": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
        win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
        bad AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        near AS (SELECT words.*, b.i AS hit FROM words ASOF LEFT JOIN bad b ON words.doc_id = b.doc_id AND words.p >= b.i),
        kept AS (SELECT doc_id, word, p, hit IS NOT NULL AND p < hit + 50 AS gone FROM near)
        SELECT w.doc_id, len(any_value(w.ws))::BIGINT AS n_words, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id GROUP BY w.doc_id""",
    "op8_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|<SYS>>|</SYS>>|/?s>|/?TURN\])', '\1\\\2\3', 'g') AS own FROM c),
        f AS (SELECT *, CASE role WHEN 'user' THEN '[INST] ' || own || ' [/INST]' WHEN 'assistant' THEN '<s> ' || own || ' </s>'
                        ELSE '<<SYS>>' || chr(10) || own || chr(10) || '<</SYS>>' END AS formatted FROM e)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(formatted))::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE docs AS (SELECT doc_id, source, lang, n_chars, text, list_reduce(
                 list_concat([4294967295], flatten(list_transform(range(1, 1 + length(doc_id::VARCHAR)), lambda i:
                     list_concat([ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT], list_transform(range(8), lambda j: -1))))),
                 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc FROM documents),
        framed AS (SELECT doc_id, lang, xor(crc, 4294967295) % 7 = 0 AS hit, n_chars,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                     || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                 coalesce(strlen(text) || ':' || text, '-') AS tail FROM docs),
        leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                 sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || tail) AS given
                 FROM framed),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx,
                 count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        nodes AS (SELECT lang, 0 AS lvl, idx, n, leaf AS h FROM placed UNION ALL
                 SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) FROM (
                     SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY idx) AS other FROM nodes) WHERE n > 1 AND idx % 2 = 0),
        subroots AS (SELECT lang, lvl AS depth, h, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place,
                 count(*) OVER () AS total FROM nodes WHERE n = 1),
        upper_nodes AS (SELECT 0 AS lvl, place AS idx, total AS n, h FROM subroots UNION ALL
                 SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) FROM (
                     SELECT *, lead(h) OVER (ORDER BY idx) AS other FROM upper_nodes) WHERE n > 1 AND idx % 2 = 0),
        walk AS (SELECT p.doc_id, p.lang, p.idx AS leaf_idx, p.leaf, s.h AS subroot, s.depth, s.place, s.total, 0 AS lvl, p.idx, p.given AS h, '' AS proof
                 FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang UNION ALL
                 SELECT w.doc_id, w.lang, leaf_idx, leaf, subroot, depth, place, total, w.lvl + 1,
                     CASE WHEN w.lvl + 1 = depth THEN place ELSE w.idx // 2 END,
                     sha256(CASE WHEN w.idx % 2 = 0 THEN w.h || coalesce(a.h, b.h, '') ELSE coalesce(a.h, b.h) || w.h END),
                     proof || coalesce(a.h, b.h, '')
                 FROM walk w LEFT JOIN nodes a ON w.lvl < depth AND a.lang IS NOT DISTINCT FROM w.lang AND a.lvl = w.lvl AND a.idx = xor(w.idx, 1)
                 LEFT JOIN upper_nodes b ON w.lvl >= depth AND b.lvl = w.lvl - depth AND b.idx = xor(w.idx, 1)
                 WHERE w.lvl < depth OR w.total > (1::BIGINT << (w.lvl - depth))),
        ends AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lang, leaf_idx ORDER BY lvl DESC) AS last FROM walk)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM ends, (SELECT h AS root FROM upper_nodes WHERE n = 1) WHERE last = 1""",
    "op13_lookup_clusters": _lloyd_sql(40, 5),
}
