"""The operators of this package over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, bpe, chat, codes, density, digest_tree, minmax, mixing, phrases, rules, toxicity, weak, whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = density.extract_main_text(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.classify_quality(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_legacy_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_pages(_table(spark, sf_dir, "pages")).drop("url")


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tree.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


#: A conversation whose texts hold what looks like the template's marks.
MARKED = r"\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', r'{MARKED}'), (-7L, 1L, 'assistant', r'{MARKED}') AS t(conv_id, turn, role, text)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = chat.format_chats(turns)
    read = chat.read_chats(chats)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    lost = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    back = bpe.decode_ids(coded.drop("text"), path, pattern)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codebooks = codes.compress_vectors(_table(spark, sf_dir, "embeddings"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(codes.codebooks_digest(codebooks)).alias("codebooks_sha256"))


def op12_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten.whiten(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_phrase_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(_table(spark, sf_dir, "documents"), kept=False)


SQL7 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

SQL4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN first_id END AS refers_to
FROM g
"""

SQL9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS joins, coalesce(lead(role) OVER w = role, false) AS goes_on,
         len(text) + len(regexp_replace(text, '[^#<\\]', '', 'g')) AS body,
         len(role) + len(regexp_replace(role, '[^#<\\]', '', 'g')) AS name
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), lost AS (
  SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         sum(body + CASE WHEN joins THEN 6 ELSE 4 + name + 9 END + CASE WHEN goes_on THEN 0 ELSE 8 END) AS chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM lost
"""


def _lloyd_sql(rounds: int = 2) -> str:
    """Vectors of 64 dimensions in parts of four. Distance and entry make one number, so the least has the lowest entry of the nearest."""
    comps = ", ".join(f"CAST(floor(256 * CAST(embedding[4 * pos + {j}] AS DOUBLE)) AS BIGINT) AS v{j}" for j in range(1, 5))
    far = " + ".join(f"(p.v{j} - c.v{j}) * (p.v{j} - c.v{j})" for j in range(1, 5))
    mean = ", ".join(f"coalesce(CAST(floor(s.v{j} / s.k) AS BIGINT), c.v{j}) AS v{j}" for j in range(1, 5))
    sums = ", ".join(f"CAST(sum(v{j}) AS BIGINT) AS v{j}" for j in range(1, 5))
    ctes = [
        "kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, pos, {comps} FROM kept, range(16) r(pos))",
        "c0 AS (SELECT pos, e, v1, v2, v3, v4 FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 64)",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS (SELECT vec_id, any_value(p.label) AS label, pos, any_value(p.v1) AS v1, any_value(p.v2) AS v2, any_value(p.v3) AS v3, any_value(p.v4) AS v4, min(({far}) * 64 + e) AS m FROM p JOIN c{k} c USING (pos) GROUP BY vec_id, pos)")
        if k < rounds:
            ctes.append(f"c{k + 1} AS (SELECT c.pos, c.e, {mean} FROM c{k} c LEFT JOIN (SELECT pos, m % 64 AS e, count(*) AS k, {sums} FROM a{k} GROUP BY ALL) s ON s.pos = c.pos AND s.e = c.e)")
    books = f"SELECT sha256(string_agg(v1 || ',' || v2 || ',' || v3 || ',' || v4, ',' ORDER BY pos, e)) FROM c{rounds}"
    return f"""WITH {', '.join(ctes)}, done AS (
      SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', m % 64), '' ORDER BY pos) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, ({books}) AS codebooks_sha256 FROM done"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_main_text": op2_main_text,
    "op3_quality_rules": op3_quality_rules,
    "op4_legacy_archive": op4_legacy_archive,
    "op5_weak_quality": op5_weak_quality,
    "op6_minmax_dedup": op6_minmax_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_chat_format": op9_chat_format,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_part_codes": op11_part_codes,
    "op12_lobpcg_whitening": op12_lobpcg_whitening,
    "op13_phrase_repeats": op13_phrase_repeats,
}

ORACLES: dict[str, str] = {"op4_legacy_archive": SQL4, "op7_exact_dedup": SQL7, "op9_chat_format": SQL9, "op11_part_codes": _lloyd_sql()}
