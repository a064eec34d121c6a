"""The registered queries of this package: one thin function for each operator
that applies it to its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontaminate, jaccard, lmscore, media, repeats, resample, segment, sharding, toxicity, warc
from .common import table, work_dir

#: Where the public tokenizers are described and found (path() gives a file's place).
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, and -7, and read the output back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = chat.format_chat(rows.unionByName(probe).withColumn("parts", chat.text_part(F.col("text"))))
    turns = chat.parse_chat(F.col("formatted"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", "formatted", turns.alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"""regexp_replace(replace(coalesce({0}, ''), '\', '\\'), '([<\[])', '\1\\', 'g')"""
OP1_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || replace({_ESC.format("role")}, chr(10), '[n') || chr(10) || {_ESC.format("text")} || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document with the subword lattice model."""
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place every document on 64 shards, and on the 63 left without the last."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    tables = {"shard": sharding.fill_table(SHARDS), "shard_without_last": sharding.fill_table(SHARDS[:-1])}
    return sharding.assign_shards(docs, "doc_id", tables).select("doc_id", "slot", "shard", "shard_without_last")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an image with its NPY tiles, and compute features
    from what is read back."""
    return media.media_features(media.store(table(spark, sf_dir, "documents"), work_dir(spark) + "/media"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample a segmentation of every text and decode it again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    back = segment.decode_pieces(segment.encode_pieces(docs, drop_text=True))
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that documents share."""
    return repeats.find_repeats(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with its best window."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-gram similarity of 0.9 or more."""
    return jaccard.components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convert every page from ARC to WARC, write the archives and read them back."""
    parsed = warc.read_arc(warc.pages_to_arc(table(spark, sf_dir, "pages")))
    path, index = work_dir(spark) + "/warc", warc.payload_index(parsed)
    warc.write_warc(warc.mark_revisits(parsed, index), path, index)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT page_id, octet_length(b) AS n, d, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""



def _tokenizer(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align every document's tokens of two tokenizers."""
    aligned = align.align_tokens(table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE), _tokenizer(PIECE_BPE), ["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    scored = align.score_links(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw a tenth of the documents towards the benchmark's words."""
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by byte-level BPE and decode it again."""
    path = _tokenizer(BYTE_BPE)
    ids = bpe.encode_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), path, packed=True, drop_text=True)
    back = bpe.decode_bpe(ids, path)
    n = (F.octet_length("token_ids") / 4).cast("long")
    return back.select("doc_id", n.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_lm_score": op2_lm_score,
    "op3_sharding": op3_sharding,
    "op4_media": op4_media,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_align": op11_align,
    "op12_resample": op12_resample,
    "op13_bpe": op13_bpe,
}
SQL = {"op1_chat": OP1_SQL, "op10_warc": OP10_SQL}
