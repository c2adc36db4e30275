"""The operators applied to their whole tables with production parameters, under the names that the entry module registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language_id, line_dedup, media, near_dup, packing, sharding, token_counts, url_filters
from .runtime import prepare, table


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op2_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.attribute_tokens(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "section", "char_start", "char_end", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_tokens")


def op3_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages")).drop("share")


def op4_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), exact=2)
    return out.select("doc_id", "n_lines", F.col("dropped").alias("dropped_lines"), F.crc32("text").alias("kept_crc32"), F.octet_length("text").cast("long").alias("kept_bytes"))


#: Tools that the chats of op5 may call: their argument schemas.
TOOLS = {
    "lookup": {"type": "object", "required": ["query", "limit"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 5}}, "additionalProperties": False},
    "measure": {"type": "object", "required": ["chars"], "properties": {"chars": {"type": "integer", "minimum": 0}, "unit": {"enum": ["chars", "bytes"]}}},
}


def tool_chats(conversations: DataFrame) -> DataFrame:
    """All rows of ``conversations``, their turns doubled, with tool traffic, which the table itself doesn't have.

    The checksum of an assistant's text decides it. Each such message makes one call (id ``call-<turn>``; of ``lookup``, ``measure`` or a tool without
    schema), with arguments read from the text, some of them out of range. Seven of eight calls have a result row: after the call, before it, or
    under an id that no call has.
    """
    k = F.crc32(F.coalesce("text", F.lit("")))
    turn, said = F.col("turn") * 2, F.col("role") == "assistant"
    ident = F.concat(F.lit("call-"), turn.cast("string"))
    lookup = F.to_json(F.struct(ident.alias("id"), F.lit("lookup").alias("name"), F.struct(F.substring("text", 1, 12).alias("query"), (k % 7).alias("limit")).alias("arguments")))
    measure = F.to_json(F.struct(ident.alias("id"), F.lit("measure").alias("name"), F.struct(F.length("text").alias("chars"), F.when(k % 5 == 0, "words").otherwise("chars").alias("unit")).alias("arguments")))
    other = F.to_json(F.struct(ident.alias("id"), F.lit("other").alias("name"), F.struct().alias("arguments")))
    call = F.when(k % 3 == 0, lookup).when(k % 3 == 1, measure).otherwise(other)
    spoken = F.when(said, F.concat(F.coalesce("text", F.lit("")), F.lit("\n<tool_call>"), call, F.lit("</tool_call>"))).otherwise(F.col("text"))
    way = F.shiftright(k, 8) % 8  # 0 to 3: after the call, 4 and 5: before it, 6: another id, 7: no result
    answer = F.to_json(F.struct(F.when(way == 6, F.concat(F.lit("lost-"), ident)).otherwise(ident).alias("tool_call_id"), F.struct(F.length("text").alias("n"), k.alias("crc")).alias("content")))
    results = conversations.where(said & (way < 7)).select("conv_id", F.when(way.isin(4, 5), turn - 1).otherwise(turn + 1).alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    return conversations.select("conv_id", turn.alias("turn"), "role", spoken.alias("text")).unionByName(results)


def op5_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(tool_chats(table(spark, sf_dir, "conversations")), TOOLS)


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents"), k=4, threshold=0.8)


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), 1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_media(table(spark, sf_dir, "documents")).withColumn("declared_type", F.lit("text/plain"))  # what the column was before
    return media.media_digests(stored, declared="declared_type")


def op10_piece_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))  # a null doc_id has no remainder
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return {k: (lambda s, d, f=f: f(prepare(s), d)) for k, f in sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op3_path_templates": url_filters.oracle()}
