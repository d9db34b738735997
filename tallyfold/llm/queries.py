"""The registered queries of this folder: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import chat, decontaminate, mixing, packing, pii, quality, ranked, repeats, simhash, token_output, topk, toxicity, whitening
from tallyfold.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


# The control-string conversation of the contract: fixed values.
CONTROL_ID, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"


@register("op3_chat_format", """
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
    esc AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>'), '###', '#\\#\\#') AS body FROM turns)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(role) + length(body) + 14) AS BIGINT) AS formatted_chars
    FROM esc GROUP BY conv_id""")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted as prefix-target examples and read back."""
    fixed = spark.range(2).select(F.lit(CONTROL_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.formatted_and_read(turns)


@register("op8_token_output")
def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents as ORC files, read back."""
    return token_output.token_output(table(spark, sf_dir, "documents"), vocabulary())


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op9_source_mix")
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@register("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their near-duplicate components."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out third."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels outside the held-out quarter."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_decontaminate", """
    WITH lowered AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    items AS (SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    cuts AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS gram FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT len(gram) AS n FROM cuts),
    places AS (SELECT row, s, list_slice(w, s, s + n - 1) AS gram FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM lowered, lengths WHERE len(w) >= n)),
    hits AS (SELECT row, s, gram FROM places WHERE gram IN (SELECT gram FROM cuts)),
    hit_words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(s, s + len(gram) - 1)) AS p FROM hits) GROUP BY 1),
    hit_items AS (SELECT row, list(DISTINCT CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits JOIN cuts USING (gram) WHERE item_id IS NOT NULL GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
        sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM lowered LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans and those that bootstrapped patterns add."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@register("op7_top_products", """
    WITH ints AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
        FROM ints q JOIN ints d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""")
def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer products of every hundredth vector with all others."""
    return topk.self_top_products(table(spark, sf_dir, "embeddings"))


@register("op1_repeats")
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed from all documents."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


@register("op11_ranked_search", """
    WITH cut AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    docs AS (SELECT * FROM cut WHERE len(w) > 0),
    total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs),
    items AS (SELECT item_id, row_number() OVER () AS item, unnest(list_distinct(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term FROM benchmark),
    found AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY 1, 2),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM found, total GROUP BY term, n_docs),
    scored AS (
        SELECT item, item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(len(w) AS BIGINT) * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM items JOIN found USING (term) JOIN weights USING (term) JOIN docs USING (row), total GROUP BY item, item_id, row, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_packed")
def op12_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op13_whitened")
def op13_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first components of their covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
