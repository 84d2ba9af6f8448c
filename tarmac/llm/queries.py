"""Queries of the operators for language-model data: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, chat, decontaminate, hard_negatives, html_text, jaccard_join, langid, lm_score, media, merkle, substring_dedup, token_counts, url_filter
from tarmac.llm.common import discard, shared_dir, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    rows = rows.unionByName(extra).withColumn("content", chat.text_parts(F.col("text")))
    done = chat.format_chats(rows).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("masked", F.array_join(chat.masked_texts(F.col("formatted"), F.col("turns")), ""))
    return done.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", "n_chars")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    done = langid.predict(docs, model, keep=("doc_id", "held_out"))
    return done.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())
    return done.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.with_media(_table(spark, sf_dir, "documents")).select("row.doc_id", "n_bytes", "media")
    done = media.media_features(stored, keep=("doc_id", "n_bytes"))
    return done.select("row.doc_id", "row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint")


#: The rules of the URL query: host, path and verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    done = url_filter.judge(_table(spark, sf_dir, "pages"), rules)
    return done.select("row.page_id", "host", "path", "rule", "verdict")


def rolled_up(spark: SparkSession, docs: DataFrame, labels: DataFrame, first: str, second: str) -> DataFrame:
    """Totals after four batches of ``docs`` (doc_id, source, lang and a count by each version).

    Batch 1 inserts all documents; 2 revises the count of those labelled low quality to the second version; 3 deletes toxic
    ones; 2 comes again.
    """
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 0).alias("poor"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Counts, not texts, are shuffled to the labels, once for all batches.
    docs = written(docs.join(marks, "doc_id", "left").fillna(False, ["poor", "toxic"]))

    def changes(rows, version, sign=1):
        return token_counts.counted(rows, version, sign, count_col=version)

    poor, toxic = F.col("poor"), F.col("toxic")
    revised = changes(docs.where(poor), first, -1).unionByName(changes(docs.where(poor), second))
    deletes = changes(docs.where(toxic & poor), second, -1).unionByName(changes(docs.where(toxic & ~poor), first, -1))
    rollup = token_counts.Rollup(spark, shared_dir(spark))
    for batch, rows in ((1, changes(docs, first)), (2, revised), (3, deletes), (2, revised)):
        rollup.commit(batch, rows)
    discard(docs)
    return rollup.totals()


def vocabularies() -> dict[str, str]:
    """The tokenizer versions of the query of token counts and their vocabulary files."""
    import public_tokenizers

    return {"words-49k": tokenizer_path(), "bytes-50k": public_tokenizers.path("byte_bpe_50k.json")}


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by two vocabularies: counts by words are revised to counts by bytes where a label says low quality."""
    done = token_counts.vocabulary_counts(_table(spark, sf_dir, "documents"), vocabularies(), keep=("doc_id", "source", "lang"))
    docs = done.select("row.*", *vocabularies())
    return rolled_up(spark, docs, _table(spark, sf_dir, "labels"), *vocabularies())


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "text", "n_sentences", "n_removed")


def merkle_rows(docs: DataFrame) -> DataFrame:
    """The manifest's columns; half of the rows, by the CRC of their ids, are altered: their texts lose all line feeds."""
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = {"text": F.when(cut, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    folded = merkle.fold(F.col("altered_leaf"), F.col("path"))
    made = merkle.manifest(docs, altered=altered).select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    done = lm_score.score_texts(_table(spark, sf_dir, "documents"), held_out)
    return done.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat": op2_chat,
    "op3_html": op3_html,
    "op4_language": op4_language,
    "op5_jaccard": op5_jaccard,
    "op6_bpe": op6_bpe,
    "op7_media": op7_media,
    "op8_urls": op8_urls,
    "op9_token_counts": op9_token_counts,
    "op10_substrings": op10_substrings,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lm_score": op13_lm_score,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_decontaminate": rf"""
        WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS win, least(len(w), 10) AS n
               FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
               FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_chat": r"""
        WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<turn ') + length(role) + length('>') + 1 + length(replace(replace(text, '\', '\b'), '<', '\l')) + length('</turn>') + 1)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op8_urls": r"""
        WITH p AS (SELECT page_id,
                          translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, host, path,
               CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
               CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'allow'
                    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'block'
                    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'allow'
                    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
        FROM p""",
}


def _told(column: str) -> str:
    """DuckDB SQL of a value in a leaf: ``-`` if null, else its UTF-8 bytes, a colon and the value."""
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of a decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
              lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295)"""

SQL["op11_merkle"] = rf"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, coalesce('=' || source, '-') AS g, {_leaf("text")} AS leaf,
               {_leaf(f"(CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS altered,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
        FROM documents),
    low AS (SELECT 0 AS lvl, g, i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves
            UNION ALL
            SELECT lvl + 1, g, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY lvl, g, i // 3),
    subs AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM low WHERE n = 1),
    high AS (SELECT 0 AS lvl, i, subroot AS node, count(*) OVER () AS n FROM subs
             UNION ALL
             SELECT lvl + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, i // 3),
    -- a node's siblings: those of its run, to its left and to its right
    low_s AS (SELECT a.lvl, a.g, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
              FROM low a JOIN low b ON a.lvl = b.lvl AND a.g = b.g AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
    high_s AS (SELECT a.lvl, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
               FROM high a JOIN high b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
    powers AS (SELECT k, (3 ** k)::BIGINT AS p FROM generate_series(0, 30) t(k)),
    steps AS (SELECT f.g, f.i, s.lvl, s.l, s.r FROM leaves f, powers JOIN low_s s ON s.lvl = k AND s.g = f.g AND s.i = f.i // p
              UNION ALL
              SELECT f.g, f.i, 100 + s.lvl, s.l, s.r FROM leaves f JOIN subs USING (g), powers JOIN high_s s ON s.lvl = k AND s.i = subs.i // p),
    paths AS (SELECT g, i, list(l || '|' || r ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS proof FROM steps GROUP BY g, i),
    done AS (SELECT doc_id, leaf, subroot, (SELECT node FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
                    list_reduce(list_prepend(altered, coalesce(path, [])), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root
             FROM leaves JOIN subs USING (g) LEFT JOIN paths ON paths.g = leaves.g AND paths.i = leaves.i)
    SELECT *, folded_root = root AS verified FROM done"""

SQL["op12_hard_negatives"] = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""
