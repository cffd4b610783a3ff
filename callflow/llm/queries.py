"""One query per operator over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callflow.llm.chat import format_conversations, read_back
from callflow.llm.decontaminate import contaminated
from callflow.llm.exact_dedup import exact_duplicates
from callflow.llm.html_text import extract_text
from callflow.llm.language import identify_languages
from callflow.llm.mixing import mix_sources
from callflow.llm.packing import pack
from callflow.llm.quality import classify_quality
from callflow.llm.repeats import remove_repeats
from callflow.llm.simhash import near_duplicates
from callflow.llm.token_counts import count_tokens
from callflow.llm.variants import spelling_variants
from callflow.llm.vector_codes import compress_vectors


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(planted))).drop("n_tokens")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages")).drop("n_blocks")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(table(spark, folder, "documents"))


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), charged=True)


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op10_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(table(spark, folder, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # code points, as n_chars of the documents counts
        F.char_length(F.make_valid_utf8(F.col("kept").cast("string"))).cast("long").alias("n_kept"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"), spoil_every=199)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress_vectors(table(spark, folder, "embeddings"))


def op13_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_dedup, op2_token_counts, op3_chat_format, op4_decontaminate, op5_html_text, op6_language_id, op7_mix_sources, op8_quality, op9_exact_dedup, op10_repeated_bytes, op11_spelling_variants, op12_vector_codes, op13_pack_sequences)
}


def crc_step(value: int) -> int:
    """What the CRC-32 polynomial makes of one byte."""
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


SQL: dict[str, str] = {
    "op11_spelling_variants": rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
    SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b
    FROM counted),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, ({[crc_step(i) for i in range(256)]}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295) AS h
    FROM bytes),
spoiled AS (
    SELECT n, CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word
    FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spoiled GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS MATERIALIZED (
    SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL""",
    "op12_vector_codes": r"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS no, vec_id, label, embedding, len(embedding) // 16 AS width
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS MATERIALIZED (
    SELECT no, (i - 1) // width AS part, (i - 1) % width AS pos, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x
    FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, no - 1 AS entry, pos, x AS c FROM flat WHERE no <= 64),
dist0 AS (SELECT no, f.part, entry, sum((x - c) * (x - c)) AS d FROM flat f JOIN book0 b ON f.part = b.part AND f.pos = b.pos GROUP BY ALL),
near0 AS (SELECT no, part, arg_min(entry, (d, entry)) AS entry FROM dist0 GROUP BY ALL),
mean0 AS (
    SELECT f.part, entry, pos, sum(x)::BIGINT AS s, count(*) AS k FROM flat f JOIN near0 n ON f.no = n.no AND f.part = n.part GROUP BY ALL),
book1 AS MATERIALIZED (
    SELECT b.part, b.entry, b.pos, CASE WHEN k IS NULL THEN c ELSE (s - ((s % k) + k) % k) // k END AS c
    FROM book0 b LEFT JOIN mean0 m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos),
dist1 AS (SELECT no, f.part, entry, sum((x - c) * (x - c)) AS d FROM flat f JOIN book1 b ON f.part = b.part AND f.pos = b.pos GROUP BY ALL),
near1 AS (SELECT no, part, arg_min(entry, (d, entry)) AS entry FROM dist1 GROUP BY ALL),
mean1 AS (
    SELECT f.part, entry, pos, sum(x)::BIGINT AS s, count(*) AS k FROM flat f JOIN near1 n ON f.no = n.no AND f.part = n.part GROUP BY ALL),
book2 AS MATERIALIZED (
    SELECT b.part, b.entry, b.pos, CASE WHEN k IS NULL THEN c ELSE (s - ((s % k) + k) % k) // k END AS c
    FROM book1 b LEFT JOIN mean1 m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos),
dist2 AS (SELECT no, f.part, entry, sum((x - c) * (x - c)) AS d FROM flat f JOIN book2 b ON f.part = b.part AND f.pos = b.pos GROUP BY ALL),
near2 AS (SELECT no, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM dist2 GROUP BY ALL),
coded AS (SELECT no, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY no),
hash AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (no), hash""",
    "op3_chat_format": r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
    SELECT *, len(regexp_extract_all(role || chr(10) || text,
        '<\|turn\|>|<\|says\|>|<\|done\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\\')) AS broken
    FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text) + broken)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
    "op5_html_text": r"""
WITH a AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
b AS (
    SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>?', ' ', 'g') AS body FROM a),
c AS (
    SELECT page_id, url, trim(regexp_replace(
        replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '&amp', '&'),
        '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c""",
    "op9_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents),
g AS (
    SELECT doc_id, body,
           first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size
    FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g""",
}
