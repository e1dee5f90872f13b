"""The thin queries of this subpackage, as __spark_entry__ registers them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.quality_rules import COUNTS, quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.chat_format import chat_format, digests

    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(chat_format(rows.unionByName(own)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broadcast form of op3: spans of 20 words and more that the benchmark holds leave the documents."""
    from opalgrid.llm.substring_dedup import remove_reference

    out = remove_reference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.ngram_join import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of words and subwords over all documents, by signed deltas over the whole table: every
    document is inserted under its word count in both versions, the subword version is revised to
    its own counts, all documents are deleted and inserted again, and the batches are folded into
    one. Replays change nothing."""
    import uuid

    from opalgrid.llm.common import shared_dir, stash
    from opalgrid.llm.token_counts import WORDS, Rollup, deletes, inserts, revisions, token_counts

    counts = stash(token_counts(table(spark, sf_dir, "documents"), {"word_bpe_49k": tokenizer_path()}))
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.delete_on_exit()
    words, subwords = counts.where(F.col("tokenizer") == WORDS), counts.where(F.col("tokenizer") != WORDS)
    stale = words.withColumn("tokenizer", F.lit("word_bpe_49k"))
    changes = [inserts(words.unionByName(stale)), revisions(stale, subwords), deletes(counts), inserts(counts)]
    for batch in (0, 1, 2, 3, 1, 2):
        rollup.commit(batch, changes[batch])
    rollup.compact()
    return rollup.totals()


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from opalgrid.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_chat_format, op3_substring_dedup, op4_mixing, op5_exact_dedup, op6_ngram_join, op7_packing, op8_html_extraction, op9_token_counts, op10_toxicity, benchmark_spans)}

_CONTROL = ["[TURN] ", "[/TURN]", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _escapes(text: str) -> str:
    """SQL: how many backslashes escaping adds to ``text``."""
    return " + ".join(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ["\\", *_CONTROL])


_SPLIT = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: SQL: windows of 20 words and their hashes; the words that the windows ``late`` cover, and the rest.
_LEADS = ", ".join(f"lead(h, {j}) OVER v" for j in range(1, 20))
_WINDOWS = f"""w AS MATERIALIZED (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
word AS MATERIALIZED (SELECT doc_id, p, t, hash(t) AS h FROM (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS t FROM w)),
k AS MATERIALIZED (SELECT doc_id, p AS i, hash(h, {_LEADS}) AS h FROM word WINDOW v AS (PARTITION BY doc_id ORDER BY p) QUALIFY lead(h, 19) OVER v IS NOT NULL)"""
_WITHOUT = """gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
rest AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS t FROM (SELECT * FROM word SEMI JOIN removed USING (doc_id)) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)"""

ORACLES = {
    "op6_ngram_join": f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
one AS MATERIALIZED (SELECT ws, min(doc_id) AS r FROM w GROUP BY ws),
word AS MATERIALIZED (SELECT r, p, hash(t) AS h FROM (SELECT r, generate_subscripts(ws, 1) AS p, unnest(ws) AS t FROM one WHERE len(ws) >= 4)),
sh AS MATERIALIZED (SELECT DISTINCT r, g FROM (
  SELECT r, hash(h, lead(h, 1) OVER v, lead(h, 2) OVER v, lead(h, 3) OVER v) AS g FROM word WINDOW v AS (PARTITION BY r ORDER BY p) QUALIFY lead(h, 3) OVER v IS NOT NULL
  UNION ALL SELECT r, hash(ws) FROM one WHERE len(ws) BETWEEN 1 AND 3)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY 1),
part AS MATERIALIZED (SELECT sh.r, g, n FROM sh JOIN n USING (r) WHERE g IN (SELECT g FROM sh GROUP BY g HAVING count(*) > 1)),
common AS (SELECT a.r AS x, b.r AS y, any_value(a.n + b.n) AS total, count(*) AS c FROM part a JOIN part b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (total - c)),
same AS (SELECT one.r AS x, w.doc_id AS y FROM one JOIN w USING (ws) WHERE len(ws) > 0 AND w.doc_id <> one.r),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link UNION ALL SELECT x, y FROM same UNION ALL SELECT y, x FROM same),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.r) AS component_id FROM reach JOIN w USING (doc_id) JOIN one USING (ws) LEFT JOIN n ON n.r = one.r GROUP BY doc_id""",
    "op2_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(15 + length(role) + length(text) + {_escapes("text")} + {_escapes("role")} + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op3_substring_dedup": f"""
WITH {_WINDOWS},
late AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
{_WITHOUT}
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(CASE WHEN n > 0 THEN coalesce(t, '') ELSE array_to_string(ws, ' ') END) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN rest USING (doc_id)""",
    "benchmark_spans": f"""
WITH {_WINDOWS},
b AS (SELECT item_id, {_SPLIT.format("coalesce(text, '')")} AS bs FROM benchmark),
bword AS (SELECT item_id, p, hash(t) AS h FROM (SELECT item_id, generate_subscripts(bs, 1) AS p, unnest(bs) AS t FROM b)),
bk AS (SELECT hash(h, {_LEADS}) AS h FROM bword WINDOW v AS (PARTITION BY item_id ORDER BY p) QUALIFY lead(h, 19) OVER v IS NOT NULL),
late AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM bk)),
{_WITHOUT}
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(CASE WHEN n > 0 THEN coalesce(t, '') ELSE array_to_string(ws, ' ') END) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN rest USING (doc_id)""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
