"""Registered queries of the corpus operators, with DuckDB SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.llm import decontaminate, htmltext, mixing, secrets, simhash, substring, tokencount, toxicity, vectors, warc
from lodestitch.llm.base import table
from lodestitch.operators.scratch import Scratch


#: The public vocabulary the token counts use.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').path}/archive"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    captures = warc.captured_pages(warc.assemble(warc.read_records(spark, path, with_payload=False)))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    automaton = tokencount.Automaton(*tokencount.byte_level_pieces(vocabulary))
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), automaton)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(found.fp).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_decontamination": op3_decontamination,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_source_mixing": op6_source_mixing,
    "op7_main_text": op7_main_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

# The base spans by interleaving what lies between matches with the matches themselves.
def _sql_spans(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    options = "'i'" if kind == 0 else "''"
    found = f"regexp_extract_all(t, '{pattern}', 0, {options})"
    return f"""(SELECT doc_id, row, {kind} AS kind, '{name}' AS name, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(s := ends[i] - length(m[i]), e := ends[i], v := v[i]))) AS x
 FROM (SELECT doc_id, row, m, v, list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda g: length(g))) AS BIGINT)) AS ends
  FROM (SELECT doc_id, row, {found} AS m, regexp_extract_all(t, '{pattern}', {group}, {options}) AS v, string_split_regex(t, '{'(?i)' if kind == 0 else ''}{pattern}') AS gaps FROM d)))"""


def _op1_sql() -> str:
    assign = secrets.ASSIGN.removeprefix("(?i)").replace("'", "''")
    parts = [("assign", assign, 2, 8), ("access", secrets.ACCESS, 0, 16), ("hex", secrets.HEX, 0, 32), ("live", secrets.TOKEN, 0, 20)]
    spans = " UNION ALL ".join(f"SELECT doc_id, row, kind, name, x.s AS s, x.e AS e, x.v AS v FROM {_sql_spans(i, *part)} WHERE length(x.v) >= {part[3]}" for i, part in enumerate(parts))
    label = "concat(name, ':', s, ':', e)"
    return f"""WITH d AS (SELECT doc_id, source, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
every AS MATERIALIZED ({spans}),
ok AS MATERIALIZED (SELECT every.*, source FROM every JOIN d USING (row) WHERE kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM every b WHERE b.row = every.row AND b.kind < 3 AND b.s < every.e AND every.s < b.e))),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) <= {secrets.MAX_LIVE_OWNERS} AND count(DISTINCT concat(coalesce(source, chr(1)), chr(2), coalesce(CAST(doc_id AS VARCHAR), chr(1)))) <= {secrets.MAX_LIVE_REPOS} AS live FROM ok GROUP BY v),
j AS (SELECT ok.*, live FROM ok JOIN own USING (v) WHERE kind < 3 OR live),
g AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, string_agg({label}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({label}, ',' ORDER BY s, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j GROUP BY row)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (row)"""


_TOKENS = "list_filter(string_split(regexp_replace(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"
_SPLIT = "list_filter(string_split(regexp_replace(coalesce({}, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op1_secret_ownership": _op1_sql(),
    "op3_decontamination": f"""WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents), b AS (SELECT item_id, {_TOKENS.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, len(g) AS n, array_to_string(g, ' ') AS g FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: list_slice(w, i, i + 9))) AS g FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS g FROM d JOIN sizes ON len(w) >= n),
hits AS (SELECT doc_id, pos, n, item FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_embedding_near_dedup": """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS o FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS o FROM e UNION SELECT r.u, l.o FROM reach r JOIN l ON l.u = r.o),
c AS (SELECT u, min(o) AS component_id FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id""",
    # Rows of one id and text are one document; texts that share an id come in the order of a hash, here another one than the operator's.
    "op8_substring_dedup": f"""WITH d AS (SELECT *, dense_rank() OVER (ORDER BY doc_id NULLS LAST, md5(t)) AS k FROM (SELECT doc_id, coalesce(text, '') AS t, {_SPLIT.format("text")} AS w FROM documents)),
once AS (SELECT k, any_value(w) AS w FROM d GROUP BY k),
win AS (SELECT k, unnest(range(1, len(w) - 18)) AS pos, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(list_slice(w, i, i + 19), ' ')))) AS h FROM once WHERE len(w) >= 20),
later AS (SELECT k, pos FROM (SELECT k, pos, row_number() OVER (PARTITION BY h ORDER BY k, pos) AS r FROM win) WHERE r > 1),
gone AS (SELECT k, list(DISTINCT p) AS g FROM (SELECT k, unnest(range(pos, pos + 20)) AS p FROM later) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed, sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE (SELECT coalesce(string_agg(x, ' ' ORDER BY i), '') FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i) WHERE NOT list_contains(g, i)) END) AS kept_sha256 FROM d LEFT JOIN gone USING (k)""",
}
