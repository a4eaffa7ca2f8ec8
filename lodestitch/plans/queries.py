"""Registered linkage queries over the test tables, each with DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.functions import text as T
from lodestitch.operators import blocking, evaluate, resolve, review, scoring
from lodestitch.operators.components import connected_components
from lodestitch.operators.normalize import normalize, with_ids
from lodestitch.operators.scratch import Scratch
from lodestitch.plans.linkage import Linkage
from lodestitch.sources import files, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Three consecutive parts are one true entity under three sources' spellings; the text runs in both engines.
ENTITIES = """SELECT CAST(p.p_partkey AS BIGINT) AS id, concat('s', CAST(p.p_partkey % 3 AS STRING)) AS source,
 CAST(p.p_partkey AS STRING) AS external_id, CAST(b.p_partkey AS BIGINT) AS true_entity_id,
 concat(CASE WHEN p.p_partkey % 7 = 0 THEN upper(b.p_name) WHEN p.p_partkey % 7 = 1 THEN concat(substr(b.p_name,1,3), substr(b.p_name,5)) ELSE b.p_name END,
  ' ', b.p_type, CASE p.p_partkey % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' B.V.' WHEN 3 THEN ' Holdings Co.' ELSE '' END) AS raw_name,
 concat(CAST(1000 + b.p_partkey * 37 % 9000 AS STRING), ' Main St', CASE WHEN p.p_partkey % 13 = 0 THEN '' ELSE concat(', City', CAST(b.p_partkey % 11 AS STRING)) END,
  CASE WHEN p.p_partkey % 8 = 0 THEN '' ELSE concat(', ', CAST(10000 + b.p_partkey * 7919 % 89999 AS STRING)) END) AS raw_address
FROM {part} p JOIN {part} b ON b.p_partkey = p.p_partkey - p.p_partkey % 3"""
CAP = 60

#: Scored pairs between customers: a sparse graph with conflicts.
SCORED = """SELECT c_custkey AS id, LEAST(c_custkey, other) AS entity_a_id, GREATEST(c_custkey, other) AS entity_b_id, 'k' AS blocking_key, CAST((c_custkey * 37 + 11) % 100 AS DOUBLE) / 100 AS similarity_score
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey * 7919 + 13) % 150 + 150 * (c_custkey // 150) ELSE c_custkey - c_custkey % 6 END AS other FROM {customer}) t WHERE other <> c_custkey"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENTITIES, part=read(spark, sf_dir, "part"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(raw_entities(spark, sf_dir))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SCORED.replace("c_custkey // 150", "CAST(floor(c_custkey / 150) AS BIGINT)")
    return spark.sql(text, customer=read(spark, sf_dir, "customer"))


# ---- DuckDB forms of the normalization, for ASCII text ----

_ENT = f"ent AS ({ENTITIES.format(part='part')})"


def _sql_clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce({x}, '')), '&', ' and '), '.', ''), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _sql_expand(words: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"list_transform({words}, lambda w: CASE w {cases} ELSE w END)"


def _sql_address(x: str) -> str:
    return f"array_to_string({_sql_expand(_sql_words(_sql_clean(x)), T.ADDRESS_WORDS)}, ' ')"


def _sql_city(x: str) -> str:
    return f"array_to_string({_sql_expand(_sql_words(_sql_clean(x)), T.CITY_WORDS)}, ' ')"


_POSTAL = T.POSTAL.removeprefix("(?U)")


def _sql_postal(x: str) -> str:
    return f"coalesce(upper(regexp_replace(regexp_extract_all({x}, '{_POSTAL}', 1)[-1], '[\\s-]', '', 'g')), '')"


def _sql_city_from(x: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, ','), lambda p: trim(p)), lambda p: p <> '')"
    return f"CASE WHEN len({parts}) >= 3 THEN {_sql_city(f'{parts}[-2]')} WHEN len({parts}) = 2 THEN {_sql_city(f"regexp_replace({parts}[-1], '{_POSTAL}', '')")} ELSE '' END"


def _sql_names() -> str:
    """CTEs that end in ``nm (id, normalized_name, legal_suffix, core)``."""
    steps = [f"n0 AS (SELECT id, {_sql_clean('raw_name')} AS t, '' AS suffix FROM ent)"]
    for i, (form, spellings) in enumerate(T.LEGAL_FORMS):
        pattern = rf"\b(?:{spellings})\b"
        steps.append(f"n{i + 1} AS (SELECT id, regexp_replace(t, '{pattern}', ' ', 'g') AS t, CASE WHEN suffix = '' AND regexp_matches(t, '{pattern}') THEN '{form}' ELSE suffix END AS suffix FROM n{i})")
    forms = ", ".join(f"'{f}'" for f, _ in T.LEGAL_FORMS)
    core = _sql_expand(f"list_filter(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({forms}))", T.NAME_WORDS)
    steps.append(f"n AS (SELECT id, suffix, {core} AS core FROM n{len(T.LEGAL_FORMS)})")
    steps.append("nm AS (SELECT id, trim(concat(array_to_string(core, ' '), ' ', suffix)) AS normalized_name, suffix AS legal_suffix, list_sort(list_distinct(core)) AS tokens FROM n)")
    return ", ".join(steps)


_NORM = f"{_ENT}, {_sql_names()}, norm AS (SELECT ent.id, source, normalized_name, legal_suffix, tokens, {_sql_address('raw_address')} AS normalized_address, {_sql_city_from('raw_address')} AS normalized_city, {_sql_postal('raw_address')} AS normalized_postal_code FROM ent JOIN nm USING (id))"
_TOK = f"CASE WHEN len(tokens) > 0 THEN tokens ELSE {_sql_words('normalized_name')} END"


def _sql_soundex(t: str) -> str:
    code = f"translate(lower({t}), 'bfpvcgjkqsxzdtlmnraeiouy0123456789hw', '11112222222233455600000000000000000099')"
    code = f"concat(replace({code}[1], '9', '0'), replace({code}[2:], '9', ''))"
    for d in "123456":
        code = f"regexp_replace({code}, '{d}+', '{d}', 'g')"
    rest = f"replace({code}[2:], '0', '')"
    return f"concat(upper({t}[1]), rpad(({rest})[1:3], 3, '0'))"


_KEYS = f"""tok AS (SELECT id, {_TOK} AS t, normalized_city AS city, CASE WHEN normalized_postal_code <> '' THEN normalized_postal_code[1:3] ELSE normalized_city[1:3] END AS geo FROM norm),
keys AS (SELECT id, 0 AS strategy, concat('np:', array_to_string(t, '')[1:3], '|', geo) AS key FROM tok WHERE len(t) > 0 AND geo <> ''
 UNION ALL SELECT id, 1, concat('si:', array_to_string(list_sort(list_transform(t, lambda w: w[1])), ''), '|', city) FROM tok WHERE len(t) > 0 AND city <> ''
 UNION ALL SELECT id, 2, concat('ph:', array_to_string(list_sort(list_transform(t, lambda w: {_sql_soundex('w')})), ''), '|', city) FROM tok WHERE len(t) > 0 AND city <> ''),
blocks AS (SELECT strategy, key, count(*) AS members, min(id) AS first FROM keys GROUP BY ALL),
kept AS (SELECT keys.*, first FROM keys JOIN blocks USING (strategy, key) WHERE members BETWEEN 2 AND {CAP}),
pairs AS (SELECT a.id AS a, b.id AS b, min(struct_pack(strategy := a.strategy, first := a.first, key := a.key)) AS k FROM kept a JOIN kept b ON a.strategy = b.strategy AND a.key = b.key AND a.id < b.id GROUP BY ALL)"""
_BLOCKED = f"WITH {_NORM}, {_KEYS}"


@query("SELECT source, external_id, raw_name, raw_address, city, postal_code FROM (SELECT 'registry' AS source, concat('REG-', CAST(c_custkey AS VARCHAR)) AS external_id, c_name AS raw_name, concat(c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(', ', n_name) END) AS raw_address, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE n_name END AS city, '' AS postal_code FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'directory', concat('DIR-', CAST(s_suppkey AS VARCHAR)), s_name, concat('Dock ', CAST(s_suppkey AS VARCHAR), ', ', n_name), '', '' FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def src_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("n_name", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("n_name"))).withColumn("key", F.concat(F.lit("REG-"), F.col("c_custkey").cast("string"))).withColumn("row", F.col("c_custkey"))
    s = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.withColumn("key", F.concat(F.lit("DIR-"), F.col("s_suppkey").cast("string"))).withColumn("dock", F.concat(F.lit("Dock "), F.col("s_suppkey").cast("string"))).withColumn("row", F.col("s_suppkey"))
    both = files.adapt(c, "registry", "key", "c_name", files.joined("c_mktsegment", "n_name"), "n_name", None).unionByName(files.adapt(s, "directory", "key", "s_name", files.joined("dock", "n_name"), None, None))
    return both.drop("row")


@query("SELECT CAST(row_number() OVER (ORDER BY o, k) AS BIGINT) AS id, o AS source_order, k AS row FROM (SELECT 0 AS o, c_custkey AS k FROM customer UNION ALL SELECT 1, s_suppkey FROM supplier)")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    rows = c.select(F.lit(0).alias("source_order"), F.col("c_custkey").alias("row")).unionAll(s.select(F.lit(1), "s_suppkey"))
    return with_ids(rows).select("id", "source_order", "row")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.first_write_wins(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return state.last_write_wins(rows, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT least(x, y) AS entity_a_id, greatest(x, y) AS entity_b_id, arg_min(k, seq) AS blocking_key, min(seq) AS seq FROM (SELECT o_custkey % 50 AS x, o_orderkey % 50 AS y, o_orderpriority AS k, o_orderkey AS seq FROM orders) GROUP BY ALL")
def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("entity_a_id"), (F.col("o_orderkey") % 50).alias("entity_b_id"), F.col("o_orderpriority").alias("blocking_key"), F.col("o_orderkey").alias("seq"))
    return state.canonical_pairs(rows)


@query("SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 0.5 END, o_totalprice) AS similarity_score FROM orders")
def update_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("similarity_score"))
    return state.update_scores(rows, rows.where("id % 3 = 0").select("id", F.lit(0.5).alias("similarity_score")))


_LOG = "SELECT user_id AS pair_id, event_type AS decision, CASE WHEN event_id % 3 = 0 THEN concat('r', CAST(event_id AS VARCHAR)) END AS reviewer, CASE WHEN event_type = 'purchase' THEN 'match' END AS hand_label, event_id AS seq FROM events"


@query(f"SELECT pair_id, arg_max(decision, seq) AS decision, arg_max(reviewer, seq) FILTER (reviewer IS NOT NULL) AS reviewer, arg_max(hand_label, seq) FILTER (hand_label IS NOT NULL) AS hand_label, min(seq) AS id FROM ({_LOG}) GROUP BY pair_id")
def decision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("pair_id"), F.col("event_type").alias("decision"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("reviewer"), F.when(F.col("event_type") == "purchase", "match").alias("hand_label"), F.col("event_id").alias("seq"))
    return state.fold_decisions(log)


@query(f"WITH {_NORM} SELECT id, normalized_name, legal_suffix, array_to_string(tokens, ',') AS name_core_tokens FROM norm")
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("id", "normalized_name", "legal_suffix", state.pack_tokens("name_core_tokens").alias("name_core_tokens"))


@query(f"WITH {_NORM} SELECT id, normalized_address FROM norm")
def norm_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("id", "normalized_address")


@query(f"SELECT n_nationkey, {_sql_city("concat('St. ', n_name, ' N')")} AS city FROM nation")
def norm_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", T.city_name(F.concat(F.lit("St. "), "n_name", F.lit(" N"))).alias("city"))


@query(f"WITH {_NORM} SELECT id, normalized_postal_code FROM norm")
def extract_postal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("id", "normalized_postal_code")


@query(f"WITH {_NORM} SELECT id, normalized_city FROM norm")
def extract_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("id", "normalized_city")


def _one_strategy(name: str, number: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        only = {name: blocking.STRATEGIES[name]}
        return blocking.blocks(entities(spark, sf_dir), only).select("key", "members", "first")

    QUERIES[f"block_{name}"] = run
    ORACLE_SQL[f"block_{name}"] = f"{_BLOCKED} SELECT key, members, first FROM blocks WHERE strategy = {number}"


for _i, _name in enumerate(blocking.STRATEGIES):
    _one_strategy(_name, _i)


@query(f"{_BLOCKED} SELECT CAST(row_number() OVER (ORDER BY k.strategy, k.first, a, b) AS BIGINT) AS id, a AS entity_a_id, b AS entity_b_id, k.key AS blocking_key FROM pairs")
def block_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block(entities(spark, sf_dir), CAP).drop("similarity_score")


@query(f"{_BLOCKED} SELECT CAST(strategy AS INT) AS strategy, key, members FROM blocks WHERE members > {CAP}")
def skipped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.skipped_blocks(entities(spark, sf_dir), CAP)


@query(f"{_BLOCKED} SELECT n AS n_entities, n * (n - 1) // 2 AS full_pairwise_comparisons, c AS candidate_pairs, 1 - c / (n * (n - 1) // 2) AS reduction_ratio FROM (SELECT count(*) AS n FROM norm), (SELECT count(*) AS c FROM pairs)")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.blocking_stats(entities(spark, sf_dir), CAP)


def _sql_indel(a: str, b: str) -> str:
    """Insert-delete ratio by the bit-parallel subsequence length, for texts up to 120 characters."""
    bits = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END)), 0)::HUGEINT)"
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    last = f"list_reduce({bits}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"2 * (length({a}) - bit_count({last})) / (length({a}) + length({b}))"


_PAIRED = f"{_BLOCKED}, two AS (SELECT a, b, k, x.source AS oa, y.source AS ob, x.normalized_address AS aa, y.normalized_address AS ab, array_to_string(list_sort({_sql_words('x.normalized_address')}), ' ') AS ta, array_to_string(list_sort({_sql_words('y.normalized_address')}), ' ') AS tb, x.normalized_name AS na, y.normalized_name AS nb, array_to_string(list_sort({_sql_words('x.normalized_name')}), ' ') AS sa, array_to_string(list_sort({_sql_words('y.normalized_name')}), ' ') AS sb, x.normalized_postal_code AS pa, y.normalized_postal_code AS pb, x.normalized_city AS ca, y.normalized_city AS cb FROM pairs JOIN norm x ON x.id = a JOIN norm y ON y.id = b)"


# The best insert-delete ratio of the shorter name with a window of the longer one, in both directions for equal lengths.
_PARTIAL = """sides AS (SELECT DISTINCT na, nb, x.s AS s, x.l AS l FROM (SELECT na, nb, unnest(CASE WHEN length(na) < length(nb) THEN [struct_pack(s := na, l := nb)] WHEN length(na) > length(nb) THEN [struct_pack(s := nb, l := na)] ELSE [struct_pack(s := na, l := nb), struct_pack(s := nb, l := na)] END) AS x FROM (SELECT DISTINCT na, nb FROM two WHERE na <> '' AND nb <> ''))),
masks AS (SELECT na, nb, length(s) AS n, length(l) AS m, (CAST(1 AS HUGEINT) << length(s)) - 1 AS ones, list_transform(string_split(l, ''), lambda c: coalesce(list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN substr(s, i, 1) = c THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END)), 0)::HUGEINT) AS bits FROM sides),
windows AS (SELECT na, nb, n, m, ones, bits, unnest(range(1, m + n)) AS stop FROM masks),
partials AS (SELECT na, nb, max(2 * (n - bit_count(list_reduce(list_slice(bits, greatest(0, stop - n) + 1, least(stop, m)), lambda v, x: ((v + (v & x)) | (v - (v & x))) & ones, ones))) / (n + least(stop, m) - greatest(0, stop - n))) AS best FROM windows GROUP BY na, nb)"""
_FEATURES = f"""{_PAIRED}, {_PARTIAL},
feats AS (SELECT two.*, CASE WHEN na = '' AND nb = '' THEN 1.0 ELSE {_sql_indel('sa', 'sb')} END::DOUBLE AS name_token_sort, CASE WHEN na = '' OR nb = '' THEN CAST(na = nb AS INT) ELSE best END::DOUBLE AS name_partial, CASE WHEN na = '' OR nb = '' THEN CAST(na = nb AS INT) ELSE jaro_winkler_similarity(na, nb) END::DOUBLE AS name_jaro_winkler,
 CASE WHEN aa = '' OR ab = '' THEN 0 ELSE {_sql_indel('ta', 'tb')} END::DOUBLE AS address_token_sort, CASE WHEN pa = '' OR pb = '' THEN 0.5 WHEN pa = pb THEN 1.0 ELSE 0.0 END::DOUBLE AS postal_match, CASE WHEN ca = '' OR cb = '' THEN 0.5 ELSE {_sql_indel('ca', 'cb')} END::DOUBLE AS city_similarity FROM two LEFT JOIN partials USING (na, nb)),
numbered AS (SELECT CAST(row_number() OVER (ORDER BY k.strategy, k.first, a, b) AS BIGINT) AS id, * FROM feats)"""
_TOTAL = " + ".join(["0::DOUBLE", *[f"{name} * {weight}::DOUBLE" for name, weight in scoring.WEIGHTS.items()]])
_OWN = f"{_FEATURES}, scored AS (SELECT id, a AS entity_a_id, b AS entity_b_id, k.key AS blocking_key, {_TOTAL} AS similarity_score FROM numbered)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Scratch(spark, "features").write(entities(spark, sf_dir))
    return scoring.add_features(blocking.block(e, CAP).drop("similarity_score"), e)


@query(f"{_PAIRED} SELECT a AS entity_a_id, b AS entity_b_id, round({_sql_indel('sa', 'sb')}, 6) AS name_token_sort FROM two")
def feat_token_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("entity_a_id", "entity_b_id", F.round("name_token_sort", 6).alias("name_token_sort"))


@query(f"{_PAIRED} SELECT a AS entity_a_id, b AS entity_b_id, round(jaro_winkler_similarity(na, nb), 6) AS name_jaro_winkler FROM two")
def feat_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("entity_a_id", "entity_b_id", F.round("name_jaro_winkler", 6).alias("name_jaro_winkler"))


@query(f"{_PAIRED} SELECT a AS entity_a_id, b AS entity_b_id, CASE WHEN pa = '' OR pb = '' THEN 0.5 WHEN pa = pb THEN 1.0 ELSE 0.0 END::DOUBLE AS postal_match, round(CASE WHEN ca = '' OR cb = '' THEN 0.5 ELSE {_sql_indel('ca', 'cb')} END, 6) AS city_similarity FROM two")
def feat_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("entity_a_id", "entity_b_id", "postal_match", F.round("city_similarity", 6).alias("city_similarity"))


@query(f"{_FEATURES} SELECT a AS entity_a_id, b AS entity_b_id, round(name_partial, 6) AS name_partial FROM feats")
def feat_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("entity_a_id", "entity_b_id", F.round("name_partial", 6).alias("name_partial"))


@query(f"{_FEATURES} SELECT a AS entity_a_id, b AS entity_b_id, round(address_token_sort, 6) AS address_token_sort FROM feats")
def feat_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("entity_a_id", "entity_b_id", F.round("address_token_sort", 6).alias("address_token_sort"))


@query(f"{_FEATURES} SELECT id, a AS entity_a_id, b AS entity_b_id, {', '.join(f'round({c}, 9) AS {c}' for c in scoring.WEIGHTS)} FROM numbered")
def feat_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestitch.schema import FEATURES

    return _features(spark, sf_dir).select("id", "entity_a_id", "entity_b_id", *[F.round(c, 9).alias(c) for c in FEATURES])


@query(f"{_OWN} SELECT id, entity_a_id, entity_b_id, round(similarity_score, 9) AS similarity_score FROM scored")
def score_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.HeuristicScorer().score(_features(spark, sf_dir)).select("id", "entity_a_id", "entity_b_id", F.round("similarity_score", 9).alias("similarity_score"))


@query()
def score_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Scratch(spark, "logistic").write(entities(spark, sf_dir))
    pairs = blocking.block(e, CAP)
    truth = raw_entities(spark, sf_dir).select("id", "true_entity_id")
    examples = evaluate.label_pairs(pairs, truth).select("entity_a_id", "entity_b_id", (F.col("hand_label") == "match").cast("double").alias("label"))
    scorer = scoring.LogisticScorer().fit(examples, e)
    return scoring.score_pairs(pairs, e, scorer).select("id", F.round("similarity_score", 4).alias("similarity_score"))


_BANDS = "banded AS (SELECT *, CASE WHEN similarity_score >= 0.75 THEN 'match' WHEN similarity_score <= 0.6 THEN 'no_match' ELSE 'review' END AS first_decision FROM scored)"
_BANDED = f"scored AS ({SCORED.format(customer='customer')}), {_BANDS}"
_RESOLVED = """edges AS (SELECT entity_a_id AS u, entity_b_id AS v FROM banded WHERE first_decision = 'match' UNION SELECT entity_b_id, entity_a_id FROM banded WHERE first_decision = 'match'),
reach AS (SELECT u AS node, u AS other FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON e.u = r.other),
comp AS (SELECT node, min(other) AS cluster_id FROM reach GROUP BY node),
flagged AS (SELECT DISTINCT x.cluster_id FROM banded JOIN comp x ON x.node = entity_a_id JOIN comp y ON y.node = entity_b_id WHERE first_decision = 'no_match' AND x.cluster_id = y.cluster_id),
touched AS (SELECT node FROM comp JOIN flagged USING (cluster_id)),
decided AS (SELECT *, CASE WHEN entity_a_id IN (SELECT node FROM touched) OR entity_b_id IN (SELECT node FROM touched) THEN 'review' ELSE first_decision END AS decision FROM banded)"""
_CLUSTERED = f"WITH RECURSIVE {_BANDED}, {_RESOLVED}"
_RUN = f"{_OWN.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_BANDS}, {_RESOLVED}"


@query(f"WITH {_BANDED} SELECT id, first_decision AS decision FROM banded")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).select("id", resolve.classify(F.col("similarity_score")).alias("decision"))


@query(f"{_CLUSTERED} SELECT node, cluster_id AS component FROM comp")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = scored_pairs(spark, sf_dir).where("similarity_score >= 0.75")
    return connected_components(matches, "entity_a_id", "entity_b_id", Scratch(spark, "clusters"))


@query(f"{_CLUSTERED} SELECT cluster_id, array_to_string(list_sort(list(node)), ',') AS entity_ids, CASE WHEN cluster_id IN (SELECT cluster_id FROM flagged) THEN 'flagged_conflict' ELSE 'resolved' END AS status FROM comp GROUP BY cluster_id")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.resolve(scored_pairs(spark, sf_dir)).clusters
    return found.select("cluster_id", F.array_join(F.col("entity_ids").cast("array<string>"), ",").alias("entity_ids"), "status")


@query(f"{_CLUSTERED} SELECT id, entity_a_id, entity_b_id, first_decision, first_decision <> 'review' AND (entity_a_id IN (SELECT node FROM touched) OR entity_b_id IN (SELECT node FROM touched)) AS demoted, CASE WHEN entity_a_id IN (SELECT node FROM touched) OR entity_b_id IN (SELECT node FROM touched) THEN 'review' ELSE first_decision END AS decision FROM banded")
def resolve_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(scored_pairs(spark, sf_dir)).pairs.select("id", "entity_a_id", "entity_b_id", "first_decision", "demoted", "decision")


_TRUE = "true_pairs AS (SELECT x.id AS a, y.id AS b FROM ent x JOIN ent y ON x.true_entity_id = y.true_entity_id AND x.id < y.id)"


@query(f"WITH {_ENT}, {_TRUE} SELECT a, b FROM true_pairs")
def true_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.true_pairs(raw_entities(spark, sf_dir).select("id", "true_entity_id"))


@query(f"{_BLOCKED}, {_TRUE} SELECT count(p.a) / count(*) AS recall, count(p.a) AS tp, count(*) - count(p.a) AS fn FROM true_pairs t LEFT JOIN pairs p ON p.a = t.a AND p.b = t.b")
def blocking_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.blocking_recall(blocking.block(entities(spark, sf_dir), CAP), evaluate.true_pairs(raw_entities(spark, sf_dir)))


@query(
    f"{_BLOCKED}, {_TRUE}, c AS (SELECT (SELECT count(*) FROM pairs JOIN true_pairs USING (a, b)) AS tp, (SELECT count(*) FROM pairs) AS p, (SELECT count(*) FROM true_pairs) AS t) SELECT tp / p AS precision, tp / t AS recall, 2 * (tp / p) * (tp / t) / (tp / p + tp / t) AS f1, tp, p - tp AS fp, t - tp AS fn, CAST(0 AS BIGINT) AS tn FROM c"
)
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = evaluate.ordered(blocking.block(entities(spark, sf_dir), CAP))
    return evaluate.pairwise_prf(predicted, evaluate.true_pairs(raw_entities(spark, sf_dir)))


@query(f"WITH {_BANDED} SELECT CASE WHEN similarity_score >= 0.83 THEN 'high' WHEN similarity_score <= 0.55 THEN 'low' ELSE 'mid' END AS band, count(*) AS n FROM scored GROUP BY ALL")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_bands(scored_pairs(spark, sf_dir))


_DRAWN = f"""{_OWN}, {_TRUE}, drawn AS (SELECT *, CASE WHEN similarity_score >= 0.83 THEN 'high' WHEN similarity_score <= 0.55 THEN 'low' ELSE 'mid' END = 'mid' AS mid, md5(concat('99:', id)) AS turn FROM scored),
middle AS (SELECT * FROM drawn WHERE mid ORDER BY turn, id LIMIT 100), others AS (SELECT * FROM drawn WHERE NOT mid ORDER BY turn, id LIMIT (SELECT 300 - count(*) FROM middle))"""


@query(f"{_DRAWN} SELECT id, CASE WHEN t.a IS NOT NULL THEN 'match' ELSE 'no_match' END AS hand_label FROM (SELECT * FROM middle UNION ALL SELECT * FROM others) x LEFT JOIN true_pairs t ON t.a = entity_a_id AND t.b = entity_b_id")
def hand_label_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Scratch(spark, "sample").write(entities(spark, sf_dir))
    pairs = scoring.score_pairs(blocking.block(e, CAP), e)
    return evaluate.hand_label_sample(pairs, raw_entities(spark, sf_dir).select("id", "true_entity_id")).select("id", "hand_label")


def _sql_explained() -> str:
    lists = {"agreements": [], "disagreements": [], "uncertain": []}
    missing = {"address_token_sort": "aa = '' OR ab = ''", "postal_match": "pa = '' OR pb = ''", "city_similarity": "ca = '' OR cb = ''"}
    for name, label in review.LABELS.items():
        gone = missing.get(name, "FALSE")
        for state, test in (("agreements", f"NOT ({gone}) AND {name} >= {review.AGREE}"), ("disagreements", f"NOT ({gone}) AND {name} <= {review.DISAGREE}"), ("uncertain", gone)):
            lists[state].append(f"CASE WHEN {test} THEN '{label}' END")
    columns = ", ".join(f"concat_ws('; ', {', '.join(cases)}) AS {state}" for state, cases in lists.items())
    return f"{_RUN} SELECT id, {columns} FROM numbered WHERE id IN (SELECT id FROM decided WHERE decision = 'review')"


@query(_sql_explained())
def explain_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Scratch(spark, "explain").write(entities(spark, sf_dir))
    pairs = scoring.score_pairs(blocking.block(e, CAP), e)
    waiting = resolve.resolve(pairs).where("review").select(*pairs.columns)
    out = review.explain(waiting, e)
    return out.select("id", *[F.array_join(c, "; ").alias(c) for c in ("agreements", "disagreements", "uncertain")])


_METRICS = f"""{_RUN}, {_TRUE}, won AS (SELECT entity_a_id AS a, entity_b_id AS b FROM decided WHERE decision = 'match'),
c AS (SELECT (SELECT count(*) FROM ent) AS n_entities, (SELECT count(*) FROM pairs) AS n_candidate_pairs, (SELECT count(*) FROM true_pairs) AS n_true_match_pairs, (SELECT count(*) FROM pairs JOIN true_pairs USING (a, b)) AS found,
 (SELECT count(*) FROM won) AS n_matches, (SELECT count(*) FROM won JOIN true_pairs USING (a, b)) AS hit, (SELECT count(*) FROM decided WHERE decision = 'no_match') AS n_no_matches, (SELECT count(*) FROM decided WHERE decision = 'review') AS n_review_queue, (SELECT count(DISTINCT cluster_id) FROM comp) AS n_clusters, (SELECT count(*) FROM flagged) AS n_flagged_conflict_clusters)
SELECT n_entities, n_candidate_pairs, n_true_match_pairs, round(found / n_true_match_pairs, 9) AS blocking_recall, n_true_match_pairs - found AS blocking_missed, round(hit / n_matches, 9) AS full_dataset_precision, round(hit / n_true_match_pairs, 9) AS full_dataset_recall, round(2 * hit / (n_matches + n_true_match_pairs), 9) AS full_dataset_f1, n_matches, n_no_matches, n_review_queue, n_clusters, n_flagged_conflict_clusters FROM c"""


@query(_METRICS)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of a whole run."""
    raw = raw_entities(spark, sf_dir)
    loaded = raw.select("source", "external_id", "raw_name", "raw_address", F.lit("").alias("city"), F.lit("").alias("postal_code"), F.lit(0).alias("source_order"), F.col("id").alias("row"))
    m = Linkage(sample_size=0).run(loaded, raw.select("source", "external_id", F.col("true_entity_id").cast("string").alias("true_entity_id"), F.lit(False).alias("is_confusable_distinct"))).metrics
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in m.items())
    return spark.createDataFrame([tuple(round(v, 9) if isinstance(v, float) else v for v in m.values())], kinds)


@query(f"{_RUN} SELECT id, entity_a_id, entity_b_id, blocking_key, round(similarity_score, 9) AS similarity_score, decision FROM decided")
def linkage_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the whole run."""
    e = Scratch(spark, "run").write(entities(spark, sf_dir))
    pairs = Scratch(spark, "run").write(scoring.score_pairs(blocking.block(e), e))
    return resolve.resolve(pairs).pairs.select("id", "entity_a_id", "entity_b_id", "blocking_key", F.round("similarity_score", 9).alias("similarity_score"), "decision")
