"""Table schemas of the linkage engine, as DDL."""

RAW = "id bigint, source string, external_id string, raw_name string, raw_address string"
LOADED = RAW + ", city string, postal_code string"
NORMALIZED = "id bigint, raw_entity_id bigint, normalized_name string, normalized_address string, normalized_city string, normalized_postal_code string, legal_suffix string, name_core_tokens array<string>, source string"
PAIRS = "id bigint, entity_a_id bigint, entity_b_id bigint, blocking_key string, similarity_score double"
DECISIONS = "id bigint, pair_id bigint, decision string, reviewer string, hand_label string"
TRUTH = "source string, external_id string, true_entity_id string, is_confusable_distinct boolean"
CLUSTERS = "cluster_id bigint, entity_ids array<bigint>, status string"
FEATURES = ("name_token_sort", "name_partial", "name_jaro_winkler", "address_token_sort", "postal_match", "city_similarity")
