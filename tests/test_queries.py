from itertools import combinations

from lodestitch.plans import queries


def test_blocks_of_9_to_60_propose_pairs(spark, tmp_path):
    parts = [(first + i, "red box", "TIN") for first in (0, 33, 66, 99) for i in range(3)]
    spark.createDataFrame(parts, "p_partkey int, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    one_block = [p for p, *_ in parts if p % 13 and p % 7 != 1]  # the others lack the city or are spelled in one word
    assert len(one_block) == 9
    got = {(r.entity_a_id, r.entity_b_id) for r in queries.block_union(spark, str(tmp_path)).collect()}
    assert set(combinations(one_block, 2)) <= got
