from signalloom.llm import jaccard_join
from signalloom.llm.common import materialise
from signalloom.llm.components import connected_components


def test_a_group_of_near_copies_makes_no_lists(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [(k, " ".join(base[: 7 * k] + [f"x{k}"] + base[7 * k + 1 :])) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    schema = "doc_id long, text_hash long, n long, digest binary, key long, prefix array<long>"
    sets = materialise(jaccard_join._hashed(docs).mapInArrow(jaccard_join._described, schema), "sets")
    full = jaccard_join.full_sets(docs, sets, jaccard_join.survivors(sets))
    assert jaccard_join.signed(full).count() > 40
    links = jaccard_join.first_links(full)
    assert links.count() <= jaccard_join.BANDS * 40
    assert jaccard_join.signed(full, connected_components(links)).count() < 40
    assert {r.component_id for r in jaccard_join.components(docs).collect()} == {0}
