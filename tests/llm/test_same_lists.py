from collections import defaultdict

from signalloom.llm import jaccard_join
from signalloom.llm.common import materialise


def test_lists_of_the_same_sets_meet_once(spark):
    base = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(k, " ".join(base[: 20 * k] + [f"x{k}"] + base[20 * k + 1 :])) for k in range(9)] + [(50 + k, " ".join(base)) for k in range(3)], "doc_id long, text string")
    schema = "doc_id long, text_hash long, n long, digest binary, key long, prefix array<long>"
    sets = materialise(jaccard_join._hashed(docs).mapInArrow(jaccard_join._described, schema), "sets")
    full = jaccard_join.full_sets(docs, sets, jaccard_join.survivors(sets))
    lists, members = defaultdict(set), {}
    for row in jaccard_join.signed(full).collect():
        lists[row.sig].add(row.node)
        members[row.sig] = row.members
    assert lists and all(len(nodes) == members[sig] for sig, nodes in lists.items())
    assert len({frozenset(nodes) for nodes in lists.values()}) == len(lists)
    assert {r.component_id for r in jaccard_join.components(docs).collect()} == {0}
