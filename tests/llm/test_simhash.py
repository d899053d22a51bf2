"""Components of fingerprints against all pairs."""

from tidemark.llm import simhash
from tidemark.llm.common import table


def test_components_are_those_of_all_pairs(spark, sf_dir):
    rows = simhash.near_copies(table(spark, sf_dir, "documents")).collect()
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in rows}
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in rows} == {i: root(i) for i in fp}
