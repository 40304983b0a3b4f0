"""The pipeline's near-copy stage against brute force over whole shingle sets."""

from __future__ import annotations

import itertools

import pytest

pytest.importorskip("quiverlake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quiverlake.llm import near_copies, simhash  # noqa: E402

from .test_llm import ODD, docs, prose  # noqa: E402


def test_near_copies(spark):
    rows = [r for r in ODD if r[0] != 8]
    for i in range(30):
        words, places = prose(8000 + i, 64).split(), [(20,), (20, 40), (5, 25, 45)][i % 3]
        rows += [(100 + 2 * i, " ".join(words)), (101 + 2 * i, " ".join("changed" if k in places else w for k, w in enumerate(words)))]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = [(a, b) for a, b in itertools.combinations(sorted(x for x in sets if x is not None), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    fps = {i: simhash.fingerprint(t or "") for i, t in rows}
    assert any((fps[a] ^ fps[b]).bit_count() > 3 for a, b in near if a >= 100)
    root = {i: i for i in sets if i is not None}
    for _ in root:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    made = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "")
    left = [r.doc_id for r in made.collect()]
    assert {i for i in left if i is not None} == {i for i in root if root[i] == i} and left.count(None) == 2


def test_fingerprints_in_reach_are_linked(spark):
    """What the deletion variants link covers every two fingerprints that differ in three bits or fewer."""
    rows = []
    for i in range(12):
        words = prose(8100 + i, 600).split()
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-1], "changed"])), (3 * i + 2, " ".join([*words[1:], "more"]))]
    texts = docs(spark, rows).select("doc_id", "text")
    nodes = near_copies._nodes(texts)
    held = {r.node: r.fp & (2**64 - 1) for r in nodes.collect()}
    assert held == {r.node: simhash.of_hashes(near_copies.shingles(near_copies.WordHashes().of(r.text))) for r in nodes.join(texts, "doc_id").collect()}
    near = [(a, b) for a, b in itertools.combinations(sorted(held), 2) if (held[a] ^ held[b]).bit_count() <= 3]
    assert near
    root = {x: x for x in held}
    found = near_copies._linked(nodes.select("node", "fp")).collect()
    for _ in held:
        for r in found:
            root[r.u] = root[r.v] = min(root[r.u], root[r.v])
    assert all(root[a] == root[b] for a, b in near)


def test_components_with_hot_centres(spark):
    import random

    from quiverlake.llm.components import components

    draw = random.Random(5)
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 160) for i in range(60)] + [(draw.randrange(300, 500), draw.randrange(300, 500)) for _ in range(150)]
    root = {x: x for link in links for x in link}
    while True:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                moved = True
        if not moved:
            break
    expected = sorted((x, r) for x, r in root.items() if x != r)
    for hot in (3, 1000):
        assert sorted(map(tuple, components(spark.createDataFrame(links, "u long, v long"), hot).collect())) == expected
