import hashlib
import zlib

import pytest

from kestrel.llm import manifest, queries

SF = "/root/testdata/sf0.01"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def above(nodes):
    return [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(above(out[-1]))
    return out


def plain(rows):
    """rows(key, group, leaf, changed) as hex: for each row the manifest by whole levels."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = levels([r[2] for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, (key, _, leaf, changed) in enumerate(groups[g]):
            proof, now = "", changed or leaf
            for at, tree in ((i, trees[g]), (k, top)):
                for nodes in tree[:-1]:
                    pair = nodes[at & ~1 : (at & ~1) + 2]
                    proof += "".join(x for j, x in enumerate(pair) if j != at & 1)
                    pair[at & 1] = now
                    now, at = h("".join(pair)), at >> 1
            out.append((key, g, leaf, trees[g][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 2, "b": 3}, {"é": 7, "z": 1024, "Z": 1025}, {"a": 2600, "b": 1}])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(i, g, h(f"{g}{i}"), h(f"x{g}{i}") if i % 3 == 0 else None) for g, n in sizes.items() for i in range(n)]
    given = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, changed string").selectExpr(
        "doc_id", "lang", "unhex(leaf) leaf", "unhex(changed) changed"
    )
    assert ordered(manifest.manifest(given.repartition(5)).collect()) == ordered(plain(rows))


def test_blocks_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 4)
    for n in (16, 17, 70):
        nodes = [h(str(i)) for i in range(n)]
        held = [nodes[i : i + 4] for i in range(0, n, 4)]
        tops = [manifest.grow([x.encode() for x in b], 2)[0].decode() for b in held]
        while len(tops) > 1:
            more = len(tops) > 4
            tops = [manifest.grow([x.encode() for x in tops[i : i + 4]], 2 if more else None)[0].decode() for i in range(0, len(tops), 4)]
        assert tops == levels(nodes)[-1]


def test_folding_takes_the_state_at_the_slot():
    nodes = [h(str(i)).encode() for i in range(11)]
    for i in range(11):
        root, tree = manifest.grow(nodes, None)
        assert manifest.fold(nodes[i], i, tree) == root
        changed = [*nodes[:i], b"other", *nodes[i + 1 :]]
        assert manifest.fold(b"other", i, tree) == manifest.grow(changed, None)[0]


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(None, None, h("a"), None), (None, None, h("a"), h("b")), (None, "x", h("c"), None), (5, "x", h("e"), None), (5, "x", h("d"), None)]
    given = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, changed string").selectExpr(
        "doc_id", "lang", "unhex(leaf) leaf", "unhex(changed) changed", "'no' root"
    )
    got = manifest.manifest(given).collect()
    key = lambda r: (r[0], r[1], r[2], r[3], r[4])
    assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, plain(rows))))
    assert sum(r.verified for r in got) == 4
    assert manifest.manifest(given.limit(0)).count() == 0


def test_query_equals_whole_levels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def leaf(r, more=0):
        values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    rows = [(r.doc_id, r.lang, leaf(r), leaf(r, 1) if zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else None) for r in docs]
    want = [(a, c, d, e, f, g, i) for a, _, c, d, e, f, g, i in plain(rows)]
    got = queries.op12_merkle_manifest(spark, SF).collect()
    assert ordered(got) == ordered(want)
    assert 0 < sum(not r.verified for r in got) < len(got)
