"""Embedding near-duplicates against brute force: planted pairs on the edge, dense groups, odd rows."""

import numpy as np
import pytest

from quire.llm import ann, capfilters, common


def by_hand(rows, least=0.95):
    """{vec_id: (n_links, component_id, kept)} of (vec_id, vector or None)."""
    ids = [i for i, _ in rows]
    whole = [None if v is None or not len(v) or not np.isfinite(np.array(v, float)).all() or not np.any(v) else np.array(v, float) for _, v in rows]
    near = {i: set() for i in ids}
    lengths = {len(v) for v in whole if v is not None}
    for d in lengths:
        own = [(i, v) for i, v in zip(ids, whole) if v is not None and len(v) == d]
        u = ann.unit(np.stack([v for _, v in own]))
        for a, b in zip(*np.nonzero(u @ u.T >= least)):
            if a != b:
                near[own[a][0]].add(own[b][0])
    least_of = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in least_of:
                least_of[j] = i
                todo += near[j]
    return {i: (len(near[i]), least_of[i], least_of[i] == i) for i in ids}


def answer(frame):
    rows = frame.collect()
    assert len({r.vec_id for r in rows}) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")


def around(rng, centre, cosine, n):
    """Vectors at this cosine from ``centre``."""
    w = rng.standard_normal((n, len(centre)))
    w -= (w @ centre)[:, None] * centre
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return cosine * centre + np.sqrt(1 - cosine**2) * w


@pytest.mark.parametrize("dim", [2, 24, 64, 100])
def test_pairs_on_the_edge_are_found_and_none_below(spark, dim):
    rng = np.random.default_rng(dim)
    base = ann.unit(rng.standard_normal((150 if dim > 2 else 12, dim)))
    other = np.concatenate([around(rng, v, c, 1) for v, c in zip(base, np.resize([0.9501, 0.9499, 0.97, 0.93], len(base)))])
    both = [*enumerate(base), *((1000 + i, 3.0 * v) for i, v in enumerate(other))]
    assert answer(capfilters.linked(frame(spark, both))) == by_hand(both)


def test_dense_groups_count_every_link(spark, monkeypatch):
    """A group of copies, one within a ball, one too wide for it, and two that touch; filters split into cells."""
    monkeypatch.setattr(capfilters, "HOT", 8)
    monkeypatch.setattr(capfilters, "CELL", 16)
    rng = np.random.default_rng(4)
    centres = ann.unit(rng.standard_normal((5, 64)))
    second = around(rng, centres[1], 0.93, 1)[0]
    groups = [np.repeat(centres[:1], 40, 0), around(rng, centres[1], 0.995, 60), around(rng, second, 0.995, 50), around(rng, centres[2], 0.972, 80), around(rng, centres[3], 0.99, 70), -centres[3:4], rng.standard_normal((150, 64))]
    rows = list(enumerate(np.concatenate(groups)[rng.permutation(sum(map(len, groups)))]))
    want = by_hand(rows)
    assert answer(capfilters.linked(frame(spark, rows))) == want
    assert max(n for n, _, _ in want.values()) > 60


def test_odd_rows(spark):
    """Nulls, zeros, non-finite components, empty vectors, other lengths, repeated ids and rows, clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, -0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [5e-324, 0.0]), (13, [1e300, 1e299]), (-7, [0.0, 2.0]), (14, [-0.0, 1.0]), (15, [3.0]), (16, [4.0]), (17, [-4.0])]
    more = [(None, [1.0, 0.0]), (8, [None, 1.0]), (1, [1.0, 0.0]), (20, [0.0, 1.0]), (20, None)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + more], "vec_id bigint, embedding array<double>, n int, cls int")
    want = by_hand([*rows, (8, None), (20, [0.0, 1.0])])
    assert answer(capfilters.linked(table)) == want
    assert want[-7] == (3, -7, True) and want[16] == (1, 15, False)
    assert capfilters.linked(table.limit(0)).count() == 0


def test_given_vectors_and_their_near_copies(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "embeddings")
    given = [(r.vec_id, r.embedding) for r in table.collect()]
    rng = np.random.default_rng(8)
    rows = given + [(10_000 + i, np.array(v) + 0.03 * rng.standard_normal(len(v))) for i, v in given[::3]]
    assert answer(capfilters.linked(frame(spark, rows))) == by_hand(rows)
    with pytest.raises(ValueError):
        capfilters.linked(table, 0.5)
