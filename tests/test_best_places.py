"""The best of many vectors are found without putting all scores in order, with the same rows on ties."""

import time

import numpy as np
import pandas as pd

from tidelog.operators import retrieval as R


def _plain(queries, vectors, ids, k):
    """The same from a full order of all products, as (row, score) lists."""
    scores = R._unit(queries) @ R._unit(vectors).T
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return np.asarray(ids)[order], np.take_along_axis(scores, order, 1)


def _frames(queries, vectors, ids):
    return pd.DataFrame({"query_id": np.arange(len(queries)), "vector": list(queries)}), pd.DataFrame({"id": ids, "vector": list(vectors)})


def test_the_best_are_those_of_a_full_order():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 15, 47, 48, 49, 1000):
        queries, vectors, ids = rng.normal(0, 1, (70, 5)), rng.normal(0, 1, (n, 5)), rng.permutation(n) - 5
        vectors[rng.random(n) < 0.05] = np.nan
        vectors[rng.random(n) < 0.05] = 0
        want, scores = _plain(queries, vectors, ids, 3)
        found = R._best_of(*_frames(queries, vectors, ids), 3)
        assert found["query_id"].tolist() == np.repeat(np.arange(70), want.shape[1]).tolist()
        assert found["id"].tolist() == want.ravel().tolist()
        assert np.allclose(found["score"].to_numpy(), scores.ravel(), equal_nan=True, rtol=0, atol=1e-14)


def test_equal_and_nearly_equal_vectors():
    base = np.random.default_rng(4).normal(0, 1, (4, 64))
    copies = np.repeat(base, 500, axis=0)
    found = R._best_of(*_frames(base, copies, np.arange(2000)[::-1]), 3)
    assert found["id"].tolist() == [i for first in (1500, 1000, 500, 0) for i in (first, first + 1, first + 2)]
    near = base[0] + np.arange(800)[:, None] * 1e-5 * base[1]  # single precision can't tell them apart
    found = R._best_of(*_frames(base[:1], near, np.arange(800)), 3)
    assert found["id"].tolist() == _plain(base[:1], near, np.arange(800), 3)[0][0].tolist()


def test_most_scores_are_not_ordered():
    rng = np.random.default_rng(5)
    queries, vectors, ids = rng.normal(0, 1, (64, 64)), rng.normal(0, 1, (8192, 64)), np.arange(8192)
    scores = (R._unit(queries) @ R._unit(vectors).T).astype(np.float32)

    def least(work):
        taken = []
        for _ in range(3):
            began = time.thread_time()
            work()
            taken.append(time.thread_time() - began)
        return min(taken)

    full = least(lambda: np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :3])
    assert least(lambda: R._near_best(scores, 3, 1e-5)) < full / 4
