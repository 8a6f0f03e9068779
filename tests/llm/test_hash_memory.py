"""Hashing the words of many texts takes little memory beside what is kept of them."""

import tracemalloc

from tidelog.llm import jaccard, words


def test_the_arrays_of_a_chunk_are_small():
    texts = [" ".join(f"w{(i * 7919 + j * 104729) % 50021:x}" for j in range(300)) for i in range(1500)]
    words._powers.clear()
    tracemalloc.start()
    found = jaccard.sets(texts)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(found) == 1500 and peak - sum(s.nbytes for s in found) < 30_000_000
