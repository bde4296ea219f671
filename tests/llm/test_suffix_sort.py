import numpy as np

from recordlens.llm.suffix_sort import common_prefix, rising, suffix_order, words_at


def test_order_and_prefixes_equal_brute_force():
    rng = np.random.default_rng(1)
    for case in range(300):
        n = int(rng.integers(0, 200))
        text = rng.integers(1, rng.integers(1, 5) + 2, n).astype(np.uint8)
        if case % 3 == 0 and n:
            text = np.tile(text[:5], n)[:n]
        wanted = np.flatnonzero(rng.random(n) < rng.random())
        raw = text.tobytes()
        order = suffix_order(text, wanted, 24)
        assert sorted(order) == list(wanted)
        cut = [raw[i : i + 24] for i in order]
        assert cut == sorted(cut)
        prefix = common_prefix(words_at(text, 32), order, 24)
        for i in range(1, len(order)):
            a, b = (raw[j:].ljust(64, b"\0")[:24] for j in (order[i - 1], order[i]))
            assert prefix[i] == next((k for k in range(24) if a[k] != b[k]), 24)


def test_rising_is_the_suffix_comparison():
    rng = np.random.default_rng(2)
    for _ in range(100):
        text = rng.integers(1, 4, int(rng.integers(0, 40))).astype(np.uint8)
        raw = text.tobytes()
        assert rising(text).tolist() == [raw[i:] < raw[i + 1 :] for i in range(len(raw))]
