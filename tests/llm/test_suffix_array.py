import random

import numpy as np

from quillmesh.llm.suffix_array import joined, suffix_array


def test_equals_sorting():
    rng = random.Random(8)
    cases = [[], [0], [1, 1], [0, 0, 0], [2, 1, 2, 1], [0] * 50, [1, 0] * 30, list(b"mississippi"), list(b"abcabcabcabc" * 9)]
    cases += [[rng.randrange(rng.choice([1, 2, 3, 300])) for _ in range(rng.randint(1, 120))] for _ in range(800)]
    cases.append([10**12, 5, 10**12, 5, 10**12, 7] * 20)
    for text in cases:
        assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_joined_keeps_order_without_overflow():
    a = np.array([1 << 40, 5, 1 << 40, 0, 5])
    b = np.array([3, 1 << 40, 2, 9, 0])
    assert np.argsort(joined(a, b), kind="stable").tolist() == sorted(range(5), key=lambda k: (a[k], b[k]))
