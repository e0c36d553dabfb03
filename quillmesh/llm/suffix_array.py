"""Suffix arrays by the difference cover {1, 2} modulo 3, vectorised.

Triples at sampled positions are sorted and named; where names repeat the algorithm recurses on the
names; the remaining suffixes are sorted by their first letter and the rank of what follows, and
merged in by counting the sampled suffixes before each of them.
"""

from __future__ import annotations

import numpy as np


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key in the order of (a, b); a is made dense where the product would overflow."""
    a = a.astype(np.int64, copy=False)
    wide = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * wide >= 1 << 63:
        a = np.unique(a, return_inverse=True)[1]
    return a * wide + b


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of a sequence of nonnegative integers, in order; a prefix comes before what it begins."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: list(text[i:])), np.int64)
    s = np.zeros(n + 4, np.int64 if int(text.max()) >= (1 << 31) - 1 else np.int32)
    s[:n] = text
    s[:n] += 1

    # Sort the sampled triples and name them; with n = 1 mod 3 the empty suffix is sampled, to part the halves.
    # Keys are 64 bits wide and live shortly; what is kept through the recursion has 32 where it can.
    narrow = np.int32 if n < (1 << 31) - 8 else np.int64
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=narrow), np.arange(2, n + (n % 3 == 1), 3, dtype=narrow)])
    triples = joined(joined(s[sample], s[sample + 1]), s[sample + 2])
    order = np.argsort(triples).astype(narrow)
    triples = triples[order]
    new = np.ones(len(sample), bool)
    new[1:] = triples[1:] != triples[:-1]
    del triples
    names = np.empty(len(sample), narrow)
    names[order] = np.cumsum(new, dtype=narrow)
    if not new.all():
        del order, new
        order = suffix_array(names)  # recurse on names
    del names
    rank = np.zeros(n + 4, narrow)
    rank[sample[order]] = np.arange(1, len(sample) + 1, dtype=narrow)
    sample = sample[order]
    sample = sample[sample < n]

    # Sort the remaining suffixes by their first letter and the rank of the next suffix; count the sampled ones before each.
    rest = np.arange(0, n, 3, dtype=narrow)
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    keys = joined(s[np.concatenate([rest, one])], rank[np.concatenate([rest, one]) + 1])
    own = np.argsort(keys[: len(rest)])
    at = np.arange(len(rest)) + np.searchsorted(keys[len(rest) :], keys[: len(rest)][own])
    rest = rest[own]
    del keys, own
    both = np.concatenate([rest, two])
    keys = joined(joined(s[both], s[both + 1]), rank[both + 2])
    at += np.searchsorted(keys[len(rest) :], keys[: len(rest)])
    del keys, both
    out = np.empty(n, narrow)
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sample
    return out
