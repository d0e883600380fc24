"""Very long child lists are aligned exactly, not within a band."""

import random

from signalloom.llm import html_extract
from signalloom.llm.html_extract import Wrapper


def listing(rng, n, contents):
    def leaf(key):
        return Wrapper(key, 1, {rng.choice(contents): 1}, [])

    return [[Wrapper(rng.choice("xyz"), 1, {rng.choice(contents): 1}, [leaf(rng.choice("ab")) for _ in range(rng.randrange(4))])] for _ in range(n)]


def test_rows_give_the_alignment_of_the_whole_table():
    for seed, contents in ((1, range(40)), (2, range(5000)), (3, range(2))):
        rng = random.Random(seed)
        left, right = listing(rng, 130, contents), listing(rng, 110, contents)
        right[40:60] = left[90:110]
        matching = html_extract.Matching()
        want = html_extract.best_alignment(130, 110, lambda i, j: matching.worth(left[i][0], right[j][0]))  # noqa: B023
        assert html_extract.long_alignment(left, right) == want


def test_a_far_partner_is_found():
    item = lambda k: Wrapper("div", 1, {k: 1}, [Wrapper("p", 1, {-k: 1}, [])])
    head = [Wrapper("div", 1, {10**6 + k: 1}, []) for k in range(300)]
    left, right = [item(k) for k in range(1, 400)], [*head, *(item(k) for k in range(1, 400))]
    pairs = html_extract.Matching().children(Wrapper("x", 1, {}, left), Wrapper("x", 1, {}, right))[1]
    assert pairs == [(k, 300 + k) for k in range(399)]
