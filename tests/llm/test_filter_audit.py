"""The filter audit against a walk of every document through every order."""

import re
import sys
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import LONG, WORD, collected, frame, rows  # noqa: E402

from llm import filter_audit  # noqa: E402

MORE = [(20, "SHOUTING WORDS " * 40), (21, "a # b"), (22, "SHOUTING WORDS " * 40), (23, LONG), (24, "few words here")]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (7, 1, 0), (20, 0, 1), (22, None, 1), (22, 1, None), (None, 1, 1), (99, 1, 1)]


def plain(found, labels):
    """found: (id, part, text). Every document walks through all 120 orders."""
    least = {}
    for i, _, t in found:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = defaultdict(Counter)
    for i, part, t in found:
        t, part = t or "", part or ""
        w = WORD.findall(t)
        failed = {x for x, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            any(c in t for c in "#$%&*|"), i is not None and least.get(t, i) < i), strict=True) if bad}
        for order in permutations("ABCDE"):
            at = min((order.index(x) + 1 for x in failed), default=9)
            for step, x in enumerate(order, 1):
                c = out[part, "".join(order), step]
                c["kept"] += at > step
                c["removed"] += at == step
                c["redundant"] += x in failed and at < step
                c["unique_fails"] += failed == {x}
                c["good_lost"] += at == step and i in good
                c["toxic_lost"] += at == step and i in toxic
                out[part, x]["shapley"] += at == step
    for (part, *rest), c in list(out.items()):
        if len(rest) == 2:
            c["shapley"] = out[part, rest[0][rest[1] - 1]]["shapley"]
    return {k: +c for k, c in out.items() if len(k) == 3}


def audited(spark, found, labels):
    docs = spark.createDataFrame([(i, p, t, "x", 1) for i, p, t in found],
                                 "doc_id long, source string, text string, mask string, n int")
    held = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    return collected(filter_audit.audit(filter_audit.failures(docs, held)))


def test_odd_rows(spark):
    found = [(i, ("web", "", None, "books")[k % 4], t) for k, (i, t) in enumerate(rows() + MORE)]
    want = plain(found, LABELS)
    got = audited(spark, found, LABELS)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        key = r.pop("part"), r.pop("filter_order"), r.pop("step")
        assert +Counter(r) == want[key], key


def test_empty(spark):
    assert audited(spark, [], []) == []
    got = audited(spark, [(1, "a", "x " * 60)], [])
    assert len(got) == 600 and {r["good_lost"] for r in got} == {0}


def test_hot_text(spark):
    """A text that most rows share, over several parts."""
    found = [(i, f"s{i % 3}", "same text") for i in range(1, 400)] + [(500 + i, "s0", f"other {i}") for i in range(50)]
    want = plain(found, [(1, 1, 0)])
    for r in audited(spark, found, [(1, 1, 0)]):
        key = r.pop("part"), r.pop("filter_order"), r.pop("step")
        assert +Counter(r) == want[key]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_intervals_are_the_orders(n):
    want = defaultdict(set)
    for r, order in enumerate(permutations(range(n))):
        assert filter_audit.rank(order, n) == r
        for mask in range(1, 1 << n):
            step = 1 + min(k for k, x in enumerate(order) if mask >> x & 1)
            want[mask, step].add(r)
    got = defaultdict(set)
    for mask, step, a, b in filter_audit.intervals(n):
        assert a < b and not got[mask, step] & set(range(a, b))
        got[mask, step] |= set(range(a, b))
    assert got == want


def test_extra_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0, "y")], "doc_id long, quality int, toxic int, digest string")
    got = filter_audit.failures(frame(spark), labels, source_col="shard").collect()
    assert sum(r.n for r in got) == len(rows()) and {r.part for r in got} == {"x"}
