"""Line dedup against a plain dictionary, for one and for several groups."""

import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import LONG, frame, lower, rows  # noqa: E402

from llm import line_dedup  # noqa: E402
from llm.common import documents  # noqa: E402

SPACE = " \t\n\x0b\x0c\r"
MORE = [
    (30, "A common Heading Line\nown words of thirty\n"), (31, "  a COMMON heading line \t\nown words of thirty one"),
    (32, "a common heading line\r\na common heading line\n\x0ba common heading line"), (29, "x\na common heading line\nx"),
    (33, "ÄÖÜäöü ßßß\nninechars\nninechars!"), (34, "ÄÖÜäöü ßßß\näÖÜäöü ßßß\nninechars\nninechars!"),
    (35, " ninechars\nninechars "), (36, " ninechars\nninechars "), (29, "a common heading line"),
    (37, LONG + "\nthe last line of a long text"), (38, "the last line of a long text\n" + LONG),
    (None, "a line of rows without id"), (None, "a line of rows without id\nand one more"), (39, ""), (40, "\n\n"),
]


def plain(found, least=2):
    held = defaultdict(set)
    keys = lambda t: [lower(x.strip(SPACE)) for x in (t or "").split("\n")]
    for k, (i, t) in enumerate(found):
        for x in keys(t):
            if len(x) >= 10:
                held[x].add((i is None, i or 0, k))
    owner = {x: min(v)[:2] for x, v in held.items() if len(v) >= least}
    out = []
    for i, t in found:
        own = (i is None, i or 0)
        lines = (t or "").split("\n")
        keep = [x for x, key in zip(lines, keys(t), strict=True) if owner.get(key, own) == own]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def got(spark, found, least=2, **how):
    docs = documents_of(spark, found)
    arrays = line_dedup.line_arrays(docs, least, **how)
    out = line_dedup.drop_repeated_lines(docs, arrays, least)
    return arrays, sorted(map(tuple, out.collect()), key=str)


def documents_of(spark, found):
    return frame(spark, found).withColumnRenamed("kept", "group").withColumnRenamed("shard", "lost")


def test_odd_rows(spark):
    found = rows() + MORE
    arrays, lines = got(spark, found)
    assert arrays.groups == 1 and lines == plain(found)
    assert [r[3] for r in lines if r[0] == 37] == [1] and [r[3] for r in lines if r[0] == 38] == [2]


def test_empty_table(spark):
    assert got(spark, [])[1] == []
    assert got(spark, [(1, None)])[1] == [(1, "", 1, 0)]


def test_least_documents(spark):
    found = rows() + MORE
    assert got(spark, found, least=3)[1] == plain(found, 3)


def test_several_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    found = rows() + MORE + [(100 + i, f"line number {i % 40} of many\nline number {i % 7} of a few") for i in range(200)]
    arrays, lines = got(spark, found, array_bytes=300)
    assert arrays.groups > 2 and arrays.shards > arrays.groups
    assert lines == plain(found)


def test_hash_of_the_lines(spark, sf_small):
    found = [(r.doc_id, r.text) for r in documents(spark, sf_small).select("doc_id", "text").collect()]
    want = {i: (n, lost, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, lost in plain(found)}
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256)
           for r in line_dedup.op13_line_dedup(spark, sf_small).collect()}
    assert out == want


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 20_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h, f = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    if n > 2:
        h[:n // 2] = h[0]  # equal halves: the other half tells them apart
    perfect = line_dedup.PerfectHash.build(h, f)
    assert sorted(perfect.places(h, f)) == list(range(n))
    assert sum(perfect.sizes) <= 4 * n + 64 * len(perfect.sizes)
    strange = perfect.places(*rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64))
    assert ((strange >= -1) & (strange < max(n, 1))).all()
