import hashlib

from llm import sharding
from llm.common import documents

from odd_rows import collected, frame, rows


def smallest_capacity(sizes, shards):
    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def check_slots(found, n):
    """Every row once, and places without gaps in each shard."""
    assert len(found) == n
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_minimax_on_documents(spark, sf_small):
    docs = documents(spark, sf_small)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    for shards in (1, 3, 8):
        found = collected(sharding.shard(docs, shards))
        check_slots(found, len(plain))
        heads = {}
        for i, t in plain:
            heads[t] = min(i, heads.get(t, i))
        sizes = {}
        for i, t in plain:
            sizes[heads[t]] = sizes.get(heads[t], 0) + len(t.encode()) + 1
        sums = {}
        for r in found:
            sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        assert max(sums.values()) == smallest_capacity([sizes[h] for h in sorted(sizes)], shards)
        shard_of = {r["doc_id"]: r["shard"] for r in found}
        assert all(shard_of[i] == shard_of[heads[t]] for i, t in plain)
        ordered = [shard_of[h] for h in sorted(sizes)]
        assert ordered == sorted(ordered)


def test_odd_rows(spark):
    found = collected(sharding.shard(frame(spark), 4))
    check_slots(found, len(rows()))
    by_text = {}
    for r in found:
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    # null texts are one group apart from the empty text; null ids come first
    groups = {}
    for i, t in rows():
        groups.setdefault(t, []).append(i)
    line = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        key = "null" if t is None else hashlib.sha256(t.encode()).hexdigest()
        line.append(((bool(known), min(known, default=0)), key, len(ids) * (len((t or "").encode()) + 1)))
    sizes = [n for *_, n in sorted(line)]
    sums = {}
    for r in found:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert sum(sums.values()) == sum(sizes) and max(sums.values()) == smallest_capacity(sizes, 4)
    assert sum(r["doc_id"] is None for r in found) == 2


def test_a_hot_group_leaves_the_rest_balanced(spark):
    docs = [(i, f"text number {i:03d}") for i in range(60)] + [(1000 + i, "copied text 00") for i in range(30)] \
        + [(2000 + i, f"later text {i:03d}") for i in range(30)]
    sums = {}
    for r in collected(sharding.shard(frame(spark, docs), 8)):
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert max(sums.values()) == 30 * 15 and len(sums) == 8


def test_empty_and_few(spark):
    assert sharding.shard(frame(spark, []), 8).count() == 0
    assert collected(sharding.shard(frame(spark, [(3, "x")]), 8))[0]["slot"] == 0
