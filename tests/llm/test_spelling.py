"""Spelling variants against all pairs of words."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd_rows import frame, lower, rows  # noqa: E402

from llm import spelling  # noqa: E402
from llm.common import documents  # noqa: E402


def plain_words(found):
    """Counts of runs, taken letter by letter."""
    out = Counter()
    for i, t in found:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                run = lower(run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 199 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                out[run] += 1
                run = ""
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and len(b) - len(a) <= 1 and a[k + (len(a) == len(b)):] == b[k + 1:]


def plain(counts):
    """All near pairs, found by taking out one letter of each word."""
    holes = {}
    for w in counts:
        for k in range(len(w) + 1):
            for key in (w[:k] + "\0" + w[k + 1:], w[:k] + "\0" + w[k:]):
                holes.setdefault(key, set()).add(w)
    near = {w: set() for w in counts}
    for held in holes.values():
        for a in held:
            near[a] |= {b for b in held if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_words_of_odd_rows(spark):
    more = [(50 + i, "Größenordnung GRÖSSE naïveté×÷ façade-facade abcdefg " * 3) for i in range(4000)]
    docs = rows() * 3 + more
    got = {r.word: r.n for r in spelling.words(frame(spark, docs)).collect()}
    assert got == plain_words(docs)
    assert any(len(w) == 6 and w.startswith("abc") for w in got)  # some letters were taken out


def test_empty(spark):
    assert found(spelling.variants(spelling.words(frame(spark, [])))) == []
    assert found(spelling.variants(spelling.words(frame(spark, [(1, None), (2, "short")])))) == []


@pytest.mark.parametrize(("letters", "least_list"), [("ab", 2), ("abcé", 2), ("abcdefgh", 1), ("ab", 10**9)])
def test_variants_of_made_words(spark, monkeypatch, letters, least_list):
    """Few letters: many near words, repeated grams and long frequent grams."""
    monkeypatch.setattr(spelling, "LEAST_LIST", least_list)
    rng = random.Random(len(letters))
    counts = {}
    for _ in range(150):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 15)))
        for _ in range(4):
            counts[w] = rng.choice((5, 6, 30, 200, 5000))
            k = rng.randrange(len(w))
            w = rng.choice((w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:],
                            w + rng.choice(letters), w[1:]))
            if len(w) < 6:
                w += letters[0] * 6
    frequent = spelling.frequent_grams(spark.createDataFrame(list(counts.items()), "word string, n long"),
                                       least_list=least_list)
    assert bool(frequent) == (least_list < 10**9)
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert found(got) == plain(counts)


def test_gram_bounds_hold():
    """No edit changes more grams than the bound says."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 12))) for _ in range(60)]
    grams = Counter(w[p:p + k] for w in words for k in range(2, 6) for p in range(len(w) - k + 1))
    frequent = {g: n for g, n in grams.items() if n > 4}
    for w in words:
        for longest in range(2, 7):
            held = spelling.decompose(w, longest, frequent)
            assert len(held) == len(w) - 1 and all(w[p:].startswith(g) for p, g in enumerate(held))
            least = len(held) - spelling.affected(held)
            for k in range(len(w) + 1):
                for other in {w[:k] + w[k + 1:], *(w[:k] + c + w[k + j:] for c in "abc" for j in (0, 1))}:
                    shared = Counter(held) & Counter(spelling.decompose(other, longest, frequent))
                    assert shared.total() >= least


def test_dictionary_is_bounded(spark):
    rng = random.Random(3)
    table = spark.createDataFrame([("".join(rng.choice("abcdef") for _ in range(9)), 5) for _ in range(500)],
                                  "word string, n long")
    assert 0 < len(spelling.frequent_grams(table, most=100, least_list=1)) <= 100


def test_whole_table(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_small).select("doc_id", "text").collect()]
    assert found(spelling.op12_spelling(spark, sf_small)) == plain(plain_words(docs))
