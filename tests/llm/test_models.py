"""Near duplicates, language model, toxicity and the pipeline."""

import collections
import math
import random

import numpy as np
import pytest
from odd_rows import PLAIN, collected, fold, frame, lower, rows, WORD

import corpus_pipeline
from llm import language_model, near_dedup, toxicity
from llm.common import ROW_KEY, documents, stage
from llm.components import components


def shingles(text, width=2):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain_components(docs, width=2):
    """doc -> least id reachable over links of at least 0.8, by all pairs."""
    sets = [shingles(t, width) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i, find(k))
            for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def check_near(spark, df, docs, width=2):
    found = collected(near_dedup.NearDuplicates(df, width).result())
    plain = plain_components(docs, width)
    want = collections.Counter((i, n, c, i == c) for i, n, c, _ in plain)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found) == want
    assert sum(r["first"] for r in found) == len({group for *_, group in plain})
    return found


def near_group(n, seed, words=60, changes=4):
    """Copies of one text with a few words changed, so that the similarities
    of pairs lie around the limit."""
    rng = random.Random(seed)
    base = [f"g{seed}w{i}" for i in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for j in rng.sample(range(words), rng.randint(0, changes)):
            w[j] = f"n{seed}k{k}j{j}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_of_odd_rows(spark):
    check_near(spark, frame(spark), rows())
    assert near_dedup.NearDuplicates(frame(spark, [])).result().count() == 0


@pytest.mark.parametrize("width", [1, 5])
def test_near_duplicates_of_other_widths(spark, width):
    check_near(spark, frame(spark), rows(), width)
    docs = list(enumerate(near_group(60, 5, changes=3) + near_group(40, 6, 80, 2) + near_group(8, 7, 4, 1)))
    check_near(spark, spark.createDataFrame(docs, "doc_id long, text string"), docs, width)


def template_pages(n, shared=76, own=25):
    """Pages of one template: every two of them have a similarity of about 0.6."""
    common = " ".join(f"menu{i}" for i in range(shared))
    return [f"{common} " + " ".join(f"p{k}w{i}" for i in range(own)) for k in range(n)]


def test_pages_of_one_template_meet_in_no_list(spark):
    """Near copies among them are found; no other pair is ever formed."""
    pages = template_pages(400)
    copies = [f"{pages[k].rsplit(' ', 2)[0]} other{k} end{j}" for k in range(0, 400, 40) for j in range(3)]
    docs = list(enumerate(pages + copies + near_group(30, 8, changes=5)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check_near(spark, df, docs)
    near = near_dedup.NearDuplicates(spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string"))
    members = near.members()
    assert members.select("c").distinct().count() > 300  # they do share buckets
    links = near.confirm(near.star_pairs(members))
    assert links.count() == 0
    assert near.rest_pairs(members, components(links))[0].count() == 0


def test_copies_of_one_text_meet_in_its_star(spark):
    """Copies that link to their text but not to each other are connected by
    pairs with the text; few pairs are left for the lists."""
    docs = list(enumerate(near_group(400, 11, 150, 6)))
    random.Random(12).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check_near(spark, df, docs, 5)
    near = near_dedup.NearDuplicates(df, 5)
    members = near.members()
    links = stage(near.confirm(near.star_pairs(members)), "links")
    assert links.count() > 100
    assert near.rest_pairs(members, components(links))[0].count() < 20


def test_near_duplicates_of_chained_templates(spark):
    """Groups whose rare shingles are shared across components."""
    rng = random.Random(3)
    parts = [" ".join(f"b{b}w{i}" for i in range(20)) for b in range(8)]
    docs = []
    for k in range(250):
        w = " ".join(parts[b] for b in sorted(rng.sample(range(8), 5))).split()
        for j in rng.sample(range(100), rng.randint(0, 8)):
            w[j] = f"x{k}j{j}"
        docs.append((k, " ".join(w)))
    check_near(spark, spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_sets_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_A_SET", 5)
    docs = list(enumerate(near_group(90, 9, changes=5)))
    check_near(spark, spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_near_duplicates_in_large_groups_around_the_limit(spark):
    docs = [(1000 + i, t) for i, t in enumerate(near_group(120, 1, changes=6) + near_group(60, 2, 30, 2)
                                                + ["copy of one text with some words"] * 200)]
    random.Random(3).shuffle(docs)
    found = check_near(spark, frame(spark, docs), docs)
    assert len({r["component_id"] for r in found}) > 3  # some changed texts stay apart


def test_near_duplicates_of_documents(spark, sf_small):
    docs = documents(spark, sf_small)
    check_near(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001), (1002, 1000)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000, 1002: 1000}


def plain_base(docs):
    tokens = [[*(w.encode() for w in WORD.findall(lower(t or ""))), b""] for _, t in docs]
    counts = collections.Counter()
    for (i, _), t in zip(docs, tokens, strict=True):
        if fold(i, 7) != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for (i, _), t in zip(docs, tokens, strict=True):
        yield (i, fold(i, 7) == 2, len(t), sum(counts[w] > 0 for w in t), n,
               sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))


def scored(df):
    model, vocabulary = language_model.train(df.filter(~language_model.held_out()).select("doc_id", "text"))
    return model, collected(language_model.score(df, model, vocabulary).withColumn(
        "held_out", language_model.held_out()))


@pytest.mark.parametrize("frequent", [400_000, 20])
def test_language_model_base_terms(spark, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)  # most words go through the join
    docs = rows() + [(2 + 100 * k, f"word{k} {PLAIN}") for k in range(20)]
    model, found = scored(frame(spark, docs))
    key = lambda r: tuple((x is None, x) for x in (r[0], r[2], r[3], r[5]))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], model.train_tokens,
                   round(r["base_score"], 6)) for r in found), key=key)
    want = sorted(((*b[:5], round(b[5], 6)) for b in plain_base(docs)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-5)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_language_model_is_normalised_and_learns(spark):
    weights = np.random.default_rng(1).normal(size=(language_model.TABLE_ROWS, language_model.SLOTS)).astype("f4")
    every = np.arange(language_model.START)
    one, two = np.full(len(every), 7), np.full(len(every), 500)
    assert np.exp(language_model.log_chance(weights, every, one, two)).sum() == pytest.approx(1, abs=1e-4)
    # two vocabularies that never mix: the word before tells the next one's
    rng = random.Random(4)
    kinds = [[f"aa{i}x" for i in range(40)], [f"bb{i}y" for i in range(40)]]
    docs = [(i, " ".join(rng.choices(kinds[i % 2], k=80))) for i in range(2000)]
    _, found = scored(frame(spark, docs))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_language_model_of_empty_tables(spark):
    _, found = scored(frame(spark, []))
    assert found == []
    _, found = scored(frame(spark, [(i, "a b") for i in range(50) if fold(i, 7) == 2]))
    assert found and all(r["n_known"] == 0 and r["base_score"] == 0 for r in found)


def toxic_docs(n, seed=0):
    """Filler texts; one in five holds some of ten bad words."""
    rng = random.Random(seed)
    filler, bad = [f"w{i}" for i in range(400)], [f"bad{i}" for i in range(10)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(filler, k=rng.randint(30, 120))
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(bad, rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_docs(1500)
    # labels of held-out rows are turned round: they must not be used
    given = [(i, q, 1 - t if fold(i, 5) == 0 else t) for i, q, t in labels] + [(None, 1, 1), (99_999, 1, 1), (7, 1, None)]
    model = toxicity.train(frame(spark, docs + rows()), spark.createDataFrame(given, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r["p"] for r in collected(toxicity.with_score(frame(spark, docs), model, out="p"))}
    held = [(found[i] >= 0.5, bool(t)) for i, _, t in labels if fold(i, 5) == 0]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    clean = [found[i] >= 0.5 for i, _ in docs if i % 5]
    assert sum(clean) <= 0.005 * len(clean)
    odd = collected(toxicity.with_score(frame(spark), model, out="score"))
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert model.score("") < 0.5


def plain_em(patterns, chance, share, rounds):
    """The label model by loops over patterns, voters and votes."""
    v, weight = toxicity.N_VOTERS, [1.0] * toxicity.N_VOTERS
    for k in range(rounds):
        post = []
        for votes, _ in patterns:
            x = math.log(share / (1 - share)) + sum(
                weight[j] * math.log(chance[1][j][votes[j]] / chance[0][j][votes[j]]) for j in range(v))
            post.append(1 / (1 + math.exp(-x)))
        soft = [[(1 - p) * n for p, (_, n) in zip(post, patterns, strict=True)],
                [p * n for p, (_, n) in zip(post, patterns, strict=True)]]
        size = [sum(s) for s in soft]
        share = min(0.5, max(1e-4, (size[1] + 0.5) / (sum(size) + 1)))
        chance = [[[(sum(s for s, (votes, _) in zip(soft[y], patterns, strict=True) if votes[j] == c) + 0.5)
                    / (size[y] + 1.5) for c in range(3)] for j in range(v)] for y in range(2)]
        if k:
            z = np.array([[{0: 0, 1: 1, 2: -1}[c] for c in votes] for votes, _ in patterns], float)
            most = np.zeros((v, v))
            for y in range(2):
                w = np.array(soft[y]) / size[y]
                mean = (z * w[:, None]).sum(0)
                cov = (z * w[:, None]).T @ z - np.outer(mean, mean)
                dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                most = np.maximum(most, np.minimum(1, np.abs(cov / np.outer(dev, dev))))
            most[most < 0.1] = 0
            weight = [1 / (1 + sum(most[j][i] for i in range(v) if i != j)) for j in range(v)]
    return chance, share, weight


def test_label_model_recovers_planted_voters(spark):
    """Voters of known accuracy, two of which always agree: the distributed
    fit gives the numbers of a plain one, the planted accuracies, and half
    the weight to the two."""
    rng, v = np.random.default_rng(4), toxicity.N_VOTERS
    right = np.concatenate(([0.9, 0.9, 0.8, 0.75, 0.7], np.full(v - 5, 0.65)))
    seen = np.concatenate((np.full(5, 0.9), np.full(v - 5, 0.3)))
    y = rng.random(6000) < 0.2
    votes = np.where(rng.random((6000, v)) < right, np.where(y, 1, 2)[:, None], np.where(y, 2, 1)[:, None])
    votes[rng.random((6000, v)) >= seen] = 0
    votes[:, 1] = votes[:, 0]
    counts = collections.Counter(map(tuple, votes.tolist()))
    bits = lambda row, c: sum(1 << j for j, x in enumerate(row) if x == c)
    table = spark.createDataFrame([(bits(r, 1), bits(r, 2), n) for r, n in counts.items()], "yes long, no long, n long")
    chance = np.full((2, v, 3), 1 / 3)
    chance[0, :, 1], chance[0, :, 2], chance[1, :, 1], chance[1, :, 2] = 0.2, 0.4667, 0.4667, 0.2
    start = toxicity.LabelModel(chance, 0.3)
    got = toxicity.fit_label_model(table, start, rounds=8)
    plain = plain_em([(r, n) for r, n in counts.items()], chance.tolist(), 0.3, 8)
    assert np.allclose(got.chance, plain[0], atol=1e-6) and abs(got.share - plain[1]) < 1e-6
    assert np.allclose(got.weight, plain[2], atol=1e-6)
    accuracy = got.chance[1, :, 1] / (got.chance[1, :, 1] + got.chance[1, :, 2])
    assert np.abs(accuracy - right)[2:].max() < 0.08 and abs(got.share - 0.2) < 0.05
    assert np.abs(got.weight[:2] - 0.5).max() < 0.05 and got.weight[2:].min() > 0.8


def test_toxicity_votes_of_held_out_rows_do_not_count(spark):
    docs, labels = toxic_docs(600)
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    other = [(i, "!!! *** WHAT ?" if fold(i, 5) == 0 else t) for i, t in docs]
    one, two = (toxicity.train(frame(spark, d), label_rows) for d in (docs, other))
    assert one.weights == two.weights and one.intercept == two.intercept


def test_toxicity_sample_loses_near_copies_only(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    # texts that share a third of their word pairs, and three copies of each of ten
    docs = [(i, " ".join(common + [f"u{i}x{j}" for j in range(40)])) for i in range(300)]
    copies = [(1000 + 10 * i + k, docs[i][1] + " end" * k) for i in range(10) for k in range(3)]
    docs = docs + copies + [(2000, None), (2001, ""), (2002, " ")]
    rng.shuffle(docs)
    sample = frame(spark, docs).select("doc_id", "text")
    kept = [r.doc_id for r in toxicity._unlike_rows(sample).collect()]
    order = {r.doc_id: r.h for r in sample.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    groups = [[i, *range(1000 + 10 * i, 1003 + 10 * i)] for i in range(10)] + [[2000, 2001, 2002]]
    want = {i for i in range(10, 300)} | {min(g, key=order.get) for g in groups}
    assert len(kept) == len(want) and set(kept) == want


def test_toxicity_counts_capitals_of_whole_texts():
    bit = 1 << [name for name, *_ in toxicity.PATTERN_VOTERS].index("mostly capitals") \
        + toxicity.LEXICONS + toxicity.ABSENCE
    calm, loud = "some calm words " * 130, "SOME LOUD WORDS " * 130
    voters = toxicity.Voters({})
    assert voters.votes(calm + loud * 3)[0] & bit
    assert not voters.votes(loud + calm * 9)[0] & bit
    for text in (calm, loud, "", "ÄÖÜ äöü ABC ЖЗИ жзи ǅ Ⅷ", "日本語 A"):
        assert toxicity.capitals(text) == sum(map(str.isupper, text))


def test_toxicity_without_examples(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark), labels)
    assert 0 <= model.score("anything") <= 1
    assert toxicity.with_score(frame(spark, []), model, out="p").count() == 0


def test_pipeline_stages(spark, sf_small):
    docs = documents(spark, sf_small)
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "packing"]
    for name, function in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(function(spark, docs, sf_small), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "near_dedup":
            assert set(after) == {i for i, _, c, _ in plain_components(before, 5) if i == c}
        if name == "decontaminate":
            from test_text_scans import plain_hits
            items = [(r.item_id, r.text) for r in documents(spark, sf_small, "benchmark").collect()]
            assert set(after) == {i for i, _, hit, _ in plain_hits(before, items) if not hit}
        if name == "secrets":
            from llm.secrets import base_spans
            assert set(after) == {i for i, _ in before}
            changed = [i for i, t in before if after[i].text != t]
            assert set(changed) >= {i for i, t in before if base_spans(t)}
            assert all(not [s for s in base_spans(after[i].text) if s[1] > 0] for i in changed)
            assert all(after[i].n_chars == len(after[i].text) for i in changed)
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i, _ in before}


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_empty_and_odd_tables(spark, sf_small, k):
    """Null, empty, repeated and very long rows, extra columns with the
    operators' own names; then no rows at all."""
    name, function = corpus_pipeline.STAGES[k]
    odd = stage(frame(spark).withColumnRenamed("n_words", "n_chars"), "odd")
    out = function(spark, odd, sf_small)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect()) if name != "packing" else None
    want = collections.Counter(rows())
    if name == "near_dedup":
        first = {}
        for (i, _, _, group), row in zip(plain_components(rows(), 5), rows(), strict=True):
            first[group] = min(first.get(group, (True, 0, row)), (i is None, i or 0, row), key=lambda x: x[:2])
        want = collections.Counter(row for *_, row in first.values())
    if name == "packing":
        pieces = collections.Counter(r.doc_id for r in out.collect())
        assert set(pieces) == {i for i, _ in rows()} and pieces[7] > 1 and pieces[2] == 2
    else:
        assert got == want and out.columns == odd.columns
    none = stage(frame(spark, []), "none")
    assert function(spark, none, sf_small).count() == 0
    if name != "packing":
        assert function(spark, none, sf_small).columns == none.columns


def test_pipeline_drops_toxic_documents(spark, tmp_path):
    """The documents that the classifier rejects go, and no others."""
    docs, labels = toxic_docs(1200, seed=3)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = stage(frame(spark, docs), "toxic")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, given, str(tmp_path)).collect()}
    model = toxicity.train(given, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert left == {i for i, t in docs if model.score(t) < 0.5}
    gone = {i for i, _ in docs} - left
    assert sum(i % 5 == 0 for i in gone) >= 0.95 * 240 and sum(i % 5 > 0 for i in gone) <= 2


def test_pipeline_keeps_odd_rows_apart(spark, sf_small):
    """Extra columns with clashing names, null and repeated rows."""
    docs = stage(frame(spark), "odd")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_small)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got[(1, PLAIN)] == 1 and got[(2, PLAIN)] == 0 and got[(5, None)] == 1 and got[(None, None)] == 1
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_small)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert ROW_KEY[0] in docs.columns


def test_pipeline_drops_rows_of_frames_that_are_no_file_scan(spark, sf_small):
    item = next(r.text for r in documents(spark, sf_small, "benchmark").collect() if len(r.text.split()) > 20)
    docs = frame(spark, [(1, PLAIN), (2, PLAIN), (3, item)])
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_small).collect()} == {1, 3}
    both = docs.filter("doc_id = 3").unionByName(docs.filter("doc_id < 3"))
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, both, sf_small).collect()} == {1, 2}
