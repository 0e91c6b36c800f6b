import random
import re

import pytest
from pyspark.sql import functions as F

from terravane.llm import neardup
from terravane.llm.graph import components
from tests.llm.cases import documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")


def grams(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """key -> (group, copies, links, text_links)."""
    sets = {i: grams(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links, texts = dict.fromkeys(sets, 0), {i: set() for i in sets}
    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                    links[a] += 1
                    links[b] += 1
                    if sets[a] != sets[b]:
                        texts[a].add(sets[b])
                        texts[b].add(sets[a])
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    copies = {i: sum(sets[j] == sets[i] for j in sets) if sets[i] else 1 for i in sets}
    return {i: (root(i), copies[i], links[i], len(texts[i])) for i in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["key"]: (r["group"], r["copies"], r["links"], r["text_links"]) for r in neardup.jaccard_groups(df).collect()}
    want = brute(rows)
    assert {k: v for k, v in got.items() if k in want} == want
    return got


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_copies_near_copies_and_strangers(spark):
    rng = random.Random(2)
    base = [" ".join(f"b{rng.randrange(500)}" for _ in range(rng.randrange(5, 200))) for _ in range(30)]
    texts = base + [base[0]] * 20 + [t for b in base[:8] for t in family(rng, b, 6, 4)] + ["", None, " ", "one", "one", "one two", "four words are few", "four words are few"]
    check(spark, list(enumerate(texts)))


def test_a_large_group_takes_several_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = " ".join(f"b{rng.randrange(500)}" for _ in range(120))
    rows = list(enumerate(family(rng, base, 150, 3)))
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = check(spark, rows)
    assert max(v[2] for v in got.values()) > 100


def test_many_documents_share_a_passage(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for i in range(120)]
    got = check(spark, rows)
    assert all(v[0] == k for k, v in got.items())


def test_matches_are_the_longest_shared_prefixes(spark):
    rng = random.Random(6)
    forest = neardup.Forest(trees=3, depth=4)
    labels = {i: [b"".join(bytes([0, rng.randrange(2)]) for _ in range(4)) for _ in range(3)] for i in range(200)}
    labelled = spark.createDataFrame([(d, [bytearray(x) for x in own]) for d, own in labels.items()], "node long, labels array<binary>").repartition(7)
    matches = neardup._matches(labelled, forest, 2)[0]
    got = [tuple(r) for r in matches.collect()]
    assert all(any(labels[a][t][: 2 * n] == labels[b][t][: 2 * n] for t in range(3)) for a, b, n in got)
    for depth in (4, 3, 2):
        up = {d: d for d in labels}

        def root(d, up=up):
            while up[d] != d:
                d = up[d]
            return d

        for t in range(3):
            nodes = {}
            for d, own in labels.items():
                a, b = root(d), root(nodes.setdefault(own[t][: 2 * depth], d))
                up[max(a, b)] = min(a, b)
        found = {r["node"]: r["root"] for r in components(neardup._lines(matches, depth)).collect()}
        assert found == {d: root(d) for d in labels if sum(root(x) == root(d) for x in labels) > 1}


def test_edges_grow_with_texts_and_not_with_pairs(spark, monkeypatch):
    rng = random.Random(7)
    base = " ".join(f"b{rng.randrange(500)}" for _ in range(120))
    texts = sorted(set(family(rng, base, 600, 3)))
    monkeypatch.setattr(neardup, "BLOCK", 16)
    seen = []
    monkeypatch.setattr(neardup, "components", lambda edges: (seen.append(edges.distinct().count()), components(edges))[1])

    def most(n):
        seen.clear()
        neardup.jaccard_groups(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")).count()
        return max(seen)

    few, many = most(200), most(400)
    assert few < 3 * 200 and many <= 2.1 * few


def test_texts_under_one_id_are_told_apart(spark):
    rng = random.Random(9)
    one, two = (" ".join(f"{c}{rng.randrange(500)}" for _ in range(80)) for c in "ab")
    rows = [(1, one), (1, two), (1, two), (2, two + " more"), (3, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["key"], r["group"], r["links"]) for r in neardup.jaccard_groups(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert sorted(tuple(r) for r in neardup.without_near_duplicates(df).collect()) == sorted([(1, one), (1, two)])


def test_prefixes_shorten_for_the_weakest_link(spark):
    """Pairs from 0.8 to 0.84: all are found, though whole labels miss some of them."""
    rng = random.Random(10)
    rows = []
    for i in range(400):
        w = [f"v{i}x{k}" for k in range(104)]
        near = w[: rng.choice([94, 95])]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near + [f"u{i}x{k}" for k in range(len(w) - len(near))]))]
    grams_ = {i: grams(t) for i, t in rows}
    sims = [len(grams_[2 * i] & grams_[2 * i + 1]) / len(grams_[2 * i] | grams_[2 * i + 1]) for i in range(400)]
    assert min(sims) >= 0.8 and max(sims) < 0.85
    got = neardup.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("links = 1").count() == 800


def test_depth_shortens_to_the_target_recall():
    forest = neardup.Forest()
    d = forest.prefix(0.8)
    assert 1 - (1 - 0.8**d) ** forest.trees >= forest.recall > 1 - (1 - 0.8 ** (d + 1)) ** forest.trees
    assert forest.prefix(0.99) == forest.depth and forest.prefix(0.1) == 1


def test_tables_of_all_kinds(spark):
    docs = documents(spark).withColumns({"key": F.lit(1), "group": F.lit("x")})
    got = neardup.jaccard_groups(docs)
    assert got.count() == docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))).distinct().count()
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.where("source = 'hot'").count() == 1
    assert kept.where("doc_id in (3, 105)").count() == 1 and kept.where("doc_id in (103, 104)").count() == 1
    assert kept.where("doc_id is null").count() == 2
    assert neardup.jaccard_groups(empty(spark)).count() == 0
    assert neardup.without_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 80)] + [(200, 201), (201, 202)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, a)
            up.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up
