"""Near-duplicate components against brute-force Jaccard of five-word shingles."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest

from codecairn.llm import near_text, simhash

from test_near_and_lines import WORD


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(given):
    """Smallest id of each row's component."""
    sets = [shingles(t) for _, t in given]
    root = list(range(len(given)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or {()}:
            holders[x].append(k)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    first = {}
    for k, (i, _) in enumerate(given):
        if i is not None:
            first[find(k)] = min(first.get(find(k), i), i)
    return sorted(((i, first.get(find(k))) for k, (i, _) in enumerate(given)), key=repr)


def check(docs, **options):
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sorted(((r.doc_id, r.component_id) for r in near_text.near_components(docs, **options).collect()), key=repr)
    assert got == brute(given)
    return got


def varied(seed, groups, each, passage=0):
    """Groups of copies with some words changed, around the least similarity; some words common to all."""
    rnd = random.Random(seed)
    common = [f"passage{k}" for k in range(passage)]
    texts = []
    for g in range(groups):
        base = [f"w{g}x{rnd.randint(0, 300)}" for _ in range(rnd.randint(40, 200))]
        for _ in range(each):
            words = list(base)
            for _ in range(rnd.randint(0, len(words) // 20)):
                words[rnd.randrange(len(words))] = f"other{rnd.randint(0, 999)}"
            texts.append(" ".join(words[:20] + common + words[20:]))
    return texts


@pytest.mark.parametrize("seed, groups, each, passage", [(1, 40, 4, 0), (2, 3, 60, 0), (3, 60, 2, 60)])
def test_near_copies(make_docs, seed, groups, each, passage):
    got = check(make_docs(varied(seed, groups, each, passage)))
    assert groups <= len({c for _, c in got}) < len(got)


def test_crowded_shingles_keep_all_links(make_docs):
    check(make_docs(varied(4, 4, 30, 20)), crowd=2)


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert near_text.near_components(no_docs).count() == 0


def test_stage_keeps_one_of_texts_that_differ_in_many_fingerprint_bits(spark, make_docs):
    """Four of five shingles in common: one text stays, as by brute force."""
    docs = make_docs(varied(5, 30, 2))
    want = {c for _, c in brute([(r.doc_id, r.text) for r in docs.collect()])}
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == want
    assert len(want) < 60


def test_fingerprint_links_are_compared_first(spark, make_docs, monkeypatch):
    """The pairs connect exactly the texts within two fingerprint bits, and the stage takes them."""
    words = " ".join(f"w{k}" for k in range(400))
    texts = [f"{words} end{k}" for k in range(30)] + varied(6, 10, 3) + ["", "one", "two"]
    given = spark.createDataFrame(list(enumerate(texts)), "node long, plain string")
    prints = [simhash.fingerprint(t) for t in texts]
    near = [[b for b, y in enumerate(prints) if (x ^ y).bit_count() <= 2] for x in prints]
    pairs = [(r.a, r.b) for r in near_text.fingerprint_pairs(given).collect()]
    assert len(pairs) > 10 and all(b in near[a] and a != b for a, b in pairs)

    def reached(neighbours):
        groups = []
        for k in range(len(texts)):
            seen, todo = {k}, [k]
            while todo:
                new = set(neighbours(todo.pop())) - seen
                seen |= new
                todo += new
            groups.append(min(seen))
        return groups

    assert reached(lambda k: [b for a, b in pairs if a == k] + [a for a, b in pairs if b == k]) == reached(near.__getitem__)
    taken, whole = [], near_text.fingerprint_pairs
    monkeypatch.setattr(near_text, "fingerprint_pairs", lambda t: taken.append(t.count()) or whole(t))
    check(make_docs(texts))
    assert taken == [len(set(texts))]
