"""SimHash components and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from codecairn.llm import line_dedup, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Root (smallest position) of each distinct print."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    todo = list(prints)
    for k, a in enumerate(todo):
        for b in todo[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def check(docs):
    rows = simhash.simhash_components(docs).collect()
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    prints = {t: brute_fingerprint(t) for _, t in given}
    assert sorted(((r.doc_id, r.fingerprint) for r in rows), key=repr) == sorted(((i, f"{prints[t]:016x}") for i, t in given), key=repr)
    roots = brute_components(set(prints.values()))
    first = {}
    for i, t in given:
        if i is not None:
            root = roots[prints[t]]
            first[root] = min(first.get(root, i), i)
    for r in rows:
        assert r.component_id == first.get(roots[int(r.fingerprint, 16)])


def test_documents(documents):
    check(documents)


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert simhash.simhash_components(no_docs).count() == 0


def test_near_copies(make_docs):
    rnd = random.Random(1)
    base = [f"word{rnd.randint(0, 400)}" for _ in range(500)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(500)] = f"other{rnd.randint(0, 9)}"
        texts.append(" ".join(words))
    check(make_docs(texts))


def links_of(spark, prints):
    schema = T.StructType([T.StructField("fp", T.LongType())])
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    rows = simhash.components(simhash.links(spark.createDataFrame(signed, schema))).collect()
    return {int(np.int64(r.node).astype(np.uint64)): int(np.int64(r.root).astype(np.uint64)) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dense_and_chained_prints(spark, seed):
    """Crowded cells, long chains and prints two or three bits apart keep exactly their components."""
    rnd = random.Random(seed)
    prints = set()
    centre = rnd.getrandbits(64)
    for _ in range(250):
        prints.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
    chain = rnd.getrandbits(64)
    for step in range(40):
        prints.add(chain)
        chain ^= (1 << (step * 3 % 64)) | (1 << ((step * 3 + 1) % 64))
    for _ in range(60):
        p = rnd.getrandbits(64)
        prints |= {p, p ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3])))}
    want = brute_components(prints)
    members = {}
    for p, root in want.items():
        members.setdefault(root, set()).add(p)
    got = {}
    for p, root in links_of(spark, prints).items():
        got.setdefault(root, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(m) for m in members.values() if len(m) > 1)


@pytest.mark.parametrize("order", ["ascending", "random", "star"])
def test_long_chains_take_few_rounds(spark, monkeypatch, order):
    names = list(range(5000))
    if order == "random":
        random.Random(8).shuffle(names)
    edges = [(4999, i) for i in range(4999)] if order == "star" else list(zip(names, names[1:]))
    rounds, write = [], simhash.shared_table

    def counted(df, name):
        rounds.append(name)
        return write(df, name)

    monkeypatch.setattr(simhash, "shared_table", counted)
    got = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node for r in got} == set(names) and {r.root for r in got} == {0}
    assert rounds.count("simhash-hooks") <= 15 and rounds.count("simhash-jump") <= 60


def test_a_line_without_blanks_takes_no_time(make_docs):
    import time

    docs = make_docs(["x" * 3_000_000, "x" * 2_000_000 + " y" * 500_000, " \t".join("z" * 400_000)])
    start = time.time()
    assert line_dedup.line_dedup(docs).count() == 3
    assert time.time() - start < 60


def test_grid_distance_is_a_lower_bound():
    rnd = np.random.default_rng(0)
    a, b = (rnd.integers(-(2**63), 2**63 - 1, 500) for _ in range(2))
    grid = np.abs(simhash.segment_counts(a) - simhash.segment_counts(b)).sum(axis=1)
    assert (grid <= np.bitwise_count((a ^ b).view(np.uint64))).all()


def brute_lines(rows, min_sites):
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            line = line.strip(" ")
            if len(WORD.findall(line)) >= 4:
                sites.setdefault(line, set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    found = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        gone = sum(len(x.strip(" ")) for x in lines if x.strip(" ") in bad)
        total = sum(len(x.strip(" ")) for x in lines)
        if gone and gone <= 0.5 * total:
            rest = [x for x in lines if x.strip(" ") not in bad]
            found.append((i, "\n".join(rest), len(lines) - len(rest)))
        else:
            found.append((i, t, 0))
    return sorted(found, key=repr)


def lines_table(make_docs):
    rnd = random.Random(3)
    texts, sources = [], []
    for k in range(300):
        own = [f"own line number {k} part {j} with words" for j in range(rnd.randint(2, 6))]
        shared = [f"shared line of rank {r} here" for r in range(1, 25) if k % 25 < r]
        rnd.shuffle(shared)
        lines = own + shared[: rnd.randint(0, 5)] + ["", "short one"]
        rnd.shuffle(lines)
        texts.append("\n".join(lines))
        sources.append(f"site{k % 25}")
    return make_docs([*texts, None, ""], [*sources, None, "site1"])


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_lines(make_docs, broadcast):
    docs = lines_table(make_docs)
    rows = line_dedup.line_dedup(docs, broadcast_lines=broadcast).collect()
    want = brute_lines([(r.doc_id, r.text, r.source) for r in docs.collect()], line_dedup.MIN_SITES)
    assert sorted(((r.row.doc_id, r.text, r.n_removed) for r in rows), key=repr) == want
    assert any(n for _, _, n in want)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_line_edges(edge_docs, no_docs, broadcast):
    rows = line_dedup.line_dedup(edge_docs, broadcast_lines=broadcast).collect()
    assert sorted(((r.row.doc_id, r.text) for r in rows), key=repr) == sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=repr)
    assert rows[0].row.__fields__ == edge_docs.columns
    assert line_dedup.line_dedup(no_docs, broadcast_lines=broadcast).count() == 0


def test_copies_of_a_page_are_left_whole(make_docs):
    page = "\n".join(f"line {k} of a page that is copied" for k in range(8))
    docs = make_docs([page] * 30 + [f"a text of its own {k}\nand another line here {k}" for k in range(30)])
    assert all(r.n_removed == 0 for r in line_dedup.line_dedup(docs).collect())
