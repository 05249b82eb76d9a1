import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codecairn.llm import context_mixing as cm
from codecairn.llm import lm_scoring

SF = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def brute_base(docs):
    """Per row: id, held out, tokens, known, N, base score."""
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + ["\n"]) for i, t in docs]
    count = Counter(w for i, ws in tokens for w in ws if not held(i))
    total, distinct = sum(count.values()), len(count)
    for i, ws in tokens:
        score = sum(math.log10((count[w] + 1) / (total + 1 * (distinct + 1))) for w in ws)
        yield i, held(i), len(ws), sum(count[w] > 0 for w in ws), total, round(score, 6)


def rows(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def brute_bits(docs):
    """The model by plain dictionaries, decision after decision."""
    texts = [(t or "").encode().lower() for _, t in docs]
    units = [cm.units_of(t, True) for t in texts]
    pairs = np.zeros(65536, np.int64)
    for (i, _), us in zip(docs, units):
        for u in us if not held(i) else []:
            for before, byte in zip(b"\xff" + u, u):
                pairs[256 * before + byte] += 1
    code = cm.Code(pairs)

    def path(unit, j):
        pair = 256 * (unit[j - 1] if j else 255) + unit[j]
        places = range(code.start[pair], code.start[pair] + code.length[pair])
        return [(int(code.node[a]), int(code.bit[a]), float(cm.OWN[code.own[a]])) for a in places]

    def contexts(unit, j):
        return [(o, unit[j - o : j]) if o and j > o else (None, unit[:j]) for o in cm.ORDERS]

    n = defaultdict(lambda: [0, 0])
    for (i, _), us in zip(docs, units):
        if not held(i):
            for u in us:
                for j in range(len(u)):
                    for c in set(contexts(u, j)):
                        for node, bit, _ in path(u, j):
                            n[c, node][bit] += 1

    def floor(x):
        return max(v for v in cm.LEVELS.tolist() if v <= x)

    out = []
    for us in units:
        mix = np.tile(cm.FIRST.astype(float), (cm.GATES, 1))
        curve = np.full((cm.GATES, 1), cm.DAMPING)
        centre = 1 / (1 + np.exp(-np.linspace(-8, 8, cm.CELLS)))
        cells = np.tile(centre * cm.CELL_PRIOR, (cm.GATES, 1))
        seen, bits = np.full(cells.shape, cm.CELL_PRIOR), 0.0
        at, block = 0, cm.BLOCK
        while at < len(us):
            done = []
            for u in us[at : at + block]:
                for j in range(len(u)):
                    for depth, (node, bit, own) in enumerate(path(u, j)):
                        pairs = [[floor(x) for x in n[c, node]] for c in contexts(u, j)]
                        x = np.array([math.log((b + cm.PRIOR) / (a + cm.PRIOR)) for a, b in pairs] + [own])
                        word, tail = sum(pairs[-1]), sum(pairs[-2])
                        known = 5 if word > 500 else 4 if word > 31 else 3 if word > 3 else 2 if word else int(tail > 0)
                        g = known * 3 + (0 if depth == 0 else 1 if depth < 3 else 2)
                        z = float(x @ mix[g])
                        p = 1 / (1 + math.exp(-z))
                        cell = int((min(max(z, -8), 8) + 8) * (cm.CELLS - 1) / 16 + 0.5)
                        final = (p + cells[g, cell] / seen[g, cell]) / 2
                        bits += math.log2(final if bit else 1 - final)
                        done.append((g, x, p, bit, cell))
            pull, bend = np.zeros(mix.shape), np.zeros(curve.shape)
            for g, x, p, bit, cell in done:
                pull[g] += (bit - p) * x
                bend[g] += p * (1 - p) * cm.CURVE
                cells[g, cell] += bit
                seen[g, cell] += 1
            curve += bend
            mix = mix + cm.RATE * pull / curve
            at, block = at + block, min(2 * block, cm.LAST_BLOCK)
        out.append(bits)
    return out


def test_edge_cases(spark, edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = lm_scoring.lm_scores(edge_docs)
    assert rows(got) == sorted(brute_base(docs), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.collect())
    empty = lm_scoring.lm_scores(no_docs)
    assert empty.columns == got.columns and empty.count() == 0


def test_scores_are_those_of_plain_dictionaries(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.where("length(text) < 3000").limit(60).collect()]
    docs += [(1001, None), (1002, "The" * 40), (1003, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.score / math.log10(2) for r in lm_scoring.lm_scores(df).collect()}
    want = brute_bits(docs)
    for (i, _), bits in zip(docs, want):
        assert got[i] == pytest.approx(bits, rel=2e-3, abs=0.05)
    # the same scores however the rows are dealt
    again = {r.doc_id: r.score / math.log10(2) for r in lm_scoring.lm_scores(df.coalesce(1)).collect()}
    assert all(again[i] == pytest.approx(got[i], rel=1e-6) for i in got)


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    text = " ".join(f"word{k % 50} other{k % 7}" for k in range(3000))
    docs = [(i, text[i:]) for i in range(3)] + [(9, "x" * 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(lm_scoring, "SEGMENT", 1000)
    monkeypatch.setattr(lm_scoring, "BATCH", 3000)
    got = lm_scoring.lm_scores(df)
    assert rows(got) == sorted(brute_base(docs), key=str)
    assert [r.n_bytes for r in got.orderBy("doc_id").collect()] == [len(t) for _, t in docs]


def test_more_corpus_predicts_held_out_texts_better(spark, documents):
    """Held-out texts cost fewer bits than under the bytes' own frequencies, and fewer still with more to learn from."""

    def bits(df):
        r = [r for r in lm_scoring.lm_scores(df).collect() if r.held_out]
        return sum(-x.score / math.log10(2) for x in r) / sum(x.n_bytes + 1 for x in r)

    out = documents.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 7) = 2")
    few = bits(documents.where("doc_id < 30").unionAll(out.where("doc_id >= 30")))
    many = bits(documents)
    text = b"".join((r.text or "").encode().lower() for r in out.collect())
    n = Counter(text)
    entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in n.values())
    assert many < few < entropy and many < 0.65 * entropy


def test_code_and_cuts():
    code = cm.Code(np.arange(65536) ** 2 % 1009 * (np.arange(65536) < 5000))
    assert np.allclose((2.0 ** -code.length.reshape(256, 256)).sum(axis=1), 1)
    text = b"one two\n\nthree  four"
    assert b"".join(cm.units_of(text, True)) == text + b"\xff"
    assert cm.units_of(b"", True) == [b"\xff"] and cm.units_of(b"a ", True) == [b"a ", b"\xff"]
    parts = cm.segments_of(b"aaa bbb ccc" * 50, 40)
    assert b"".join(parts) == b"aaa bbb ccc" * 50 and all(p[-1:] == b" " for p in parts[:-1])
    values = np.array([5, 1 << 40, 0], np.uint64)
    assert (cm.unpack(cm.pack(values), np.uint64) == values).all()


def test_query_base(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows(lm_scoring.op11_lm_scores(spark, SF)) == sorted(brute_base(docs), key=str)
