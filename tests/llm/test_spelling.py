import random
import re
import zlib
from collections import Counter

from codecairn.llm import spelling

SF = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_words(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def holes(word):
    """Keys that words one edit apart, or equal, share."""
    return {(0, word)} | {(k, word[:i] + "\0" * k + word[i + 1 :]) for i in range(len(word)) for k in (0, 1)}


def brute_groups(words):
    meet = {}
    for w in words:
        for k in holes(w):
            meet.setdefault(k, []).append(w)
    near = {w: set() for w in words}
    for w in words:
        for k in holes(w):
            # a shared deletion alone may be two edits: both words must fit
            near[w] |= {v for v in meet[k] if v != w and one_edit(v, w)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_words_and_edges(spark, edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = {r.word: r.n for r in spelling.word_counts(edge_docs).collect()}
    assert got and got == brute_words(docs)
    assert rows(spelling.spelling_groups(spelling.word_counts(edge_docs))) == brute_groups(got)
    empty = spelling.spelling_groups(spelling.word_counts(no_docs))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and rows(empty) == set()


def test_any_two_words_one_edit_apart_share_a_signature():
    rng = random.Random(1)
    letters = "abcdeé"
    for _ in range(3000):
        w = "".join(rng.choices(letters, k=rng.randint(1, 14)))
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        v = w[:i] + ("" if kind == 0 else rng.choice(letters)) + w[i + (kind != 1) :]
        if not one_edit(v, w):
            continue
        a, b = sorted((v, w), key=len)
        low, high = (0, 0) if len(a) == len(b) else (1, 2)
        assert {k for s, k in spelling.signatures(a) if s == low} & {k for s, k in spelling.signatures(b) if s == high}


def test_groups_of_crowded_words(spark):
    """Few letters, so that nearly every word has many near words; chains of forms."""
    rng = random.Random(2)
    words = {"".join(rng.choices("abç", k=rng.randint(7, 9))): 10 ** rng.randint(0, 5) + rng.randint(1, 3) for _ in range(1500)}
    words |= {f"xxxxxxx{'y' * k}": 2 * 10**k for k in range(12)} | {"z" * 300: 5, "z" * 301: 50}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    got = rows(spelling.spelling_groups(df))
    assert got == brute_groups(words)
    assert ("xxxxxxx", "xxxxxxxy", "xxxxxxx" + "y" * 11, 2, 1, 20) in got


def test_query(spark, documents):
    words = brute_words([(r.doc_id, r.text) for r in documents.collect()])
    assert rows(spelling.op12_spelling_variants(spark, SF)) == brute_groups(words)
