"""Token files, word BPE, counts and packing against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from codecairn.llm import packing, token_counts, token_files, word_bpe
from codecairn.llm.bin_completion import best_fit, bin_completion, lower_bound
from codecairn.llm.common import WordEncoder, shared_path, space_led_words

ALPHABET = list("ab1  \n\t'.,<|>") + ["'s", "é", "ß", "ç", "́", " ", " ", "\x1c", "\x85", "\x00", "你", "😀", "Σ", "İ", " the", "<|endoftext|>"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 40))) for _ in range(n)]


def library(name):
    made = Tokenizer.from_file(P.path(name))
    made.encode_special_tokens = True
    return made


def ranks_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize(("name", "led"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_words_give_the_ids_of_whole_texts(name, led):
    texts = random_texts(4000, 1)
    want = [le(e.ids) for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert list(WordEncoder(P.path(name), led).ids(texts)) == want
    assert list(WordEncoder(P.path(name), led, limit=5).ids(texts)) == want


def test_cut_texts_join_and_encode_alike():
    encoding = ranks_encoding()
    for text in random_texts(4000, 2):
        words = space_led_words(text)
        assert "".join(words) == text
        assert [i for w in words for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(text)


def test_word_bpe_round_trip(edge_docs, make_docs, monkeypatch):
    encoding = ranks_encoding()
    for docs in (edge_docs, make_docs(random_texts(300, 3))):
        rows = word_bpe.decode(word_bpe.encode(docs)).collect()
        given = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
        assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in rows), key=repr) == given
        for r in rows:
            assert bytes(r.ids) == le(encoding.encode_ordinary(bytes(r.decoded).decode()))
            assert r.n_tokens == len(r.ids) // 4


def test_word_bpe_over_many_batches(make_docs, monkeypatch):
    texts = random_texts(60, 4)
    send, rows = word_bpe._send(3), []
    monkeypatch.setattr(word_bpe, "BATCH_DOCS", 7)
    import pyarrow as pa

    class Context:
        partitionId = staticmethod(lambda: 5)

    monkeypatch.setattr(word_bpe.TaskContext, "get", staticmethod(lambda: Context))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    sent = [r for b in send(iter([batch])) for r in b.to_pylist()]
    assert len(sent) == 9 and len({r["batch"] for r in sent}) == 9
    words = [w for r in sent for b in r["buckets"] for w in word_bpe._unpack_words(b["words"])]
    assert set(words) == {w for t in texts for w in space_led_words(t)}


def test_token_files(spark, edge_docs, no_docs):
    folder = shared_path(spark, "test-token-files")
    token_files.write_token_files(edge_docs, folder)
    rows = token_files.read_token_files(spark, folder).collect()
    given = sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    library_ids = {t: le([*e.ids, 2]) for t, e in zip((t for _, t in given), library("word_bpe_49k.json").encode_batch([t for _, t in given], add_special_tokens=False))}
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [i for i, _ in given]
    assert sorted(bytes(r.ids) for r in rows) == sorted(library_ids[t] for _, t in given)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    one = token_files.fetch_documents(spark, folder, [7, 14]).collect()
    texts = dict(given)
    assert {r.doc_id: bytes(r.ids) for r in one} == {i: library_ids[texts[i]] for i in (7, 14)}
    empty = shared_path(spark, "test-token-files")
    token_files.write_token_files(no_docs, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_wrong_dictionary_is_refused(spark, make_docs):
    folder = shared_path(spark, "test-token-files")
    token_files.write_token_files(make_docs(["some text", "another text"]), folder)
    spark.createDataFrame([("0" * 64, b"no", 2)], "sha256 string, bytes binary, id_bytes int").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        token_files.read_token_files(spark, folder)


def test_counts(edge_docs, no_docs, make_docs):
    docs = make_docs([*random_texts(400, 5), None, ""])
    lengths = np.array([len(e.ids) for e in library("byte_bpe_50k.json").encode_batch([r.text or "" for r in docs.collect()], add_special_tokens=False)])
    histogram = token_counts.length_histogram(token_counts.token_lengths(docs)).cache()
    for r in histogram.collect():
        assert r.n_docs == (lengths == r.length).sum() and r.docs_at_least == (lengths >= r.length).sum()
        assert r.tokens_at_least == lengths[lengths >= r.length].sum()
        assert r.truncated_total == np.minimum(lengths, r.length).sum()
        assert r["quantile"] == pytest.approx((lengths <= r.length).mean())
    limits = [0, 1, 7, 13, 10_000]
    assert list(token_counts.truncated_totals(histogram, limits).first()) == [int(np.minimum(lengths, x).sum()) for x in limits]
    assert list(token_counts.quantile_lengths(histogram, [0.5, 1.0]).first()) == [int(np.quantile(lengths, q, method="inverted_cdf")) for q in (0.5, 1.0)]
    assert token_counts.length_histogram(token_counts.token_lengths(edge_docs)).count() > 5
    assert token_counts.length_histogram(token_counts.token_lengths(no_docs)).count() == 0


def check_packing(rows, ids, capacity):
    from collections import defaultdict

    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == capacity for r in own[1:])
        assert len(own) == -(-len(ids[doc]) // capacity)
        for r in own:
            assert zlib.crc32(le(ids[doc][r.start : r.start + r.length])) == r.ids_crc32
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == list(np.cumsum([0, *(r.length for r in held)])[:-1])
        assert sum(r.length for r in held) <= capacity
    return len(bins)


def test_packing(documents, texts, no_docs, edge_docs):
    encoded = {i: [*e.ids, 2] for i, e in zip(texts, library("byte_bpe_50k.json").encode_batch(list(texts.values()), add_special_tokens=False))}
    rows = packing.best_fit_packing(documents).collect()
    bins = check_packing(rows, encoded, 1024)
    counts = {}
    for r in rows:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert lower_bound(counts, 1024) <= bins <= sum(t for _, t in best_fit(counts, 1024))
    assert packing.best_fit_packing(no_docs).count() == 0
    edge = packing.best_fit_packing(edge_docs).collect()
    assert sum(r.length for r in edge) == sum(len(e.ids) + 1 for e in library("byte_bpe_50k.json").encode_batch([r.text or "" for r in edge_docs.collect()], add_special_tokens=False))


def fewest_bins(items, capacity):
    """Exhaustive search for tiny cases."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= items[k]:
                rest = list(rooms)
                rest.remove(room)
                place(k + 1, [*rest, room - items[k]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rnd = random.Random(6)
    for _ in range(150):
        items = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 9))]
        counts = {n: items.count(n) for n in items}
        patterns = bin_completion(counts, 20)
        used = {}
        for pattern, times in patterns:
            assert sum(n * c for n, c in pattern) <= 20
            for n, c in pattern:
                used[n] = used.get(n, 0) + c * times
        assert used == counts
        assert sum(t for _, t in patterns) == fewest_bins(items, 20)


def test_bin_completion_beats_best_fit():
    counts = {6: 10, 5: 10, 4: 10, 3: 20, 7: 10, 2: 5}  # 18 a bin
    assert sum(t for _, t in bin_completion(counts, 18)) == lower_bound(counts, 18)


def test_words_with_a_space_in_front_are_encoded_together():
    from codecairn.llm.common import WordEncoder, tokenizer, vocabulary

    words = WordEncoder(vocabulary("byte_bpe_50k.json"), space_led=True)
    new = [" the", " Zürich", " it%%%", " als.\nEnt", " 中文", ".", "first", " a\u00a0b"]
    assert words._learn_together(new) == [".", "first"]
    for w in new[:5] + new[7:]:
        ids = tokenizer(words.path).encode(w, add_special_tokens=False).ids
        assert words.cache[w] == b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize(("name", "led"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_stems_marks_and_lines_are_kept_apart(name, led, monkeypatch):
    """No new word is encoded for each stem with marks and, in byte-level vocabularies, for each pair at a line's end."""
    from codecairn.llm import common

    texts = [" the stem### Stem.\nEnt Ent%%% a\nb", "x$$$\n\ny the*** a\tz ", "", "\x00 a###\nB", "don't İ## ǰ## J̌## é!!  a## 5## a_b## <|endoftext|>##", " the\n"]
    want = [le(e.ids) for e in library(name).encode_batch(texts, add_special_tokens=False)]
    words = WordEncoder(P.path(name), led)
    monkeypatch.setattr(common, "SLICE", 40, raising=False)
    assert list(words.ids(texts)) == want
    front = " " if led else ""
    assert {front + "stem", "###", front + "the", "***"} <= set(words.cache)
    assert not any("\nEnt" in w for w in words.cache)


def test_checksums_are_computed_where_ids_are_unpacked(spark, edge_docs):
    folder = shared_path(spark, "test-token-files")
    token_files.write_token_files(edge_docs, folder)
    sums = token_files.read_token_files(spark, folder, checksums=True)
    want = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read_token_files(spark, folder).orderBy("start").collect()]
    assert [tuple(r) for r in sums.orderBy("start").collect()] == want
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
