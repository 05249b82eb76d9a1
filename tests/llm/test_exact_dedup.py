import hashlib
from collections import defaultdict

from codecairn.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    found = []
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        for i in ids:
            found.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(found, key=repr)


def test_edges(edge_docs):
    rows = exact_dedup.exact_dedup(edge_docs).collect()
    given = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == brute(given)
    kept = defaultdict(list)
    for r in rows:
        kept[r.text_sha256].append(r.kept)
    assert all(sum(k) == 1 for k in kept.values())


def test_empty(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.drop_repeats(no_docs).count() == 0


def test_whole_rows(edge_docs):
    rows = exact_dedup.drop_repeats(edge_docs).collect()
    assert sorted((r.text or "") for r in rows) == sorted({r.text or "" for r in edge_docs.collect()})
    assert rows[0].__fields__ == edge_docs.columns


def test_crowded_filter_and_join_without_broadcast(documents, monkeypatch):
    want = sorted(map(tuple, exact_dedup.exact_dedup(documents).collect()))
    monkeypatch.setattr(exact_dedup, "ROWS_PER_BLOCK", 10_000)  # one block: nearly every row is a candidate
    monkeypatch.setattr(exact_dedup, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, exact_dedup.exact_dedup(documents).collect())) == want


def test_unique_rows_pass_unshuffled(documents):
    marked = exact_dedup._with_flag(documents.select("doc_id", exact_dedup.whole_text("text").alias("text")), documents.count())
    n = documents.select("text").distinct().count()
    singles = documents.count() - sum(r["count"] for r in documents.groupBy("text").count().where("count > 1").collect())
    passed = marked.where("not candidate").count()
    assert n and passed > 0.9 * singles
