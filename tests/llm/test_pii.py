import hashlib
import random
import re

import pytest

from codecairn.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def brute_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return found


def test_base_spans_equal_the_patterns():
    rnd = random.Random(0)
    for _ in range(20_000):
        text = "".join(rnd.choices(list("a1.@-+ ()") + ["0255", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (200) 555-0100"], k=rnd.randint(0, 14)))
        assert pii.plain_spans(text) == brute_base(text), text


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to john.doe [at] mail.example.com today", "email", "john.doe [at] mail.example.com"),
        ("write to john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("john at example dot com", "email", "john at example dot com"),
        ("JOHN AT EXAMPLE DOT CO DOT UK!", "email", "JOHN AT EXAMPLE DOT CO DOT UK"),
        ("mail bob{at}host{dot}net.", "email", "bob{at}host{dot}net"),
        ("bob@host dot net", "email", "bob@host dot net"),
        ("see jоhn@exаmple.com here", "email", "jоhn@exаmple.com"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("joe​@exam​ple.org", "email", "joe​@exam​ple.org"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus one two zero two five five five zero one four three now", "phone", "plus one two zero two five five five zero one four three"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 192 dot 168 dot 0 dot 1.", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 192[.]168[.]0[.]7", "ip", "192[.]168[.]0[.]7"),
        ("٤١١١١١١١١١١١١١١١", "card", "٤١١١١١١١١١١١١١١١"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    start = text.index(part)
    assert (kind, start, start + len(part)) in pii.disguised_spans(text)


@pytest.mark.parametrize(
    "text",
    [
        "They met at noon. Then they left at once.", "One two three four.", "un deux trois quatre cinq six",
        "Look at it. Dot com was a time.", "привет как дела", "am Punkt der Linie", "at dot at dot",
        "He was at home (at last) and then. (dot)", "seven eight nine ten",
    ],
)
def test_clean_texts_have_none(text):
    assert pii.disguised_spans(text) == []


def test_base_spans_stay_and_masks_cover():
    text = "a@b.co and joe [at] b.co and 10.0.0.1"
    base, every = pii.all_spans(text)
    assert set(base) <= set(every) and len(every) == 3
    assert pii.mask(text, every) == "[EMAIL] and [EMAIL] and [IP]"


def test_linear_on_long_runs():
    for text in ("a" * 400_000, "1" * 400_000, "@" * 200_000, "a@" * 200_000, "+1 " * 200_000, "one " * 100_000, "a at " * 100_000, "1." * 200_000, " dot " * 80_000, "[at]" * 100_000):
        pii.all_spans(text)


def test_operator(edge_docs, no_docs, make_docs):
    texts = ["joe [at] example [dot] com", "plain a@b.cd", None, "nothing here"]
    rows = {r.row.doc_id: r for r in pii.find_pii(make_docs(texts)).collect()}
    assert [rows[k].n_email for k in range(4)] == [0, 1, 0, 0]
    assert [rows[k].n_added for k in range(4)] == [1, 0, 0, 0]
    assert [rows[k].masked for k in range(4)] == ["[EMAIL]", "plain [EMAIL]", None, "nothing here"]
    edge = pii.find_pii(edge_docs).collect()
    assert len(edge) == edge_docs.count() and edge[0].row.__fields__ == edge_docs.columns
    assert pii.find_pii(no_docs).count() == 0


def test_query(spark):
    rows = pii.op10_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
