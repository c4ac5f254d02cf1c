"""op11 against a plain alignment by both libraries, text by text."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import alignment as al

SHAPE = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def both():
    with open(al.BYTE_BPE, encoding="utf-8") as f, open(al.PIECE_BPE, "rb") as g:
        return al.ByteTokenizer(f.read()), al.PieceTokenizer(g.read())


@pytest.fixture(scope="module")
def aligner():
    with open(al.BYTE_BPE, encoding="utf-8") as f, open(al.PIECE_BPE, "rb") as g:
        return al.Aligner(f.read(), g.read())


def plain(both, text):
    """(A ids, B ids, groups as text, links) of one text by the contract's words, with the slow library alone."""
    a_side, b_side = both
    a, b = (a_side.slow.encode(" " + text, add_special_tokens=False).ids, b_side.own.encode(text)) if text else ([], [])
    if any(b"".join(side.octets[x] for x in ids) != (" " + text).encode() for side, ids in ((a_side, a), (b_side, b))):
        a, b = [], []
    ends_a, ends_b = (np.cumsum([len(side.octets[x]) for x in ids]).tolist() for side, ids in ((a_side, a), (b_side, b)))
    place_a, place_b = ({end: k for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
    links = [(x, b[place_b[end]]) for x, end in zip(a, ends_a) if end in place_b]
    groups, at_a, at_b = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = place_a[end] + 1, place_b[end] + 1
        groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
        at_a, at_b = to_a, to_b
    return a, b, ";".join(groups), links


def expected(both, rows):
    found = [(i, *plain(both, t or "")) for i, t in rows]
    counts = Counter(p for *_, links in found for p in links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        ((i, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, g, links in found),
        key=repr,
    )


ODD = [
    (1, None), (2, ""), (3, " "), (4, "plain words, plainly"), (4, "plain words, plainly"), (None, "no id"), (5, "a▁b"), (6, "<|endoftext|> <s></s><unk><0x41>"), (7, "  two  spaces \n \n and lines\n\n\tend  "),
    (8, "👩‍👩‍👧 é é 한국어 조각 ابت 　 x"), (9, "tab\t\tb \r\n c\x1c \x1d d\x85 e"), (10, "x" * 3000), (11, "한국어" * 500), (12, "it's we'll 12 345"), (13, "\0"), (14, "a " * 400), (15, "a\n \nb \n"),
]


def test_odd_texts_equal_the_plain_way(spark, both):
    got = sorted((tuple(r) for r in al.aligned_counts(spark.createDataFrame(ODD, SHAPE)).collect()), key=repr)
    assert got == expected(both, ODD)


@pytest.mark.parametrize("sent", [al.SENT, 200, 0])
def test_documents_equal_the_plain_way_whatever_is_sent(spark, both, sent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in al.aligned_counts(docs, sent=sent).collect()), key=repr)
    assert got == expected(both, rows)


def test_columns_of_any_name_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two", 1, "x")], "doc_id int, text string, row int, links string")
    assert [tuple(r)[:5] for r in al.aligned_counts(docs).collect()] == [(1, 2, 2, 2, 2)]
    assert al.aligned_counts(spark.createDataFrame([], SHAPE)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sé한 \n\t\x1c 1.▁"), max_size=30), max_size=4))
def test_units_give_what_whole_texts_give(aligner, both, texts):
    for got, text in zip(al.aligned_batch(aligner, texts), texts):
        a, b, groups, links = plain(both, text)
        pairs, times = al.unpacked(got[5])
        assert got[:2] == (len(a), len(b))
        assert got[4] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, times)} == Counter(links)


def test_a_store_that_is_full_begins_anew(both, monkeypatch):
    with open(al.BYTE_BPE, encoding="utf-8") as f, open(al.PIECE_BPE, "rb") as g:
        small = al.Aligner(f.read(), g.read())
    monkeypatch.setattr(al, "KEPT_UNITS", 3)
    for text in ("one two three", "four five", "one two six", "seven eight nine ten"):
        (got,) = al.aligned_batch(small, [text])
        assert got[0] == len(plain(both, text)[0])


def test_a_very_long_run_of_white_space(aligner, both):
    text = " " * 1_200_000 + "end"
    (got,) = al.aligned_batch(aligner, [text])
    assert got[0] == len(both[0].slow.encode(" " + text, add_special_tokens=False).ids) and got[1] == len(both[1].own.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(1, n - 1) if n > 1 else st.nothing()), st.sets(st.integers(1, n - 1) if n > 1 else st.nothing()))))
def test_components_are_the_minimal_groups(case):
    n, a, b = case
    ends_a, ends_b = (np.array(sorted({*x, n})) for x in (a, b))
    group_a, group_b, count = al.groups_of(ends_a, ends_b)
    common = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
    assert count == len(common)
    assert group_a.tolist() == [int(np.searchsorted(common, e)) for e in ends_a] and group_b.tolist() == [int(np.searchsorted(common, e)) for e in ends_b]


def test_overlaps_are_all_pairs_that_share_a_byte():
    rng = np.random.default_rng(5)
    for _ in range(50):
        ends = [np.array(sorted({*rng.integers(1, 40, 12).tolist(), 40})) for _ in range(2)]
        spans = [list(zip([0, *e[:-1].tolist()], e.tolist())) for e in ends]
        want = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if s < q and p < e}
        i, j = al.overlaps(*ends)
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
