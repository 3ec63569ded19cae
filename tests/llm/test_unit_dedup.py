from __future__ import annotations

import random

import pytest

from flowlens.llm import unit_dedup

LAST = 2**63 - 1


def plain(rows, unit, min_chars, min_run):
    """Text, units and removed units of every row, comparing all units with all."""
    first = {}
    listed = [(LAST if d is None else d, [u for u in unit_dedup.units((t or "").encode(), unit)]) for d, t in rows]
    for doc, own in listed:
        for k, (_, _, words) in enumerate(own):
            key = tuple(words)
            first[key] = min(first.get(key, (doc, k)), (doc, k))
    out = []
    for (doc, text), (rank, own) in zip(rows, listed, strict=True):
        again = {
            k
            for k, (_, _, w) in enumerate(own)
            if first[tuple(w)][0] != rank or any(tuple(w) == tuple(x[2]) for x in own[:k])
        }
        raw, kept, at, gone, k = (text or "").encode(), b"", 0, 0, 0
        while k < len(own):
            stop = k
            while stop in again:
                stop += 1
            sizes = [len(b" ".join(own[i][2]).decode()) for i in range(k, stop)]
            if stop > k and sum(s for s in sizes if s >= min_chars) >= max(1, min_run):
                kept += raw[at : own[k][0]]
                at, gone = own[stop - 1][1], gone + stop - k
            k = max(stop, k + 1)
        out.append((doc, (kept + raw[at:]).decode(), len(own), gone))
    return out


def _rows():
    r = random.Random(8)
    sentences = [" ".join(f"wörd{r.randrange(500)}" for _ in range(r.randrange(1, 15))) + "." for _ in range(60)]
    rows = []
    for i in range(50):
        picked = [r.choice(sentences) for _ in range(r.randrange(12))]
        rows.append((i * 7 % 50, "".join(s + r.choice(" \n") for s in picked)))
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    rows += [(200, "A start.\n" + passage), (100, passage.upper() + " And more! Is it? yes"), (None, passage)]
    rows += [(None, passage), (300, None), (301, ""), (302, " \n\n"), (303, "y " * 50_000), (303, passage)]
    return rows


@pytest.mark.parametrize(
    ("unit", "min_chars", "min_run"),
    [("sentence", 30, 100), ("sentence", 1, 1), ("line", 0, 0), ("paragraph", 50, 120)],
)
def test_equals_plain_version(spark, unit, min_chars, min_run):
    rows = _rows()
    table = spark.createDataFrame(
        [(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_units int, unit string"
    )
    out = unit_dedup.dedup_units(table, unit, min_chars, min_run)
    assert out.columns == ["doc_id", "text", "unit", "n_units", "n_removed", "spans"]
    got = [(r["doc_id"], r["text"], r["n_units"], r["n_removed"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, unit, min_chars, min_run), key=repr)


def test_spans_point_into_the_original(spark):
    rows = [(d, t) for d, t in _rows() if d is not None and d < 300]
    out = unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), "sentence", 20, 40)
    texts = dict(rows)
    for r in out.collect():
        kept, at = "", 0
        for s in r["spans"]:
            kept += texts[r["doc_id"]][at : s["start"]]
            at = s["end"]
        assert kept + texts[r["doc_id"]][at:] == r["text"]


def test_empty_table(spark):
    assert unit_dedup.dedup_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passages_go_and_short_repeats_stay(spark):
    line = "this work is licensed under the gnu general public license, version 3."
    r = random.Random(5)

    def some(n):
        return [f"w{r.randrange(10**6)}" for _ in range(n)]

    sentences = ". ".join(" ".join(some(9)) for _ in range(6)) + "."
    inside = " ".join(some(70))  # repeated in the middle of different sentences
    rows = [
        (1, f"{line} The. the. {sentences}"), (2, f"The. {line} the. And more here. {sentences} Yes."),
        (3, " ".join([*some(30), inside, *some(30)])), (4, " ".join([*some(9), inside, *some(9)])),
    ]
    out = unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r["doc_id"]: r["text"] for r in out}
    assert kept[1] == rows[0][1] and kept[3] == rows[2][1]
    assert kept[2] == f"The. {line} the. And more here. Yes."
    left = set(kept[4].split()) & set(inside.split())
    assert len(left) < 25 and len(kept[4].split()) >= 18


def test_parts_of_long_sentences_do_not_depend_on_what_stands_around(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}".encode() for _ in range(200)]
    alone = [tuple(w) for _, _, w in unit_dedup.units(b" ".join(words), "sentence")]
    longer = [tuple(w) for _, _, w in unit_dedup.units(b"some  other\twords " + b" ".join(words) + b" end.", "sentence")]
    assert len(alone) > 15 and set(alone[1:-1]) <= set(longer)
    text = b"Some  other\twords " + b" ".join(words) + b" end."
    parts = list(unit_dedup.units(text, "sentence"))
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert [w for _, _, own in parts for w in own] == text.lower().split()
