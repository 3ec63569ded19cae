from __future__ import annotations

import random
import re

from flowlens.llm import secret_scan


def _docs(seed: int, n: int):
    r = random.Random(seed)
    syllables = "the er on an re he in ed nd ha at en es of or".split()
    out = []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 12))) for _ in range(60)]
        kind = i % 4
        if kind == 0:
            words.insert(20, "password=" + "".join(r.choice("0123456789abcdef") for _ in range(20)))
        if kind == 1:
            words.insert(30, "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)))
        out.append((i, " ".join(words), f"src{i % 5}"))
    return out


def _table(spark, rows):
    return spark.createDataFrame(
        [(*r, 1.0, "x") for r in rows], "doc_id long, text string, source string, length double, value string"
    )


def test_candidates_are_where_a_scan_finds_them(spark):
    rows = _docs(1, 12) + [(50, None, None), (51, "", "a"), (52, "é" * 30 + "A1" * 8 + "==", "b"), (52, "x", "b")]
    rows += [(53, "Z9" * 20 + " " + "q" * 40_000, None)]
    found = secret_scan.candidates(_table(spark, rows)).collect()
    expected = [
        (d, m.start(), m[0]) for d, t, _ in rows for m in re.finditer(secret_scan.CANDIDATE, t or "")
    ]
    assert sorted((r["doc_id"], r["start"], r["value"]) for r in found) == sorted(expected)


def test_held_out_accuracy(spark):
    train, test = _table(spark, _docs(2, 160)), _table(spark, _docs(3, 80))
    words = secret_scan.dictionary(train)
    fitted = secret_scan.fit(
        secret_scan.weak_labels(secret_scan.features(secret_scan.candidates(train), words)), trees=12
    )
    held = secret_scan.features(secret_scan.candidates(test), words)
    truth = {
        (r["doc_id"], r["start"]): r["value"].startswith("AKIA") or "=" in r["before"][-1:]
        for r in held.collect()
    }
    scored = secret_scan.judge(held, fitted).collect()
    right = sum(r["secret"] == truth[r["doc_id"], r["start"]] for r in scored)
    assert len(scored) == len(truth) and right / len(scored) > 0.97


def test_without_labels(spark):
    out = secret_scan.scan(_table(spark, [(1, "thereoninedthehaenesof other", "a")])).collect()
    assert [(r["doc_id"], r["start"], r["score"], r["secret"]) for r in out] == [(1, 0, None, None)]
    assert secret_scan.scan(_table(spark, [])).collect() == []


def test_named_values_of_any_length_and_characters(spark):
    texts = {
        1: ('password = "Tr0ub4dor&3x"', ["Tr0ub4dor&3x"]),
        2: ("DB_PWD: p.w!8@$~ and more", ["p.w!8@$~"]),
        3: ("{'api_key2': 'a b:9'}, x = 'not one'", ["a b:9"]),
        4: ("a_rather_long_secret_name := s3cr3t.", ["a_rather_long_secret_name", "s3cr3t"]),
        5: ('é "auth"=>"ü7" the key is "here" 12:30', ["ü7"]),
        6: ("token=" + "x1" * 5_000, ["x1" * 5_000]),
    }
    rows = [(d, t, "a") for d, (t, _) in texts.items()]
    found = secret_scan.candidates(_table(spark, rows)).orderBy("doc_id", "start").collect()
    assert {d: [r["value"] for r in found if r["doc_id"] == d] for d in texts} == {d: v for d, (_, v) in texts.items()}
    assert all(texts[r["doc_id"]][0][r["start"] :].startswith(r["value"]) for r in found)


def test_look_alikes_with_digits_are_negatives(spark):
    uuid, digest = "0a1b2c3d-1111-2222-3333-0123456789ab", "0123456789abcdef" * 2
    text = f"card 4111111111111111 id {uuid} sum {digest} odd aB3dE6gH9kL2mN5pQ8 then token: {digest} pwd='x9!y'"
    rows = secret_scan.candidates(_table(spark, [(1, text, "a")]))
    labels = [(r["value"], r["label"]) for r in secret_scan.weak_labels(rows).orderBy("start").collect()]
    assert labels == [("4111111111111111", 0.0), (uuid, 0.0), (digest, 0.0), (digest, 1.0), ("x9!y", 1.0)]
