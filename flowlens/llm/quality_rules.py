"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials
over the buckets, one of trusted documents and one of the whole corpus, give every bucket a log
ratio; a document's score is the mean over its n-grams. The documents labelled good and bad set the
threshold once, and every document is then held against the same value.

The raw multinomial counts all documents. Trusted documents, and the labelled ones that set the
threshold, are a bounded sample (``SAMPLE`` of each label, by hash of the id). Defined results: a
null or empty text has no words and fails the base rules; repeated rows are judged alike and each;
a label that is null or whose document is missing is ignored, the lowest label counts where one id
has several; without trusted documents no score exists and the base rules decide; an empty table
gives an empty result. Columns of the input with any name pass through ``judge`` unchanged.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.columns import free
from flowlens.session import store

BUCKETS = 1 << 14
#: labelled documents of each kind at most
SAMPLE = 1 << 14
#: share of the sample's good (lowest) and bad (highest) scores that the threshold may ignore
TAIL = 0.005
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30

_SPACE = " \t\n\x0b\x0c\r"
_GAP = "[ \\t\\n\\x0B\\f\\r]+"
_SYMBOL = "[#*$%&|<>]"


class Fitted(NamedTuple):
    """Log ratio of every bucket, none where nothing is trusted, and the threshold."""

    weights: list[float] | None
    threshold: float


def _once(df: DataFrame, name: str, keep: list[str], **columns: Column) -> DataFrame:
    """Columns evaluated once a row, as fields of ``name``; a generator keeps them from being inlined."""
    fields = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array(fields)).alias(name))


def _words(text: Column) -> Column:
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, _GAP))


def _neighbours(values: Column, apart: int) -> Column:
    """Hashes of each value with the one ``apart`` places later."""
    n = F.greatest(F.size(values) - apart, F.lit(0))
    return F.zip_with(
        F.slice(values, F.lit(1), n),
        F.slice(values, F.lit(1 + apart), n),
        lambda a, b: F.xxhash64(a, b),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(pairs: Column) -> Column:
    """Words in windows of eight that occur twice or more, from the hashes of word pairs.

    Window hashes are sorted with their places; those with an equal neighbour are repeated, and
    each adds the words that the next repeated window does not cover.
    """

    def places(ordered: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            same = [
                F.coalesce(F.get(ordered, k + d)["hash"] == x["hash"], F.lit(False)) for d in (-1, 1)
            ]
            return F.when(same[0] | same[1], x["place"])

        return F.array_sort(F.array_compact(F.transform(ordered, repeated)))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(
            at,
            F.slice(at, F.lit(2), F.greatest(F.size(at), F.lit(1))),
            lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)),
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, x: n + x)

    def count(windows: Column) -> Column:
        ordered = F.sort_array(
            F.transform(windows, lambda x, k: F.struct(x.alias("hash"), k.alias("place")))
        )
        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            _let(_let(ordered, places), covered),
        ).otherwise(F.lit(0).cast("long"))

    return _let(_neighbours(_neighbours(pairs, 2), 4), count)


def _grams(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and a struct ``grams`` of word hashes ``one`` and word-pair hashes ``two``."""
    split = _once(docs, "split_", keep, words=_words(F.col(text)))
    hashed = _once(split, "grams_", keep, one=F.transform("split_.words", lambda w: F.xxhash64(w)))
    return _once(
        hashed,
        "grams",
        keep,
        one=F.col("grams_.one"),
        two=_neighbours(F.col("grams_.one"), 1),
    )


def _bucket(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def _counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every bucket in the documents."""
    grams = _grams(docs.select(F.col("text").alias("body")), "body", [])
    each = grams.select(F.explode(F.concat("grams.one", "grams.two")).alias("gram"))
    return each.groupBy(_bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("n"))


def _score(grams: Column, weights: list[float]) -> Column:
    """Mean log ratio of a document's n-grams; null without any."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.get(table, _bucket(x)))

    n = F.size(grams["one"]) + F.size(grams["two"])
    return (total(grams["one"]) + total(grams["two"])) / F.when(n > 0, n)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted:
    """Bucket weights and threshold from all documents and a sample of the labelled ones."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("quality = 1").orderBy(*order).limit(sample).unionByName(
        known.where("quality = 0").orderBy(*order).limit(sample)
    )
    # at most 2 * sample ids, so the documents stay where they are
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    labelled = store(labelled.select("text", "quality"), "labelled")
    raw = _counts(docs)
    trusted = _counts(labelled.where("quality = 1"))
    both = raw.select("bucket", "n", F.lit(0).cast("long").alias("t")).unionByName(
        trusted.select("bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("t"))
    )
    # one row a bucket, BUCKETS in all
    rows = both.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    counts = {r["bucket"]: (r["n"], r["t"]) for r in rows}
    n_raw, n_trusted = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not n_trusted:
        return Fitted(None, 0.0)
    weights = [_log_ratio(*counts.get(b, (0, 0)), n_raw, n_trusted) for b in range(BUCKETS)]
    grams = _grams(labelled, "text", ["quality"])
    scores = grams.select("quality", _score(F.col("grams"), weights).alias("score"))
    row = scores.agg(
        F.expr(f"percentile(case when quality = 1 then score end, {TAIL})").alias("good"),
        F.expr(f"percentile(case when quality = 0 then score end, {1 - TAIL})").alias("bad"),
    ).first()
    ends = [x for x in (row["good"], row["bad"]) if x is not None]
    return Fitted(weights, sum(ends) / len(ends) if ends else 0.0)


def _log_ratio(n: int, t: int, n_raw: int, n_trusted: int) -> float:
    return log((t + 1) / (n_trusted + BUCKETS)) - log((n + 1) / (n_raw + BUCKETS))


def judge(docs: DataFrame, fitted: Fitted, name: str = "verdict") -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` of counts, ``base_failed``, ``score``, ``kept``."""
    columns = docs.columns
    names = {k: free(docs, k) for k in ("split_", "counts_", "grams_", "found_")}
    text = F.coalesce(F.col("text"), F.lit(""))
    split = _once(docs, names["split_"], columns, words=_words(text))
    words = F.col(names["split_"])["words"]
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    counted = _once(
        split,
        names["counts_"],
        columns,
        n_words=F.size(words).cast("long"),
        word_chars=F.char_length(F.array_join(words, "")).cast("long"),
        n_symbols=F.regexp_count(text, F.lit(_SYMBOL)).cast("long"),
        n_dup_lines=_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        one=F.transform(words, lambda w: F.xxhash64(w)),
    )
    counts = F.col(names["counts_"])
    paired = counted.select(
        *[F.col(f"`{c}`") for c in columns],
        names["counts_"],
        F.explode(F.array(F.struct(_neighbours(counts["one"], 1).alias("two")))).alias(names["grams_"]),
    )
    two = F.col(names["grams_"])["two"]
    grams = {"one": counts["one"], "two": two}
    score = (
        F.lit(None).cast("double") if fitted.weights is None else _score(grams, fitted.weights)
    )
    kept = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    found = _once(
        paired,
        names["found_"],
        columns,
        **{k: counts[k] for k in kept},
        n_repeat_words=_repeated(two),
        score=score,
    )
    found_ = F.col(names["found_"])
    failed = (found_["n_words"] < MIN_WORDS) | (
        100 * found_["n_repeat_words"] > MAX_REPEAT_PERCENT * found_["n_words"]
    )
    fine = F.coalesce(found_["score"] >= F.lit(fitted.threshold), F.lit(True))
    verdict = F.struct(
        *[found_[k].alias(k) for k in (*kept, "n_repeat_words", "score")],
        failed.alias("base_failed"),
        (~failed & fine).alias("kept"),
    )
    return found.select(*[F.col(f"`{c}`") for c in columns], verdict.alias(name))
