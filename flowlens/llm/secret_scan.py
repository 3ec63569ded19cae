"""Secret scan with a random forest that removes false positives; DataFrame functions only.

Every run of 16 key characters or more in a text is a candidate, and every quoted or assigned value
after a name like ``password`` or ``api_key``, whatever its length and characters. A forest over its length, character
transitions, coverage by frequent words, the document's path and the neighbouring words tells
secrets from look-alikes. It is fitted on labelled findings, at most ``SAMPLE`` of each label by hash;
the frequent words are counted over all documents.

Defined results: null and empty texts have no candidates; a null path counts as empty; repeated rows
are scanned each; ``score`` and ``secret`` are null where the labelled findings have one label or
none; an empty table gives an empty result. Columns other than those named in ``candidates`` are not
read. Secrets themselves are not part of the result, only their digests.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.session import store

#: labelled findings of each label at most
SAMPLE = 1 << 13
#: words of the dictionary at most, and slots of its table
WORDS, SLOTS = 1 << 12, 1 << 13
TREES, DEPTH, SEED = 24, 8, 17
LEAST_SCORE = 0.5

CANDIDATE = "[A-Za-z0-9_+/-]{16,}={0,2}"
#: characters of the neighbouring text that are looked at, on either side
NEAR = 40
_NAMES = "pass|pwd|secret|token|key|auth|cred"
_ASSIGNED = f"(?i:{_NAMES})[A-Za-z0-9_]{{0,24}}[\"']?[ \\t]{{0,4}}(?::=|=>|[=:])[ \\t]{{0,4}}"
#: values after a name; the first two conditions are cheap and fail nearly everywhere
NAMED = (
    "(?<=[=:> \\t\"'])(?<=[=:>][ \\t]{0,4}[\"']?)(?:"
    f"(?<={_ASSIGNED}\")[^\"\\n]+(?=\")|(?<={_ASSIGNED}')[^'\\n]+(?=')"
    f"|(?<={_ASSIGNED})[^\\s\"'=:>][^\\s\"']*(?<![,;.)}}\\]]))"
)
FOUND = f"{NAMED}|{CANDIDATE}"
#: MD5 and SHA digests, UUIDs
LOOK_ALIKE = "(?i)^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$"
#: transitions between two characters, counted and divided by the candidate's length
TRANSITIONS = {
    "lower_lower": "[a-z](?=[a-z])",
    "upper_upper": "[A-Z](?=[A-Z])",
    "lower_upper": "[a-z](?=[A-Z])",
    "upper_lower": "[A-Z](?=[a-z])",
    "letter_digit": "[A-Za-z](?=[0-9])",
    "digit_letter": "[0-9](?=[A-Za-z])",
    "digit_digit": "[0-9](?=[0-9])",
    "same_same": "(.)(?=\\1)",
    "vowel_consonant": "[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])",
    "consonants": "[b-df-hj-np-tv-z](?=[b-df-hj-np-tv-z])",
    "hexadecimal": "[0-9a-f](?=[0-9a-f])",
    "punctuation": "[^A-Za-z0-9]",
}
FEATURES = [
    "length", "kinds", *TRANSITIONS, "coverage",
    "path_length", "path_test", "path_hash",
    "named", "assigned", "quoted", "before_known", "after_known", "before_length", "after_length",
]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """Candidates of all texts: ``doc_id``, ``start``, ``value``, ``path``, ``before``, ``after``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)).alias("values"),
        F.split(text, FOUND, -1).alias("parts"),
    ).where("size(values) > 0")
    near = F.transform(
        F.col("values"),
        lambda v, k: F.struct(
            v.alias("value"),
            F.char_length(F.get(F.col("parts"), k)).cast("long").alias("gap"),
            F.substring(F.get(F.col("parts"), k), -NEAR, NEAR).alias("before"),
            F.substring(F.get(F.col("parts"), k + 1), 1, NEAR).alias("after"),
        ),
    )
    each = rows.select("doc_id", "path", "row", F.posexplode(near).alias("place", "near"))
    each = each.select("doc_id", "path", "row", "place", "near.*")
    # a window per document row over its candidates' lengths only
    upto = W.partitionBy("row").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(upto)
    return each.withColumn("start", end - F.char_length("value")).select(
        "doc_id", "start", "value", "path", "before", "after"
    )


def frequent_words(docs: DataFrame, most: int = WORDS) -> DataFrame:
    """The most frequent words of three to eight letters of all documents, ``most`` at most."""
    words = docs.select(F.explode(F.split("text", "[ \t\n\r]+")).alias("word"))
    words = words.where(F.col("word").rlike("^[a-z]{3,8}$"))
    counted = words.groupBy("word").count().where("count > 1")
    return counted.orderBy(F.desc("count"), "word").limit(most).select("word")


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def dictionary(docs: DataFrame, most: int = WORDS) -> list[str]:
    """Hash table of frequent words: ``SLOTS`` texts, each of some words between commas."""
    words = frequent_words(docs, most)
    slots = words.groupBy(_slot(F.col("word")).alias("slot"))
    slots = slots.agg(F.array_sort(F.collect_list("word")).alias("words"))
    table = [""] * SLOTS
    for row in slots.collect():  # WORDS words in all
        table[row["slot"]] = f",{','.join(row['words'])},"
    return table


def _known(word: Column, table: Column) -> Column:
    """Whether a word is in the dictionary; one list of it is looked at."""
    return F.contains(F.get(table, _slot(word)), F.concat(F.lit(","), word, F.lit(",")))


def _coverage(value: Column, table: Column) -> Column:
    """Share of a candidate's characters inside frequent words of three letters or more."""

    def step(state: Column, at: Column) -> Column:
        longest = F.greatest(
            *[
                F.when(_known(F.substr(value, at, F.lit(n)), table), at + n).otherwise(0)
                for n in (3, 4, 5, 6)
            ]
        )
        reach = F.greatest(state["reach"], longest)
        return F.struct(
            reach.alias("reach"), (state["inside"] + F.when(at < reach, 1).otherwise(0)).alias("inside")
        )

    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("inside"))
    places = F.sequence(F.lit(1), F.char_length(value))
    return F.aggregate(places, start, step, lambda s: s["inside"] / F.char_length(value))


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` and the columns named in ``FEATURES``."""
    table = F.split(F.lit(";".join(words)), ";")
    value, size = F.col("value"), F.char_length("value")
    before, after = F.lower("before"), F.lower("after")
    word_before = F.regexp_extract(before, "([a-z]+)[^a-z]*$", 1)
    word_after = F.regexp_extract(after, "^[^a-z]*([a-z]+)", 1)
    kinds = [value.rlike(x).cast("int") for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
    columns = {
        "length": size,
        "kinds": kinds[0] + kinds[1] + kinds[2] + kinds[3],
        **{k: F.regexp_count(value, F.lit(v)) / size for k, v in TRANSITIONS.items()},
        "coverage": _coverage(F.lower("value"), table),
        "path_length": F.char_length("path"),
        "path_test": F.lower("path").rlike("test|example|sample|mock|fixture"),
        "path_hash": F.pmod(F.xxhash64("path"), F.lit(8)),
        "named": before.rlike(_NAMES),
        "assigned": before.rlike("[=:]>?[ \\t]*[\"']?$"),
        "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "before_known": _known(word_before, table),
        "after_known": _known(word_after, table),
        "before_length": F.char_length(word_before),
        "after_length": F.char_length(word_after),
    }
    return found.select(
        *found.columns, *[columns[k].cast("double").alias(k) for k in FEATURES]
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings by rules: known key forms and named assignments 1; 0, with no name before,
    mere letters, mere digits (cards, numbers), hex digests and UUIDs.

    Candidates that no rule decides are not labelled.
    """
    value, before = F.col("value"), F.lower("before")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("\\s")
    secret = value.rlike("^AKIA[0-9A-Z]{16}$") | (
        mixed & before.rlike(f"{_ASSIGNED}[\"']?$")
    )
    plain = ~value.rlike("[0-9]") | ~value.rlike("[A-Za-z]") | value.rlike(LOOK_ALIKE)
    harmless = plain & ~before.rlike(_NAMES)
    label = F.when(secret, 1.0).when(harmless, 0.0)
    return found.withColumn("label", label).where("label is not null")


def fit(
    labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES
) -> RandomForestClassificationModel | None:
    """Forest over ``FEATURES`` and ``label``; None unless both labels occur."""
    order = [F.xxhash64("value", "before", "after"), F.col("value"), F.col("before"), F.col("after")]
    parts = [
        labelled.where(f"label = {k}").orderBy(*order).limit(sample).select("label", *FEATURES)
        for k in (0, 1)
    ]
    rows = store(parts[0].unionByName(parts[1]).coalesce(1), "labelled-findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=DEPTH, seed=SEED
    )
    return forest.fit(_vectors(rows))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``digest``, ``score`` and ``secret`` of every candidate."""
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(_vectors(found))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id",
        "start",
        F.char_length("value").alias("length"),
        F.sha2("value", 256).alias("digest"),
        F.round("score", 6).alias("score"),
        (F.col("score") >= LEAST_SCORE).alias("secret"),
    )


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Candidates of all documents with the forest's verdict.

    ``labelled`` has the columns of ``candidates`` and ``label`` (1 secret, 0 not); without it the
    rules of ``weak_labels`` label candidates of the documents themselves.
    """
    words = dictionary(docs)
    found = store(features(candidates(docs, path), words), "secret-candidates")
    known = weak_labels(found) if labelled is None else features(labelled, words)
    return judge(found, fit(known))
