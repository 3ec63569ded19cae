"""Labelled dataset: validation, label matching, splits, counters and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.contract import (
    CLASS_MIN_SAMPLES,
    FEATURE_NAMES,
    FEATURE_SCHEMA_VERSION,
    FEATURES,
    MIN_CAPTURES_PER_SPLIT,
    MIN_SAMPLES_PER_CLASS,
    MIN_TOTAL_SAMPLES,
    SPLIT_SEED,
    TRAFFIC_CLASSES,
    TRAIN_RATIO,
    UNKNOWN_CLASS,
    VALIDATION_RATIO,
)
from flowlens.functions.numeric import round_half_even
from flowlens.functions.ordering import newest, number_rows

# ---- fixed values: rejection reasons ------------------------------------------------------
VERSION_MISMATCH = "feature_schema_version_mismatch"
NULL_VALUE = "null_on_non_nullable"
BOOLEAN = "bool_not_numeric"
WRONG_TYPE = "wrong_type"
NOT_FINITE = "not_finite"
OUT_OF_RANGE = "out_of_range"
ORPHAN = "orphan_flow_feature"
LABEL_MISSING = "missing traffic_type"
LABEL_UNKNOWN = "unknown class for class_definition"
LABEL_ABSTENTION = "UNKNOWN is the abstention class, not a training target"
LABEL_NO_KEY = "neither capture_id nor capture_sha256 provided"
LABEL_BAD_SHA = "capture_sha256 is not a 64-char hex digest"


# ---- feature rows -------------------------------------------------------------------------
_REASONS = (NULL_VALUE, BOOLEAN, WRONG_TYPE, NOT_FINITE, OUT_OF_RANGE, VERSION_MISMATCH)
#: a problem is one number: ten times the feature's place in the contract, and the reason's
_CODE = {reason: i for i, reason in enumerate(_REASONS)}
_INFINITE = "double('Infinity')"


def _number_arms(place: int, feature, number: str) -> str:
    """Branches of a case that judge a number."""
    bounds = [f"{number} < {feature.minimum!r}D"] if feature.minimum is not None else []
    bounds += [f"{number} > {feature.maximum!r}D"] if feature.maximum is not None else []
    arms = f"when isnan({number}) or abs({number}) = {_INFINITE} then {10 * place + _CODE[NOT_FINITE]}"
    return f"{arms} when {' or '.join(bounds)} then {10 * place + _CODE[OUT_OF_RANGE]}" if bounds else arms


def _absent(place: int, feature) -> str:
    return "cast(null as int)" if feature.nullable else str(10 * place + _CODE[NULL_VALUE])


def _first(row: str, checks: list[str]) -> str:
    """The first check of ``row``, known as ``r`` in them, that is not null.

    Coalesce ends there, so nothing is built for what lies behind. The lambda keeps the chain out of the
    generated code, where it would be a method too long to compile.
    """
    return f"transform(array({row}), r -> coalesce({', '.join(checks)}))[0]"


def _typed_problem(row: str) -> str:
    """The first problem of a struct of numbers, in contract order."""
    checks = []
    for i, feature in enumerate(FEATURES):
        number = f"r.{feature.name}"
        checks.append(f"case when {number} is null then {_absent(i, feature)} {_number_arms(i, feature, number)} end")
    return _first(row, checks)


def _json_problem(cells: str) -> str:
    """The same for an array of JSON values with their types, one for each feature."""
    checks = []
    for i, feature in enumerate(FEATURES):
        kind, value = f"r[{i}].kind", f"r[{i}].value"
        checks.append(
            f"case when {kind} is null or {kind} = 'VOID' then {_absent(i, feature)} "
            f"when {kind} = 'BOOLEAN' then {10 * i + _CODE[BOOLEAN]} "
            f"when {kind} = 'STRING' and cast({value} as string) in ('#NaN', '#Infinity', '#-Infinity') "
            f"then {10 * i + _CODE[NOT_FINITE]} "
            f"when not ({kind} in ('BIGINT', 'DOUBLE') or {kind} like 'DECIMAL%') then {10 * i + _CODE[WRONG_TYPE]} "
            f"{_number_arms(i, feature, f'cast({value} as double)')} end"
        )
    return _first(cells, checks)


def _clean(value: str) -> str:
    """True for rows without any problem, as one flat expression, so most rows skip the search.

    A sum is finite only if every value is; NaN compares as larger than infinity.
    """
    tests, terms = [], []
    for feature in FEATURES:
        number = value.format(f=feature.name)
        bounds = [f"{number} >= {feature.minimum!r}D"] if feature.minimum is not None else []
        if feature.maximum is not None:
            bounds.append(f"{number} <= {feature.maximum!r}D")
        test = " and ".join(bounds) or f"{number} is not null"
        tests.append(f"coalesce({test}, {str(feature.nullable).lower()})")
        terms.append(f"coalesce({number}, 0D)")
    return f"({' and '.join(tests)} and {' + '.join(terms)} < {_INFINITE})"


def _with_reason(rows: DataFrame, columns: list[str], problem: str) -> DataFrame:
    other_version = f"not (feature_schema_version <=> '{FEATURE_SCHEMA_VERSION}')"
    first = f"case when {other_version} then {_CODE[VERSION_MISMATCH]} else {problem} end"
    # out of a generator: a filter on the reason would otherwise judge, and parse, every row many times over
    judged = rows.selectExpr(*columns, f"inline(array(named_struct('_problem', {first})))")
    reasons, names = (", ".join(f"'{x}'" for x in values) for values in (_REASONS, FEATURE_NAMES))
    return judged.selectExpr(
        "* except (_problem)",
        f"get(array({reasons}), _problem % 10) as reject_reason",
        f"case when _problem % 10 <> {_CODE[VERSION_MISMATCH]} then get(array({names}), cast(_problem div 10 as int)) end "
        "as reject_feature",
    )


def validate_features(rows: DataFrame) -> DataFrame:
    """First failing check per row, in contract order, as ``reject_reason``/``reject_feature``.

    Values are judged, never clipped or filled.
    """
    numbers = ", ".join(f"'{n}', cast({n} as double)" for n in FEATURE_NAMES)
    problem = _typed_problem(f"named_struct({numbers})")
    return _with_reason(rows, rows.columns, f"case when not {_clean('cast({f} as double)')} then {problem} end")


def validate_feature_json(rows: DataFrame) -> DataFrame:
    """The same for features stored as one JSON document in ``feature_json``.

    Unreadable documents count as empty. JSON types are told apart, so ``true`` and ``"7"`` are
    not numbers; the non-standard tokens NaN and Infinity are recognised. Documents of numbers and
    nulls are read in one typed pass; only the others are parsed again, once, to name what is wrong.
    """
    schema = ", ".join([*(f"{name} double" for name in FEATURE_NAMES), "_corrupt string"])
    read = (
        f"from_json(feature_json, '{schema}', map('mode', 'PERMISSIVE', "
        "'columnNameOfCorruptRecord', '_corrupt'))"
    )
    typed = rows.selectExpr("*", f"{read} as _typed")
    # the pattern is looked for only where one of its words stands
    words = " or ".join(f"contains(feature_json, '{w}')" for w in ("NaN", "INF", "Infinity"))
    odd = (
        "feature_json is null or _typed is null or _typed._corrupt is not null "
        f"or (({words}) and feature_json rlike '\"[-+]?(NaN|INF|Infinity)\"')"
    )
    marked = r"regexp_replace(feature_json, ':\\s*(NaN|-?Infinity)', ':\"#$1\"')"
    document = f"try_variant_get(try_parse_json({marked}), '$', 'map<string,variant>')"
    values = ", ".join(f"m['{name}']" for name in FEATURE_NAMES)
    cells = (
        f"transform(array({document}), m -> transform(array({values}), "
        "x -> named_struct('value', x, 'kind', schema_of_variant(x))))[0]"
    )
    kept = [*rows.columns, "_typed"]
    parsed = typed.selectExpr(*kept, f"case when {odd} then {cells} end as _cells")
    problem = (
        f"case when _cells is not null then {_json_problem('_cells')} "
        f"when not {_clean('_typed.{f}')} then {_typed_problem('_typed')} end"
    )
    judged = _with_reason(parsed, [*kept, "_cells"], problem)
    number = "if(_cells is null, _typed.{n}, try_variant_get(_cells[{i}].value, '$', 'double')) as {n}"
    return judged.selectExpr(
        *rows.columns,
        *[number.format(n=n, i=i) for i, n in enumerate(FEATURE_NAMES)],
        "reject_reason",
        "reject_feature",
    )


def latest_analyses(analyses: DataFrame) -> DataFrame:
    """The newest analysis of every capture, so re-analysed captures count once."""
    return newest(analyses, ["capture_id"], [F.col("created_at").desc(), F.col("analysis_id")])


def with_provenance(
    features: DataFrame,
    flows: DataFrame,
    analyses: DataFrame,
    captures: DataFrame,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Features with their flow, analysis and capture; a missing link is an orphan.

    What is known of a capture, with ``keys`` its classes as ``labels``, is put together first and then
    joined to the flows, so that the features move once, by their flow, and never by the few captures.
    """
    traced = analyses.select("analysis_id", "capture_id").join(
        captures.select("capture_id", "capture_sha256", F.lit(True).alias("_capture")),
        "capture_id",
        "left",
    )
    known = ["capture_sha256"]
    if keys is not None:
        traced = traced.join(capture_labels(traced, keys), "capture_id", "left")
        known.append("labels")
    linked = flows.select("flow_id", "flow_key", "analysis_id").join(traced, "analysis_id", "left")
    own = [F.col(f"`{c}`") for c in features.columns if c != "flow_id"]
    return features.join(linked, "flow_id", "left").select(
        "capture_id",
        "analysis_id",
        "flow_id",
        *own,
        "flow_key",
        *known,
        F.when(F.col("_capture").isNull(), F.lit(ORPHAN)).alias("orphan_reason"),
    )


# ---- labels -------------------------------------------------------------------------------
def validate_labels(entries: DataFrame) -> DataFrame:
    """Label entries with their class in upper case and the first failing check.

    ``UNKNOWN`` is refused: it marks abstention and is never a training target.
    """
    classes = ", ".join(f"'{name}'" for name in TRAFFIC_CLASSES)
    named = entries.withColumn(
        "traffic_type", F.upper(F.trim(F.coalesce("traffic_type", F.lit(""))))
    )
    return named.selectExpr(
        "*",
        f"""case when traffic_type = '' then '{LABEL_MISSING}'
            when traffic_type not in ({classes}) then '{LABEL_UNKNOWN}'
            when traffic_type = '{UNKNOWN_CLASS}' then '{LABEL_ABSTENTION}'
            when capture_id is null and capture_sha256 is null then '{LABEL_NO_KEY}'
            when capture_sha256 is not null and not capture_sha256 rlike '^[0-9a-fA-F]{{64}}$'
            then '{LABEL_BAD_SHA}' end as reject_reason""",
    )


def label_keys(checked: DataFrame) -> DataFrame:
    """Capture key (id or content hash) to class; the last entry of a key wins."""
    keys = F.filter(F.array("capture_id", "capture_sha256"), lambda k: k.isNotNull())
    return (
        checked.where("reject_reason is null")
        .select("index", "traffic_type", F.posexplode(keys).alias("position", "capture_key"))
        .withColumn("capture_key", F.trim("capture_key"))
        .groupBy("capture_key")
        .agg(F.max_by("traffic_type", F.struct("index", "position")).alias("traffic_type"))
    )


def capture_labels(captures: DataFrame, keys: DataFrame) -> DataFrame:
    """Classes of every labelled capture as ``labels``: by its id, else by its content hash.

    These are several only where a capture has several content hashes.
    """
    by_id = keys.select(F.col("capture_key").alias("capture_id"), F.col("traffic_type").alias("_id"))
    by_sha = keys.select(
        F.col("capture_key").alias("capture_sha256"), F.col("traffic_type").alias("_sha")
    )
    found = captures.select("capture_id", "capture_sha256").distinct()
    return (
        found.join(by_id, "capture_id", "left")
        .join(by_sha, "capture_sha256", "left")
        .groupBy("capture_id")
        .agg(F.collect_list(F.coalesce("_id", "_sha")).alias("labels"))
    )


def capped(rows: DataFrame, max_rows: int | None) -> DataFrame:
    """All rows, or the first ``max_rows`` by flow id."""
    return rows if max_rows is None else rows.orderBy("flow_id").limit(max_rows)


def build_dataset(
    features: DataFrame,
    flows: DataFrame,
    analyses: DataFrame,
    captures: DataFrame,
    keys: DataFrame,
    max_rows: int | None = None,
) -> DataFrame:
    """Feature rows with ``reject_reason`` and ``label``; samples are the labelled, accepted rows.

    ``max_rows`` bounds the rows, the first by flow id, where a bounded set is wanted.
    """
    if max_rows is None:
        linked = with_provenance(features, flows, analyses, captures, keys)
    else:  # the classes of the captures and hashes among the kept rows
        linked = capped(with_provenance(features, flows, analyses, captures), max_rows)
        linked = linked.join(capture_labels(linked, keys), "capture_id", "left")
    checked = validate_features(linked)
    reason = F.coalesce("orphan_reason", "reject_reason")
    judged = checked.withColumn("reject_reason", reason)
    # a row for each class of its capture, and one without where there is none
    return judged.select("*", F.explode_outer("labels").alias("label")).drop("orphan_reason", "labels")


def samples(dataset: DataFrame) -> DataFrame:
    return dataset.where("reject_reason is null and label is not null")


def audit_rows(dataset: DataFrame) -> DataFrame:
    """Provenance of every sample."""
    return samples(dataset).select(
        "capture_id", "analysis_id", "flow_key", "label", "feature_schema_version"
    )


def dataset_counters(dataset: DataFrame) -> DataFrame:
    accepted = F.col("reject_reason").isNull()
    labelled = accepted & F.col("label").isNotNull()
    known = F.when(~F.coalesce(F.col("reject_reason") == ORPHAN, F.lit(False)), F.col("capture_id"))
    return dataset.agg(
        F.count("*").alias("total_rows"),
        F.count_if(labelled).alias("labeled_rows"),
        F.count_if(accepted & F.col("label").isNull()).alias("unlabeled_rows"),
        F.count_if(~accepted).alias("rejected_rows"),
        F.count_distinct(known).alias("capture_count"),
        F.count_distinct(F.when(labelled, F.col("capture_id"))).alias("labeled_capture_count"),
    )


def rejection_counts(rows: DataFrame) -> DataFrame:
    return (
        rows.where("reject_reason is not null")
        .groupBy(F.col("reject_reason").alias("reason"))
        .agg(F.count("*").alias("rows"))
        .orderBy("reason")
    )


def declared_classes(rows: DataFrame, label: str = "label") -> DataFrame:
    """Declared class names together with those found in the data."""
    names = ", ".join(f"('{name}')" for name in TRAFFIC_CLASSES)
    declared = rows.sparkSession.sql(f"SELECT * FROM VALUES {names} AS classes(class_name)")
    found = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("class_name")).distinct()
    return declared.union(found).distinct()


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage of every declared or found class, zeros included."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class_name")).agg(
        F.count("*").alias("n")
    )
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    joined = declared_classes(rows, label).join(counts, "class_name", "left").select(
        "class_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"), whole.alias("whole")
    )
    share = joined.withColumn("share", F.col("count") / F.greatest(F.col("whole"), F.lit(1)) * 100.0)
    return share.select(
        "class_name", "count", round_half_even("share", 2).alias("percentage")
    )


def dataset_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 over all samples, independent of row order.

    Row hashes are folded in three levels of hash-prefix buckets (65 536, 256, 1), so no task
    sorts more than a bucket.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])

    def fold(df: DataFrame, digits: int) -> DataFrame:
        return df.groupBy(F.substring("h", 1, digits).alias("bucket")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")
        )

    leaves = rows.select(F.sha2(text, 256).alias("h"))
    first = fold(leaves, 4).select(F.concat("bucket", "h").alias("h"))
    second = fold(first, 2).select(F.concat("bucket", "h").alias("h"))
    whole = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
    return second.agg(whole.alias("dataset_digest"))


# ---- splits -------------------------------------------------------------------------------
def split_sizes(total: str, minimum: int = MIN_CAPTURES_PER_SPLIT) -> str:
    """Struct of train and validation capture counts as SQL text.

    Too few captures all go to training. Otherwise every split gets at least ``minimum``, taken
    from the larger of the first two when the rest falls short.
    """
    start = (
        f"named_struct('train', greatest(cast({total} * {TRAIN_RATIO}D as bigint), {minimum}L), "
        f"'validation', greatest(cast({total} * {VALIDATION_RATIO}D as bigint), {minimum}L))"
    )
    step = (
        f"case when {total} - s.train - s.validation >= {minimum} then s "
        "when s.train >= s.validation "
        "then named_struct('train', s.train - 1L, 'validation', s.validation) "
        "else named_struct('train', s.train, 'validation', s.validation - 1L) end"
    )
    balanced = f"aggregate(sequence(1, {2 * minimum}), {start}, (s, i) -> {step})"
    return (
        f"case when {total} >= {3 * minimum} then {balanced} "
        f"else named_struct('train', {total}, 'validation', 0L) end"
    )


def allocate_captures(captures: DataFrame, key: str, seed: int = SPLIT_SEED) -> DataFrame:
    """Whole captures to train, validation and test by the order of a seeded hash.

    Use the content hash as key: one file uploaded twice then stays on one side.
    """
    keys = captures.select(key).distinct()
    hashed = keys.withColumn("_hash", F.sha2(F.concat_ws("|", F.lit(str(seed)), key), 256))
    numbered = number_rows(
        hashed, [F.col("_hash"), F.col(key)], F.substring("_hash", 1, 3), "_position"
    )
    total = keys.agg(F.count("*").alias("n")).scalar()
    sized = numbered.withColumn("_total", total).selectExpr("*", f"{split_sizes('_total')} as _size")
    return sized.selectExpr(
        key,
        """case when _position <= _size.train then 'train'
            when _position <= _size.train + _size.validation then 'validation'
            else 'test' end as split""",
    )


def split_rows(rows: DataFrame, allocation: DataFrame, key: str) -> DataFrame:
    """Rows with their split; rows of unallocated captures are left out."""
    return rows.join(allocation, key)


def leaked_captures(rows: DataFrame, key: str) -> DataFrame:
    """Captures found in more than one split; must be empty before fitting."""
    return (
        rows.groupBy(key)
        .agg(F.count_distinct("split").alias("splits"))
        .where("splits > 1")
    )


def sufficiency(dataset: DataFrame, split: DataFrame) -> DataFrame:
    """Status and every shortfall that forbids training, as one row."""
    counters = dataset_counters(dataset)
    small = (
        samples(dataset)
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") < max(CLASS_MIN_SAMPLES, MIN_SAMPLES_PER_CLASS))
        .agg(
            # one entry per class: the vocabulary bounds the list
            F.array_sort(
                F.collect_list(
                    F.format_string(f"class %s has %d samples, needs {CLASS_MIN_SAMPLES}", "label", "n")
                )
            ).alias("small")
        )
        .scalar()
    )
    held = split.where("split in ('validation', 'test')").agg(F.count_distinct("split").alias("n")).scalar()

    def unless(condition: Column, text: Column) -> Column:
        return F.when(~condition, text)

    few = F.format_string(f"labeled flows %d < min_total_samples {MIN_TOTAL_SAMPLES}", "labeled_rows")
    captures = F.format_string(
        f"labeled captures %d < min_captures_per_split {MIN_CAPTURES_PER_SPLIT}", "labeled_capture_count"
    )
    empty = F.lit("capture-level split produced an empty validation or test set")
    shortfalls = F.concat(
        F.array_compact(F.array(unless(F.col("labeled_rows") >= MIN_TOTAL_SAMPLES, few))),
        small,
        F.array_compact(
            F.array(
                unless(F.col("labeled_capture_count") >= MIN_CAPTURES_PER_SPLIT, captures),
                unless(held == 2, empty),
            )
        ),
    )
    return counters.select(
        "labeled_rows",
        F.when(F.col("labeled_rows") == 0, "INSUFFICIENT_LABELED_DATA")
        .when(F.size(shortfalls) > 0, "INSUFFICIENT_DATA")
        .otherwise("OK")
        .alias("status"),
        shortfalls.alias("shortfalls"),
    )
