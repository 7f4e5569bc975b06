"""Events to callbacks: explode, validate, name and classify.

Everything here is a map over the event scan: each event's array is parsed once,
classified, exploded once and judged element by element. No operator shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outboxlake.functions import rules
from outboxlake.functions import variant as vj
from outboxlake.options import Options

CHECKED = "checked"
OVERSIZED = "oversized"
TOO_MANY = "too_many"
CORRUPT = "corrupt"
UNLISTED = "unlisted"

# Fixed value: label that marks an array-level reject.
ROOT_LABEL = "<root>"

EVENT_KEYS = ("id", "event_id", "kind", "created_at")


def with_payload_size(events: DataFrame) -> DataFrame:
    if "payload_size_bytes" in events.columns:
        return events
    return events.withColumn("payload_size_bytes", F.octet_length("payload").cast("bigint"))


def classify_events(events: DataFrame, opts: Options) -> DataFrame:
    """Event keys, payload size, parsed array, array length and branch.

    ``_names`` holds the names as text, also those of other JSON types.
    """
    array = F.col("_array")
    size = F.col("n_callbacks")
    all_root = F.array_distinct("_names") == F.array(F.lit(ROOT_LABEL))
    branch = (
        F.when(F.col("payload_size_bytes") > opts.payload_size_limit, OVERSIZED)
        .when(size.isNull(), CORRUPT)
        .when(size > opts.max_callbacks_per_event, TOO_MANY)
        .when((size == 0) | F.coalesce(all_root, F.lit(False)), UNLISTED)
        .otherwise(CHECKED)
    )
    return (
        with_payload_size(events)
        .select(*EVENT_KEYS, "callbacks", "payload_size_bytes")
        .withColumn("_array", rules.callback_array(F.col("callbacks")))
        .withColumn("_names", array["name"].try_cast("array<string>"))
        .withColumn("n_callbacks", F.when(array.isNotNull(), F.size(array)))
        .withColumn("branch", branch)
    )


def explode_callbacks(events: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per array element with its 0-based position and raw value."""
    rows = events.select(
        *EVENT_KEYS, _numbered(rules.callback_array(F.col("callbacks")))
    )
    return rows if keep_empty else rows.filter(F.col("pos").isNotNull())


def _numbered(array: Column) -> Column:
    """Outer explode: the inner form makes the planner parse the text twice, once in an
    inferred filter on the array size. Callers drop the rows without a position."""
    return F.posexplode_outer(array).alias("pos", "element")


def callback_names(events: DataFrame) -> DataFrame:
    """Name of each element without validation, ``[pos]`` where it has none."""
    return explode_callbacks(events).select(
        "id",
        "event_id",
        "pos",
        F.coalesce(rules.element_name(F.col("element")), rules.position_label(F.col("pos"))).alias(
            "callback_name"
        ),
    )


def oversized_text(size: Column, limit: int) -> Column:
    return F.concat(
        F.lit("source_payload_too_large: "),
        size.cast("string"),
        F.lit(f" bytes > {limit} bytes (rejected by dispatcher before send)"),
    )


def judge_callbacks(
    events: DataFrame,
    opts: Options,
    branches: tuple[str, ...] | None = None,
    mark_duplicates: bool = True,
) -> DataFrame:
    """One row per callback element of every event, with its verdict.

    Columns: event keys, ``n_callbacks``, ``branch``, ``pos``, ``label``, ``reason``,
    ``message``, ``valid``, ``mode`` (rejects are managed) and ``target`` (NULL for
    rejects; not worked out unless used). Without ``mark_duplicates`` a repeated
    valid name stays valid, which is all an insert-if-absent needs.
    """
    classified = classify_events(events, opts)
    array = F.col("_array")
    if branches:
        # Other events lose their array here, not their row in a filter: see `filter_once`.
        array = F.when(F.col("branch").isin(*branches), array)
    checked = F.col("branch").isin(CHECKED, UNLISTED)
    names = F.array_compact("_names")
    repeats = (F.col("n_callbacks") > 1) & (F.size(F.array_distinct(names)) < F.size(names))
    rows = classified.withColumn("_siblings", F.when(checked & repeats, F.col("_array"))).select(
        *EVENT_KEYS,
        "payload_size_bytes",
        "n_callbacks",
        "branch",
        "_siblings",
        _numbered(array),
    ).filter(F.col("pos").isNotNull())
    typed, lazy, *last = rules.stages(opts)
    judged = vj.add_stages(rows, [typed])
    twin = checked & _earlier_valid_twin(opts) if mark_duplicates else F.lit(False)
    # Elements of events that are refused as a whole get no verdict of their own.
    parts = {n: F.when(checked, part) for n, part in vj.stage_columns(lazy).items()}
    judged = judged.withColumns({**parts, "_twin": twin}).drop("_siblings")
    code, *last = last
    judged = judged.withColumns({n: F.when(checked, part) for n, part in vj.stage_columns(code).items()})
    judged = vj.add_stages(judged, last)
    duplicate = F.col("_twin") & F.col("code").isNull()
    valid = checked & F.col("code").isNull() & ~F.col("_twin")
    return judged.withColumn("valid", valid).select(
        *EVENT_KEYS,
        "n_callbacks",
        "branch",
        "pos",
        "label",
        F.when(duplicate, rules.DUPLICATE_NAME)
        .when(checked, F.col("reason"))
        .when(F.col("branch") == TOO_MANY, rules.TOO_MANY)
        .alias("reason"),
        F.when(duplicate, rules.TEXT_DUPLICATE)
        .when(checked, F.col("message"))
        .when(F.col("branch") == TOO_MANY, _too_many_text(opts))
        .otherwise(oversized_text(F.col("payload_size_bytes"), opts.payload_size_limit))
        .alias("message"),
        "valid",
        F.when(F.col("valid"), rules.mode(F.col)).otherwise("managed").alias("mode"),
        F.when(F.col("valid"), F.col("target")).alias("target"),
    )


def _too_many_text(opts: Options) -> Column:
    return F.concat(
        F.lit(rules.PREFIX + "too many callbacks in event ("),
        F.col("n_callbacks").cast("string"),
        F.lit(f"); max is {opts.max_callbacks_per_event}"),
    )


@vj.per_session
def _earlier_valid_twin(opts: Options) -> Column:
    """Whether a valid element of the same name comes earlier in the array."""
    return F.coalesce(
        F.when(
            F.col("_siblings").isNotNull(),
            F.exists(
                F.slice("_siblings", F.lit(1), F.col("pos")),
                lambda e: F.when(
                    rules.element_name(e) == F.get("_texts", F.lit(0)), rules.is_valid(e, opts)
                ).otherwise(F.lit(False)),
            ),
        ),
        F.lit(False),
    )


def validate_callbacks(events: DataFrame, opts: Options) -> DataFrame:
    """Verdict per element of the events that reach element validation."""
    return judge_callbacks(events, opts, (CHECKED, UNLISTED))


def dedupe_callback_names(events: DataFrame, opts: Options) -> DataFrame:
    """Elements refused only because a valid one of that name came earlier."""
    return vj.filter_once(validate_callbacks(events, opts), F.col("reason") == rules.DUPLICATE_NAME)


def resolve_targets(events: DataFrame, opts: Options) -> DataFrame:
    """Valid elements with defaults filled in, one column per target field."""
    return (
        vj.filter_once(validate_callbacks(events, opts), F.col("target").isNotNull())
        .select("id", "event_id", "pos", "target.*")
    )


def oversized_payloads(events: DataFrame, opts: Options) -> DataFrame:
    """One row per callback of each event over the payload limit."""
    big = with_payload_size(events).filter(
        F.col("payload_size_bytes") > opts.payload_size_limit
    )
    return _name_rows(
        big, oversized_text(F.col("payload_size_bytes"), opts.payload_size_limit)
    )


def array_level_rejects(events: DataFrame, opts: Options) -> DataFrame:
    """One row per callback of each event whose array is longer than allowed."""
    long = vj.filter_once(classify_events(events, opts), F.col("branch") == TOO_MANY)
    return _name_rows(long, _too_many_text(opts)).withColumn("reason", F.lit(rules.TOO_MANY))


def _name_rows(events: DataFrame, message: Column) -> DataFrame:
    rows = events.withColumn("message", message).select(
        "id",
        "event_id",
        "kind",
        "message",
        _numbered(rules.callback_array(F.col("callbacks"))),
    ).filter(F.col("pos").isNotNull())
    label = F.coalesce(rules.element_name(F.col("element")), rules.position_label(F.col("pos")))
    return rows.select("id", "event_id", "kind", "pos", label.alias("callback_name"), "message")


def corrupt_events(events: DataFrame, opts: Options) -> DataFrame:
    """Events whose callbacks are not a JSON array (and whose payload is in bounds)."""
    corrupt = vj.filter_once(classify_events(events, opts), F.col("branch") == CORRUPT)
    return corrupt.select(*EVENT_KEYS, "callbacks")
