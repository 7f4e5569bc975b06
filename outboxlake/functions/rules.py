"""The ordered validation rules of one callback element.

Each stage adds columns computed from ``element`` (see ``callback_array``) and ``pos``.
The last stages yield ``code`` (index of the first failing rule, NULL when valid) and
label, reason, message and the resolved target.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from outboxlake import options as limits
from outboxlake.functions import urls
from outboxlake.functions import variant as vj
from outboxlake.functions.variant import Getter, Stage
from outboxlake.options import Options

# Header names a callback may not set.
RESERVED_HEADERS = (
    "authorization",
    "cookie",
    "host",
    "content-length",
    "content-type",
    "transfer-encoding",
    "connection",
    "upgrade",
    "expect",
    "te",
    "trailer",
    "proxy-authorization",
)
RESERVED_PREFIX = "x-outbox-"
HEADER_NAME = r"^[!#$%&'*+\-.^_`|~0-9A-Za-z]+\z"
HEADER_VALUE = r"^[\t\x20-\x7e]*\z"
CALLBACK_NAME = r"^[a-z][a-z0-9_]{2,63}\z"

# Reason labels in rule order.
REASONS = (
    "not_an_object",
    "missing_name",
    "name_not_string",
    "name_invalid",
    "missing_url",
    "url_not_string",
    "url_malformed",
    "url_has_userinfo",
    "url_bad_scheme",
    "url_no_host",
    "url_private_host",
    "invalid_mode",
    "missing_signing_key_id",
    "headers_not_object",
    "header_name_invalid",
    "header_reserved",
    "header_duplicate",
    "header_value_invalid",
    "max_attempts_not_integer",
    "max_attempts_out_of_range",
    "backoff_not_array",
    "backoff_empty",
    "backoff_element_invalid",
    "backoff_element_out_of_range",
    "timeout_not_integer",
    "timeout_out_of_range",
    "external_timeout_not_integer",
    "external_timeout_out_of_range",
    "max_completion_cycles_not_integer",
    "max_completion_cycles_out_of_range",
    "external_missing_timeout",
)
DUPLICATE_NAME = "duplicate_name"
TOO_MANY = "too_many_callbacks"
NOT_ARRAY = "not_array"
OTHER = "other"
CODE = {reason: i for i, reason in enumerate(REASONS)}

PREFIX = "invalid_callback: "

# Message texts.
TEXT_NOT_ARRAY = PREFIX + "top-level callbacks value is not a JSON array"
TEXT_DUPLICATE = PREFIX + "duplicate callback name within event"

TARGET_FIELDS = (
    "name",
    "url",
    "mode",
    "signing_key_id",
    "headers",
    "max_attempts",
    "backoff",
    "timeout_seconds",
    "external_completion_timeout_seconds",
    "max_completion_cycles",
)


# Fields read from a callback element.
ELEMENT_FIELDS = (
    "name",
    "url",
    "mode",
    "signing_key_id",
    "headers",
    "max_attempts",
    "backoff_seconds",
    "timeout_seconds",
    "external_completion_timeout_seconds",
    "max_completion_cycles",
)
ELEMENT_TYPE = "struct<" + ",".join(f"{f}:variant" for f in ELEMENT_FIELDS) + ">"


def callback_array(text: Column) -> Column:
    """Callbacks text as an array of element structs of raw JSON values.

    NULL unless the text is a JSON array; a NULL element is not a JSON object, a NULL
    field is absent, a JSON null is a value of type VOID.
    """
    return vj.parse(text).try_cast(f"array<{ELEMENT_TYPE}>")


def element_name(element: Column) -> Column:
    return vj.text(element["name"])


def _typed_stage(c: Getter) -> dict[str, Column]:
    """Fields by JSON type. One lambda per type keeps the generated code small."""
    element = c("element")
    texts = ("name", "url", "mode", "signing_key_id")
    numbers = (
        "max_attempts",
        "timeout_seconds",
        "external_completion_timeout_seconds",
        "max_completion_cycles",
    )
    return {
        "_texts": F.transform(F.array(*[element[f] for f in texts]), vj.text),
        "_numbers": F.transform(F.array(*[element[f] for f in numbers]), vj.unsigned),
    }


def _named(c: Getter) -> Getter:
    """Readable names for the entries of the typed arrays."""

    def text(i: int) -> Column:
        return F.get(c("_texts"), F.lit(i))

    def number(i: int) -> Column:
        return F.get(c("_numbers"), F.lit(i))

    def find(name: str) -> Column:
        if name == "_mode":
            return F.coalesce(text(2), F.lit("managed"))
        if name in _TEXT_PLACE:
            return text(_TEXT_PLACE[name])
        if name in _NUMBER_PLACE:
            return number(_NUMBER_PLACE[name])
        return c(name)

    return find


def mode(c: Getter) -> Column:
    return _named(c)("_mode")


_TEXT_PLACE = {"_name": 0, "_url": 1, "_key": 3}
_NUMBER_PLACE = {"_attempts": 0, "_timeout": 1, "_external": 2, "_cycles": 3}


def _lazy_stage(opts: Options):
    """Parts that need array functions; each is worked out only where it is present."""
    schemes = _schemes(opts)

    def problem(c: Getter) -> dict[str, Column]:
        found = (
            F.when(c("_host_kind") == urls.MALFORMED, CODE["url_malformed"])
            .when(urls.has_userinfo(c), CODE["url_has_userinfo"])
            .when(~c("_scheme").isin(*schemes), CODE["url_bad_scheme"])
        )
        if not opts.allow_private_ip_targets:
            found = found.when(c("_host_kind") == urls.PRIVATE, CODE["url_private_host"])
        return {"_problem": found}

    def stage(columns: Getter) -> dict[str, Column]:
        c = _named(columns)
        headers, backoff = c("element")["headers"], c("element")["backoff_seconds"]
        checked_url = vj.chain_stages({"_url": c("_url")}, (*urls.STAGES, problem), "_problem")
        return {
            "_url_problem": F.when(
                urls.plain(c("_url"), ("https", "http")),
                F.when(
                    ~c("_url").startswith("https:") & F.lit("http" not in schemes),
                    CODE["url_bad_scheme"],
                ),
            ).when(c("_url").isNotNull(), checked_url),
            "_bad_header": F.when(headers.isNotNull(), _first_bad_header(headers)),
            "_backoff": F.when(
                backoff.isNotNull(), F.transform(vj.elements(backoff), _backoff_entry)
            ),
        }

    return stage


def _schemes(opts: Options) -> tuple[str, ...]:
    return ("https", "http") if opts.allow_insecure_urls else ("https",)


def _backoff_entry(value: Column) -> Column:
    return F.struct(vj.unsigned(value).alias("n"), F.variant_get(value, "$", "string").alias("raw"))


def _first_bad_header(headers: Column) -> Column:
    """(code, header, part) of the first failing header in key order, NULL if none."""

    def judge(keys: Column, lowered: Column, values: Column) -> Column:
        def one(key: Column, i: Column) -> Column:
            low = F.lower(key)
            value = F.try_element_at(values, key)
            code = (
                F.when(~key.rlike(HEADER_NAME), CODE["header_name_invalid"])
                .when(
                    low.isin(*RESERVED_HEADERS) | low.startswith(RESERVED_PREFIX),
                    CODE["header_reserved"],
                )
                .when(F.array_position(lowered, low) <= i, CODE["header_duplicate"])
                .when(
                    ~F.coalesce(vj.is_string(value), F.lit(False)), CODE["header_value_invalid"]
                )
                .when(
                    ~F.variant_get(value, "$", "string").rlike(HEADER_VALUE), len(REASONS)
                )
            )
            return F.when(code.isNotNull(), F.struct(code.alias("code"), key.alias("header")))

        return F.get(F.filter(F.transform(keys, one), lambda s: s.isNotNull()), F.lit(0))

    def with_keys(values: Column) -> Column:
        keys = F.array_sort(F.map_keys(values))
        return vj.bind(
            F.struct(keys.alias("keys"), F.transform(keys, F.lower).alias("lowered")),
            lambda k: judge(k["keys"], k["lowered"], values),
        )

    return vj.bind(vj.entries(headers), with_keys)


def _code_stage(opts: Options):
    def stage(columns: Getter) -> dict[str, Column]:
        c = _named(columns)
        element = c("element")
        chain = (
            F.when(element.isNull(), CODE["not_an_object"])
            .when(element["name"].isNull(), CODE["missing_name"])
            .when(c("_name").isNull(), CODE["name_not_string"])
            .when(~c("_name").rlike(CALLBACK_NAME), CODE["name_invalid"])
            .when(element["url"].isNull(), CODE["missing_url"])
            .when(c("_url").isNull(), CODE["url_not_string"])
            .when(c("_url_problem").isNotNull(), c("_url_problem"))
            .when(~c("_mode").isin("managed", "external"), CODE["invalid_mode"])
        )
        if not opts.allow_unsigned_callbacks:
            chain = chain.when(c("_key").isNull(), CODE["missing_signing_key_id"])
        chain = chain.when(
            element["headers"].isNotNull() & ~vj.kind(element["headers"]).startswith("OBJECT"),
            CODE["headers_not_object"],
        ).when(
            c("_bad_header").isNotNull(),
            F.least(c("_bad_header")["code"], F.lit(CODE["header_value_invalid"])),
        )

        def ranged(chain: Column, field: str, typed: str, name: str, high: int) -> Column:
            present = element[field].isNotNull()
            return chain.when(present & c(typed).isNull(), CODE[f"{name}_not_integer"]).when(
                present & ~c(typed).between(1, high), CODE[f"{name}_out_of_range"]
            )

        chain = ranged(
            chain, "max_attempts", "_attempts", "max_attempts", limits.MAX_ATTEMPTS_LIMIT
        )
        chain = _backoff_rules(chain, c)
        chain = ranged(
            chain, "timeout_seconds", "_timeout", "timeout", limits.MAX_TIMEOUT_SECONDS
        )
        chain = ranged(
            chain,
            "external_completion_timeout_seconds",
            "_external",
            "external_timeout",
            limits.MAX_EXTERNAL_TIMEOUT_SECONDS,
        )
        chain = ranged(
            chain,
            "max_completion_cycles",
            "_cycles",
            "max_completion_cycles",
            limits.MAX_COMPLETION_CYCLES,
        )
        chain = chain.when(
            (c("_mode") == "external") & element["external_completion_timeout_seconds"].isNull(),
            CODE["external_missing_timeout"],
        )
        return {"code": chain}

    return stage


def _bad_backoff(c: Getter) -> Column:
    """First backoff element that is not an integer in range, as a struct."""
    return F.get(
        F.filter(
            c("_backoff"),
            lambda e: e["n"].isNull() | ~e["n"].between(1, limits.MAX_BACKOFF_SECONDS),
        ),
        F.lit(0),
    )


def _backoff_rules(chain: Column, c: Getter) -> Column:
    present = c("element")["backoff_seconds"].isNotNull()
    bad = _bad_backoff(c)
    return (
        chain.when(present & c("_backoff").isNull(), CODE["backoff_not_array"])
        .when(present & (F.size(c("_backoff")) == 0), CODE["backoff_empty"])
        .when(
            present & bad.isNotNull(),
            F.when(bad["n"] > 0, CODE["backoff_element_out_of_range"]).otherwise(
                CODE["backoff_element_invalid"]
            ),
        )
    )


def _message(c: Getter, opts: Options) -> Column:
    def about_url(tail: str) -> Column:
        return F.concat(F.lit(PREFIX + "url '"), c("_url"), F.lit("' " + tail))

    def about_header(tail: str) -> Column:
        return F.concat(F.lit(PREFIX + "header '"), c("_bad_header")["header"], F.lit("' " + tail))

    def raw(field: str) -> Column:
        return F.variant_get(c("element")[field], "$", "string")

    def got(text: str, value: Column) -> Column:
        return F.concat(F.lit(PREFIX + text + "; got "), value)

    def span(field: str, high: int) -> str:
        return f"{field} must be between 1 and {high}"

    scheme_text = (
        "url must use http:// or https:// scheme"
        if opts.allow_insecure_urls
        else "url must use https:// scheme"
    )
    whole = " must be a positive integer"
    bad = _bad_backoff(c)
    external_name = "external_completion_timeout_seconds"
    texts: dict[str, Column | str] = {
        "not_an_object": "element is not an object",
        "missing_name": "missing required field 'name'",
        "name_not_string": "'name' must be a string",
        "name_invalid": "name must match ^[a-z][a-z0-9_]{2,63}$",
        "missing_url": "missing required field 'url'",
        "url_not_string": "'url' must be a string",
        "url_malformed": about_url("is structurally malformed"),
        "url_has_userinfo": about_url("must not contain userinfo (username/password)"),
        "url_bad_scheme": F.concat(
            F.lit(PREFIX + scheme_text + "; got '"), c("_url"), F.lit("'")
        ),
        "url_no_host": about_url("has no host"),
        "url_private_host": about_url(
            "targets a private or loopback address "
            "(set allow_private_ip_targets=true to allow local targets)"
        ),
        "invalid_mode": F.concat(
            F.lit(PREFIX + "mode must be 'managed' or 'external'; got '"),
            c("_mode"),
            F.lit("'"),
        ),
        "missing_signing_key_id": "missing required field 'signing_key_id' "
        "(set allow_unsigned_callbacks=true to omit)",
        "headers_not_object": "headers must be a JSON object",
        "header_name_invalid": F.concat(
            F.lit(PREFIX + "header name '"),
            c("_bad_header")["header"],
            F.lit("' contains invalid characters"),
        ),
        "header_reserved": about_header("is reserved and cannot be set"),
        "header_duplicate": about_header(
            "is a duplicate (header names are case-insensitive)"
        ),
        "header_value_invalid": F.when(
            c("_bad_header")["code"] == CODE["header_value_invalid"],
            about_header("value must be a string"),
        ).otherwise(
            about_header(
                "value contains illegal characters "
                "(control characters and non-ASCII bytes are not allowed)"
            )
        ),
        "max_attempts_not_integer": "max_attempts" + whole,
        "max_attempts_out_of_range": got(
            span("max_attempts", limits.MAX_ATTEMPTS_LIMIT), raw("max_attempts")
        ),
        "backoff_not_array": "backoff_seconds must be an array",
        "backoff_empty": "backoff_seconds must not be empty",
        "backoff_element_invalid": F.when(
            bad["n"] == 0, PREFIX + "backoff_seconds elements must be > 0"
        ).otherwise(PREFIX + "backoff_seconds elements must be positive integers"),
        "backoff_element_out_of_range": got(
            f"backoff_seconds elements must be <= {limits.MAX_BACKOFF_SECONDS}", bad["raw"]
        ),
        "timeout_not_integer": "timeout_seconds" + whole,
        "timeout_out_of_range": got(
            span("timeout_seconds", limits.MAX_TIMEOUT_SECONDS), raw("timeout_seconds")
        ),
        "external_timeout_not_integer": external_name + whole,
        "external_timeout_out_of_range": got(
            span(external_name, limits.MAX_EXTERNAL_TIMEOUT_SECONDS), raw(external_name)
        ),
        "max_completion_cycles_not_integer": "max_completion_cycles" + whole,
        "max_completion_cycles_out_of_range": got(
            span("max_completion_cycles", limits.MAX_COMPLETION_CYCLES), raw("max_completion_cycles")
        ),
        "external_missing_timeout": "mode='external' requires "
        "'external_completion_timeout_seconds'",
    }
    chain = None
    for reason, text in texts.items():
        value = F.lit(PREFIX + text) if isinstance(text, str) else text
        hit = c("code") == CODE[reason]
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def _target(c: Getter, opts: Options) -> Column:
    element = c("element")
    headers = F.coalesce(
        element["headers"].try_cast("map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )
    backoff = F.coalesce(
        element["backoff_seconds"].try_cast("array<bigint>"),
        F.array(*[F.lit(s).cast("bigint") for s in opts.backoff]),
    )

    def number(typed: str, default: int, kind: str) -> Column:
        return F.coalesce(c(typed).cast(kind), F.lit(default).cast(kind))

    return F.struct(
        c("_name").alias("name"),
        c("_url").alias("url"),
        c("_mode").alias("mode"),
        c("_key").alias("signing_key_id"),
        headers.alias("headers"),
        number("_attempts", opts.max_attempts, "int").alias("max_attempts"),
        backoff.alias("backoff"),
        number("_timeout", opts.timeout_seconds, "bigint").alias("timeout_seconds"),
        c("_external").alias("external_completion_timeout_seconds"),
        number("_cycles", opts.max_completion_cycles, "int").alias("max_completion_cycles"),
    )


def _verdict_stage(opts: Options):
    def stage(columns: Getter) -> dict[str, Column]:
        c = _named(columns)
        message = vj.bind(c("code"), lambda code: _message(_with_code(c, code), opts))
        reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), c("code") + 1)
        return {
            "label": F.coalesce(c("_name"), position_label(c("pos"))),
            "reason": F.when(c("code").isNotNull(), reason),
            "message": F.when(c("code").isNotNull(), message),
            "target": F.when(c("code").isNull(), _target(c, opts)),
        }

    return stage


def _with_code(c: Getter, code: Column) -> Getter:
    return lambda name: code if name == "code" else c(name)


def position_label(pos: Column) -> Column:
    return F.concat(F.lit("["), pos.cast("string"), F.lit("]"))


def code_stages(opts: Options) -> Sequence[Stage]:
    """Stages up to ``code``: enough to tell valid from invalid."""
    return (_typed_stage, _lazy_stage(opts), _code_stage(opts))


@functools.cache
def stages(opts: Options) -> Sequence[Stage]:
    return (*code_stages(opts), _verdict_stage(opts))


def is_valid(element: Column, opts: Options) -> Column:
    """Validity of one element as a single expression (for lambda variables)."""
    return vj.chain_stages({"element": element}, code_stages(opts), "code").isNull()
