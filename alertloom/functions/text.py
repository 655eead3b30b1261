"""Scrubbing of untrusted values and the fenced prompt block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

# Fence tokens, caps and the truncation mark.
FENCE_OPEN = "<untrusted_data>"
FENCE_CLOSE = "</untrusted_data>"
MAX_FIELD = 2_000
MAX_BLOCK = 60_000
TRUNCATION_MARK = "...[truncated]"

# Unicode "other" characters and the two separators, keeping tab, line feed and return.
UNSAFE_CHARS = r"[\p{C}\u2028\u2029&&[^\t\n\r]]"
# A JSON text cut up: its strings, quotes included, and what stands between them.
_JSON_TOKENS = r'"(?:[^"\\]++|\\.)*+"|[^"]++'


def strip_control_chars(value: Column) -> Column:
    return F.regexp_replace(value, UNSAFE_CHARS, "")


def cap_text(value: Column, limit: int) -> Column:
    """The first `limit` characters and a mark, where there are more."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit(TRUNCATION_MARK))).otherwise(value)


def scrub_text(value: Column, max_field: int = MAX_FIELD) -> Column:
    """Stripped and capped text; only text that is over the cap is stripped before it is measured."""
    clean = strip_control_chars(value)
    return F.when(F.length(value) <= max_field, clean).otherwise(cap_text(clean, max_field))


def strip_whitespace(value: Column) -> Column:
    """Drop leading and trailing whitespace of every kind, not spaces alone."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def distinct_in_order(values: Column, limit: int) -> Column:
    """First `limit` distinct non-empty values, in the order they were first seen."""
    return F.slice(F.filter(F.array_distinct(values), lambda v: v != ""), 1, limit)


def iso_utc(moment: Column) -> Column:
    """ISO-8601 text; the session time zone is expected to be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def _rewrite(value: str, dtype: T.DataType, leaf: Callable[[str, T.DataType], str], depth: int = 0) -> str:
    """SQL that rebuilds a nested value with struct fields in name order and `leaf` applied to its leaves."""
    item = f"_v{depth}"
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda field: field.name)
        parts = [f"'{f.name}', " + _rewrite(f"{value}.`{f.name}`", f.dataType, leaf, depth) for f in fields]
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({', '.join(parts)}) END"
    if isinstance(dtype, T.ArrayType):
        return f"transform({value}, {item} -> {_rewrite(item, dtype.elementType, leaf, depth + 1)})"
    if isinstance(dtype, T.MapType):
        key = _rewrite(f"{item}.key", T.StringType(), leaf, depth + 1)
        held = _rewrite(f"{item}.value", dtype.valueType, leaf, depth + 1)
        done = f"transform(map_entries({value}), {item} -> struct({key} AS key, {held} AS value))"
        # Scrubbing can make two keys equal: the later entry stands.
        last = f"filter(_all{depth}, (_e{depth}, _i{depth}) -> NOT exists(slice(_all{depth}, _i{depth} + 2, size(_all{depth})), _l{depth} -> _l{depth}.key <=> _e{depth}.key))"
        return f"transform(array({done}), _all{depth} -> map_from_entries({last}))[0]"
    return leaf(value, dtype)


def scrub(column: str, dtype: T.DataType, max_field: int = MAX_FIELD) -> Column:
    """Scrub every string in a nested column; numbers, booleans and nulls pass, other types become text.

    Struct fields come out in name order, as canonical JSON wants them.
    """
    as_is = (T.BooleanType, T.NullType, T.VariantType)
    unsafe = UNSAFE_CHARS.replace("\\", "\\\\")

    def leaf(item: str, kind: T.DataType) -> str:
        if isinstance(kind, as_is) or (isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType)):
            return item
        value = f"CAST({item} AS STRING)"
        clean = f"regexp_replace({value}, '{unsafe}', '')"
        return (
            f"CASE WHEN length({value}) <= {max_field} THEN {clean} "
            f"WHEN length({clean}) > {max_field} THEN concat(left({clean}, {max_field}), '{TRUNCATION_MARK}') ELSE {clean} END"
        )

    return F.expr(_rewrite(f"`{column}`", dtype, leaf))


def in_name_order(column: str, dtype: T.DataType) -> Column:
    return F.expr(_rewrite(f"`{column}`", dtype, lambda item, _kind: item))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is named many times; inside a lambda Spark would work it out for each."""
    return F.element_at(F.transform(F.array(value), use), 1)


def may_need_scrub(json_text: Column, max_field: int = MAX_FIELD) -> Column:
    """False only where no string in a JSON text can hold an unsafe character or be over the cap."""
    escaped = json_text.rlike(r"\\[ubf]")
    return (F.length(json_text) > max_field) | json_text.rlike(UNSAFE_CHARS) | escaped


def scrub_json(json_text: Column, max_field: int = MAX_FIELD) -> Column:
    """JSON text of any shape with every string in it scrubbed, keys included; null stays null.

    The text must be JSON as to_json writes it. It is cut into tokens, of which only strings that
    may need it are read, scrubbed and written again; numbers keep their digits. Keys that become
    equal all stay, in order: a reader that takes the last of equal keys gives the later value.
    """

    def token(t: Column) -> Column:
        # Stripping only shortens, so that what is over the cap then is what is cut.
        clean = strip_control_chars(F.variant_get(F.parse_json(t), "$", "string"))
        again = F.to_json(F.array(_once(clean, lambda c: cap_text(c, max_field))))
        quoted = _once(again, lambda a: F.substring(a, F.lit(2), F.length(a) - 2))
        return F.when(F.startswith(t, F.lit('"')) & may_need_scrub(t, max_field), quoted).otherwise(t)

    tokens = F.regexp_extract_all(json_text, F.lit(_JSON_TOKENS), F.lit(0))
    return F.when(may_need_scrub(json_text, max_field), F.array_join(F.transform(tokens, token), "")).otherwise(json_text)


def canonical_json(value: Column) -> Column:
    """Compact ASCII JSON of a value whose struct fields are already in name order."""
    return F.to_json(value, {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})


def flat_json(value: Column) -> Column:
    """JSON text with nulls kept and non-ASCII characters as they are."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def inert_payload(payload: Column, max_block: int = MAX_BLOCK) -> Column:
    """Payload without fence tokens, capped, and with angle brackets as JSON escapes.

    Removing a token can make another one out of what stood around it; with the escapes no
    token can stand in the text whatever was nested, and the JSON still parses to the same value.
    """
    bare = F.replace(F.replace(payload, F.lit(FENCE_OPEN), F.lit("")), F.lit(FENCE_CLOSE), F.lit(""))
    capped = cap_text(bare, max_block)
    return F.replace(F.replace(capped, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def fence_block(payload: Column, max_block: int = MAX_BLOCK) -> Column:
    return F.concat(F.lit(FENCE_OPEN + "\n"), inert_payload(payload, max_block), F.lit("\n" + FENCE_CLOSE))


def block_is_cut(payload: Column, max_block: int = MAX_BLOCK) -> Column:
    bare = F.replace(F.replace(payload, F.lit(FENCE_OPEN), F.lit("")), F.lit(FENCE_CLOSE), F.lit(""))
    return F.length(bare) > max_block
