"""Property sets as sorted arrays of canonical JSON strings, their keys and their signatures.

All are column expressions: they stay in generated code and take and give columns. Null arrays give null,
except where a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits of content keys.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def props_sorted(props: Column) -> Column:
    """Distinct properties in code-point order: the canonical form of a set."""
    return F.array_sort(F.array_distinct(props))


def encode_pair(key: Column, value: Column) -> Column:
    """One property of a key and a scalar value, as compact JSON."""
    return F.to_json(F.create_map(key, value))


def encode_value(value: Column) -> Column:
    """One property of the list form: the value alone."""
    return F.to_json(F.array(value))


def props_encode(pairs: Column) -> Column:
    """Properties of a map from key to an array of scalar values: one string for each member."""
    every = F.flatten(F.transform(F.map_entries(pairs), lambda e: F.transform(e["value"], lambda v: encode_pair(e["key"], v))))
    return props_sorted(every)


def props_encode_list(values: Column) -> Column:
    """Properties of a plain list of values."""
    return props_sorted(F.transform(values, encode_value))


def prop_key(prop: Column) -> Column:
    """The key of a property; null in the list form."""
    return F.get(F.json_object_keys(prop), F.lit(0))


def prop_value(prop: Column) -> Column:
    """The value of a property as text, in either form."""
    return F.coalesce(F.get(F.map_values(F.from_json(prop, "map<string,string>")), F.lit(0)), F.get_json_object(prop, "$[0]"))


def is_a(props: Column, required: Column) -> Column:
    """Whether every required property is there; nothing required is always met."""
    return F.size(F.array_except(required, props)) == 0


def add_property(props: Column, key: Column, value: Column) -> Column:
    """The set with one more property in key form. A set in list form is refused."""
    listed = F.exists(props, lambda p: p.startswith("["))
    return F.when(F.assert_true(~F.coalesce(listed, F.lit(False)), "a list of values can't hold a key").isNull(), props_sorted(F.array_union(props, F.array(encode_pair(key, value)))))


def add_value(props: Column, value: Column) -> Column:
    """The set with one more value in list form. A set in key form is refused."""
    keyed = F.exists(props, lambda p: p.startswith("{"))
    return F.when(F.assert_true(~F.coalesce(keyed, F.lit(False)), "a set of keys can't hold a bare value").isNull(), props_sorted(F.array_union(props, F.array(encode_value(value)))))


def props_union(a: Column, b: Column) -> Column:
    return props_sorted(F.array_union(a, b))


def props_intersect(a: Column, b: Column) -> Column:
    return props_sorted(F.array_intersect(a, b))


def props_except(a: Column, b: Column) -> Column:
    return props_sorted(F.array_except(a, b))


def signature(props: Column, parents: Column) -> Column:
    """Canonical text: sorted properties, then the sorted signatures of the parents."""
    return F.concat(F.array_join(F.array_sort(props), ","), F.lit(":["), F.array_join(F.array_sort(parents), ","), F.lit("]"))


def content_key(text: Column, length: int = 8) -> Column:
    """``length`` base-62 digits of SHA-256, most significant first; lengths to 8 stay within a long."""
    if not 1 <= length <= 8:
        raise ValueError("a key has 1 to 8 digits")
    size, chunk = 62**length, 12
    wide = lambda x: F.lit(str(x)).cast("decimal(18,0)")

    def number(digest: Column) -> Column:
        # Chunks of hexadecimal digits, each by its place's remainder; their sum has at most 30 digits.
        parts = [(F.conv(F.substring(digest, at + 1, min(chunk, 64 - at)), 16, 10).cast("decimal(18,0)"), pow(16, max(0, 64 - at - chunk), size)) for at in range(0, 64, chunk)]
        total = None
        for value, place in parts:
            term = (value * wide(place)).cast("decimal(38,0)")
            total = term if total is None else total + term
        return (total.cast("decimal(38,0)") % wide(size)).cast("long")

    digits = lambda n: F.concat(*(F.substring(F.lit(DIGITS), (F.call_function("div", n, F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1)) for k in range(length - 1, -1, -1)))
    # Both are named many times and evaluated once.
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return once(F.sha2(text, 256), lambda digest: once(number(digest), digits))


def instance_key(path: Column, type_key: Column, type_name: Column, library_key: Column) -> Column:
    """The key of a data instance: eight digits over its path, type and library."""
    return content_key(F.concat_ws("|", path, type_key, type_name, library_key), 8)
