"""Text, time and address columns: log cleaning, timestamps, type names, transfer addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The timestamp of logs, and what a terminal escape looks like.
STAMP = "yyyy-MM-dd_HH-mm-ss"
ESCAPE = "\\x1b(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])"
#: Transfer types in the order in which they are carried out.
TYPES = ["GLOBUS", "SSH", "HTTP", "SYMLINK", "DIRECT"]


def std_time(time: Column) -> Column:
    """A timestamp as log text."""
    return F.date_format(time, STAMP)


def parse_std_time(text: Column) -> Column:
    """The timestamp of log text; null if it is none."""
    return F.try_to_timestamp(text, F.lit(STAMP))


def millis(time: Column) -> Column:
    return F.unix_millis(time)


def text_clean(text: Column) -> Column:
    """Text without terminal escapes and line ends after it."""
    return F.regexp_replace(F.regexp_replace(text, ESCAPE, ""), "[\\r\\n]+$", "")


def dedented(text: Column) -> Column:
    """Lines without the indent of the first line that isn't empty, and without white space around the whole.

    A line end after the text stays if the last line has nothing but the indent.
    """
    lines = F.split(text, "\n")
    cut = F.coalesce(F.char_length(F.regexp_extract(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), "^[ \t]*", 0)), F.lit(0))
    bare = F.transform(lines, lambda x: F.substring(x, cut + 1, F.char_length(x)))
    whole = F.regexp_replace(F.array_join(bare, "\n"), "^\\s+|\\s+$", "")
    return F.concat(whole, F.when(F.element_at(bare, -1) == "", "\n").otherwise(""))


def dtype_namespace(name: Column) -> Column:
    """The namespace of ``ns::name`` or ``lib::ns::name``."""
    parts = F.split(name, "::")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))


def dtype_name(name: Column) -> Column:
    """The bare name of ``ns::name`` or ``lib::ns::name``."""
    return F.element_at(F.split(name, "::"), -1)


def dtype_library(name: Column) -> Column:
    parts = F.split(name, "::")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(0)))


def index_value(value: Column) -> Column:
    """An index key of a list: its members joined by ``_``."""
    return F.array_join(value, "_")


def json_document(*columns: str) -> Column:
    """The compact JSON of some columns."""
    return F.to_json(F.struct(*columns))


def json_keys(document: Column) -> Column:
    return F.json_object_keys(document)


def _globus_url(address: Column) -> Column:
    return address.rlike("^https?://app\\.globus\\.org(?:[/?#]|$)")


def _query_part(address: Column, name: str) -> Column:
    """The first value of origin_ or else destination_ ``name`` in the query of a URL, decoded."""
    of = lambda side: F.nullif(F.regexp_extract(address, f"[?&]{side}_{name}=([^&#]*)", 1), F.lit(""))
    return F.url_decode(F.coalesce(of("origin"), of("destination")))


def address_type(address: Column) -> Column:
    """The transfer type that an address speaks: GLOBUS, SSH, HTTP or DIRECT (a path)."""
    return (
        F.when(address.startswith("globus://") | _globus_url(address), "GLOBUS")
        .when(address.startswith("ssh://"), "SSH")
        .when(address.rlike("^(?:https?|ftp)://"), "HTTP")
        .otherwise("DIRECT")
    )


def address_endpoint(address: Column) -> Column:
    """Endpoint of a GLOBUS address, host of an SSH or HTTP one, empty for a path."""
    return (
        F.when(_globus_url(address), _query_part(address, "id"))
        .when(address.rlike("^(?:globus|ssh)://"), F.regexp_extract(address, "^[a-z]+://([^:]*)", 1))
        .when(address_type(address) == "HTTP", F.regexp_extract(address, "^[a-z]+://([^/?#]*)", 1))
        .otherwise("")
    )


def address_path(address: Column) -> Column:
    """The path of an address; for HTTP without query and fragment."""
    return (
        F.when(_globus_url(address), _query_part(address, "path"))
        .when(address.rlike("^(?:globus|ssh)://"), F.regexp_extract(address, "^[a-z]+://[^:]*:?(.*)$", 1))
        .when(address_type(address) == "HTTP", F.regexp_extract(address, "^[a-z]+://[^/?#]*([^?#]*)", 1))
        .otherwise(address)
    )


def with_path(address: Column, path: Column) -> Column:
    """The address with another path."""
    kind, end = address_type(address), address_endpoint(address)
    return (
        F.when(kind == "GLOBUS", F.concat(F.lit("globus://"), end, F.lit(":"), path))
        .when(kind == "SSH", F.concat(F.lit("ssh://"), end, F.lit(":"), path))
        .when(kind == "HTTP", F.concat(F.regexp_extract(address, "^([a-z]+://)", 1), end, path))
        .otherwise(path)
    )


def child(address: Column, name: Column) -> Column:
    """The address of something below."""
    return with_path(address, F.concat_ws("/", F.regexp_replace(address_path(address), "/+$", ""), name))


def relocated(path: Column, inside: Column, outside: Column) -> Column:
    """A path below ``inside`` as one below ``outside``; others stay."""
    return F.when((path == inside) | F.startswith(path, F.concat(inside, F.lit("/"))), F.concat(outside, F.substring(path, F.char_length(inside) + 1, F.char_length(path)))).otherwise(path)


def address_name(address: Column) -> Column:
    """The last part of the path."""
    return F.regexp_extract(address_path(address), "([^/]*)/*$", 1)


def address_stem(address: Column) -> Column:
    """The last part of the path without its last extension."""
    return F.regexp_replace(address_name(address), "(?<=.)\\.[^.]*$", "")


def priority(kind: Column) -> Column:
    """The place of a transfer type in the order of execution, from 1."""
    return F.array_position(F.array(*map(F.lit, TYPES)), kind)
