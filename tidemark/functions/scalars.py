"""Column expressions shared by the operators and the plans. All of them stay in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes that the visit log and the webhook accept.
DASHBOARD_UID = r"/d(?:-solo)?/([^/]+)"
READING_NAME = r"\A[A-Za-z0-9_]+\z"
MAX_READINGS = 100
MAX_READING_LENGTH = 1000
QUERY_TEXT_LENGTH = 2000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_from(a: Column | str, b: Column | str) -> Column:
    """`a IS DISTINCT FROM b`."""
    return ~col(a).eqNullSafe(col(b))


def any_of(conditions: Iterable[Column]) -> Column:
    """OR over a list of conditions; false for an empty list."""
    conditions = list(conditions)
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: Iterable[Column]) -> Column:
    """AND over a list of conditions; true for an empty list."""
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def value_map(value: Column | str, mapping: Mapping, default=None) -> Column:
    """Simple CASE: each key of `mapping` to its value, anything else to `default`."""
    cases = list(mapping.items())
    chain = F.when(col(value) == F.lit(cases[0][0]), F.lit(cases[0][1]))
    for key, result in cases[1:]:
        chain = chain.when(col(value) == F.lit(key), F.lit(result))
    return chain.otherwise(F.lit(default))


def covers(start: Column | str, end: Column | str, ts: Column) -> Column:
    """Whether the half-open period [start, end) covers `ts`; a NULL bound is open."""
    begins = col(start).isNull() | (col(start) <= ts)
    goes_on = col(end).isNull() | (col(end) > ts)
    return begins & goes_on


def in_window(ts: Column | str, t_from: Column, t_to: Column) -> Column:
    """A dashboard time range: both ends included."""
    return col(ts).between(t_from, t_to)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1e6)


def clamped_delta(now: Column, before: Column) -> Column:
    """Counter growth. A reset counts as 0, and so does a missing predecessor."""
    return F.greatest(now - before, F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def slug(name: Column | str) -> Column:
    """A name as an identifier: runs of other characters become `_`, no digit in front."""
    # strip() in most languages removes any blank, trim() in SQL the space character only.
    lowered = F.lower(F.regexp_replace(col(name), r"^\s+|\s+$", ""))
    joined = F.regexp_replace(lowered, r"[^a-z0-9]+", "_")
    bare = F.regexp_replace(joined, r"^_+|_+$", "")
    return F.when(bare.rlike(r"^[0-9]"), F.concat(F.lit("t_"), bare)).otherwise(bare)


def first_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a pattern's group, NULL where nothing matches."""
    return F.when(col(text).rlike(pattern), F.regexp_extract(col(text), pattern, group))


def dashboard_uid(path: Column | str) -> Column:
    return first_match(path, DASHBOARD_UID)


def client_address(forwarded: Column | str, peer: Column | str) -> Column:
    """First address of the forwarding list, else the direct peer."""
    first = F.split_part(col(forwarded), F.lit(","), F.lit(1))
    return F.coalesce(F.nullif(first, F.lit("")), col(peer))


def session_hash(*cookies: Column | str) -> Column:
    """md5 of the first cookie that is not empty; md5('') when there is none."""
    present = [F.nullif(col(c), F.lit("")) for c in cookies]
    return F.md5(F.coalesce(*present, F.lit("")))


NO_SESSION = "d41d8cd98f00b204e9800998ecf8427e"
"""md5(''): visits without a cookie. They are visits, but not one session."""


def sha256(content: Column | str) -> Column:
    return F.sha2(col(content), 256)


def iso_timestamp(text: Column | str) -> Column:
    """ISO 8601 text as an instant, NULL if it is not one. Naive text is in the session zone.

    Only the shape date, `T` or blank, and at least hours and minutes counts as a date-time.
    """
    shape = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}(:\d{1,2}([.,]\d{1,9})?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?$"
    text = F.trim(col(text))
    # Spark wants seconds before a zone, and reads a zone written +02:00 but not +02 or +0200.
    text = F.regexp_replace(text, r"([T ]\d{1,2}:\d{1,2})(?=$|\s|Z|[+-])", "$1:00")
    zoned = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.regexp_replace(zoned, r"(:\d{1,2}(?:[.,]\d+)?)\s*([+-]\d{2})$", "$1$2:00")
    zoned = F.regexp_replace(zoned, ",", ".")
    return F.when(text.rlike(shape), F.try_to_timestamp(zoned))


def log_timestamp(text: Column | str) -> Column:
    """ISO 8601 text, or a date alone, as an instant; NULL for anything else, such as a year."""
    day = F.when(F.trim(col(text)).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(F.trim(col(text))))
    return F.coalesce(iso_timestamp(text), day)


def json_text(document: Column | str, field: str) -> Column:
    """`document ->> field` on a text column; NULL for bad JSON or a missing field."""
    return F.get_json_object(col(document), f"$.{field}")


def is_json(document: Column | str) -> Column:
    """Whether the text is exactly one JSON value of any kind, scalars included.

    The parser stops at the end of the first value and ignores what follows. Only a single value
    is valid both as the element of an array and as the member of an object. Objects that name a key twice
    are JSON with the settings of `tidemark.session`.
    """
    text = col(document)
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return element.isNotNull() & member.isNotNull()
