"""Secrets in texts: patterns of known kinds, and strings too random to be words.

Everything here is DataFrame functions. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# The lookbehind stops the search from trying every end of a long run.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

# Numbers merged in one go where an array has a running sum, and characters of a text cut at a time.
CHUNK, TEXT_CHUNK = 128, 4_096
# Bits of a count of up to 20, and counts in a long.
COUNT_BITS, PER_WORD = 5, 12

KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGNED = 12
WINDOW = 20


class CharClass(NamedTuple):
    """Strings that match `pattern` count as random from `bits` of entropy in some window on."""

    pattern: str
    bits: float


# The first class that fits holds. Letters alone have to be nearly all different: compounds of many
# syllables reach 3.9 bits in 20 letters. No entropy of 20 characters equals one of these bounds.
CLASSES = (
    CharClass(r"^[0-9a-fA-F]+$", 3.01),
    CharClass(r"^[A-Za-z/_-]+=*$", 4.11),
    CharClass(r"^[A-Za-z0-9+/_-]+=*$", 3.61),
)

# Strings of these shapes are no secrets: UUIDs, dates and counters, sample keys of manuals.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9+/_-]+$",
    r"(?i)example",
)


def _spans(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, kind, end, found>> of the leftmost matches, those with a short group dropped.

    A match starts behind all the text between matches so far, and all matches so far; a Spark regex
    function gives no positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # No match, no second search.
    between = F.when(F.size(found) > 0, F.split(text, pattern, -1))
    steps = F.arrays_zip(
        found.alias("found"), inner.alias("inner"), F.slice(between, 1, F.size(found)).alias("before")
    )

    def placed(steps: Column) -> Column:
        before = _before_each(F.transform(steps, lambda m: F.length(m["before"]) + F.length(m["found"])), lambda a, b: a + b)
        pairs = F.filter(F.arrays_zip(steps.alias("match"), before.alias("after")), lambda p: F.length(p["match"]["inner"]) >= least)
        return F.transform(
            pairs,
            lambda p: F.struct(
                (p["after"] + F.length(p["match"]["before"])).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (p["after"] + F.length(p["match"]["before"]) + F.length(p["match"]["found"])).alias("end"),
                p["match"]["found"].alias("found"),
            ),
        )

    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    return F.when(F.size(found) > 0, _let(steps, placed)).otherwise(none)


def _let(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before_each(numbers: Column, merge, levels: int = 3) -> Column:
    """For each number the merge of 0 and all numbers before it.

    Chunk by chunk, each from the merge of the chunks before. A step copies one chunk at most, so that the work is linear up to
    `CHUNK` to the power of `levels` numbers.
    """

    def within(chunk: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("seen"))
        step = lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))
        return F.aggregate(chunk, state, step, lambda s: s["seen"])

    if levels == 1:
        return within(numbers, F.lit(0))

    def chunked(numbers: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(CHUNK))
        return _let(F.transform(starts, lambda i: F.slice(numbers, i, CHUNK)), merged)

    def merged(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), merge))
        zipped = F.arrays_zip(chunks.alias("chunk"), _before_each(totals, merge, levels - 1).alias("start"))
        return F.flatten(F.transform(zipped, lambda z: within(z["chunk"], z["start"])))

    return _let(numbers, chunked)


def peak_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of `window` neighbouring characters; 0 for shorter texts.

    The sum of c*log2(c) over the counts c of a window follows from the one before by the counts of
    the character that leaves and of the one that enters. The counts are kept from step to step, `PER_WORD` to a number; a
    step takes one from the first and gives one to the second. They cover ASCII from "+" to "z", all that keys are made of.
    """
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    of = lambda c: F.get(weight, c)
    names = [f"count{i}" for i in range(-(-(ord("z") - ord("+") + 1) // PER_WORD))]
    code = lambda ch: F.ascii(ch) - ord("+")
    place = lambda ch: (code(ch) % PER_WORD) * COUNT_BITS
    one = lambda ch: F.call_function("shiftleft", F.lit(1).cast("long"), place(ch))

    def changed(counts: list[Column], ch: Column, by: int) -> list[Column]:
        word = F.floor(code(ch) / PER_WORD)
        return [c + F.when(word == i, one(ch) * by).otherwise(F.lit(0)) for i, c in enumerate(counts)]

    def count(counts: list[Column], ch: Column) -> Column:
        word = F.get(F.array(*counts), F.floor(code(ch) / PER_WORD).cast("int"))
        return F.call_function("shiftright", word, place(ch)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def leave(state, ch):
        gone = F.get(state["chars"], F.lit(0))
        counts = [state[n] for n in names]
        n = count(counts, gone)
        less = F.struct(
            F.slice(state["chars"], 2, window).alias("chars"),
            (state["total"] + of(n - 1) - of(n)).alias("total"),
            state["peak"].alias("peak"),
            *(c.alias(name) for c, name in zip(changed(counts, gone, -1), names)),
        )
        return F.when(F.size(state["chars"]) == window, less).otherwise(state)

    def enter(state, ch):
        counts = [state[n] for n in names]
        n = count(counts, ch)
        total = state["total"] + of(n + 1) - of(n)
        complete = F.size(state["chars"]) >= window - 1
        bits = F.when(complete, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        return F.struct(
            F.concat(state["chars"], F.array(ch)).alias("chars"),
            total.alias("total"),
            F.greatest(state["peak"], bits).alias("peak"),
            *(c.alias(name) for c, name in zip(changed(counts, ch, 1), names)),
        )

    first = F.struct(
        F.array().cast("array<string>").alias("chars"),
        F.lit(0.0).alias("total"),
        F.lit(0.0).alias("peak"),
        *(F.lit(0).cast("long").alias(n) for n in names),
    )
    step = lambda state, ch: _let(leave(state, ch), lambda left: enter(left, ch))
    return F.aggregate(F.split(text, ""), first, step, lambda s: s["peak"])


def _random(found: Column, classes: tuple[CharClass, ...], allowed: tuple[str, ...]) -> Column:
    bound = F.coalesce(*(F.when(found.rlike(c.pattern), F.lit(c.bits)) for c in classes))
    listed = F.lit(False)
    for pattern in allowed:
        listed = listed | found.rlike(pattern)
    return ~listed & (peak_entropy(found) > bound)


def secret_spans(
    text: Column, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED
) -> Column:
    """array<struct<start, kind, end>>, by start, then kind; null text has none.

    `kind` is an index of KINDS. Three kinds are patterns; `entropy` are runs of 20 or more
    characters of keys with a window of high entropy for their class of characters, unless they look
    like something allowed. The window is a constant of the method, the run is reported whole.
    """
    text = F.coalesce(text, F.lit(""))
    random = F.filter(_spans(text, CANDIDATE, "entropy"), lambda s: _random(s["found"], classes, allowed))
    every = F.concat(
        _spans(text, ASSIGN, "assign", 2, LEAST_ASSIGNED),
        _spans(text, ACCESS, "access"),
        _spans(text, HEX, "hex"),
        random,
    )
    return F.array_sort(
        F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, spans) per row, without a shuffle. Empty and null texts have no spans."""
    return documents.select(F.col(doc_id).alias("doc_id"), secret_spans(F.col(text), **options).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*(F.lit(k) for k in KINDS)), k + 1)
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or each union of overlapping spans, replaced by `mark`."""


    def marked(spans: Column) -> Column:
        # The furthest end of the spans before each: where the text that is kept goes on.
        before = _before_each(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        apart = F.filter(F.arrays_zip(spans.alias("span"), before.alias("at")), lambda z: z["span"]["start"] >= z["at"])
        starts = F.sequence(F.lit(1), F.length(text), F.lit(TEXT_CHUNK))
        chunks = F.transform(starts, lambda i: F.substring(text, i, F.lit(TEXT_CHUNK)))
        return _let(apart, lambda apart: _let(chunks, lambda chunks: pieces(spans, apart, chunks)))

    def pieces(spans: Column, apart: Column, chunks: Column) -> Column:
        def part(low: Column, high: Column) -> Column:
            # Of the few chunks that hold it: to find a place in a text takes as long as the text before it.
            first = F.floor(low / TEXT_CHUNK).cast("int")
            several = F.slice(chunks, first + 1, F.floor((high - 1) / TEXT_CHUNK).cast("int") - first + 1)
            cut = F.substring(F.array_join(several, ""), low - first * TEXT_CHUNK + 1, high - low)
            return F.when(high > low, cut).otherwise("")

        kept = F.transform(apart, lambda z: F.concat(part(z["at"], z["span"]["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), part(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) > 0, _let(spans, marked)).otherwise(text)
