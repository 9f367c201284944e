r"""Secrets in texts: fixed patterns, and strings too random to be words.

Candidate strings are runs of letters, digits and ``+/_=-``, cut into runs of one character
class: hexadecimal or base 64. A window of fixed width slides over each; the counts of its
characters are carried along, one entering and one leaving at each step, and with them the
sum of ``c * log2(c)`` that Shannon entropy needs. Windows over the class's threshold are joined
to spans. The allow-list suppresses what is known to be harmless: dates and stand-ins
(``HARMLESS_PARTS``) by themselves, what is left of a candidate as a whole (``_harmless``). Of
spans that touch a base span, what lies outside of it is given if it is as long as a window.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


@dataclass(frozen=True)
class Class:
    """A character class: ``pattern`` of a candidate, window ``width``, entropy ``threshold``."""

    kind: str
    pattern: str
    alphabet: str
    width: int
    threshold: float


LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    Class("entropy_hex", r"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{20,}(?![A-Za-z0-9+/_=-])",
          "0123456789abcdefABCDEF", 20, 2.9),
    Class("entropy_base64", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Za-z])"
          r"[A-Za-z0-9+/_=-]{20,}", f"{LOWER}{LOWER.upper()}0123456789+/_=-", 20, 3.7),
)
# UUIDs, numbers, words joined by signs. The regular expressions of Java call
# themselves for every round of a repeated group, so words are looked at one by one.
HARMLESS = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9+/_=-]+)$"
JOINED_BY, WORD = r"[+/_=-]+", r"^(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4})$"
# Dates and times; what stands between signs and holds a run of the alphabet or a
# stand-in for secrets in instructions, with at most 32 characters on either side of it.
HARMLESS_PARTS = (
    r"(?<![A-Za-z0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2,6}(?:Z|[+-][0-9]{2,4})?)?"
    r"|[A-Za-z0-9]{0,32}(?i:example|sample|placeholder|changeme|dummy|xxxx|abcdefgh|01234567|12345678)[A-Za-z0-9]{0,32})"
    r"(?![A-Za-z0-9])"
)
# Parts whose lengths are added up at a time.
RUN = 256
SIGNS = r"^[+/_=-]+|[+/_=-]+$"


# Entropies are compared as whole numbers of such parts of a bit, so that every engine agrees.
PARTS = 1_000_000


def weights(width: int) -> list[int]:
    """``c * log2(c)`` for counts up to ``width``, in parts."""
    return [round(c * log2(c) * PARTS) if c else 0 for c in range(width + 1)]


def most(of: Class) -> int:
    """The sum of ``c * log2(c)`` at which a window's entropy reaches the threshold."""
    return round((log2(of.width) - of.threshold) * of.width * PARTS)


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _starts(lengths: Column) -> Column:
    """Where each of several parts begins. Sums run inside runs of ``RUN`` parts and then over
    runs, as a list that grows is copied at each step."""

    def sums(parts: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(parts, state, lambda held, n: F.struct(
            (held["at"] + n).alias("at"), F.concat(held["starts"], F.array(held["at"])).alias("starts")), lambda held: held["starts"])

    def cut(parts: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda k: F.slice(parts, (k * RUN + 1).cast("int"), RUN))
        return _bound(runs, lambda r: F.flatten(F.zip_with(
            r, sums(F.transform(r, lambda run: F.aggregate(run, F.lit(0), lambda a, n: a + n)), F.lit(0)), sums)))

    return F.when(F.size(lengths) <= RUN, sums(lengths, F.lit(0))).otherwise(_bound(lengths, cut))


def _matches(text: Column, pattern: str, kind: str, ok=None) -> Column:
    """Spans ``(kind, start, end)`` of a pattern's matches, by the lengths of what lies between."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(
            F.length(gap).alias("gap"), m.alias("text")))
        return _bound(F.filter(steps, lambda s: s["text"].isNotNull()), spans)

    def spans(steps: Column) -> Column:
        def span(s: Column, at: Column) -> Column:
            start = at + s["gap"]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(s["text"])).alias("end"), s["text"].alias("text"))

        return F.zip_with(steps, _starts(F.transform(steps, lambda s: s["gap"] + F.length(s["text"]))), span)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")
    return _bound(found, lambda f: F.when(F.size(f) == 0, none).otherwise(placed(f)))


def _harmless(text: Column) -> Column:
    """Whether all of a text is a UUID, a number, or words joined by signs, which may end it."""
    words = lambda parts: (parts[0] != "") & F.forall(parts, lambda p: (p == "") | p.rlike(WORD))
    return text.rlike(HARMLESS) | _bound(F.split(text, JOINED_BY, -1), words)


def _suspect(of: Class, candidate: Column) -> Column:
    """What a candidate ``(start, text)`` holds beside harmless parts, as far as it is a candidate
    and not harmless itself."""
    text = candidate["text"]

    def left(found: Column) -> Column:
        steps = F.arrays_zip(F.split(text, HARMLESS_PARTS, -1).alias("gap"), found.alias("part"))
        return F.when(F.size(found) == 0, F.array(F.struct(candidate["start"].alias("start"), text.alias("text")))).otherwise(
            _bound(steps, gaps_of))

    def gaps_of(steps: Column) -> Column:
        lengths = F.transform(steps, lambda s: F.length(s["gap"]) + F.coalesce(F.length(s["part"]), F.lit(0)))
        return F.zip_with(steps, _starts(lengths), lambda s, at: F.struct((candidate["start"] + at).alias("start"), s["gap"].alias("text")))

    gaps = _bound(F.regexp_extract_all(text, F.lit(HARMLESS_PARTS), F.lit(0)), left)
    # Signs beside a part that was cut out belong to neither.
    bare = lambda g: F.when(g["text"] == text, text).otherwise(F.regexp_replace(g["text"], SIGNS, ""))
    return F.filter(gaps, lambda g: g["text"].rlike(of.pattern) & ~_harmless(bare(g)))


def _outside(span: Column, base: Column, width: int) -> Column:
    """The parts of a span between the base spans, sorted by start, of ``width`` or more."""
    state = F.struct(span["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("parts"))

    def until(held: Column, end: Column) -> Column:
        part = F.struct(held["at"].alias("start"), end.alias("end"))
        return F.when(end - held["at"] >= width, F.concat(held["parts"], F.array(part))).otherwise(held["parts"])

    def step(held: Column, b: Column) -> Column:
        return F.struct(F.greatest(held["at"], b["end"]).alias("at"), until(held, b["start"]).alias("parts"))

    near = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return F.aggregate(near, state, step, lambda held: until(held, span["end"]))


def _random_spans(of: Class, candidate: Column) -> Column:
    """Spans of a candidate's windows that reach the entropy threshold, joined where they meet.

    The counts are kept as a string with one character per letter of the alphabet; the code of
    a character is its count.
    """
    size, width = len(of.alphabet), of.width
    table = F.array(*(F.lit(w) for w in weights(width)))
    index = lambda c: F.instr(F.lit(of.alphabet), c)
    count = lambda counts, i: F.ascii(F.substring(counts, i, F.lit(1))) - 48
    put = lambda counts, i, n: F.overlay(counts, F.char(n + 48), i, F.lit(1))

    def slide(letters: Column) -> Column:
        def step(held: Column, at: Column) -> Column:
            def leave(old: Column) -> Column:
                def left(n: Column) -> Column:
                    return F.struct(
                        put(held["counts"], old, n - 1).alias("counts"),
                        (held["sum"] - F.get(table, n) + F.get(table, n - 1)).alias("sum"))

                return F.when(at < width, F.struct(held["counts"].alias("counts"), held["sum"].alias("sum"))).otherwise(
                    _bound(count(held["counts"], old), left))

            def enter(kept: Column) -> Column:
                def entered(new: Column) -> Column:
                    def added(n: Column) -> Column:
                        total = kept["sum"] - F.get(table, n) + F.get(table, n + 1)
                        hit = (at >= width - 1) & (total <= most(of))
                        begin = at - width + 1
                        spans = held["spans"]
                        last = F.element_at(spans, -1)
                        grown = F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))),
                                         F.array(F.struct(last["start"].alias("start"), (at + 1).alias("end"))))
                        fresh = F.concat(spans, F.array(F.struct(begin.alias("start"), (at + 1).alias("end"))))
                        touching = (F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["end"] >= begin)
                        return F.struct(
                            put(kept["counts"], new, n + 1).alias("counts"),
                            total.alias("sum"),
                            F.when(~hit, spans).when(touching, grown).otherwise(fresh).alias("spans"))

                    return _bound(count(kept["counts"], new), added)

                return _bound(index(F.get(letters, at)), entered)

            old = F.coalesce(index(F.get(letters, F.greatest(at - width, F.lit(0)))), F.lit(1))
            return _bound(_bound(old, leave), enter)

        none = F.array().cast("array<struct<start:int,end:int>>")
        start = F.struct(F.lit("0" * size).alias("counts"), F.lit(0).cast("int").alias("sum"), none.alias("spans"))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(letters) - 1), start, step, lambda held: held["spans"])

    return _bound(F.split(candidate, ""), slide)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each row of ``docs``.

    Returns ``doc_id``, ``base`` and ``spans``: arrays of ``(start, kind, end)`` in code points,
    end exclusive, by start, then by the order of ``KINDS``. A row gives a row, whatever its
    id; a null text counts as empty. Other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    # Texts without a match, nearly all, cost one search for each pattern.
    values = lambda: F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    assigned = _bound(values(), lambda value: F.filter(
        F.zip_with(_matches(t, ASSIGN, "assign"), value, lambda s, v: F.when(F.length(v) >= 6, s)),
        lambda s: s.isNotNull()))
    base = read.select(
        "doc_id", "text",
        F.concat(assigned, _matches(t, ACCESS, "access"), _matches(t, HEX, "hex")).alias("base"),
        *(_matches(t, of.pattern, of.kind).alias(of.kind) for of in CLASSES),
    )

    def added(of: Class) -> Column:
        sorted_base = F.array_sort(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))

        def spans(c: Column) -> Column:
            return F.transform(_random_spans(of, c["text"]), lambda s: F.struct(
                (c["start"] + s["start"]).alias("start"), (c["start"] + s["end"]).alias("end")))

        suspect = F.flatten(F.transform(F.col(of.kind), lambda c: _suspect(of, c)))
        found = F.flatten(F.transform(suspect, spans))
        fresh = _bound(sorted_base, lambda base: F.flatten(F.transform(found, lambda s: _outside(s, base, of.width))))
        return F.transform(fresh, lambda s: F.struct(
            F.lit(of.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("text")))

    def listed(spans: Column) -> Column:
        rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
        return F.transform(
            F.sort_array(F.transform(spans, lambda s: F.struct(
                s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))),
            lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return base.select("doc_id", listed(F.col("base")).alias("base"),
                       listed(F.concat("base", *map(added, CLASSES))).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
