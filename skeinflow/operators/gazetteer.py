"""Names from a table of surface forms, found in one pass over a text.

The table may have any number of forms in any script. Its size is counted; it is
sent to the tasks in parts of at most `part_chars` characters, as automatons that
find all forms of a part at once. With several parts the finds of all of them are
put together before overlaps are settled, so the result does not depend on it.

A match is the longest form at the leftmost place. A form next to a letter, a
digit, an underscore or a hyphen is none, and case counts. A hyphen between a
letter and a capital parts two names, unless it is in a form of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import fixed

#: Stands for a hyphen of a form's own while other hyphens go.
OWN_HYPHEN = "‑"
SPANS = "array<struct<start:int,end:int,form:string,name:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("form", pa.string()), ("name", pa.string())]))


def _automaton(keys: Iterator[tuple[str, object]]):
    out = ahocorasick.Automaton()
    for key, value in keys:
        out.add_word(key, value)
    if len(out):
        out.make_automaton()
        return out
    return None


def _joins(char: str) -> bool:
    return char.isalnum() or char in "_-"


class Forms:
    """A part of the table; its automatons are made where they are first asked for, once a process."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs

    def __getstate__(self):
        return {"pairs": self.pairs}

    @cached_property
    def whole(self):
        return _automaton((form, (form, name)) for form, name in self.pairs)

    @cached_property
    def hyphened(self):
        return _automaton((form, form) for form, _ in self.pairs if "-" in form)

    @cached_property
    def by_name(self):
        out: dict[str, list[str]] = {}
        for form, name in sorted(self.pairs):
            out.setdefault(name, []).append(form)
        return out

    @cached_property
    def lower(self):
        """Every form in lower case, and its first letters, with the names that have it."""
        keys: dict[str, set[str]] = {}
        for form, name in self.pairs:
            keys.setdefault(form.lower(), set()).add(name)
            if len(form) >= fixed.STATE_STEM:
                keys.setdefault(form[: fixed.STATE_STEM].lower(), set()).add(name)
        return _automaton((k, sorted(v)) for k, v in keys.items())

    def guarded(self, text: str) -> str:
        """The text with OWN_HYPHEN for the hyphens within forms."""
        if "-" not in text or self.hyphened is None:
            return text
        chars = None
        for last, form in self.hyphened.iter(text):
            chars = chars or list(text)
            chars[last + 1 - len(form) : last + 1] = form.replace("-", OWN_HYPHEN)
        return "".join(chars) if chars else text

    def longest(self, text: str, least: int) -> list[tuple[int, int, str, str]]:
        """The longest form (of `least` characters or more) at each place where one stands free, ascending."""
        best: dict[int, tuple[int, int, str, str]] = {}
        if self.whole is not None:
            n = len(text)
            for last, (form, name) in self.whole.iter(text):
                end, start = last + 1, last + 1 - len(form)
                if len(form) < least or (end < n and _joins(text[end])) or (start and _joins(text[start - 1])):
                    continue
                if start not in best or best[start][1] < end:
                    best[start] = (start, end, form, name)
        return [best[k] for k in sorted(best)]


def _settled(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Leftmost first, longest of those at one place, none overlapping."""
    out, reached = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[0] >= reached:
            out.append(s)
            reached = s[1]
    return out


def _told(spans: list[tuple[int, int, str, str]]) -> list[dict]:
    return [dict(zip(("start", "end", "form", "name"), s, strict=True)) for s in spans]


def _each(kind: str, arrow: pa.DataType, sent, f):
    """A column function that gives f(a part of the table, value) for every value."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return in_runs(values, arrow, lambda v: f(sent.value, v))

    return run


def in_runs(values: pa.Array, arrow: pa.DataType, f, most: int = 1 << 20) -> pa.Array:
    """f of every value. Python's objects stand for values of about `most` bytes at a time, not for a whole batch."""
    text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist() if text else [64] * len(values)
    out, start, total = [], 0, 0
    for i, n in enumerate([*sizes, most]):
        if (total and total + n > most) or i == len(sizes):
            out.append(pa.array([f(v) for v in values.slice(start, i - start).to_pylist()], arrow))
            start, total = i, 0
        total += n
    return pa.concat_arrays(out)


class Gazetteer:
    """From a DataFrame (form, name). Null and empty forms and null names are left out; of several names of one form the
    least one counts. Texts that are null have no names."""

    def __init__(self, forms: DataFrame, part_chars: int = 16 << 20):
        spark = forms.sparkSession
        table = forms.where((F.col("form") != "") & F.col("name").isNotNull()).groupBy("form").agg(F.min("name").alias("name"))
        size = table.agg(F.coalesce(F.sum(F.length("form") + F.length("name")), F.lit(0))).first()[0]
        parts = max(1, -(-size // part_chars))
        part = F.pmod(F.xxhash64("form"), F.lit(parts))
        told = [[tuple(r) for r in table.where(part == p).select("form", "name").collect()] for p in range(parts)]
        self.parts = [spark.sparkContext.broadcast(Forms(pairs)) for pairs in told]
        self.hyphened = [sent for sent, pairs in zip(self.parts, told, strict=True) if any("-" in form for form, _ in pairs)]

    def _guarded(self, c: Column) -> Column:
        for sent in self.hyphened:  # no other part changes a text
            c = _each("string", pa.string(), sent, lambda forms, t: None if t is None else forms.guarded(t))(c)
        return c

    def parted(self, c: Column) -> Column:
        """The text with a space for each hyphen that parts names."""
        text = F.regexp_replace(self._guarded(c), r"(?<=\p{L})-(?=[A-Z\x{C0}-\x{DD}])", " ")
        return F.replace(text, F.lit(OWN_HYPHEN), F.lit("-"))

    def spans(self, c: Column, least: int = 1) -> Column:
        """The matches in a text as it is, with their places (characters, end exclusive)."""
        alone = len(self.parts) == 1

        def match(forms: Forms, text: str | None) -> list[dict]:
            found = forms.longest(text or "", least)
            return _told(_settled(found) if alone else found)

        found = [_each(SPANS, _SPAN, sent, match)(c) for sent in self.parts]
        if alone:
            return found[0]

        @F.arrow_udf(SPANS)
        def settle(spans: pa.Array) -> pa.Array:
            return pa.array([_told(_settled([tuple(s.values()) for s in row])) for row in spans.to_pylist()], _SPAN)

        return settle(F.concat(*found))

    def places(self, c: Column | str) -> Column:
        """The names of the places in a text, in order of appearance, each once."""
        return F.array_distinct(F.transform(self.spans(self.parted(_column(c))), lambda s: s["name"]))

    def flat(self, c: Column | str) -> Column:
        """A headline without possessives, its other hyphens and slashes as spaces, every form of four letters or more under its name."""
        text = F.regexp_replace(F.regexp_replace(self._guarded(F.coalesce(_column(c), F.lit(""))), "[-/]", " "), "(?U)(?<=\\w)['’](?:s\\b)?", "")
        text = F.replace(text, F.lit(OWN_HYPHEN), F.lit("-"))

        @F.arrow_udf("string")
        def renamed(texts: pa.Array, spans: pa.Array) -> pa.Array:
            out = []
            for text, row in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                for s in reversed(row):
                    text = text[: s["start"]] + s["name"] + text[s["end"] :]
                out.append(text)
            return pa.array(out, pa.string())

        return renamed(text, self.spans(text, 4))

    def known(self, names: Column) -> Column:
        """For an array of words, the name of each that is a form, null for the others."""

        def look(forms: Forms, row: list | None) -> list | None:
            table = forms.whole
            return None if row is None else [table.get(x, (None, None))[1] if x and table is not None else None for x in row]

        found = [_each("array<string>", pa.list_(pa.string()), sent, look)(names) for sent in self.parts]
        out = found[0]
        for more in found[1:]:
            out = F.zip_with(out, more, lambda a, b: F.coalesce(a, b))
        return out

    def forms_of(self, names: Column) -> Column:
        """For an array of names of the table, the forms of each, in order; an empty list for a null or another word."""
        look = lambda forms, row: None if row is None else [forms.by_name.get(x, []) for x in row]
        found = [_each("array<array<string>>", pa.list_(pa.list_(pa.string())), sent, look)(names) for sent in self.parts]
        out = found[0]
        for more in found[1:]:
            out = F.zip_with(out, more, lambda a, b: F.array_sort(F.concat(a, b)))
        return out

    def mentions(self, c: Column | str) -> Column:
        """The names of which any form, or its first five letters, occurs anywhere in a text, case and word ends aside."""

        def mention(forms: Forms, text: str | None) -> list[str]:
            return [] if forms.lower is None else sorted({n for _, names in forms.lower.iter((text or "").lower()) for n in names})

        return F.array_distinct(F.concat(*[_each("array<string>", pa.list_(pa.string()), sent, mention)(_column(c)) for sent in self.parts]))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sovereign(c: Column) -> Column:
    """Whether a text has a word that only a sovereign party is called by."""
    return F.lower(c).rlike(fixed.SOVEREIGN)


def parties_named(names: Column, known: Column, mentioned: Column, text: Column, *, need_party: bool = True, tight: Column | None = None) -> Column:
    """Whether a text carries the parties `names`.

    `known` has for each of them its name as a State, or null for a company (Gazetteer.known), `mentioned` the States
    that the text mentions under any form (Gazetteer.mentions). A company of four letters or more counts where its
    name stands in the text, case aside. Without need_party any party or State will do. With it a company is asked
    for, or two States; where `tight` holds, and no company is named, one State with a word that shows a sovereign
    party is enough. Null lists name nobody.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    both = F.coalesce(F.arrays_zip(names.alias("name"), known.alias("state")), F.array().cast("array<struct<name:string,state:string>>"))
    company = F.exists(both, lambda b: b["state"].isNull() & (F.length(b["name"]) > 3) & F.contains(low, F.lower(b["name"])))
    held = F.size(F.filter(both, lambda b: b["state"].isNotNull() & F.array_contains(mentioned, b["state"])))
    if not need_party:
        return F.coalesce(company | (held >= 1), F.lit(False))
    out = company | (held >= 2)
    if tight is not None:
        out = out | (tight & (held >= 1) & sovereign(low) & ~F.exists(both, lambda b: b["state"].isNull()))
    return F.coalesce(out, F.lit(False))
