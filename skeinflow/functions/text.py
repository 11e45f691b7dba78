"""Column functions over texts, urls and HTML; no Python runs on the executors except in fold().

Patterns get (?U) where classes of letters must be Unicode and (?iu) where case
must be ignored beyond ASCII. Null texts count as empty unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinflow.functions import fixed

# Latin letters whose decomposition begins with an ASCII letter, built from the Unicode tables.


def _folding(first: int = 0xC0, last: int = 0x24F) -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(first, last + 1)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_in(words, c: Column) -> Column:
    """Whether a word is in a list of literals."""
    return c.isin(*words)


def fold(c: Column | str) -> Column:
    """Latin letters without their marks; what is then not ASCII goes. Letters that become two (ligatures) go as well."""
    a, b = _folding()
    return F.regexp_replace(F.translate(_text(c), a, b), "[^\\x00-\\x7F]", "")


def stem(w: Column) -> Column:
    """Numbers stay, 350m and 1bn lose their letters, other words one suffix if three letters or more are left."""
    return (
        F.when(w.rlike("^[0-9]+$"), w)
        .when(w.rlike("^[0-9]+[mkb]n?$"), F.regexp_replace(w, "[a-z]+$", ""))
        .otherwise(bound(F.regexp_replace(w, fixed.SUFFIX, ""), lambda cut: F.when(F.length(cut) >= 3, cut).otherwise(w)))
    )


def stem_short(w: Column) -> Column:
    """The other stemmer: lower case, one of ies, es, s, ed, ing off the end."""
    return F.regexp_replace(F.lower(w), "(ies|es|s|ed|ing)$", "")


def _alias(w: Column) -> Column:
    return reduce(lambda rest, kv: F.when(w == kv[0], kv[1]).otherwise(rest), fixed.ALIASES.items(), w)


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def stems(c: Column | str, stop=fixed.STOP) -> Column:
    """Stems of a headline's words in order, repeats kept: three letters or more or a short name, not a stop word."""
    words = _found(F.lower(fold(c)), "[a-z0-9]+")
    kept = F.filter(words, lambda w: ((F.length(w) >= 3) | words_in(fixed.SHORT_WORDS, w)) & ~words_in(stop, w))
    return F.transform(F.transform(kept, _alias), stem)


def tokens(c: Column | str) -> Column:
    return F.array_distinct(stems(c))


def bigrams(c: Column | str, stems_: Column | None = None) -> Column:
    """Pairs of stems that follow each other, joined by a space, each once."""
    def pairs(s: Column) -> Column:
        n = F.greatest(F.size(s) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.concat_ws(" ", a, b)))

    return bound(stems(c), pairs) if stems_ is None else pairs(stems_)


CAPITALISED = "[A-Za-z][A-Za-z'\\x{00c0}-\\x{024f}]+"


def propers(c: Column | str) -> Column:
    """Stems of capitalised words after the first, of four letters or more, not stop words."""
    later = bound(_found(_text(c), CAPITALISED), lambda words: F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    kept = F.filter(later, lambda w: w.rlike("^[A-Z\\x{00c0}-\\x{00de}]") & (F.length(w) >= 4) & ~words_in(fixed.STOP, F.lower(w)))
    return F.array_distinct(F.transform(F.transform(F.transform(kept, lambda w: F.lower(fold(w))), _alias), stem))


def shared_propers(a: Column | str, b: Column | str, state_stems: Column) -> Column:
    """Stems of names that two headlines share, without words of the trade, of places and of courts' ranks. Where the
    first headline names nothing else but States, the States that they share. state_stems: stems of the words of States."""
    def names(c: Column | str) -> Column:
        words = _found(F.replace(_text(c), F.lit("-"), F.lit(" ")), CAPITALISED)
        later = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        kept = F.filter(later, lambda w: w.rlike("^[A-Z\\x{00c0}-\\x{00de}]") & (F.length(w) >= 3) & ~words_in(fixed.STOP, F.lower(w)))
        return F.array_distinct(F.transform(kept, lambda w: stem(F.lower(fold(w)))))

    common = F.transform(F.array(*[F.lit(w) for w in fixed.GENERIC]), stem)
    noise = F.array_union(F.array_union(common, state_stems), F.array(*[F.lit(w) for w in fixed.NAME_NOISE]))

    def shared(pa: Column, both: Column) -> Column:
        named = F.array_except(both, noise)
        only_states = F.size(F.array_except(pa, noise)) == 0
        return F.when(F.size(named) > 0, named).when(only_states, F.array_intersect(both, state_stems)).otherwise(F.array().cast("array<string>"))

    return bound(names(a), lambda pa: bound(F.array_intersect(pa, names(b)), lambda both: shared(pa, both)))


def stems5(c: Column | str, stop=fixed.STEM5_STOP) -> Column:
    """First five letters of words of four and more, each once."""
    words = _found(F.lower(_text(c)), "[a-z0-9]{4,}")
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~words_in(stop, w)), lambda w: F.substring(w, 1, 5)))


# --- urls --------------------------------------------------------------------------------------------------


def canonical_url(c: Column | str) -> Column:
    """Scheme and authority in lower case, no slashes at the path's end, no empty or tracking parameters, no fragment."""
    u = _text(c)
    bare = F.regexp_replace(u, "(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.when(scheme != "", F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*:", "")).otherwise(bare)
    authority = F.lower(F.regexp_extract(rest, "^//([^/?]*)", 1))
    tail = F.when(rest.startswith("//"), F.regexp_replace(rest, "^//[^/?]*", "")).otherwise(rest)
    path = F.regexp_replace(F.regexp_extract(tail, "(?s)^[^?]*", 0), "/+$", "")
    query = F.regexp_extract(tail, "(?s)\\?(.*)$", 1)
    tracking = "^(?:" + "|".join([*fixed.TRACKING_PREFIXES, *(f"{n}$" for n in fixed.TRACKING_NAMES)]) + ")"
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda q: (q != "") & ~F.regexp_extract(q, "^[^=]*", 0).rlike(tracking)), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
    )


def host(c: Column | str) -> Column:
    """Authority of a url in lower case without one www., amp. or m. before it; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(_text(c), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^(www|amp|m)\\.", "")


def title_key(c: Column | str) -> Column:
    """SHA-256 of a title's letters and digits in lower case."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " ")), 256)


def fingerprint(url: Column | str, title: Column | str) -> Column:
    """SHA-256 of the canonical url where there is one, else the title's key."""
    u = canonical_url(url)
    return F.when(u != "", F.sha2(u, 256)).otherwise(title_key(title))


def outlet_key(c: Column | str) -> Column:
    """A headline without what follows its last ' - ', letters and digits only."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(_text(c), " - [^-]*$", "")), "[^a-z0-9]+", " "))


def registrable(c: Column | str) -> Column:
    """The label that names an outlet in its host: the one before the suffix, also where that has two parts."""
    parts = F.split(host(c), "\\.")
    n = F.size(parts)
    second = F.try_element_at(parts, F.lit(-2)).isin("co", "com", "org", "net", "gov", "ac") & (F.length(F.try_element_at(parts, F.lit(-1))) == 2)
    return F.coalesce(F.when(second & (n >= 3), F.try_element_at(parts, F.lit(-3))).otherwise(F.try_element_at(parts, F.lit(-2))), F.lit(""))


def is_paywall(c: Column | str) -> Column:
    t = F.lower(F.trim(_text(c)))
    return (t == "") | reduce(lambda a, b: a | b, [t.startswith(p) for p in fixed.PAYWALL])


def outlet_rank(source: Column | str, url: Column | str, tiers: dict[int, tuple[str, ...]]) -> Column:
    """The first tier of which a key stands in source or host, else 4; keys of four letters or fewer as whole words."""
    text = F.lower(F.trim(F.concat_ws(" ", F.replace(_text(source), F.lit("Google News / "), F.lit("")), host(url))))

    def held(key: str) -> Column:
        return text.rlike(rf"(?U)(?<![\w.])\Q{key}\E(?!\w)") if len(key) <= 4 else F.contains(text, F.lit(key))

    out = F.lit(4)
    for tier in sorted(tiers, reverse=True):
        out = F.when(reduce(lambda a, b: a | b, [held(k.lower()) for k in tiers[tier]]), tier).otherwise(out)
    return out


# --- HTML --------------------------------------------------------------------------------------------------

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """The entities of XML, the apostrophe and the hard space; others stay as they are."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\s\\x{00a0}]+", " "))


def html_text(c: Column | str) -> Column:
    """Tags to spaces, entities decoded, white space collapsed; scripts and styles go whole."""
    t = F.regexp_replace(_text(c), "(?is)<(script|style)\\b.*?</\\1\\s*>", " ")
    return squeeze(unescape(F.regexp_replace(t, "<[^>]*>", " ")))


def html_list(c: Column | str) -> Column:
    """Items between line breaks, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(_text(c), "(?i)<br\\s*/?>", -1), lambda x: squeeze(unescape(F.regexp_replace(x, "<[^>]*>", " ")))), lambda x: x != "")


def html_links(c: Column | str) -> Column:
    """(href, label) of each anchor in order, labels cleaned."""
    pattern = "(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    hrefs, labels = (F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(hrefs, labels, lambda h, x: F.struct(h.alias("href"), squeeze(unescape(F.regexp_replace(x, "<[^>]*>", " "))).alias("label")))


def absolute_url(href: Column, page: Column) -> Column:
    """A link as seen from a page: whole urls stay, // and / are completed, others go beside the page."""
    scheme = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(page, "^[^?#]*", 0), "(?<=[^/:]/)[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder), href))
    )


def plain_text(c: Column | str) -> Column:
    """HTML as mail text: blocks end lines, tags go, runs of spaces and of blank lines shrink."""
    t = F.regexp_replace(_text(c), "(?is)<(script|style)\\b.*?</\\1\\s*>", "")
    t = F.regexp_replace(t, "(?i)</(?:p|div|tr|li|h[1-6]|table)\\s*>|<br\\s*/?>", "\n")
    t = unescape(F.regexp_replace(t, "<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \\t\\x{00a0}]+", " "), " ?\\n\\s*\\n\\s*", "\n\n"))


def page_summary(c: Column | str, least_words: int = 12, least_chars: int = 80) -> Column:
    """A page's description of enough words, else its first long paragraph that is no boilerplate, else empty."""
    meta = lambda name: squeeze(unescape(F.regexp_extract(_text(c), f"(?is)<meta[^>]+(?:name|property)=\"{name}\"[^>]*content=\"([^\"]*)\"", 1)))
    enough = lambda t: F.when(F.size(F.split(t, " ")) >= least_words, t)
    paragraphs = F.transform(F.regexp_extract_all(_text(c), F.lit("(?is)<p(?:\\s[^>]*)?>(.*?)</p>"), F.lit(1)), lambda p: squeeze(unescape(F.regexp_replace(p, "<[^>]*>", " "))))
    good = F.filter(paragraphs, lambda p: (F.length(p) >= least_chars) & ~p.rlike("(?i)cookie|subscribe|sign in|log in|advertis|©"))
    first = F.get(good, F.lit(0))
    return F.coalesce(
        enough(meta("og:description")), enough(meta("description")), enough(meta("twitter:description")),
        F.array_join(F.slice(F.split(first, " "), 1, 90), " "), F.lit(""),
    )


# --- sentences, languages, places ---------------------------------------------------------------------------


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.trim(_text(c)), fixed.SENTENCE, -1), lambda s: F.trim(s)), lambda s: s != "")


def slug(date: Column, title: Column | str, most: int = 70) -> Column:
    """Date and title in dashes."""
    words = F.regexp_replace(F.regexp_replace(F.lower(fold(title)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat_ws("-", date.cast("string"), F.regexp_replace(F.substring(words, 1, most), "-$", ""))


def upper_share(c: Column | str) -> Column:
    """Share of upper-case letters among letters; null without letters."""
    letters = F.regexp_count(_text(c), F.lit("(?U)\\p{L}"))
    return F.when(letters > 0, F.regexp_count(_text(c), F.lit("\\p{Lu}")) / letters)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def language(c: Column | str, default: str = "en") -> Column:
    """A guess from scripts, else from function words; ties go to the first language of the table."""
    t = _text(c)
    low = F.lower(t)
    others = [k for k in fixed.LANGUAGE_WORDS if k != "en"]

    def by_votes(v: Column) -> Column:
        best = reduce(lambda rest, k: F.when(v[k] == v["most"], k).otherwise(rest), reversed(others), F.lit(default))
        return F.when(v["n"] < 3, default).when((v["most"] >= 2) & (v["most"] > v["en"]), best).otherwise(default)

    def counted(words: Column) -> Column:
        of = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
        votes = {k: of(v.split()) for k, v in fixed.LANGUAGE_WORDS.items()}
        return F.struct(F.size(words).alias("n"), *[x.alias(k) for k, x in votes.items()])

    def with_most(v: Column) -> Column:
        return F.struct(v["n"].alias("n"), *[v[k].alias(k) for k in fixed.LANGUAGE_WORDS], F.greatest(*[v[k] for k in others]).alias("most"))

    words = F.regexp_extract_all(low, F.lit("\\p{L}+"), F.lit(0))
    guess = bound(bound(bound(words, counted), with_most), by_votes)
    cyrillic = (
        F.when(low.rlike("[іїєґ]"), "uk").when(low.rlike("[ыэъё]") | ~low.rlike("[іїє]"), "ru").otherwise("uk")
    )

    def by_script(letters: Column) -> Column:
        out = F.when(letters == 0, default)
        for chars, code in fixed.SCRIPTS:
            out = out.when(F.regexp_count(t, F.lit(f"[{chars}]")) >= 0.3 * letters, code)
        return out.when(F.regexp_count(t, F.lit("[\\x{0400}-\\x{04FF}]")) >= 0.3 * letters, cyrillic).otherwise(guess)

    # Without a letter beyond the Greek ones no script can have its share.
    return F.when(~t.rlike("[\\x{0400}-\\x{10FFFF}]"), guess).otherwise(bound(F.regexp_count(t, F.lit("\\p{L}")), by_script))


def places(c: Column | str, forms: dict[str, str]) -> Column:
    """Canonical names of the places that a text names, in order of appearance, each once. Longest form first;
    a form next to a letter, digit or hyphen is no match, and case counts. A hyphen between a letter and a capital
    parts two names, unless it is in a form of its own. For short tables: each form stands in the plan
    (operators.gazetteer takes tables of any size)."""
    if not forms:
        return F.array().cast("array<string>")
    alternatives = "|".join(rf"\Q{f}\E" for f in sorted(forms, key=lambda f: (-len(f), f)))
    text = _text(c)
    for f in (f for f in forms if "-" in f):
        text = F.replace(text, F.lit(f), F.lit(f.replace("-", "\u2011")))
    text = F.replace(F.regexp_replace(text, r"(?<=\p{L})-(?=[A-Z\x{C0}-\x{DD}])", " "), F.lit("\u2011"), F.lit("-"))
    found = F.regexp_extract_all(text, F.lit(rf"(?U)(?<![\w-])(?:{alternatives})(?![\w-])"), F.lit(0))
    lookup = F.create_map(*[F.lit(x) for kv in sorted(forms.items()) for x in kv])
    return F.array_distinct(F.transform(found, lambda f: F.element_at(lookup, f)))


def topics(c: Column | str, forms: dict[str, str], capitals: dict[str, str] | None = None) -> Column:
    """'measure|place' of each measure and place that a text names; empty where it names none of either."""
    t = _text(c)
    measures = F.filter(F.array(*[F.when(t.rlike(f"(?i){p}"), m) for m, p in fixed.MEASURES]), lambda m: m.isNotNull())
    low = F.lower(fold(t))
    by_city = [F.when(low.rlike(rf"\b\Q{k}\E\b"), v) for k, v in (capitals or {}).items()]
    by_city.append(F.when(t.rlike(f"(?i){fixed.REGION}"), "eu"))
    where = F.array_distinct(F.concat(F.transform(places(t, forms), lambda p: F.lower(fold(p))), F.filter(F.array(*by_city), lambda p: p.isNotNull())))
    return F.flatten(F.transform(measures, lambda m: F.transform(where, lambda p: F.concat_ws("|", m, p))))
