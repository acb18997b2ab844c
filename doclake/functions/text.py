"""Column builders over strings; all stay in whole-stage code."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that carry no search.
STOP_WORDS = frozenset("a an and are as at be by can did do does for from how in is it of on or that the this to was were what when where which who why will with".split())
# Characters that count as one token each (CJK and Hangul).
WIDE = "[\\u3000-\\u9FFF\\uAC00-\\uD7AF]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` worked out once, however often a lambda asks for it."""
    return F.transform(F.array(value), f)[0]


def runs_of(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, in order."""
    joined = lambda c, i: F.concat(*[F.get(c, i + k) for k in range(n)])
    return let(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - (n - 1), F.lit(0))), lambda _, i: joined(c, i)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


# A number that is no part of a name, with its sign.
NUMBER = "(?<![A-Za-z0-9_.])(?<![A-Za-z][-‐])[-+−]?[0-9]+(?:[.,][0-9]+)*"


def number_value(raw: Column) -> Column:
    """A written number: commas between groups of three are dropped, a single one is a decimal comma, others give null."""
    plain = F.replace(raw, F.lit("−"), F.lit("-"))
    groups = plain.rlike("^[^,]*(,[^,]{3})*,[^,.]{3}$")
    shown = F.when(groups, F.replace(plain, F.lit(","), F.lit(""))).when(plain.rlike("^[^,.]*,[^,.]*$"), F.replace(plain, F.lit(","), F.lit("."))).when(~F.contains(plain, F.lit(",")), plain)
    return shown.try_cast("double")


def numbers_in(text: Column) -> Column:
    """The values of the numbers in a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), number_value), lambda v: v.isNotNull())


def has_value(value: Column, text: Column) -> Column:
    """Whether a text states a value, to a part in a thousand million."""
    return F.exists(numbers_in(text), lambda v: F.abs(v - value) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(value)))


def wide_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, WIDE, ""))


def approx_tokens(text: Column) -> Column:
    """Wide characters count one each, others a quarter, rounded up."""
    wide = wide_count(text)
    return (wide + F.floor((F.length(text) - wide + 3) / 4)).cast("int")


#: Letters whose capitals are several, and those of them that also have one (Unicode's simple mapping).
_SEVERAL, _ONE = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"


def upper_by_letter(text: Column) -> Column:
    """Capitals letter by letter, as SQL's upper gives them: ẞ for ß; a letter whose capitals are several stays."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(F.translate(text, _SEVERAL, _ONE), ""), one), "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))


def html_text(html: Column) -> Column:
    """Plain text of a page: scripts and styles go, cell, row and line ends become spaces, tags vanish."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    spaced = F.regexp_replace(bare, "(?i)</(td|th|tr|p|div|li|h[1-6])>|<br[^>]*>", " ")
    plain = F.regexp_replace(spaced, "<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return collapse(plain)


# What separates the words of a query, and what is cut off their ends.
TERM = "[^\\s\"“”‘’，。；：！？、（）]+"
EDGE = "'.,;:!?()[]{}"


def query_terms(query: str) -> list[str]:
    """Words of a query, without stop words unless nothing else remains.  A literal: evaluated by the driver."""
    words = [w for w in (m.strip(EDGE) for m in re.findall(TERM, query)) if w]
    return [w for w in words if w.lower() not in STOP_WORDS] or words


def terms_of(query: Column) -> Column:
    """``query_terms`` of a column."""
    cut = "[" + re.escape(EDGE) + "]+"
    words = F.filter(F.transform(F.regexp_extract_all(query, F.lit(TERM), 0), lambda w: F.regexp_replace(w, f"^{cut}|{cut}$", "")), lambda w: w != "")
    content = F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def highlight(body: Column, terms: list[str], width: int = 160) -> Column:
    """The first ``width`` characters from a third of that before the first hit, all hits marked, cuts shown by dots."""
    at = F.least(*[F.nullif(F.locate(t.lower(), F.lower(body)), F.lit(0)) for t in [*terms, *terms[:1]]])
    start = F.greatest(F.lit(0), at - 1 - width // 3)
    any_term = "|".join(re.escape(t) for t in sorted(set(terms), key=len, reverse=True))
    marked = F.regexp_replace(F.substring(body, start + 1, F.lit(width)), f"(?i){any_term}", "\u0002$0\u0003")
    dots = F.when(start + width < F.length(body), "…").otherwise("")
    first = F.concat(F.left(body, F.lit(width)), F.when(F.length(body) > width, "…").otherwise(""))
    return F.when(at.isNull(), first).otherwise(F.concat(F.when(start > 0, "…").otherwise(""), marked, dots))


def sentences(text: Column) -> Column:
    """Pieces that end with a stop and white space, or a wide stop."""
    return F.filter(F.split(text, "(?<=[.!?;])\\s+|(?<=[。！？；])"), lambda s: s != "")


# Fixed value: bracketed groups of block ids inside a text.
INLINE_IDS = "\\s*[\\[【(（]\\s*(?:(?:d_[0-9a-fA-F]+#)?[bB][_-]?[0-9]+[\\s,，、;；]*)+[\\]】)）]"


def without_ids(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, INLINE_IDS, ""))


def occurrences(text: Column, term: str) -> Column:
    """Number of times a lower-cased term occurs, not overlapping."""
    low = F.lower(text)
    return F.expr("0") + ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / F.lit(len(term))).cast("int")


def decoration_key(text: Column) -> Column:
    """Running headers with other page numbers get one key."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), "[ \\t\\n\\r]+", "")


def content_hash(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("␞", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def normal_ids(text: Column) -> Column:
    """Distinct block ids, in order, of any way to write them: b_12, B-0012."""
    found = F.regexp_extract_all(text, F.lit("(?i)b[_-]([0-9]+)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("b_"), F.lpad(x.cast("int").cast("string"), 4, "0"))))
