"""Parsing of dirty text as Column expressions: names, measures, clocks, records, dates, pages."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with marks and their plain forms, in the same order.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžćčđł"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyszccdl"
# Name suffixes that don't tell people apart.
SUFFIX = r" (jr|sr|ii|iii|iv)\.?$"


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def plain_name(x: Column) -> Column:
    """Lower case, without marks and suffix, single blanks."""
    folded = squeezed(F.translate(F.lower(x), MARKED, PLAIN))
    return F.trim(F.regexp_replace(folded, SUFFIX, ""))


def folded(x: Column) -> Column:
    """Lower case, without marks."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def slug(x: Column) -> Column:
    kept = F.regexp_replace(F.translate(F.lower(x), MARKED, PLAIN), r"[^a-z0-9 -]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(kept), r"[ ]+", "-"), r"-+", "-")


def last_token(x: Column) -> Column:
    return F.element_at(F.split(squeezed(x), " "), -1)


def same_name(a: Column, b: Column) -> Column:
    """Equal, or the same last token, or one contains the other."""
    x, y = plain_name(a), plain_name(b)
    return (x == y) | (last_token(x) == last_token(y)) | x.contains(y) | y.contains(x)


def fuzzy_name(a: Column, b: Column, edits: int = 2) -> Column:
    """One contains the other, or lengths and letters differ by at most `edits`."""
    x, y = plain_name(a), plain_name(b)
    close = (F.abs(F.length(x) - F.length(y)) <= edits) & (F.levenshtein(x, y) <= edits)
    return x.contains(y) | y.contains(x) | close


def number(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(x, pattern, group).try_cast("double")


def height_cm(x: Column) -> Column:
    """5' 11\" in centimetres."""
    return (number(x, r"(\d+)'", 1) * 12 + F.coalesce(number(x, r"'\s*(\d+)", 1), F.lit(0.0))) * 2.54


def reach_cm(x: Column) -> Column:
    """72\" in centimetres; numbers above 100 are centimetres already."""
    n = number(x, r"([\d.]+)")
    return F.when(n > 100, n).otherwise(n * 2.54)


def pounds(x: Column) -> Column:
    return number(x, r"([\d.]+)\s*(?:lbs?)?")


def percent(x: Column) -> Column:
    """'47%' as 47.0."""
    return F.regexp_replace(F.trim(x), "%", "").try_cast("double")


def record(x: Column, part: int) -> Column:
    """Part 1 to 3 of '15-3-1'."""
    return F.regexp_extract(x, r"(\d+)-(\d+)-(\d+)", part).try_cast("int")


def result(x: Column) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t.contains("win"), "win").when(t.contains("loss"), "loss").when(t.contains("draw"), "draw").when(t.contains("nc") | t.contains("no contest"), "nc")


def method(x: Column) -> Column:
    t = F.upper(x)
    return F.when(t.contains("KO"), "KO").when(t.contains("SUB"), "SUB").when(t.contains("DEC"), "DEC").otherwise("OTHER")


def clock_minutes(round_: Column, clock: Column) -> Column:
    """Minutes of a contest that ended in a round at m:ss (rounds of five minutes): 15 without round, at least half a minute."""
    m, s = number(clock, r"^(\d+):(\d+)$", 1), number(clock, r"^(\d+):(\d+)$", 2)
    minutes = F.coalesce((round_ - 1) * 5 + m + s / 60, round_ * 5.0)
    return F.when(minutes.isNull(), 15.0).otherwise(F.greatest(F.lit(0.5), minutes))


def parse_date(x: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "MMM dd, yyyy", "MMMM dd, yyyy", "dd MMM yyyy")) -> Column:
    """The first format that fits."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.trim(x), F.lit(f))) for f in formats))


def age_years(born: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, born) / 12).cast("int")


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and page furniture, lower case, single blanks."""
    out = html
    for tag in ("script", "style", "nav", "footer", "header"):
        out = F.regexp_replace(out, f"(?is)<{tag}\\b.*?</{tag}>", " ")
    return F.lower(squeezed(F.regexp_replace(out, "(?s)<[^>]*>", " ")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def in_context(text: Column, word: str, around: int = 100) -> Column:
    """All occurrences of a word with what stands around them.

    What the pattern .{0,around}word.{0,around} finds, by searches for the word: the pattern itself tries every place of
    the text with every length before it.
    """

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else contexts(t, word, around))

    low = F.lower(text)
    told = found(F.when(low.contains(word), low))  # texts without the word stay where they are
    return F.when(low.isNotNull(), F.coalesce(told, F.array().cast("array<string>")))


def contexts(text: str, word: str, around: int) -> list[str]:
    """Of each place: from `around` characters before the next word (or where the place before ended) to as many after the last word that starts no later than it may."""
    out, at = [], 0
    while (first := text.find(word, at)) >= 0:
        start = max(at, first - around)
        last = text.rfind(word, start, start + around + len(word))
        at = last + len(word) + around
        out.append(text[start:at])
    return out


def keyword_mentions(text: Column, major: Sequence[str], minor: Sequence[str], around: int = 100, name: Column | None = None) -> Column:
    """Structs (keyword, severity, context) in the order of the words: all places of major words, of minor ones only if there is none.

    With a name, a place counts if a part of the name (three letters or more) stands in its context, and in each section of it.
    """
    parts = F.array().cast("array<string>") if name is None else F.filter(F.split(F.lower(name), r"\s+"), lambda w: F.length(w) > 2)
    named = lambda s: F.exists(parts, lambda w: s.contains(w))
    relevant = lambda c: (F.size(parts) == 0) | (named(c) & F.forall(F.split(c, " \\| "), named))

    def places(words: Sequence[str], severity: str) -> Column:
        def of(w: str) -> Column:
            told = lambda c: F.struct(F.lit(w).alias("keyword"), F.lit(severity).alias("severity"), F.trim(c).alias("context"))
            return F.transform(F.filter(in_context(text, w, around), relevant), told)

        each = [of(w) for w in words]
        return F.concat(*each) if each else F.array().cast("array<struct<keyword:string,severity:string,context:string>>")

    found = places(major, "major")
    return F.when(F.size(found) > 0, found).otherwise(places(minor, "minor"))


def event_score(title: Column, search: str, stop: tuple[str, ...] = ("the", "and")) -> Column:
    """Keyword hits in a title: one for each word of the search, and two more for those of four letters or more."""
    import re

    words = [w for w in re.split(r"\s+|\bvs\b\.?", search.lower()) if len(w) > 1 and w not in stop]
    t = F.lower(title)
    return sum((F.when(t.contains(w), 3 if len(w) >= 4 else 1).otherwise(0) for w in words), F.lit(0))


# Months in order, and what a text says about when something was (days before today; the first that fits).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
COMEBACK = "return|comeback|back in action|cleared|all clear|recovered|fully healed|ready to fight|back in the cage|ended up with|i had|had surgery|underwent|went through|after that surgery|after the surgery|since the fight|since that|it took a long time"
AGO = ((COMEBACK, 300), ("this week|just|breaking", 7), ("last week", 14), ("this month|recently", 30), ("last month", 60), ("recent|latest|new|today", 90))


def injury_date(text: Column, as_of: Column) -> Column:
    """The middle of a named month of a named year, else as long ago as the text suggests, else half a year ago."""
    t = F.lower(text)
    year, month = F.regexp_extract(t, r"20[12][0-9]", 0), F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(MONTHS, 1))):
        month = F.when(t.contains(name), f"{i:02d}").otherwise(month)
    ago = F.lit(180)
    for pattern, days in reversed(AGO):
        ago = F.when(t.rlike(pattern), days).otherwise(ago)
    named = F.when((year != "") & month.isNotNull(), F.to_date(F.concat_ws("-", year, month, F.lit("15"))))
    return F.coalesce(named, F.date_sub(as_of, ago))


def routed(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key and a column for each field: the value whose label contains the field's word."""
    label = F.lower("label")
    return rows.groupBy(key).agg(*(F.max(F.when(label.contains(word), F.col("value"))).alias(name) for name, word in fields.items()))
