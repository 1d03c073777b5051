"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(c: str | Column) -> Column:
    """The part after the last slash."""
    return F.element_at(F.split(c, "/"), -1)


def short_label(itemset: str | Column, width: int = 20) -> Column:
    """Items of a pattern cut to width characters (the last an ellipsis), joined by +."""
    cut = lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(x)
    return F.array_join(F.transform(F.split(itemset, r" \| "), cut), " + ")


def slugify(c: str | Column, default: str = "topic") -> Column:
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(default)).otherwise(s)


def flag_emoji(code: str | Column) -> Column:
    """Two letters as a pair of regional indicators, empty for anything else."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    marks = "".join(chr(0x1F1E6 + i) for i in range(26))
    up = F.upper(F.trim(code))
    return F.when(up.rlike("^[A-Z]{2}$"), F.translate(up, letters, marks)).otherwise("")


def iso_date(c: str | Column) -> Column:
    """The date part of an ISO string if its positions look like one, else null (month 99 passes)."""
    d = F.substring(c, 1, 10)
    return F.when(d.rlike("^[0-9]{4}-.{2}-.{2}$"), d)


def year_of(year: Column, publication_year: Column, date: Column) -> Column:
    """Year, else publication year, else the date's first four characters; non-digits are null."""
    return F.coalesce(year.cast("string").try_cast("int"), publication_year.cast("string").try_cast("int"), F.substring(date, 1, 4).try_cast("int"))


def year_month(publication_date: Column, pub_year: Column, created: Column) -> Column:
    """(year, month): from the publication date, else the year with a null month, else from the creation date."""
    part = lambda d: F.struct(F.substring(d, 1, 4).try_cast("int").alias("year"), F.substring(d, 6, 2).try_cast("int").alias("month"))
    return (
        F.when(publication_date.rlike("^[0-9]{4}-[0-9]{2}"), part(publication_date))
        .when(pub_year.isNotNull(), F.struct(pub_year.cast("int").alias("year"), F.lit(None).cast("int").alias("month")))
        .when(created.rlike("^[0-9]{4}-[0-9]{2}"), part(created))
    )


def real_doi(doi: Column) -> Column:
    """Null for blank and placeholder identifiers."""
    return F.when(~F.lower(F.trim(doi)).rlike(r"^$|^(n/a|none|null|unknown)$|example|placeholder"), F.trim(doi))


def reader_url(original: Column, doi: Column, fallback: Column) -> Column:
    """The reader's link: the original address, else the DOI as an address, else the fallback."""
    clean = real_doi(doi)
    by_doi = F.when(clean.rlike("^https?://"), clean).otherwise(F.concat(F.lit("https://doi.org/"), clean))
    web = lambda u: F.when(u.rlike("^https?://"), u)
    return F.coalesce(web(original), by_doi, web(fallback))


def compact_count(n: Column) -> Column:
    """80000 as 80k, 1500000 as 1.5M; one decimal, without a trailing zero."""
    tenths = lambda unit: F.floor((n * 10 + unit // 2) / unit)  # noqa: E731  half up, in whole tenths
    text = lambda t, mark: F.concat(F.floor(t / 10).cast("string"), F.when(t % 10 == 0, "").otherwise(F.concat(F.lit("."), (t % 10).cast("string"))), F.lit(mark))
    return F.when(n >= 1_000_000, text(tenths(1_000_000), "M")).when(n >= 1000, text(tenths(1000), "k")).otherwise(n.cast("string"))


def inverted_text(index: Column) -> Column:
    """Text from a map of word to places."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(entries), lambda x: x["w"]), " ")


def topic_refs(topics: Column) -> Column:
    """One (id, name) a topic, keyed by id else name; the first wins. topics: array of (id, display_name)."""
    named = F.filter(topics, lambda t: F.trim(t["display_name"]) != "")
    refs = F.transform(named, lambda t: F.struct(short_id(t["id"]).alias("id"), F.trim(t["display_name"]).alias("name")))
    key = lambda r: F.coalesce(r["id"], r["name"])
    return F.filter(refs, lambda r, i: F.array_position(F.transform(refs, key), key(r)) == i + 1)


def set_jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are equal, one empty set shares nothing."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def md_cell(c: Column) -> Column:
    """A value as a cell of a Markdown table."""
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
