"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyloom.params import ChunkParams

#: The characters that Python's str.strip takes off.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def hash_id(*parts: Column) -> Column:
    """md5 of the parts' UTF-8 text."""
    return F.md5(F.concat(*parts))


def normalize_source(x: Column) -> Column:
    """What stands before the first middle dot, stripped; null becomes empty."""
    return strip(F.split(strip(F.coalesce(x, F.lit(""))), "·", 2)[0])


def path(l0: Column, l1: Column, l2: Column, sep: str = "/") -> Column:
    """Joined levels; a blank level ends the path."""
    return F.when(l0 == "", "").when(l1 == "", l0).when(l2 == "", F.concat_ws(sep, l0, l1)).otherwise(F.concat_ws(sep, l0, l1, l2))


def depth(l0: Column, l1: Column, l2: Column) -> Column:
    """Number of levels of the path."""
    return F.when(l0 == "", 0).when(l1 == "", 1).when(l2 == "", 2).otherwise(3)


def chunks(x: Column, p: ChunkParams = ChunkParams()) -> Column:
    """Overlapping chunks of a long text; the last is the text's last ``size`` characters. Short texts have none."""
    n = F.ceil((F.length(x) - p.size) / p.step).cast("int")
    body = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(x, k * p.step + 1, F.lit(p.size)))
    return F.when(F.length(x) <= p.threshold, F.array().cast("array<string>")).otherwise(F.concat(body, F.array(F.right(x, F.lit(p.size)))))


def head(x: Column, p: ChunkParams = ChunkParams()) -> Column:
    return F.left(x, F.lit(p.head))


def tail(x: Column, p: ChunkParams = ChunkParams()) -> Column:
    return F.right(x, F.lit(p.tail))


def token_count(x: Column) -> Column:
    """Characters, the count used where no tokenizer is at hand."""
    return F.length(x)


def metadata(source: Column, note: Column) -> Column:
    return F.to_json(F.struct(source.alias("source"), note.alias("note")))


def keywords(x: Column) -> Column:
    return F.filter(F.split(strip(x), r"\s+"), lambda k: k != "")


def enhance(query: Column, words: Column, enabled: bool = True) -> Column:
    """The query followed by its keywords."""
    return F.when(F.lit(enabled) & (F.size(words) > 0), F.concat_ws(" ", query, F.array_join(words, " "))).otherwise(query)


def title_prefix(prepend: Column, hierarchy: Column, sep: str = "/") -> Column:
    """The source's name if it is given, else the path's ends in brackets."""
    parts = F.split(hierarchy, sep)
    ends = F.concat(F.lit("["), parts[0], F.lit("·"), F.element_at(parts, -1), F.lit("] "))
    return F.when(F.coalesce(prepend, F.lit("")) != "", prepend).when(F.coalesce(hierarchy, F.lit("")) == "", "").when(F.size(parts) >= 2, ends).otherwise(F.concat(F.lit("["), hierarchy, F.lit("] ")))


def overlap(a: Column, b: Column) -> Column:
    """Length ratio if the shorter is part of the longer, else 0; of equal lengths b counts as the shorter."""
    first = F.length(a) < F.length(b)
    short, long_ = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(F.contains(long_, short), F.length(short) / F.length(long_)).otherwise(0.0)


def is_long(x: Column, threshold: int = 700) -> Column:
    return F.length(x) > threshold


def preview(x: Column, n: int = 150) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def simplify(x: Column, table: dict[str, str]) -> Column:
    """Characters replaced by a table, for embedding only."""
    return F.translate(x, "".join(table), "".join(table.values()))


def findings(x: Column) -> Column:
    """Parsed findings; blank or broken JSON, no list, or an incomplete element gives none."""
    parsed = F.from_json(x, "array<struct<summary:string,explanation:string>>")
    whole = F.ltrim(x).startswith("[") & F.forall(parsed, lambda f: f.isNotNull() & f["summary"].isNotNull() & f["explanation"].isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), parsed).otherwise(F.array().cast("array<struct<summary:string,explanation:string>>"))


def list_column(x: Column, kind: str) -> Column:
    """A nested column that may arrive as JSON text."""
    return F.coalesce(F.from_json(x, kind), F.array().cast(kind))


def report_text(title: Column, summary: Column, points: Column) -> Column:
    """A report as a document: title, summary, findings."""
    lines = F.array_join(F.transform(points, lambda f: F.concat(F.lit("- "), f["summary"], F.lit(": "), f["explanation"])), "\n")
    return F.concat(F.lit("# "), title, F.lit("\n\n## Summary\n"), summary, F.lit("\n\n## Findings\n"), lines)
