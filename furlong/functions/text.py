"""Parsing and canonical forms of text fields, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

WIDE_SPACE = "　"
#: Full-width forms of ASCII (an offset of 0xFEE0), and the markers that may stand before a name.
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
MARKERS = "○●◎▲△☆★◇□(){}[]"


def clean(c: Column) -> Column:
    """Trimmed, with full-width spaces as spaces; null where nothing is left."""
    t = F.trim(F.translate(c, WIDE_SPACE, " "))
    return F.when(t != "", t)


def half_width(c: Column) -> Column:
    """Full-width ASCII as ASCII, cleaned: the part of NFKC that needs no Python."""
    return clean(F.translate(c, FULL, HALF))


def nfkc(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the exact NFKC form of a column, cleaned. The distinct values alone go through Python, in Arrow batches."""
    import pyarrow as pa

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import unicodedata

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unicodedata.normalize("NFKC", x) for x in b.column(0).to_pylist()], pa.string())], ["__k", "__v"])

    names = df.select(F.col(col).alias("__k")).filter(F.col(col).isNotNull()).distinct().mapInArrow(forms, "__k string, __v string")
    return df.join(names, df[col] == names["__k"], "left").select(*df.columns, clean(F.col("__v")).alias(out))


def strip_markers(c: Column) -> Column:
    escaped = "".join("\\" + m for m in MARKERS)
    return clean(F.regexp_replace(c, f"^[{escaped}{WIDE_SPACE} ]+", ""))


def same_name(a: Column, b: Column) -> Column:
    """One name is a prefix of the other, markers aside."""
    a, b = strip_markers(a), strip_markers(b)
    return F.coalesce(a.startswith(b) | b.startswith(a), F.lit(False))


def to_int(c: Column) -> Column:
    return clean(c).try_cast("int")


def to_decimal(c: Column, scale: int = 1) -> Column:
    return clean(c).try_cast(f"decimal(12,{scale})")


def meeting_number(c: Column) -> Column:
    """1 to 9, then A to F."""
    t = clean(c)
    return F.when(t.rlike("^[1-9A-F]$"), F.conv(t, 16, 10).cast("int"))


def dotted_date(c: Column) -> Column:
    """Y.M.D; null where it is no date."""
    return F.try_to_timestamp(clean(c), F.lit("yyyy.M.d")).cast("date")


def seconds(c: Column) -> Column:
    """M.SS.s and M:SS.s as seconds; null for anything else, '----' among it."""
    pattern, t = r"^(\d+)[.:](\d{2})\.(\d)$", clean(c)
    part = lambda k: F.regexp_extract(t, pattern, k).try_cast("int")
    return F.when(t.rlike(pattern), F.round(part(1) * 60 + part(2) + part(3) / 10, 1))


def contest_key(year: Column, venue: Column, meeting: Column, day: Column, number: Column) -> Column:
    return F.format_string("%04d%s%02d%02d%02d", year, venue, meeting, day, number)


def running_style(first_corner: Column, field: Column) -> Column:
    """From the place at the first corner: front, stalker, midpack or closer by thirds behind the leader."""
    return F.when(first_corner.isNull() | (field < 1), None).when(first_corner == 1, "front").when(first_corner <= F.ceil(field / 3), "stalker").when(first_corner <= F.ceil(2 * field / 3), "midpack").otherwise("closer")


def largest_gain(a: Column) -> Column:
    """Largest fall from one element of an array to the next; null below two elements."""
    n = F.size(a)
    return F.when(n >= 2, F.array_max(F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), lambda x, y: x - y)))


def horizon(seconds_to_post: Column) -> Column:
    return F.when(seconds_to_post.isNull(), "unknown").when(seconds_to_post < 0, "late").when(seconds_to_post <= 300, "final").when(seconds_to_post <= 3600, "hour").otherwise("early")


def capture_strength(fresh: Column, pending_before: Column, pending_after: Column, in_time: Column) -> Column:
    """strong: fetched anew, in time, with the result open before and after; weak: in time only; else none."""
    return F.when(fresh & pending_before & pending_after & in_time, "strong").when(in_time & pending_before, "weak").otherwise("none")


def has_token(audit: Column, token: str) -> Column:
    """The exact token stands in a ';'-separated string."""
    return F.coalesce(F.array_contains(F.split(audit, ";"), token), F.lit(False))


def digest(*cols: Column) -> Column:
    """SHA-256 of the canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def percentile_within(value: Column, edges: Column) -> Column:
    """Place of a value among ascending quantile values (an array of k + 1), linear between them, in [0, 1]."""
    k = F.size(edges) - 1
    below = F.size(F.filter(edges, lambda e: e <= value))
    lo, hi = F.element_at(edges, F.greatest(below, F.lit(1))), F.try_element_at(edges, F.least(below + 1, k + 1))
    return F.when(value.isNull() | (k < 1), None).when(below == 0, 0.0).when(below == k + 1, 1.0).otherwise((below - 1 + (value - lo) / (hi - lo)) / k)


#: What marks a jump contest in names and in classes.
JUMP_NAMES, JUMP_CLASSES = "障害|ジャンプ|ハードル|大障", ("JG1", "JG2", "JG3")


def track_type(surface: Column, klass: Column, *names: Column) -> Column:
    """The surface as given (trimmed; empty is null), or '障' for a jump contest, which only its names or its class tell. ``klass`` may be in full-width
    letters."""
    jump = F.coalesce(F.trim(half_width(klass)).isin(*JUMP_CLASSES), F.lit(False))
    for name in names:
        jump = jump | F.coalesce(name.rlike(JUMP_NAMES), F.lit(False))
    given = F.trim(surface)
    return F.when(jump, "障").when(given != "", given)


def hrefs(html: Column) -> Column:
    """The targets of all quoted href attributes of a page, in order; null for a null page."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


#: Fixed value: what may stand between a link's segment and its id.
LINK_INFIX = "result/recent/"


def href_id(href: Column, segment: str) -> Column:
    """The word behind /segment/ in a link; null where there is none."""
    found = F.regexp_extract(href, rf"/{segment}/(?:{LINK_INFIX})?(\w+)", 1)
    return F.when(found != "", found)


def canonical_href(html: Column) -> Column:
    """The target of the page's canonical link, whichever of its attributes stands first; null where there is none."""
    rel, to = r"""rel\s*=\s*["']canonical["']""", r"""href\s*=\s*["']([^"']*)["']"""
    a = F.regexp_extract(html, rf"(?i)<link\b[^>]*{rel}[^>]*{to}", 1)
    b = F.regexp_extract(html, rf"(?i)<link\b[^>]*{to}[^>]*{rel}", 1)
    return F.when(a != "", a).when(b != "", b)
