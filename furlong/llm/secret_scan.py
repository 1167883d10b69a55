"""Secret scans: known forms, and sliding-window Shannon entropy per character class, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: The known forms, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_b64"]

#: Character classes: the candidate's form, its alphabet, the window, and the bits a window must have.
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9+/_=-])(?:[0-9A-F]{20,}|[0-9a-f]{20,})(?![A-Za-z0-9+/_=-])", "0123456789abcdefABCDEF", 20, 2.9),
    "entropy_b64": (r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.6),
}
#: Candidates that are let through: no digit or no letter at all, words joined by strokes, and known examples.
ALLOW = [r"^[^0-9]+$", r"^[^A-Za-z]+$", r"^(?:[A-Za-z]+|[0-9]{1,8})(?:[-_/=+]+(?:[A-Za-z]+|[0-9]{1,8}))*[-_/=+]*$", r"(?i)example|sample|placeholder|changeme|dummy|x{6,}|0123456789|abcdefgh"]


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, m>>: start and end of all leftmost non-overlapping matches in code points, and a group's text.

    The pieces between the matches and the matches themselves alternate, so their lengths give the places."""
    p = _sql(pattern)
    whole = f"regexp_extract_all({text}, {p}, 0)"
    zipped = f"arrays_zip(transform({whole}, m -> length(m)), regexp_extract_all({text}, {p}, {group}), transform(slice(split({text}, {p}), 1, size({whole})), g -> length(g)))"
    fold = (
        f"aggregate({zipped}, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)), "
        "(a, x) -> named_struct('at', a.at + x.`2` + x.`0`, 'out', concat(a.out, array(named_struct('s', a.at + x.`2`, 'e', a.at + x.`2` + x.`0`, 'm', x.`1`)))), a -> a.out)"
    )
    # most texts have no match: they cost one search
    return F.expr(f"CASE WHEN {text} rlike {p} THEN {fold} ELSE cast(array() as array<struct<s:int,e:int,m:string>>) END")


def entropy_spans(cands: str, kind: str) -> Column:
    """Spans within candidates (array<struct<s, e, m>>): from the first to the last window whose entropy is high enough.

    The window's counts, one for each character of the class' alphabet, are kept as it slides: the character that
    enters and the one that leaves change two of them, and the sum of c * log2(c) with them."""
    _, alphabet, w, least = CLASSES[kind]
    g = ", ".join(f"{(c * math.log2(c) - (c - 1) * math.log2(c - 1) if c > 1 else 0.0)!r}D" for c in range(1, w + 2))
    bits = f"{math.log2(w)!r}D"
    allowed = " OR ".join(f"c.m rlike {_sql(a)}" for a in ALLOW)
    start = f"named_struct('n', cast(array_repeat(0, {len(alphabet)}) as array<int>), 'sum', 0.0D, 'from', -1, 'to', -1)"
    symbol = f"transform(split(c.m, ''), x -> instr({_sql(alphabet)}, x))"
    step = (
        # enter
        "transform(array(i), i -> named_struct('i', i, 'n', transform(a.n, (v, j) -> v + cast(j + 1 = q[i] as int)), 'sum', a.sum + array(" + g + ")[a.n[q[i] - 1]], 'from', a.from, 'to', a.to))"
    )
    leave = (
        f"transform({step}, b -> CASE WHEN b.i < {w} THEN b ELSE named_struct('i', b.i, 'n', transform(b.n, (v, j) -> v - cast(j + 1 = q[b.i - {w}] as int)), "
        f"'sum', b.sum - array({g})[b.n[q[b.i - {w}] - 1] - 1], 'from', b.from, 'to', b.to) END)"
    )
    hot = f"(b.i >= {w - 1} AND {bits} - b.sum / {w} >= {least}D)"
    move = (
        f"transform({leave}, b -> named_struct('n', b.n, 'sum', b.sum, 'from', CASE WHEN b.from < 0 AND {hot} THEN b.i - {w - 1} ELSE b.from END, 'to', CASE WHEN {hot} THEN b.i + 1 ELSE b.to END))[0]"
    )
    slide = f"aggregate(sequence(0, size(q) - 1), {start}, (a, i) -> {move}, a -> named_struct('s', c.s + a.from, 'e', c.s + a.to, 'hot', a.from >= 0))"
    each = f"transform(filter({cands}, c -> NOT ({allowed})), c -> transform(array({symbol}), q -> {slide})[0])"
    return F.expr(f"transform(filter({each}, r -> r.hot), r -> named_struct('s', r.s, 'e', r.e))")


def find_secrets(docs: DataFrame, *, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``: array<struct<start, kind, end, name>> of all secrets of each whole text, by start, then kind.

    Places are code points, ends exclusive. Known forms (assign, access, hex) keep their spans. The entropy method adds the
    spans of its own kinds: high-entropy windows of candidates, also those inside an assignment, but not inside an access
    or hex span, which already is such a string. A null or empty text has none; rows that repeat get equal results; an
    empty table stays empty; a column named ``out`` is replaced, all others stay. Nothing is shuffled; a long text is
    searched as a whole, and the work grows with its matches times their number."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != out]
    # the row's own columns stay inside one struct, so that no name clashes with those used here
    df = docs.select(F.struct(*own).alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    df = df.withColumns({"__assign": matches("__t", ASSIGN, 2), "__access": matches("__t", ACCESS), "__hex": matches("__t", HEX)})
    df = df.withColumn("__assign", F.filter("__assign", lambda x: F.length(x["m"]) >= 6))
    df = df.withColumn("__told", F.concat("__access", "__hex"))
    spans = []
    for kind, (pattern, *_) in CLASSES.items():
        df = df.withColumn(f"__c_{kind}", matches("__t", pattern))
        df = df.withColumn(f"__s_{kind}", entropy_spans(f"__c_{kind}", kind))
        df = df.withColumn(f"__s_{kind}", F.expr(f"filter(__s_{kind}, x -> NOT exists(__told, b -> b.s < x.e AND x.s < b.e))"))
    # a hexadecimal candidate is not told twice
    df = df.withColumn("__s_entropy_b64", F.expr("filter(__s_entropy_b64, x -> NOT exists(__s_entropy_hex, b -> b.s < x.e AND x.s < b.e))"))
    for k, (name, col) in enumerate(zip(KINDS, ["__assign", "__access", "__hex", "__s_entropy_hex", "__s_entropy_b64"], strict=True)):
        spans.append(F.expr(f"transform({col}, x -> named_struct('start', x.s, 'kind', {k}, 'end', x.e, 'name', '{name}'))"))
    return df.select("__row.*", F.array_sort(F.concat(*spans)).alias(out))


def redact(found: DataFrame, *, text_col: str = "text", secrets: str = "secrets", mark: str = "[SECRET]") -> Column:
    """The text of a row of ``find_secrets`` with each secret (or run of overlapping ones) replaced by ``mark``."""
    t, m = f"`{text_col}`", _sql(mark)
    fold = (
        f"aggregate({secrets}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> CASE WHEN x.start >= a.at "
        f"THEN named_struct('at', x.end, 'out', concat(a.out, array(substring({t}, a.at + 1, x.start - a.at), {m}))) "
        f"ELSE named_struct('at', greatest(a.at, x.end), 'out', a.out) END, a -> concat(array_join(a.out, ''), substring({t}, a.at + 1)))"
    )
    return F.expr(f"CASE WHEN size({secrets}) = 0 THEN {t} ELSE {fold} END")
