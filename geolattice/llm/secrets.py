"""Secret scans in DataFrame functions only; every row is scanned by itself, so nothing shuffles.

Base findings are leftmost non-overlapping matches of three patterns. Further findings come
from sliding-window Shannon entropy: candidate strings are runs of token characters, a
window moves over each by one character at a time, the count of the character that enters
and of the one that leaves adjust the running sum of n*log2(n), and the most disordered
window is held against the threshold of the candidate's character class. An allow-list
suppresses candidates; it never suppresses base findings.

The work grows in proportion to a text: the counts of a window are kept in the state of one
pass over a run's characters, long runs and long lists of findings are worked on in blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolattice.llm.common import free_name

#: The kinds in listed order with pattern, the group whose length counts, and its least length.
#: Runs of one class are maximal, so for access and hex the least length may stand in the pattern itself:
#: a shorter run holds no longer one, and dropping it later or never matching it is the same.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]{12,})", 1, 16),
    ("hex", r"([0-9a-f]{32,})", 1, 32),
)

#: Candidates hold a digit and a letter and at least ``MIN_CANDIDATE`` token characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_CANDIDATE = 20
WINDOW = 20

#: Character classes in the order tried: name, the whole candidate's pattern, least entropy in bits of the best window.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 3.05),
    ("upper", r"^[A-Z0-9]+$", 3.55),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.85),
)

#: Candidates that match any of these are no secrets: identifiers, dates, placeholders, paths, runs of one character.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|your[_-]",
    r"^/?[a-z]+/[a-z0-9_/-]*$",
    r"(.)\1{7}",
)


#: Findings, and characters of a run, that are worked on at once.
BLOCK_SPANS, BLOCK_CHARS = 256, 1 << 15
_SPAN = "struct<start:int,end:int,ord:int,kind:string,text:string>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _blocks(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size``."""
    starts = F.filter(F.sequence(F.lit(0), F.size(values), F.lit(size)), lambda at: at < F.size(values))
    return F.transform(starts, lambda at: F.slice(values, at + 1, F.lit(size)))


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, order, kind, text) of the matches whose group is long enough, in code points.

    Matches are numbered off in blocks, so that lists grow only within one.
    """
    order = [k for k, *_ in BASE].index(kind) if kind in [k for k, *_ in BASE] else len(BASE)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = _let(matches, lambda m: F.arrays_zip(m.alias("m"), groups.alias("g"), F.slice(gaps, 1, F.size(m)).alias("gap")))
    none = F.array().cast(f"array<{_SPAN}>")

    def span(at: Column, x: Column) -> Column:
        start = at + F.char_length(x["gap"])
        return F.struct(start.alias("start"), (start + F.char_length(x["m"])).alias("end"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), x["m"].alias("text"))

    def step(acc: Column, x: Column) -> Column:
        found = F.when(F.char_length(x["g"]) >= least, F.array_append(acc["found"], span(acc["at"], x))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.char_length(x["gap"]) + F.char_length(x["m"])).alias("at"), found.alias("found"))

    def of_block(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda s: s.withField("start", s["start"] + acc["at"]).withField("end", s["end"] + acc["at"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["parts"], moved).alias("parts"))

    blocks = _let(zipped, lambda z: F.transform(_blocks(z, BLOCK_SPANS), of_block))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("parts"))
    return F.when(text.rlike(pattern), F.aggregate(blocks, start, join, lambda acc: F.flatten(acc["parts"]))).otherwise(none)


#: n*log2(n) in units of 2**-40, so that running sums are whole numbers and do not drift.
_UNIT = 1 << 40
_NLOGN = [0, *(round(n * math.log2(n) * _UNIT) for n in range(1, 128))]
_UP = [b - a for a, b in zip(_NLOGN, _NLOGN[1:], strict=False)]
_DOWN = [0, *(-u for u in _UP)]


def _least_sum(codes: Column, width: int) -> Column:
    """Least sum of n*log2(n) over the windows of an array of codes from 1 to 80.

    The counts of the window are the bytes of one value, at the codes' places; each step
    raises that of the code that enters and lowers that of the code that leaves.
    """
    byte = F.array(*[F.lit(bytes([n])) for n in range(128)])
    none = F.lit(0).cast("long")
    read = lambda counts, c: F.ascii(F.substring(counts, c, F.lit(1)).cast("string"))
    write = lambda counts, c, n: F.overlay(counts, F.get(byte, n), c, F.lit(1))

    def move(acc: Column, x: Column) -> Column:
        there = read(acc["counts"], x["c"])
        raised = write(acc["counts"], x["c"], there + 1)
        gone = read(acc["counts"], x["g"])
        counts = F.when(x["g"].isNull(), raised).when(x["g"] == x["c"], acc["counts"]).otherwise(write(raised, x["g"], gone - 1))
        up = acc["sum"] + F.get(F.lit(_UP), there)
        total = F.when(x["g"].isNull(), up).when(x["g"] == x["c"], acc["sum"]).otherwise(up + F.get(F.lit(_DOWN), gone))
        least = F.when(x["g"].isNull(), acc["least"]).otherwise(F.least(acc["least"], acc["sum"]))
        return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

    start = F.struct(F.lit(bytes(80)).alias("counts"), none.alias("sum"), F.lit((1 << 63) - 1).alias("least"))
    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("c"), F.get(codes, i - width).alias("g")))
    return F.aggregate(pairs, start, move, lambda acc: F.least(acc["least"], acc["sum"]))


def window_entropy(candidate: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, of the windows of ``width`` (127 at most) token characters.

    Shorter strings are one window. Blocks of a long string overlap by a window less one
    character, so every window lies in one of them.
    """
    size = F.octet_length(candidate)
    starts = F.sequence(F.lit(0), F.greatest(size - width, F.lit(0)), F.lit(BLOCK_CHARS))
    block = lambda raw, at: F.split(F.substring(raw, at + 1, F.lit(BLOCK_CHARS + width - 1)).cast("string"), "")
    codes = lambda raw, at: F.transform(F.filter(block(raw, at), lambda c: c != ""), lambda c: F.ascii(c) - 42)
    sums = _let(candidate.cast("binary"), lambda raw: F.transform(starts, lambda at: _let(codes(raw, at), lambda c: _least_sum(c, width))))
    n = F.least(size, F.lit(width)).cast("double")
    return F.log2(n) - F.array_min(sums) / n / F.lit(float(_UNIT))


def is_disordered(candidate: Column) -> Column:
    """Whether the most disordered window passes the threshold of the candidate's class and the allow-list is silent."""
    threshold = F.lit(1e300)
    for _, pattern, least in reversed(CLASSES):
        threshold = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(threshold)
    allowed = candidate.rlike("|".join(f"(?:{p})" for p in ALLOW[:-1])) | candidate.rlike(ALLOW[-1])
    return F.when(allowed, False).otherwise(window_entropy(candidate) >= threshold)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets in whole texts.

    Returns one row per input row: ``id_col``, n_assign, n_access, n_hex, n_entropy (long),
    base (array of kind:start:end of the base findings), all (the same with those of kind
    entropy), entropy findings being outside base ones; both ordered by start, then kind.

    A NULL text counts as empty and has no findings; NULL and repeated ids come back as they
    are; an empty table gives no rows; other columns are ignored, whatever their names. Very
    long texts are scanned whole.
    """
    text, found = free_name([id_col], "_text"), free_name([id_col], "_found")
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    t = F.col(text)
    runs = F.filter(_spans(t, "entropy", f"({CANDIDATE})", 1, MIN_CANDIDATE), lambda s: s["text"].rlike("[0-9]"))
    rows = rows.withColumns({f"{found}_{kind}": _spans(t, kind, pattern, group, least) for kind, pattern, group, least in BASE})
    rows = rows.withColumn(f"{found}_runs", runs)
    base = F.array_sort(F.concat(*[F.transform(F.col(f"{found}_{k}"), lambda s: s.dropFields("text")) for k, *_ in BASE]))
    rows = rows.withColumn(f"{found}_base", base)
    b = F.col(f"{found}_base")
    reach = lambda x: F.struct(F.array_min(F.transform(x, lambda s: s["start"])).alias("start"), F.array_max(F.transform(x, lambda s: s["end"])).alias("end"), x.alias("spans"))
    meets = lambda s: lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])
    overlaps = lambda s, parts: F.exists(parts, lambda x: F.when(meets(s)(x), F.exists(x["spans"], meets(s))).otherwise(False))
    open_ = lambda parts: F.filter(F.col(f"{found}_runs"), lambda s: F.when(overlaps(s, parts), False).otherwise(is_disordered(s["text"])))
    fresh = _let(_let(b, lambda x: F.transform(_blocks(x, BLOCK_SPANS), reach)), open_)
    rows = rows.withColumn(f"{found}_more", F.when(F.size(f"{found}_runs") > 0, F.transform(fresh, lambda s: s.dropFields("text"))).otherwise(F.slice(b, 1, 0)))
    named = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return rows.select(
        id_col,
        *[F.size(f"{found}_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE],
        F.size(f"{found}_more").cast("long").alias("n_entropy"),
        named(b).alias("base"),
        named(F.array_sort(F.concat(b, F.col(f"{found}_more")))).alias("all"),
    )
