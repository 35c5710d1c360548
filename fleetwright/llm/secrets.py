"""Secret scans with column functions: fixed patterns, and sliding-window entropy of random-looking strings.

Base kinds are taken leftmost and without overlap, each on its own, then filtered:
``assign`` (a secret's name, a sign, a value of 8 or more characters), ``access`` (AKIA and
capitals or digits, 16 or more in all), ``hex`` (32 or more). ``entropy`` spans are added: runs
of ``CANDIDATE`` characters, cut at the words of the allow list, are classed by ``CLASSES``; a
window of ``WINDOW`` characters slides over each, its Shannon entropy kept by adding the
character that enters and taking out the one that leaves; a run of which the best window of a
part reaches its class's bound is a span; parts shorter than the window are not looked at.
Positions are code points.

Cases: null text counts as empty and has no span; equal starts are ordered by kind as listed;
spans of different kinds may overlap; equal rows give equal results; an empty table gives no
rows; a very long text is one row of a task, whose work grows with its characters and, beyond
thousands of matches, with the square of their number; other columns are ignored, or kept by ``redacted``, which leaves texts without spans
(null ones too) as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""((?i:{NAMES}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is long enough is one match of the bounded pattern, and a shorter one is none.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SHORTEST_VALUE = 8

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Class, its pattern and the bits that a window must reach; the first class that fits counts. Nine of ten random
#: strings reach these bounds; longer ones, with more windows, are held to higher ones.
CLASSES = [
    ("32 digits", r"^[0-9]{32,}$", 2.9),
    ("24 digits", r"^[0-9]{24,}$", 2.8),
    ("digits", r"^[0-9]+$", 2.7),
    ("numbers", r"^[0-9_=+/-]+$", 2.8),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9),
    ("32 letters of one case", r"^(?:[a-z]{32,}|[A-Z]{32,})$", 3.65),
    ("24 letters of one case", r"^(?:[a-z]{24,}|[A-Z]{24,})$", 3.53),
    ("letters of one case", r"^(?:[a-z]+|[A-Z]+)$", 3.43),
    ("letters", r"^[A-Za-z]+$", 3.65),
    ("words", r"^[A-Za-z_=+/-]+$", 4.0),
    ("24 letters of one case and digits", r"^(?:[a-z0-9]{24,}|[A-Z0-9]{24,})$", 3.7),
    ("letters of one case and digits", r"^(?:[a-z0-9]+|[A-Z0-9]+)$", 3.6),
    ("letters and digits", r"^[A-Za-z0-9]+$", 3.75),
    ("base64", r"^.+$", 3.8),
]
#: UUIDs, placeholders and rows of letters or digits.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|redacted|your_?(?:key|token|secret)",
    r"(?i)abcdefghij|0123456789",
)
KINDS = ["assign", "access", "hex", "entropy"]
MARK = "[SECRET]"


def _spans(kind: str, text: Column, pattern: str, matches: Column, keep: str) -> Column:
    """Structs (start, rank, kind, end) of a pattern's matches.

    Cutting the text at the pattern gives what lies between its matches, so running sums of
    both lengths are the positions. ``keep`` says by ``k`` whether the match counts.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(matches, F.length)
    rank = KINDS.index(kind)
    empty = "cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)"
    walk = f"""
        aggregate(
            sequence(0, size(_found) - 1),
            named_struct('at', 0, 'spans', {empty}),
            (s, k) -> named_struct(
                'at', s.at + _gaps[k] + _found[k],
                'spans', IF({keep}, concat(s.spans, array(named_struct(
                    'start', s.at + _gaps[k], 'rank', {rank}, 'kind', '{kind}', 'end', s.at + _gaps[k] + _found[k]
                ))), s.spans)
            ),
            s -> s.spans
        )"""
    return gaps, found, f"IF(size(_matches) = 0, {empty}, {walk})"


def with_spans(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``_base`` and ``_entropy``: arrays of (start, rank, kind, end), each in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("_text", text)
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)):
        found = found.withColumn("_matches", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
        if kind == "assign":
            values = F.when(
                F.size("_matches") > 0,
                F.transform(F.regexp_extract_all("_text", F.lit(pattern), F.lit(2)), F.length),
            )
            found, keep = found.withColumn("_value", values), f"_value[k] >= {SHORTEST_VALUE}"
        elif kind == "entropy":
            found = found.withColumn("_random", F.transform("_matches", lambda m: _is_random(m, window, allowed)))
            keep = "_random[k]"
        else:
            keep = "true"
        gaps, lengths, walk = _spans(kind, F.col("_text"), pattern, F.col("_matches"), keep)
        some = F.size("_matches") > 0
        found = (
            found.withColumn("_gaps", F.when(some, gaps))
            .withColumn("_found", F.when(some, lengths))
            .withColumn(f"_{kind}", F.expr(walk))
            .drop("_matches", "_gaps", "_found", "_value", "_random")
        )
    return found.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))


def _is_random(run: Column, window: int, allowed: tuple[str, ...]) -> Column:
    """Whether a part of the run between the words of the allow list has a window that reaches its class's bound."""
    whole = [p for p in allowed if p.startswith("^")]
    words = "|".join(f"(?:{p})" for p in allowed if p not in whole)
    suppressed = F.lit(False)
    for pattern in whole:
        suppressed |= run.rlike(pattern)

    def is_random(part: Column) -> Column:
        bound = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            bound = F.when(part.rlike(pattern), F.lit(bits)).otherwise(bound)
        return (F.length(part) >= window) & (best_entropy(part, window) >= bound)

    return ~suppressed & F.exists(F.split(run, words, -1) if words else F.array(run), is_random)


def best_entropy(run: Column, window: int = WINDOW) -> Column:
    """Highest entropy in bits of any ``window`` characters in a row of a string (of the whole, if shorter)."""

    def term(count: Column) -> Column:
        return count * F.log2(F.greatest(count, F.lit(1)))

    # What does not change from step to step is carried along: in a step it would be worked out anew each time.
    own = F.struct(F.split(run, "").alias("signs"), F.array_distinct(F.split(run, "")).alias("known"))
    codes = F.transform(
        F.array(own), lambda s: F.transform(s["signs"], lambda c: (F.array_position(s["known"], c) - 1).cast("int"))
    )[0]
    size = F.least(F.length(run), F.lit(window))
    start = F.struct(
        F.transform(own["known"], lambda _: F.lit(0)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("best"),
        size.alias("size"),
    )

    def slide(state: Column, code: Column, out: Column) -> Column:
        """``out`` is the code that leaves; -1 while the window fills, -2 when it is full for the first time."""
        counts = state["counts"]
        come = counts[code]
        gone = F.when(out >= 0, counts[F.greatest(out, F.lit(0))]).otherwise(F.lit(0))
        change = term(come + 1) - term(come) + F.when(gone > 0, term(gone - 1) - term(gone)).otherwise(F.lit(0.0))
        total = state["sum"] + F.when(code == out, F.lit(0.0)).otherwise(change)
        moved = F.transform(counts, lambda n, k: n + (k == code).cast("int") - (k == out).cast("int"))
        bits = F.log2(state["size"]) - total / state["size"]
        best = F.when(out == -1, state["best"]).otherwise(F.greatest(state["best"], bits))
        return F.struct(moved.alias("counts"), total.alias("sum"), best.alias("best"), state["size"].alias("size"))

    leaving = F.concat(F.array_repeat(F.lit(-1), size - 1), F.array(F.lit(-2)), codes)
    steps = F.zip_with(
        codes,
        F.slice(leaving, 1, F.length(run)),
        lambda code, out: F.struct(code.alias("code"), out.alias("out")),
    )
    return F.aggregate(steps, start, lambda s, x: slide(s, x["code"], x["out"]), lambda s: s["best"])


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every row."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select(
        "doc_id",
        *(F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("_base", "_entropy"))).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every span of a text replaced by ``mark``, overlapping ones by a single one; ``n_chars``
    follows where a text changed."""
    found = with_spans(docs).withColumn("_all", F.array_sort(F.concat("_base", "_entropy")))
    hidden = F.expr(
        f"""
        aggregate(
            _all,
            named_struct('at', 0, 'out', cast('' as string)),
            (s, x) -> named_struct(
                'at', greatest(s.at, x.end),
                'out', IF(x.start >= s.at, concat(s.out, substring(_text, s.at + 1, x.start - s.at), '{mark}'), s.out)
            ),
            s -> concat(s.out, substring(_text, s.at + 1))
        )"""
    )
    some = F.size("_all") > 0
    columns = {c: F.col(c) for c in docs.columns}
    columns["text"] = F.when(some, F.col("_hidden")).otherwise(F.col("text"))
    if "n_chars" in columns:
        length = F.length("_hidden").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(some, length).otherwise(F.col("n_chars"))
    found = found.withColumn("_hidden", F.when(some, hidden))
    return found.select(*(c.alias(name) for name, c in columns.items()))
