"""Benchmark passages in documents by template canonicalisation, with DataFrame functions alone.

Both texts become templates: names (a capitalised word inside a sentence), numbers, and units
after numbers turn into typed placeholders, other words are lower-cased (A-Z) and lose the
punctuation at their ends; tokens of punctuation alone go. What is looked for are windows of
``window`` tokens that an item and a document share, as templates or as plain words (a copy in
lower case has no names, and a word after a heading is one for its surroundings). Every such
window holds an anchor, a shorter window that starts at a ``stride``-th token of the document;
anchors are hashed where the documents lie, in each kind, and meet the hashes of the benchmark's
windows of that length, which are written once so that their number is known: up to
``broadcast_rows`` of them are broadcast, more are joined by a shuffle. Only documents with a hit
are looked at again: an anchor fixes an alignment of one document, one item and an offset, in
which all tokens are compared: equal are those with equal templates or equal words. Runs of ``window`` equal tokens or more are kept, and
their slots must be consistent: one value of the item stands for one value of the document
throughout the alignment, or else throughout the run. Runs of ``window`` equal words always stay.
A question with other numbers or names in it is found; a chance meeting of placeholders is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytestats import bind
from ..session import materialise
from .text import BLANKS, lower_az, row_key, whole

# Placeholders (private-use characters) and units of measure.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = ["mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yards", "mile", "miles",
         "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l", "liter", "liters", "litre", "litres",
         "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days",
         "week", "weeks", "month", "months", "year", "years", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "kv", "j", "kj",
         "k", "c", "f", "degrees", "percent", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cents",
         "kb", "mb", "gb", "tb", "mph"]

_GAP = "\\x20\\x09-\\x0D"
_WORD = f"\\p{{L}}\\p{{N}}{NAME}{NUMBER}{UNIT}"
_UNITS = "|".join(UNITS)
# Each pattern begins with a class that few characters are in, and looks back only from there.
#: white space and a word with one capital, where no end of a sentence stands before; and where no line ends there either
_NAME_AT, _NAME_IN_LINE = (f"([{gap}](?<=[^.!?:{_GAP}][{gap}])[{gap}]*+)\\p{{Lu}}\\p{{Ll}}++(?=[^{_WORD}{_GAP}]*+(?:[{_GAP}]|\\z))" for gap in (_GAP, "\\x20\\x09\\x0B-\\x0D"))
#: a text without it has the same names by both
_LINE_NAME = f"\\n(?<=[^.!?:]\\n)[{_GAP}]*+\\p{{Lu}}\\p{{Ll}}"
#: punctuation at the start of a token, or at its end
_EDGES = f"[^{_WORD}{_GAP}](?:(?<![^{_GAP}][^{_WORD}{_GAP}])[^{_WORD}{_GAP}]*+|(?<=[{_WORD}][^{_WORD}{_GAP}])[^{_WORD}{_GAP}]*+(?=[{_GAP}]|\\z))"
_NUMBER_AT = f"[0-9](?<![^{_GAP}][0-9])[0-9.,:/-]*+(?:{_UNITS})?(?![^{_GAP}])"
_UNIT_AT = f"{NUMBER}([{_GAP}]++)(?:{_UNITS})(?![^{_GAP}])"


def _split(text: Column) -> Column:
    """Each step's text is bound, so that it is made once however often the next step looks at it."""
    return bind(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{_GAP}]+")))


def _plain(text: Column) -> Column:
    return bind(F.regexp_replace(text, _EDGES, ""), lower_az)


def plain_tokens(text: Column) -> Column:
    """Words without punctuation at their ends, lower-cased."""
    return _split(_plain(text))


def template_tokens(text: Column, name_at: str = _NAME_AT) -> Column:
    """As many tokens as ``plain_tokens``, with placeholders for names, numbers and units."""
    clean = _plain(F.regexp_replace(text, name_at, f"$1{NAME}"))
    return _split(F.regexp_replace(F.regexp_replace(clean, _NUMBER_AT, NUMBER), _UNIT_AT, f"{NUMBER}$1{UNIT}"))


def window_hashes(tokens: Column, n_tokens: Column, length: int, stride: int = 1) -> Column:
    """Hashes of the windows of an array of token hashes that start at every ``stride``-th token; fewer tokens than a window have none."""
    starts = F.when(n_tokens >= length, F.sequence(F.lit(0), n_tokens - length, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(tokens, i + k) for k in range(length)]).alias("h")))


_KEY = "_leaking_row_key"


def _whole_version(text_col: str) -> Column:
    return F.xxhash64(whole(text_col), F.length(whole(text_col)))


def _windows(df: DataFrame, keys: list[str], length: int, stride: int = 1) -> DataFrame:
    """``keys, pos, h`` of windows of ``text``: of its templates, and where they differ of its plain tokens and of templates whose names are inside a line."""
    kinds = {"t": template_tokens(F.col("text")), "p": plain_tokens(F.col("text")), "l": F.when(F.col("text").rlike(_LINE_NAME), template_tokens(F.col("text"), _NAME_IN_LINE))}
    hashed = df.select(*keys, *[F.transform(tokens, lambda t: F.xxhash64(t)).alias(name) for name, tokens in kinds.items()])
    own = {name: window_hashes(F.col(name), F.size(name), length, stride) for name in kinds}
    other = lambda t, name: F.array_compact(F.zip_with(t, own[name], lambda a, b: F.when(a["h"] != b["h"], b)))
    return hashed.select(*keys, F.inline(bind(own["t"], lambda t: F.concat(t, other(t, "p"), other(t, "l")))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = 8, min_literals: int = 4, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``id, version, item_id, n_windows, item_windows, n_slots, n_changed``: one row per document and item that leaks into it.

    ``version`` is a hash of the text, so that rows which repeat an id with another text are
    judged on their own; equal rows give one row here. ``n_windows``: the most windows of the item in one alignment;
    ``n_slots`` and ``n_changed``: its placeholders, and those whose values differ. An alignment
    or run needs ``min_literals`` tokens that are no placeholders, or no changed value. An item of fewer
    than ``window`` tokens is looked for as one window of its own length, if that has
    ``min_literals`` tokens at least; shorter ones cannot be told from chance and are never found.
    Null texts are empty; null ids of documents count, items with a null id are passed over, and
    one item id with several texts has the windows of all. Empty tables give an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    base = base.select("id", _whole_version("text").alias("version"), "text")
    items = (benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), whole(item_text_col).alias("text"))
             .distinct().withColumn("tokens", F.size(template_tokens(F.col("text")))).where(F.col("tokens") >= min_literals))
    items = materialise(items.withColumn("copy", F.xxhash64("text")), "items")
    short = [r[0] for r in items.where(F.col("tokens") < window).select("tokens").distinct().collect()]  # window - 1 values at most

    # Of each run of n equal tokens, an anchor of n - stride + 1 tokens starts at a stride-th token of the document.
    stride = {n: max(1, n // 2) for n in [window, *short]}
    wanted = hits = None
    for n, step in stride.items():
        own = items.where(F.col("tokens") >= window if n == window else F.col("tokens") == n)
        part = _windows(own, ["item", "copy"], n - step + 1).withColumn("n", F.lit(n))
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = materialise(wanted.withColumnRenamed("pos", "at"), "item-windows")
    bounded = wanted.count() <= broadcast_rows
    small = F.broadcast if bounded else (lambda df: df)
    for n, step in stride.items():
        hashes = wanted.where(F.col("n") == n).select("h").distinct()
        part = _windows(base, ["id", "version"], n - step + 1, step).join(small(hashes), "h", "left_semi").withColumn("n", F.lit(n))
        hits = part if hits is None else hits.unionByName(part)
    hits = materialise(hits.distinct(), "hits")

    # Alignments of a document, an item and an offset; all tokens of the item against the document's there.
    line = ["id", "version", "item", "copy", "off"]
    met = hits.join(small(wanted), ["h", "n"]).select("id", "version", "item", "copy", "n", (F.col("pos") - F.col("at")).alias("off")).distinct()
    both_kinds = F.arrays_zip(plain_tokens(F.col("text")).alias("plain"), template_tokens(F.col("text")).alias("template"))
    item_tokens = items.select("item", "copy", F.posexplode(both_kinds).alias("at", "i"))
    cells = met.join(small(item_tokens), ["item", "copy"]).select(*line, "n", "at", (F.col("off") + F.col("at")).alias("pos"), "i")
    # Texts with a hit, moved once and always merged, so that the plan is the same for few and for many.
    seen = hits.select(row_key(F.col("id"), F.col("version")).alias("key")).distinct()
    texts = base.withColumn("key", row_key(F.col("id"), F.col("version"))).join(seen.hint("merge"), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("id").alias("id"), F.first("version").alias("version"), F.first("text").alias("text"))
    doc_tokens = texts.select("id", "version", F.posexplode(both_kinds).alias("pos", "d"))
    c, d = cells.alias("c"), doc_tokens.alias("d")
    both = c.join(d, F.col("c.id").eqNullSafe(F.col("d.id")) & (F.col("c.version") == F.col("d.version")) & (F.col("c.pos") == F.col("d.pos")))
    both = both.select(*[F.col(f"c.{x}").alias(x) for x in line], "n", "at", F.col("i.template").alias("it"), F.col("i.plain").alias("ip"),
                       F.col("d.d.template").alias("dt"), F.col("d.d.plain").alias("dp")).where("it = dt or ip = dp")
    slot, differs = F.col("it").isin(NAME, NUMBER, UNIT), F.col("ip") != F.col("dp")
    # Runs of n equal tokens or more (windows over one item's tokens): of equal templates, of either kind, of equal words.
    for name, equal in (("alike", F.expr("it = dt")), ("equal", F.lit(True)), ("verbatim", ~differs)):
        both = both.withColumn(name, equal).withColumn(f"{name}_run", F.col("at") - F.row_number().over(Window.partitionBy(*line, name).orderBy("at")))
        both = both.withColumn(name, F.col(name) & (F.count("*").over(Window.partitionBy(*line, name, f"{name}_run")) >= F.col("n")))
    both = both.where("equal")
    # What fits is consistent, a value of a slot having one value of the document, and has literal tokens or no changed value.
    for name, by in (("fits_alike", [*line, "alike"]), ("fits", line), ("fits_run", [*line, "equal_run"])):
        value, part = Window.partitionBy(*by, "it", "ip"), Window.partitionBy(*by)
        both = both.withColumn("one", ~slot | (F.min("dp").over(value) == F.max("dp").over(value)))
        literals, changed = (F.count(F.when(x, 1)).over(part) for x in (~slot, slot & differs))
        both = both.withColumn(name, F.min("one").over(part) & ((literals >= min_literals) | (changed == 0)))
    # Templates that fit count alone; else the alignment if it fits, else its runs that fit, and of the others what is word for word.
    both = both.withColumn("fits_alike", F.col("alike") & F.col("fits_alike")).withColumn("found", F.max("fits_alike").over(Window.partitionBy(*line)))
    part = F.col("fits") | F.col("fits_run")
    both = both.withColumn("piece", F.when(F.col("found"), F.struct(F.col("alike_run").alias("a"), F.lit(0).cast("long").alias("b")))
                           .otherwise(F.struct(F.col("equal_run").alias("a"), F.when(part, F.lit(0).cast("long")).otherwise(F.col("verbatim_run")).alias("b"))))
    both = both.where(F.when(F.col("found"), F.col("alike")).otherwise(part | F.col("verbatim")))
    full = both.groupBy(*line).agg((F.count("*") - (F.first("n") - 1) * F.countDistinct("piece")).alias("n_windows"), F.first("found").alias("found"),
                                   F.count(F.when(slot, 1)).alias("n_slots"), F.count(F.when(slot & differs, 1)).alias("n_changed"))
    full = full.join(items.select("item", "copy", F.greatest(F.col("tokens") - window + 1, F.lit(1)).alias("item_windows")), ["item", "copy"])
    best = F.max(F.struct("found", "n_windows", (-F.col("n_changed")).alias("same"), "n_slots", "item_windows")).alias("x")
    return (full.groupBy("id", "version", "item").agg(best)
            .select("id", "version", F.col("item").alias("item_id"), F.col("x.n_windows").cast("long").alias("n_windows"), F.col("x.item_windows").cast("long").alias("item_windows"),
                    F.col("x.n_slots").cast("long").alias("n_slots"), (-F.col("x.same")).cast("long").alias("n_changed")))


def without_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that no row of ``leaks`` names."""
    rows = docs.withColumn(_KEY, row_key(F.col(id_col), _whole_version(text_col)))
    out = leaks.select(row_key(F.col("id"), F.col("version")).alias(_KEY)).distinct()
    return rows.join(out, _KEY, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
