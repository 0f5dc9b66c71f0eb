"""Spelling variants: words one edit apart, found by scanning sorted lists with shared matrix rows.

Counting. Runs of letters are exploded and counted by word, with partial sums in each task.

Zones. Two words one edit apart agree before the place of their first difference and after the
edit. For words of length L and L or L + 1, that place lies in the zone [0, m) or [m, L + 1),
m = (L + 1) // 2; a pair whose place lies in a zone [a, b) shares the first ``a`` and the last ``L - b``
code points, so words are grouped by these (and L), and only the core between them is compared. A group of
more than ``max_group`` words is dealt anew: its zone is halved, which lengthens what must be
shared, until the group is small or the zone is one place, where the letters bound its size. Each pair
lies in exactly one zone at each stage, so none is lost and none found twice.

Scan. Inside a group the cores are sorted. The three-cell band of the edit matrix of a query and a
prefix hangs on the prefix alone, so words that follow each other reuse the rows of their common
prefix (the LCP of neighbours), and when all cells of a row exceed one edit, the whole range of
words with that prefix is skipped. The scan goes down the list depth by depth for a batch of
queries and many groups at once, with array operations: a state is a query, a range of the list that
shares a prefix, and that prefix's row.

Forms. The best near word is one aggregation; roots come from pointer doubling (counts at least double at
each step, so chains have at most log2 of the largest count steps and doubling log2 of that).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import lower_az, whole


def typo(word: Column, id_: Column, one_in: int) -> Column:
    """The word, without one code point where ``one_in`` divides the unsigned crc32 of ``id:word``; a null id counts as empty.

    The code point deleted is number crc32 modulo the word's length, from 0.
    """
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = "A-Za-z\u00c0-\u00ff", min_length: int = 5,
                min_count: int = 3, one_in: int | None = 97) -> DataFrame:
    """``word, n``: the distinct words of ``min_length`` code points or more and ``min_count`` occurrences or more.

    Words are the maximal runs of ``letters`` (the inside of a character class that holds A-Z and a-z) of
    the whole texts, A-Z lower-cased, after ``typo`` (not applied if ``one_in`` is None). Repeated rows count each; a null
    text has no words.
    """
    runs = F.regexp_extract_all(lower_az(whole(text_col)), F.lit(f"[{letters}]+"), F.lit(0))
    words = df.select(F.col(id_col).alias("id"), F.explode(runs).alias("word"))
    if one_in is not None:
        words = words.select(typo(F.col("word"), F.col("id"), one_in).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# One edit apart, inside sorted groups

def _flat(cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings one after the other, and where each string begins (and the last ends)."""
    raw = cores.cast(pa.large_string())
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1]
    text = bytes(data[offsets[0]:offsets[-1]]) if data is not None else b""
    codes = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return codes, lead[offsets - offsets[0]]


def _neighbour_lcp(codes: np.ndarray, begin: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Code points that each string of a sorted list shares with the one before; -1 where a group starts."""
    lcp = np.full(len(length), -1, np.int64)
    live = np.flatnonzero(group[1:] == group[:-1]) + 1
    depth = 0
    while len(live):
        lcp[live] = depth
        live = live[(length[live] > depth) & (length[live - 1] > depth)]
        live = live[codes[begin[live] + depth] == codes[begin[live - 1] + depth]]
        depth += 1
    return lcp


def one_edit_pairs(cores: pa.Array, group: np.ndarray, asks: np.ndarray, states_at_once: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of a list that are in one group, one edit apart, with i asking.

    ``cores``: strings, distinct in their group and sorted by group and code points; ``group``: a number each;
    ``asks``: whether a string is a query, that is, looks for its near strings in the group. Two near
    strings that both ask are found from both sides.
    """
    codes, edges = _flat(cores)
    begin, length = edges[:-1], np.diff(edges)
    n = len(length)
    lcp = _neighbour_lcp(codes, begin, length, group)
    codes = np.append(codes, np.zeros(1, codes.dtype))  # a place to read from past the end
    starts = np.flatnonzero(lcp == -1)
    group_size = np.diff(np.append(starts, n))
    first, last = np.repeat(starts, group_size), np.repeat(starts + group_size, group_size)
    # The runs of each depth: strings that follow each other with depth + 1 common code points (first one, end).
    runs: list[tuple[np.ndarray, np.ndarray]] = []
    long = np.flatnonzero(length > 0)
    while len(long):
        depth = len(runs)
        new = np.flatnonzero(lcp[long] <= depth)
        runs.append((long[new], long[np.append(new[1:], len(long)) - 1] + 1))
        long = long[length[long] > depth + 1]

    queries = np.flatnonzero(asks & (last - first > 1))
    empty = queries[(length[first[queries]] == 0) & (length[queries] == 1)]
    found = [(empty, first[empty])]
    stack = []
    for at in range(0, len(queries), max(1, states_at_once // 40)):
        q = queries[at:at + max(1, states_at_once // 40)]
        row = np.zeros((len(q), 3), np.int8)  # distances of the empty prefix to the query's first -1, 0 and 1 code points; 2: two or more
        row[:, 0], row[:, 2] = 2, np.where(length[q] > 0, 1, 2)
        stack.append((0, q, first[q], last[q], row))
    while stack:
        depth, q, lo, hi, row = stack.pop()
        if depth >= len(runs):
            continue
        run, end = runs[depth]
        a, b = np.searchsorted(run, lo), np.searchsorted(run, hi)
        many = b - a
        total = int(many.sum())
        if total > states_at_once and len(q) > 1:
            half = len(q) // 2
            stack += [(depth, q[x], lo[x], hi[x], row[x]) for x in (slice(None, half), slice(half, None))]
            continue
        state = np.repeat(np.arange(len(q)), many)
        child = np.arange(total) + np.repeat(a - (np.cumsum(many) - many), many)
        i, at = q[state], run[child]
        code, size, old = codes[begin[at] + depth], length[i], row[state]
        new = np.empty_like(old)
        for k in range(3):  # the prefix with the next code point against the query's first depth + k
            j = depth + k
            cell = old[:, k] + (codes[np.minimum(begin[i] + max(j - 1, 0), len(codes) - 1)] != code)
            if k < 2:
                cell = np.minimum(cell, old[:, k + 1] + 1)
            if k > 0:
                cell = np.minimum(cell, new[:, k - 1] + 1)
            new[:, k] = np.where(j > size, 2, np.minimum(cell, 2))
        # Strings that end with this code point, compared as a whole.
        ends, k = length[at] == depth + 1, size - depth
        hit = np.flatnonzero(ends & (k >= 0) & (k <= 2))
        hit = hit[new[hit, k[hit]] == 1]
        found.append((i[hit], at[hit]))
        # Ranges whose common prefix is still within one edit, if longer strings are there.
        go = np.flatnonzero((new.min(1) <= 1) & ((end[child] - at > 1) | ~ends))
        if len(go):
            stack.append((depth + 1, i[go], at[go], end[child[go]], new[go]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _near_of_sorted(batches: Iterator[pa.RecordBatch], rows_at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Near words, both ways, from batches sorted by key and core; a group may go over several batches."""
    def near(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, core, word, n = (t[c].combine_chunks().cast(pa.large_string() if c != "n" else pa.int64()) for c in ("key", "core", "word", "n"))
        longer, closed = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("longer", "closed"))
        change = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        i, j = one_edit_pairs(core, np.concatenate(([0], np.cumsum(change))), ~longer)
        # An insertion at the zone's end belongs to the next zone.
        beyond = np.flatnonzero(closed[i] & longer[j])
        if len(beyond):
            short, long = core.take(pa.array(i[beyond])).to_pylist(), core.take(pa.array(j[beyond])).to_pylist()
            out = beyond[np.fromiter((y.startswith(x) for x, y in zip(short, long)), bool, len(beyond))]
            i, j = np.delete(i, out), np.delete(j, out)
        back = np.flatnonzero(longer[j])  # longer words do not ask
        a, b = np.concatenate((i, j[back])), np.concatenate((j, i[back]))
        for at in range(0, len(a), 50_000):
            x, y = pa.array(a[at:at + 50_000]), pa.array(b[at:at + 50_000])
            yield pa.RecordBatch.from_arrays([word.take(x).cast(pa.string()), word.take(y).cast(pa.string()), n.take(y)], names=["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= rows_at_once:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t["key"].combine_chunks()
            whole_groups = len(key) - pc.sum(pc.equal(key, key[len(key) - 1])).as_py()
            if whole_groups:
                yield from near(t.slice(0, whole_groups))
            t = t.slice(whole_groups)
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield from near(pa.Table.from_batches(held))


def near_words(words: DataFrame, max_group: int = 50_000) -> DataFrame:
    """``word, near, near_n``: a row for every ordered pair of distinct words one edit apart.

    ``words``: distinct words with their ``n``. Groups of more than ``max_group`` rows are halved by zone; groups
    of one place stay as they are.
    """
    length = F.length("word")
    zones = F.explode(F.flatten(F.transform(F.array(length, length - 1), lambda L: F.transform(
        F.array(F.lit(0), F.floor((L + 1) / 2).cast("int")), lambda a: F.struct(
            L.alias("L"), a.alias("a"), F.when(a == 0, F.floor((L + 1) / 2).cast("int")).otherwise(L + 1).alias("b")))))).alias("z")
    rows = words.where(length > 0).select("word", "n", zones).select("word", "n", "z.L", "z.a", "z.b").where("a < b").distinct()

    def keyed(rows: DataFrame) -> DataFrame:
        tail = F.greatest(F.col("L") - F.col("b"), F.lit(0))
        key = F.concat_ws("/", "L", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.substring(F.col("word"), length - tail + 1, tail))
        return rows.select("*", key.alias("key"), F.substring(F.col("word"), F.col("a") + 1, length - F.col("a") - tail).alias("core"))

    found = None
    while True:
        rows = keyed(rows)
        hot = rows.where("b - a > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > max_group).select("key")
        hot = materialise(hot, "spelling-hot")
        none = hot.isEmpty()
        ready = rows if none else rows.join(hot, "key", "left_anti")
        ready = ready.select("key", "core", (length > F.col("L")).alias("longer"), (F.col("b") <= F.col("L")).alias("closed"), "word", "n")
        pairs = ready.repartition("key").sortWithinPartitions("key", "core").mapInArrow(_near_of_sorted, "word string, near string, near_n long")
        found = pairs if found is None else found.unionAll(pairs)
        if none:
            return found
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("a").alias("x"), middle.alias("y")), F.struct(middle.alias("x"), F.col("b").alias("y")))).alias("h")
        again = rows.join(hot, "key", "left_semi").select("word", "n", "L", halves)
        rows = materialise(again.select("word", "n", "L", F.col("h.x").alias("a"), F.col("h.y").alias("b")), "spelling-zones")


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` (one form a word, no circles): where following the forms ends, by pointer doubling."""
    to = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = materialise(to.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if nxt.where("moved").isEmpty():
            return nxt.select("word", "root")
        to = nxt.select("word", "root")


def spelling_forms(words: DataFrame, ratio: float = 2, max_group: int = 50_000) -> DataFrame:
    """One row per word of ``words`` (``word, n``): ``word, form, root, n, n_near, form_n``.

    Near words differ by one inserted, deleted or replaced code point. ``form``: the near word of the largest n (ties: the
    smallest by code points) if its n is ``ratio`` times the word's or more, else null; ``ratio`` must be
    above 1, so that forms make no circles. ``root``: the last word when forms are followed, the word itself if it
    has none. Words must be distinct; an empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    best = near_words(words, max_group).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    judged = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    good = form_n >= F.col("n") * ratio
    judged = materialise(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"),
                                       F.when(good, form_n).alias("form_n")), "spelling-forms")
    roots = follow(judged.where(F.col("form").isNotNull()))
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = 2, max_group: int = 50_000, **counting) -> DataFrame:
    """``spelling_forms`` of the words that ``count_words`` finds in the texts of a table (``counting``: its parameters).

    Null and empty texts have no words, a null id counts as the empty text, repeated rows count each, an
    empty table gives an empty result, other columns are not read.
    """
    words = materialise(count_words(df, id_col, text_col, **counting), "spelling-words")
    return spelling_forms(words, ratio, max_group)
