"""Language-model scores by a hierarchical Pitman-Yor process over pairs of whole words.

Restaurants: every word that comes before another has one, whose dishes are the words after it;
they share a parent over all words, whose parent is uniform over the known words and one unknown
word. All distinct pairs of the corpus are kept as rows, so what is gathered grows with it.

Words are numbers: 64-bit hashes, with another seed until no two words of the corpus share one.
Texts are then read into blocks, kept as arrays. Between jobs go messages, rows that carry packed
arrays, each to one of three kinds of places, all bounded in size and growing in number with the
corpus: blocks of texts; buckets of pairs, which are a range of contexts and a range of words, so
that a frequent word's pairs lie in many; and shards, which are ranges of words with their counts
and tables. Every block sends its distinct pairs to their buckets, where they are counted.

Seating is that of ``pitman_yor.seat``. A pair seen once has one table always, so a sweep goes over
the other pairs alone: shards tell buckets the tables of their words, buckets seat their pairs and
send the sums back. Tables of pairs seen once by context or word are its count less that of its
pairs of two or more. Draws are hashes of pair and sweep, so retried tasks agree. Probabilities are
averaged over the sweeps after ``burn``: blocks are told of their pairs of two or more and of their
words' last tables, from which every pair's probability follows, and sum them by text. No table is
sent to every task, and the driver reads totals alone. ``pair_probabilities`` is the same model over
a table of pairs, by joins; tests hold the two together.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, materialise, materialise_at
from .pitman_yor import _FLUSH, _MANY, END, Block, discount, discount_of, seat, tokens_of

_BLOCK_BYTES = 6 << 20
_BUCKET_TOKENS = 2_000_000  # tokens of the corpus for each bucket of pairs


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed) - (1 << 63)


def number_words(rows: DataFrame, hashed=word_hash) -> tuple[DataFrame, int]:
    """``w, c``: the number and training count of every word of ``rows`` (``held_out, text``); and the seed of the numbers."""
    def counts(seed: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()

            def out() -> pa.RecordBatch:
                words = list(found)
                return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([hashed(w, seed) for w in words], pa.int64()),
                                                   pa.array(list(found.values()), pa.int64())], names=["word", "w", "n"])

            for batch in batches:
                for held, text in zip(batch.column("held_out").to_pylist(), batch.column("text")):
                    toks = tokens_of(text.as_py())
                    found.update(toks if held is False else dict.fromkeys(toks, 0))
                    if len(found) > _FLUSH:
                        yield out()
                        found.clear()
            yield out()
        return run

    for seed in count():
        words = rows.select("held_out", "text").mapInArrow(counts(seed), "word binary, w long, n long")
        words = materialise(words.groupBy("word", "w").agg(F.sum("n").alias("c")).select("w", "c"), "words")
        if words.groupBy("w").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            return words, seed


def _key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (w.view(np.uint64) ^ np.uint64(0xD1342543DE82EF95))


def _table_sums(d: float, q: float, sweep: int):
    """``kind, at, x``: tables of a sweep per context (0) and per word (1)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            u, w = f["u"].to_numpy(np.int64), f["w"].to_numpy(np.int64)
            t = seat(f["c"].to_numpy(), (q + d * f["tables"].to_numpy()) * f["p"].to_numpy(), d, _key(u, w), sweep)
            for kind, at in ((0, u), (1, w)):
                own, which = np.unique(at, return_inverse=True)
                yield pd.DataFrame({"kind": kind, "at": own, "x": np.bincount(which, t)})
    return run


def _root_tables(d0: float, new: float, sweep: int):
    """Tables of the words in the parent; ``new``: the weight of another table."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            w, t = f["w"].to_numpy(np.int64), f["t"].to_numpy()
            yield pd.DataFrame({"w": w, "t": t, "t0": seat(t, np.full(len(t), new), d0, _key(w, w), sweep)})
    return run


def pair_probabilities(pairs: DataFrame, words: DataFrame, sweeps: int, burn: int, q: float) -> tuple[DataFrame, int]:
    """``u, w, lp, base, known`` for every row of ``pairs`` (``u, w, c``, a count of 0 for pairs to be scored alone): log10 of
    the word after the context, of its smoothed share of all tokens, and whether training has the word; and the training tokens.

    ``words`` (``w, c``) has every word of the pairs.
    """
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    norm, uniform = total + 0.1 * (distinct + 1), 1 / (distinct + 1)
    seen = pairs.where("c > 0")
    one, types = F.sum((F.col("c") == 1).cast("long")).cast("double").alias("ones"), F.count("*").cast("double").alias("tables")
    contexts = materialise(seen.groupBy("u").agg(F.sum("c").cast("double").alias("customers"), one, types), "contexts")
    dishes = materialise(words.join(seen.groupBy("w").agg(one, types), "w", "left").na.fill(0.0, ["ones", "tables"]), "dishes")
    again = materialise(pairs.where("c > 1"), "pairs-again", compression="zstd")
    d, d0 = discount(pairs, "c"), discount(dishes, "tables")
    root = float(distinct)
    state = (contexts.select("u", "tables"), dishes.select("w", ((F.col("c") + uniform) / (total + 1)).alias("p")))
    states = [state]
    for sweep in range(sweeps):
        rows = again.join(state[0], "u").join(state[1], "w")
        sums = materialise(rows.mapInPandas(_table_sums(d, q, sweep), "kind int, at long, x double").groupBy("kind", "at").agg(F.sum("x").alias("x")), "tables")
        now = (F.col("ones") + F.coalesce("x", F.lit(0.0)))
        after = materialise(contexts.join(sums.where("kind = 0").select(F.col("at").alias("u"), "x"), "u", "left").select("u", now.alias("tables")), "context-tables")
        up = dishes.join(sums.where("kind = 1").select(F.col("at").alias("w"), "x"), "w", "left").select("w", now.alias("t"))
        up = materialise(up.mapInPandas(_root_tables(d0, (q + d0 * root) * uniform, sweep), "w long, t double, t0 double"), "word-tables")
        customers, root = up.agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("t0"), F.lit(0.0))).first()
        state = (after, up.select("w", ((F.col("t") - d0 * F.col("t0") + (q + d0 * root) * uniform) / (q + customers)).alias("p")))
        states.append(state)

    # The tables of a kept sweep follow from the state before it, its probabilities from the one after.
    kept = states[burn:]
    for i, (ctx, dish) in enumerate(kept):
        contexts = contexts.join(ctx.withColumnRenamed("tables", f"tables{i}"), "u")
        dishes = dishes.join(dish.withColumnRenamed("p", f"p{i}"), "w")
    n_states = len(kept)
    contexts = materialise(contexts.drop("ones", "tables"), "context-states")
    dishes = materialise(dishes.drop("ones", "tables").withColumnRenamed("c", "seen"), "word-states")

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            u, w, c = (f[x].to_numpy(np.int64) for x in ("u", "w", "c"))
            tables = [f[f"tables{i}"].to_numpy() for i in range(n_states)]
            parent = [f[f"p{i}"].to_numpy() for i in range(n_states)]
            p, many, key = np.zeros(len(f)), np.flatnonzero(c > 1), _key(u, w)
            for i in range(1, n_states):
                t = np.minimum(c, 1).astype(np.float64)
                if len(many):
                    t[many] = seat(c[many], ((q + d * tables[i - 1]) * parent[i - 1])[many], d, key[many], burn + i - 1)
                p += c - d * t + (q + d * tables[i]) * parent[i]
            p /= (n_states - 1) * (q + f["customers"].to_numpy())
            n = f["seen"].to_numpy()
            yield pd.DataFrame({"u": u, "w": w, "lp": np.log10(p), "base": np.log10((n + 0.1) / norm), "known": (n > 0).astype(np.int8)})

    states_of = [f"tables{i}" for i in range(n_states)]
    rows = pairs.join(contexts, "u", "left").na.fill(0.0, ["customers", *states_of]).join(dishes, "w")
    return rows.mapInPandas(scored, "u long, w long, lp double, base double, known byte"), total


# Messages: rows that carry arrays of whole numbers between blocks of texts, buckets of pairs and shards of words

_STATE, _WORDS, _ASK, _AGAIN, _BACK, _VALUES, _SUMS, _TABLES, _NEED, _KNOWN, _FOUND, _CHUNK, _BLOCK = range(13)
_FIELDS = "abcde"
_MESSAGE = "kind int, at long, src long, a binary, b binary, c binary, d binary, e binary, x long, y long"
_TYPES = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("src", pa.int64()), *((f, pa.binary()) for f in _FIELDS), ("x", pa.int64()), ("y", pa.int64())])


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    return zstandard.compress(np.ascontiguousarray(x, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _rising(x: np.ndarray) -> bytes:
    """``_pack`` of numbers that ascend, by their steps (which wrap around beyond 63 bits)."""
    return _pack(np.diff(x, prepend=np.int64(0)))


def _risen(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x))


def _message(kind: int, at: int, src: int, *packed: bytes, x: int = 0, y: int = 0) -> tuple:
    return kind, at, src, *packed, *[None] * (len(_FIELDS) - len(packed)), x, y


def _table(messages: list[tuple], kind=pa.RecordBatch):
    columns = zip(*messages) if messages else [[]] * len(_TYPES)
    return kind.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _TYPES)], schema=_TYPES)


def _meet(f, *frames: DataFrame) -> DataFrame:
    """``f(at, rows by kind)`` for the messages of all ``frames`` that go to one place, the rows of a kind by ``src``."""
    def run(table: pa.Table) -> pa.Table:
        found = defaultdict(list)
        for r in sorted(table.to_pylist(), key=lambda r: (r["kind"], r["src"])):
            found[r["kind"]].append(r)
        return _table(f(table.column("at")[0].as_py(), found), pa.Table)
    return reduce(DataFrame.union, (x.select(_TYPES.names) for x in frames)).groupBy("at").applyInArrow(run, _MESSAGE)


def _cuts(h: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of 64-bit numbers begins in ascending ``h``, and the end."""
    edges = np.array([(i << 64) // n - (1 << 63) for i in range(1, n)], np.int64)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))


def _blocks(seed: int, block_bytes: int, id_type: pa.DataType, hashed=word_hash):
    """A row per block of texts: its words' numbers, ascending (``a``), its tokens as places among them (``b``), the place of the end (``x``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        block, named = Block(), []

        def row() -> pa.RecordBatch:
            nonlocal number, block
            at = (part << 20) + number
            number += 1
            own = np.fromiter((hashed(w, seed) for w in block.number), np.int64, len(block.number))
            order = np.argsort(own)
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            message = _table([_message(_BLOCK, at, 0, _rising(own[order]), _pack(place[np.concatenate(block.ids)]), x=int(place[block.number[END]]), y=sum(block.lengths))])
            lists = [pa.array([[x[0] for x in named]], pa.list_(id_type)), pa.array([[x[1] for x in named]], pa.list_(pa.bool_())), pa.array([block.lengths], pa.list_(pa.int64()))]
            block = Block()
            named.clear()
            return pa.RecordBatch.from_arrays(message.columns + lists, names=[*_TYPES.names, "id", "held_out", "n_tokens"])

        for batch in batches:
            for name, out, text in zip(batch.column("id"), batch.column("held_out"), batch.column("text")):
                text = text.as_py()
                if named and len(text or b"") >= block_bytes:  # a long text has a block of its own
                    yield row()
                named.append((name.as_py(), out.as_py()))
                if block.add(text) >= block_bytes or len(named) > _MANY:
                    yield row()
        if named:
            yield row()
    return run


class _Pairs:
    """The distinct pairs of a block, ascending within each bucket; ``ranges`` squared buckets are ranges of context and word."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, end: int, cuts: np.ndarray, ranges: int):
        m = int(cuts[-1])
        before = np.concatenate(([0], tokens[:-1]))
        before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = end
        code, which = np.unique(before * m + tokens, return_inverse=True)
        u, w = code // m, code % m
        side = np.repeat(np.arange(ranges), np.diff(cuts))
        bucket = side[u] * ranges + side[w]
        order = np.argsort(bucket, kind="stable")
        self.u, self.w = u[order], w[order]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.which = place[which]  # the pair of each token
        self.begins = np.searchsorted(bucket[order], np.arange(ranges * ranges + 1))


def _chunks(ranges: int):
    """Per block and bucket: the numbers of contexts and words, and by their places the pairs with their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, lengths = _risen(r["a"]), np.array(r["n_tokens"])
                pairs = _Pairs(_unpack(r["b"]), lengths, r["x"], _cuts(own, ranges), ranges)
                learned = np.repeat([x is False for x in r["held_out"]], lengths)
                c = np.bincount(pairs.which[learned], minlength=len(pairs.u))
                out = []
                for k, (f, e) in enumerate(zip(pairs.begins, pairs.begins[1:])):
                    if f < e:
                        u, iu = np.unique(pairs.u[f:e], return_inverse=True)
                        w, iw = np.unique(pairs.w[f:e], return_inverse=True)
                        out.append(_message(_CHUNK, k, r["at"], _rising(own[u]), _rising(own[w]), _rising(iu), _pack(iw), _pack(c[f:e])))
                yield _table(out)
    return run


def _needs(shards: int):
    """The numbers of a block's words, to the shards that have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, a in zip(batch.column("at").to_pylist(), batch.column("a")):
                own = _risen(a.as_py())
                cuts = _cuts(own, shards)
                yield _table([_message(_NEED, k, at, _rising(own[f:e])) for k, (f, e) in enumerate(zip(cuts, cuts[1:])) if f < e])
    return run


def _word_shards(shards: int):
    """Words and their counts, to their shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting, part, number = 0, TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            nonlocal number
            w, c = (np.concatenate([b.column(x).to_numpy() for b in held]) for x in ("w", "c"))
            held.clear()
            order = np.argsort(w)
            w, c = w[order], c[order]
            cuts = _cuts(w, shards)
            number += 1
            return _table([_message(_WORDS, k, (part << 20) + number, _rising(w[f:e]), _pack(c[f:e])) for k, (f, e) in enumerate(zip(cuts, cuts[1:])) if f < e])

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting > _FLUSH:
                yield out()
                waiting = 0
        if held:
            yield out()
    return run


def _count_bucket(shards: int):
    """Sums the counts of a bucket's pairs. Pairs of two or more stay (``_AGAIN``) and ask shards for their words (``_ASK``); blocks are told
    of them and of pairs that only another block has learned (``_BACK``); ``x, y``: pairs of one and of two."""
    def run(at: int, found: dict) -> list[tuple]:
        chunks = [[_risen(r["a"]), _risen(r["b"]), _risen(r["c"]), _unpack(r["d"]), _unpack(r["e"])] for r in found[_CHUNK]]
        vu, vw = (np.unique(np.concatenate([x[i] for x in chunks])) for i in (0, 1))
        code, which = np.unique(np.concatenate([np.searchsorted(vu, hu)[iu] * len(vw) + np.searchsorted(vw, hw)[iw] for hu, hw, iu, iw, _ in chunks]), return_inverse=True)
        c = np.rint(np.bincount(which, np.concatenate([x[4] for x in chunks]), len(code))).astype(np.int64)
        many = c > 1
        rank, again = np.cumsum(many) - 1, c[many]
        u, iu = np.unique(code[many] // len(vw), return_inverse=True)
        w, iw = np.unique(code[many] % len(vw), return_inverse=True)
        out = [_message(_AGAIN, at, 0, _rising(vu[u]), _rising(vw[w]), _rising(iu), _pack(iw), _pack(again), x=int((c == 1).sum()), y=int((c == 2).sum()))]
        for role, (h, i) in enumerate(((vu[u], iu), (vw[w], iw))):
            customers, dishes, cuts = np.rint(np.bincount(i, again, len(h))), np.bincount(i, minlength=len(h)), _cuts(h, shards)
            out += [_message(_ASK, k, 2 * at + role, _rising(h[f:e]), _pack(customers[f:e]), _pack(dishes[f:e])) for k, (f, e) in enumerate(zip(cuts, cuts[1:])) if f < e]
        begin = 0
        for r, x in zip(found[_CHUNK], chunks):
            own = which[begin:begin + len(x[4])]
            begin += len(own)
            back, other = np.flatnonzero(many[own]), np.flatnonzero((c[own] == 1) & (x[4] == 0))
            if len(back) or len(other):
                out.append(_message(_BACK, at, r["src"], _rising(back), _rising(rank[own[back]]), _rising(other)))
        return out
    return run


# Shards: words in ascending order (a), their counts (b), the tables of pairs seen once by context (c) and word (d), and per state
# the tables of the context, those of the word and those of the word in the root (e)

def _start_shard(at: int, found: dict) -> list[tuple]:
    """``x, y``: words after one and after two contexts."""
    h, c = (np.concatenate([f(r[x]) for r in found[_WORDS]]) for f, x in ((_risen, "a"), (_unpack, "b")))
    order = np.argsort(h)
    h, c = h[order], c[order]
    ones, types = np.stack([c, c]), np.zeros((2, len(h)), np.int64)
    for r in found[_ASK]:
        i = np.searchsorted(h, _risen(r["a"]))
        ones[r["src"] % 2, i] -= _unpack(r["b"])
        types[r["src"] % 2, i] += _unpack(r["c"])
    types += ones
    first = np.concatenate([types[0], c, np.zeros_like(c)])
    return [_message(_STATE, at, 0, _rising(h), _pack(c), _pack(ones[0]), _pack(ones[1]), _pack(first), x=int((types[1] == 1).sum()), y=int((types[1] == 2).sum()))]


def _last(r: dict, n: int, states: int = 1) -> np.ndarray:
    """By state, role and word: the last ``states`` of a shard of ``n`` words."""
    return _unpack(r["e"]).reshape(-1, 3, n)[-states:] if n else np.zeros((states, 3, 0), np.int64)


def _tell_tables(at: int, found: dict) -> list[tuple]:
    """What buckets asked: the tables of contexts; the tables of words, there and in the root."""
    state, = found[_STATE]
    h = _risen(state["a"])
    last = _last(state, len(h))[0]
    out = []
    for r in found[_ASK]:
        bucket, role = divmod(r["src"], 2)
        i = np.searchsorted(h, _risen(r["a"]))
        out.append(_message(_VALUES, bucket, 2 * at + role, *(_pack(x[i]) for x in (last[1:] if role else last[:1]))))
    return out


def _seat_bucket(d: float, q: float, parent, sweep: int):
    """Seats the pairs of a bucket: their tables, and the sums per context and word to the shards."""
    def run(at: int, found: dict) -> list[tuple]:
        r, = found[_AGAIN]
        hu, hw, iu, iw, c = _risen(r["a"]), _risen(r["b"]), _risen(r["c"]), _unpack(r["d"]), _unpack(r["e"])
        if not len(c):
            return []
        got = [[x for x in found[_VALUES] if x["src"] % 2 == role] for role in (0, 1)]
        tables = np.concatenate([_unpack(x["a"]) for x in got[0]])
        p = parent(*(np.concatenate([_unpack(x[f]) for x in got[1]]) for f in "ab"))
        t = seat(c, (q + d * tables[iu]) * p[iw], d, _key(hu[iu], hw[iw]), sweep)
        out = [_message(_TABLES, at, sweep, _pack(t))]
        for role, i in ((0, iu), (1, iw)):
            sums, begin = np.rint(np.bincount(i, t)), 0
            for x in got[role]:
                n = len(_unpack(x["a"]))
                out.append(_message(_SUMS, x["src"] // 2, 2 * at + role, _pack(sums[begin:begin + n])))
                begin += n
        return out
    return run


def _next_state(d0: float, new: float, sweep: int):
    """``x, y``: tables of the words, and in the root; ``new``: the weight of another table there."""
    def run(at: int, found: dict) -> list[tuple]:
        r, = found[_STATE]
        h = _risen(r["a"])
        tables = np.stack([_unpack(r["c"]), _unpack(r["d"])])
        asked = {x["src"]: x["a"] for x in found[_ASK]}
        for x in found[_SUMS]:
            tables[x["src"] % 2, np.searchsorted(h, _risen(asked[x["src"]]))] += _unpack(x["a"])
        t0 = np.rint(seat(tables[1], np.full(len(h), new), d0, _key(h, h), sweep)).astype(np.int64)
        now = np.concatenate([_unpack(r["e"]), *tables, t0])
        return [_message(_STATE, at, 0, *(r[f] for f in "abcd"), _pack(now), x=int(tables[1].sum()), y=int(t0.sum()))]
    return run


def _answer_blocks(at: int, found: dict) -> list[tuple]:
    """For every block its pairs of two or more, their counts and the sums of their tables; and its pairs that another block has once."""
    c = _unpack(found[_AGAIN][0]["e"])
    tables = sum((_unpack(r["a"]) for r in found[_TABLES]), np.zeros(len(c), np.int64))
    out = []
    for r in found[_BACK]:
        i = _risen(r["b"])
        out.append(_message(_FOUND, r["src"], at, r["a"], _pack(c[i]), _pack(tables[i]), r["c"]))
    return out


def _answer_words(states: int):
    """For every block the counts and last states of its words."""
    def run(at: int, found: dict) -> list[tuple]:
        r, = found[_STATE]
        h, c = _risen(r["a"]), _unpack(r["b"])
        last, out = _last(r, len(h), states), []
        for x in found[_NEED]:
            i = np.searchsorted(h, _risen(x["a"]))
            out.append(_message(_KNOWN, x["src"], at, _pack(c[i]), *(_pack(last[:, k, i].ravel()) for k in range(3))))
        return out
    return run


def _score_block(ranges: int, d: float, q: float, parents: list, norm: float, names: list[str]):
    """A row per text of a block, by the counts and states that came for its pairs and words."""
    def run(table: pa.Table) -> pa.Table:
        found = defaultdict(dict)
        for r in table.to_pylist():
            found[r["kind"]][r["src"]] = r
        block, states = found[_BLOCK][0], len(parents)
        words = [found[_KNOWN].get(k) for k in range(ranges * ranges)]
        sizes = [len(_unpack(r["a"])) if r else 0 for r in words]
        cuts = np.concatenate(([0], np.cumsum(sizes)))[::ranges]
        seen = np.concatenate([_unpack(r["a"]) for r in words if r])
        tables, of_word, in_root = (np.concatenate([_unpack(r[f]).reshape(states, -1) for r in words if r], 1) for f in "bcd")
        tokens, lengths = _unpack(block["b"]), np.array(block["n_tokens"])
        pairs = _Pairs(tokens, lengths, block["x"], cuts, ranges)
        learned = np.repeat([x is False for x in block["held_out"]], lengths)
        c = np.minimum(np.bincount(pairs.which[learned], minlength=len(pairs.u)), 1)
        t = c * states
        for k, r in found[_FOUND].items():
            at = pairs.begins[k] + _risen(r["a"])
            c[at], t[at] = _unpack(r["b"]), _unpack(r["c"])
            at = pairs.begins[k] + _risen(r["d"])
            c[at], t[at] = 1, states
        p = states * c - d * t
        for i, parent in enumerate(parents):
            p += (q + d * tables[i][pairs.u]) * parent(of_word[i], in_root[i])[pairs.w]
        lp = np.log10(p / (states * (q + seen[pairs.u])))
        text = np.repeat(np.arange(len(lengths)), lengths)
        base = np.log10((seen + 0.1) / norm)[tokens]
        known = np.bincount(text, seen[tokens] > 0, len(lengths)).astype(np.int64)
        columns = [table.filter(pc.equal(table.column("kind"), _BLOCK)).column(x).combine_chunks().flatten() for x in ("id", "held_out", "n_tokens")]
        return pa.Table.from_arrays([*columns, pa.array(known), pa.array(np.bincount(text, base, len(lengths))), pa.array(np.bincount(text, lp[pairs.which], len(lengths)))], names=names)
    return run


def word_pair_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 5, burn: int = 2,
                     concentration: float = 1.0, block_bytes: int = _BLOCK_BYTES, bucket_tokens: int = _BUCKET_TOKENS) -> DataFrame:
    """One row per input row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows where ``held_out`` is false. A null or empty text is the end
    alone. Rows that repeat an id are scored and learned from one by one. Without training rows
    every token has the probability of an unknown one. An empty table gives an empty result.
    Other columns are not read.
    """
    q, spark = concentration, df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    words, seed = number_words(rows)
    kind = rows.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    if id_type == pa.string():
        rows, kind = rows.withColumn("id", F.col("id").cast("string")), "string"
    lists = f"id array<{kind}>, held_out array<boolean>, n_tokens array<long>"
    blocks = materialise(rows.mapInArrow(_blocks(seed, block_bytes, id_type), f"{_MESSAGE}, {lists}"), "blocks")
    n_tokens = blocks.agg(F.coalesce(F.sum("y"), F.lit(0))).first()[0]
    ranges = int(np.ceil(np.sqrt(max(n_tokens, 1) / bucket_tokens)))
    shards = ranges * ranges
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    norm, uniform = total + 0.1 * (distinct + 1), 1 / (distinct + 1)

    chunks = blocks.select("at", "a", "b", "x", "held_out", "n_tokens").mapInArrow(_chunks(ranges), _MESSAGE)
    counted = materialise(_meet(_count_bucket(shards), chunks), "pairs")
    again, asks, back = (counted.where(F.col("kind") == k) for k in (_AGAIN, _ASK, _BACK))
    d = discount_of(*again.agg(F.sum("x"), F.sum("y")).first())
    state, path = materialise_at(_meet(_start_shard, words.mapInArrow(_word_shards(shards), _MESSAGE), asks), "word-states")
    d0 = discount_of(*state.agg(F.sum("x"), F.sum("y")).first())
    root, kept, parents = float(distinct), [], []

    def parent(t: np.ndarray, t0: np.ndarray) -> np.ndarray:
        return (t + uniform) / (total + 1)

    for sweep in range(sweeps):
        values = _meet(_tell_tables, state, asks)
        tables, tables_path = materialise_at(_meet(_seat_bucket(d, q, parent, sweep), values, again), "tables")
        old, new = path, (q + d0 * root) * uniform
        state, path = materialise_at(_meet(_next_state(d0, new, sweep), state, asks, tables.where(F.col("kind") == _SUMS)), "word-states")
        delete_path(spark, old)
        customers, root = (float(x or 0) for x in state.agg(F.sum("x"), F.sum("y")).first())

        def parent(t: np.ndarray, t0: np.ndarray, customers=customers, root=root) -> np.ndarray:
            return (t - d0 * t0 + (q + d0 * root) * uniform) / (q + customers)

        if sweep < burn:
            delete_path(spark, tables_path)
        else:
            kept.append(tables.where(F.col("kind") == _TABLES))
            parents.append(parent)

    found = _meet(_answer_blocks, again, back, *kept)
    known = _meet(_answer_words(len(parents)), state, blocks.select("at", "a").mapInArrow(_needs(shards), _MESSAGE))
    names = [id_col, "held_out", "n_tokens", "n_known", "base_score", "score"]
    scored = blocks.withColumn("a", F.lit(None).cast("binary")).unionByName(found.union(known), allowMissingColumns=True).groupBy("at").applyInArrow(
        _score_block(ranges, d, q, parents, norm, names), f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(id_col, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
