"""Queries for 2.D byte-content features and the exploratory histogram statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import patterns
from ..operators import bytes as bt
from ..operators import flat as fl
from ..sources import view, with_views
from ..operators.partitioning import explode_array
from .registry import register, round_doubles

# bytes in long form: (doc_id, i, b) — DuckDB side only
_BL = ("bl", """SELECT doc_id, i, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS b
               FROM (SELECT doc_id, hex(content) AS h, unnest(range(size)) AS i FROM v_bytes) t""")
_HIST = ("hist", "SELECT doc_id, b, count(*) AS n FROM bl GROUP BY doc_id, b")
_STRS = ("strs", r"""SELECT doc_id, unnest(m) AS s, unnest(range(len(m))) AS pos
                    FROM (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7f]{5,}') AS m FROM v_bytes) t""")
_PSTRS = ("pstrs", r"""SELECT page_id, unnest(regexp_extract_all(html, '[\x20-\x7f]{5,}')) AS s FROM pages""")


def _bytes(spark, sf_dir):
    return view(spark, sf_dir, "v_bytes").select("doc_id", "content", "size")


@register("byte_histogram", with_views(["v_bytes"], "SELECT doc_id, b AS byte, CAST(n AS BIGINT) AS n FROM hist",
                                       [_BL, _HIST]))
def q_byte_histogram(spark, sf_dir):
    h = bt.byte_histogram(_bytes(spark, sf_dir))
    return explode_array(h, ["doc_id"], "histogram", "n", pos="byte").filter(F.col("n") > 0)


@register("byte_general", with_views(["v_bytes"], """
SELECT v.doc_id, v.size, round(e.entropy, 6) AS entropy, 0 AS is_pe,
       CASE WHEN v.size > 0 THEN CAST(('0x' || substr(hex(v.content), 1, 2)) AS INTEGER) ELSE 0 END AS start_byte_0,
       CASE WHEN v.size > 1 THEN CAST(('0x' || substr(hex(v.content), 3, 2)) AS INTEGER) ELSE 0 END AS start_byte_1,
       CASE WHEN v.size > 2 THEN CAST(('0x' || substr(hex(v.content), 5, 2)) AS INTEGER) ELSE 0 END AS start_byte_2,
       CASE WHEN v.size > 3 THEN CAST(('0x' || substr(hex(v.content), 7, 2)) AS INTEGER) ELSE 0 END AS start_byte_3
FROM v_bytes v LEFT JOIN (
  SELECT h.doc_id, -sum(h.n / t.size * log2(h.n / t.size)) AS entropy
  FROM hist h JOIN v_bytes t ON t.doc_id = h.doc_id GROUP BY h.doc_id) e ON e.doc_id = v.doc_id""",
                                     [_BL, _HIST]))
def q_byte_general(spark, sf_dir):
    b = _bytes(spark, sf_dir).select("doc_id", "content")
    g = bt.byte_general(b, is_pe=bt.magic_prefix("content", b"MZ"))
    return round_doubles(g.drop("content"))


@register("vec_general", with_views(["v_bytes"], """
SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(value, 6) AS value FROM (
  SELECT v.doc_id, unnest(range(7)) AS slot,
         unnest([CAST(v.size AS DOUBLE), e.entropy, 0.0,
                 CAST(('0x' || substr(hex(v.content), 1, 2)) AS INTEGER),
                 CAST(('0x' || substr(hex(v.content), 3, 2)) AS INTEGER),
                 CAST(('0x' || substr(hex(v.content), 5, 2)) AS INTEGER),
                 CAST(('0x' || substr(hex(v.content), 7, 2)) AS INTEGER)]) AS value
  FROM v_bytes v JOIN (SELECT h.doc_id, -sum(h.n / t.size * log2(h.n / t.size)) AS entropy
                       FROM hist h JOIN v_bytes t ON t.doc_id = h.doc_id GROUP BY h.doc_id) e
    ON e.doc_id = v.doc_id) x""", [_BL, _HIST]))
def q_vec_general(spark, sf_dir):
    v = bt.vec_general(_bytes(spark, sf_dir).select("doc_id", "content"), is_pe=bt.magic_prefix("content", b"MZ"))
    return round_doubles(explode_array(v, ["doc_id"], "vec_general", "value", pos="slot"))


_EH = [
    ("blk", """SELECT doc_id, size, unnest(CASE WHEN size < 2048 THEN [0]
                                               ELSE range(0, size - 2048 + 1, 1024) END) AS st FROM v_bytes"""),
    ("nb", """SELECT blk.doc_id, blk.st, bl.b >> 4 AS nib, count(*) AS c
              FROM blk JOIN bl ON bl.doc_id = blk.doc_id AND bl.i >= blk.st AND bl.i < blk.st + 2048
              GROUP BY ALL"""),
    ("hb", """SELECT doc_id, st, least(CAST(floor(2 * 2 * sum(-(c / 2048.0) * log2(c / 2048.0))) AS INTEGER), 15) AS hbin
              FROM nb GROUP BY ALL"""),
    ("eh", """SELECT nb.doc_id, hb.hbin, nb.nib, sum(nb.c) AS n FROM nb JOIN hb USING (doc_id, st) GROUP BY ALL"""),
]


@register("byte_entropy_hist", with_views(["v_bytes"], """
SELECT doc_id, CAST(hbin AS INTEGER) AS hbin, CAST(nib AS INTEGER) AS nibble, CAST(n AS BIGINT) AS n FROM eh""",
                                          [_BL] + _EH))
def q_byte_entropy_hist(spark, sf_dir):
    h = bt.byte_entropy_hist(_bytes(spark, sf_dir))
    x = explode_array(h, ["doc_id"], "byteentropy", "n", pos="cell").filter(F.col("n") > 0)
    return x.select("doc_id", (F.col("cell") / 16).cast("int").alias("hbin"),
                    (F.col("cell") % 16).cast("int").alias("nibble"), "n")


@register("printable_strings", with_views(["v_bytes"], "SELECT doc_id, CAST(pos AS INTEGER) AS pos, s FROM strs",
                                          [_STRS]))
def q_printable_strings(spark, sf_dir):
    b = _bytes(spark, sf_dir)
    return explode_array(b, ["doc_id"], bt.printable_strings("content"), "s", pos="pos")


_STATS_SQL = """
SELECT v.doc_id, CAST(COALESCE(a.numstrings, 0) AS BIGINT) AS numstrings,
       round(COALESCE(a.avlength, 0), 6) AS avlength, CAST(COALESCE(a.printables, 0) AS BIGINT) AS printables,
       round(COALESCE(ce.entropy, 0), 6) AS string_entropy
FROM v_bytes v
LEFT JOIN (SELECT doc_id, count(*) AS numstrings, avg(length(s)) AS avlength, sum(length(s)) AS printables
           FROM strs GROUP BY doc_id) a ON a.doc_id = v.doc_id
LEFT JOIN (SELECT doc_id, -sum(n / tot * log2(n / tot)) AS entropy FROM (
             SELECT doc_id, ch, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS tot
             FROM (SELECT doc_id, unnest(string_split(s, '')) AS ch FROM strs) c GROUP BY doc_id, ch) x
           GROUP BY doc_id) ce ON ce.doc_id = v.doc_id"""


@register("string_stats", with_views(["v_bytes"], _STATS_SQL, [_STRS]))
def q_string_stats(spark, sf_dir):
    b = _bytes(spark, sf_dir).withColumn("strings", bt.printable_strings("content"))
    s = bt.string_stats(b.select("doc_id", "strings"))
    return round_doubles(s.select("doc_id", "numstrings", "avlength", "printables", "string_entropy"))


def _sql_lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _ioc_sql(table: str, key: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {key}, {_sql_lit(n)} AS pattern, CAST(count(*) AS BIGINT) AS n FROM {table} "
        f"WHERE regexp_matches(s, {_sql_lit(p)}) GROUP BY {key}" for n, p in patterns())


@register("ioc_pattern_counts", with_views([], f"SELECT * FROM ({_ioc_sql('pstrs', 'page_id')}) t", [_PSTRS]))
def q_ioc_pattern_counts(spark, sf_dir):
    p = view(spark, sf_dir, "v_page_bytes").select("page_id", bt.printable_strings("content").alias("strings"))
    c = bt.ioc_pattern_counts(p)
    return explode_array(c, ["page_id"], "string_counts", ("pattern", "n"))


@register("ioc_pattern_counts_docs", with_views(["v_bytes"], f"SELECT * FROM ({_ioc_sql('strs', 'doc_id')}) t",
                                                [_STRS]))
def q_ioc_pattern_counts_docs(spark, sf_dir):
    b = _bytes(spark, sf_dir).select("doc_id", bt.printable_strings("content").alias("strings"))
    c = bt.ioc_pattern_counts(b)
    return explode_array(c, ["doc_id"], "string_counts", ("pattern", "n"))


_PAT_ORDER = ", ".join(f"({i}, {_sql_lit(n)})" for i, (n, _) in enumerate(patterns()))


_STRING_ITEMS = f"""
  SELECT doc_id, 0 AS slot, CAST(numstrings AS DOUBLE) AS value FROM st
  UNION ALL SELECT doc_id, 1, avlength FROM st
  UNION ALL SELECT doc_id, 2, CAST(printables AS DOUBLE) FROM st
  UNION ALL SELECT c.doc_id, 3 + c.code, c.n / CASE WHEN st.printables > 0 THEN st.printables ELSE 1 END
            FROM (SELECT doc_id, ascii(ch) - 32 AS code, count(*) AS n
                  FROM (SELECT doc_id, unnest(string_split(s, '')) AS ch FROM strs) z GROUP BY ALL) c
            JOIN st ON st.doc_id = c.doc_id
  UNION ALL SELECT doc_id, 99, string_entropy FROM st
  UNION ALL SELECT i.doc_id, 100 + po.idx, CAST(i.n AS DOUBLE)
            FROM ({_ioc_sql('strs', 'doc_id')}) i JOIN (VALUES {_PAT_ORDER}) po(idx, name) ON po.name = i.pattern"""
_ST = ("st", _STATS_SQL.replace("round(", "(").replace(", 6)", ")"))


@register("string_vector", with_views(["v_bytes"], f"""
SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(value, 6) AS value FROM ({_STRING_ITEMS}) t WHERE value <> 0""", [_STRS, _ST]))
def q_string_vector(spark, sf_dir):
    b = _bytes(spark, sf_dir).select("doc_id", bt.printable_strings("content").alias("strings"))
    v = bt.string_vector(b)
    x = explode_array(v, ["doc_id"], "vec_strings", "value", pos="slot").filter(F.col("value") != 0)
    return round_doubles(x)


@register("content_hash", with_views(["v_bytes"], "SELECT doc_id, sha256(content) AS sha256 FROM v_bytes"))
def q_content_hash(spark, sf_dir):
    return _bytes(spark, sf_dir).select("doc_id", bt.content_hash("content").alias("sha256"))


@register("range_entropy", with_views(["v_bytes"], """
SELECT v.doc_id, CAST(v.size - v.size // 2 AS BIGINT) AS overlay_size,
       round(CASE WHEN v.size - v.size // 2 > 0 THEN (v.size - v.size // 2) / v.size ELSE 0 END, 6) AS overlay_size_ratio,
       round(COALESCE(e.entropy, 0), 6) AS overlay_entropy
FROM v_bytes v LEFT JOIN (
  SELECT doc_id, -sum(n / tot * log2(n / tot)) AS entropy FROM (
    SELECT bl.doc_id, bl.b, count(*) AS n, sum(count(*)) OVER (PARTITION BY bl.doc_id) AS tot
    FROM bl JOIN v_bytes t ON t.doc_id = bl.doc_id WHERE bl.i >= t.size // 2 GROUP BY bl.doc_id, bl.b) x
  GROUP BY doc_id) e ON e.doc_id = v.doc_id""", [_BL]))
def q_range_entropy(spark, sf_dir):
    b = _bytes(spark, sf_dir)
    r = bt.range_entropy(b, "content", F.floor(F.col("size") / 2).cast("int"))
    return round_doubles(r.select("doc_id", "overlay_size", "overlay_size_ratio", "overlay_entropy"))


@register("magic_prefix", with_views(["v_bytes"], """
SELECT doc_id, CASE WHEN starts_with(text, 'Th') THEN 1 ELSE 0 END AS has_magic FROM v_bytes"""))
def q_magic_prefix(spark, sf_dir):
    b = _bytes(spark, sf_dir)
    return b.select("doc_id", bt.magic_prefix("content", b"Th").cast("int").alias("has_magic"))


@register("truncate_content", with_views(["v_bytes"], """
SELECT doc_id, CAST(least(size, 1000) AS BIGINT) AS n_bytes,
       sha256(unhex(substr(hex(content), 1, 2000))) AS sha256 FROM v_bytes"""))
def q_truncate_content(spark, sf_dir):
    t = _bytes(spark, sf_dir).select("doc_id", bt.truncate_content("content", 1000).alias("c"))
    return t.select("doc_id", F.length("c").cast("long").alias("n_bytes"), bt.content_hash("c").alias("sha256"))


_HSTATS = """
SELECT v.doc_id,
       round(COALESCE(-sum(h.n / v.size * log2(h.n / v.size)), 0), 6) AS byteH_entropy,
       round(CAST(max(h.n) AS DOUBLE), 6) AS byteH_max,
       CAST(count(h.n) AS BIGINT) AS byteH_nonzero,
       round(sqrt((sum(power(h.n - v.size / 256.0, 2)) + (256 - count(h.n)) * power(v.size / 256.0, 2)) / 256), 6)
         AS byteH_std,
       round(((sum(power(h.n - v.size / 256.0, 3)) + (256 - count(h.n)) * power(-v.size / 256.0, 3)) / 256)
             / (power(sqrt((sum(power(h.n - v.size / 256.0, 2)) + (256 - count(h.n)) * power(v.size / 256.0, 2))
                           / 256), 3) + 1e-12), 6) AS byteH_skew
FROM v_bytes v JOIN hist h ON h.doc_id = v.doc_id GROUP BY v.doc_id, v.size"""


@register("feat_hist_stats", with_views(["v_bytes"], _HSTATS, [_BL, _HIST]))
def q_feat_hist_stats(spark, sf_dir):
    h = bt.byte_histogram(_bytes(spark, sf_dir))
    return round_doubles(h.select("doc_id", *fl.feat_hist_stats(F.col("histogram"))).select(
        "doc_id", "byteH_entropy", F.col("byteH_max").cast("double").alias("byteH_max"),
        F.col("byteH_nonzero").cast("long").alias("byteH_nonzero"), "byteH_std", "byteH_skew"))


@register("feat_byteent_stats", with_views(["v_bytes"], """
SELECT e.doc_id, round(sum(e.n) / 256.0, 6) AS byteEH_mean, round(CAST(max(e.n) AS DOUBLE), 6) AS byteEH_max,
       round(sqrt((sum(power(e.n - s.m, 2)) + (256 - count(*)) * power(s.m, 2)) / 256), 6) AS byteEH_std
FROM eh e JOIN (SELECT doc_id, sum(n) / 256.0 AS m FROM eh GROUP BY doc_id) s ON s.doc_id = e.doc_id
GROUP BY e.doc_id, s.m""", [_BL] + _EH))
def q_feat_byteent_stats(spark, sf_dir):
    h = bt.byte_entropy_hist(_bytes(spark, sf_dir))
    return round_doubles(h.select("doc_id", *fl.feat_byteent_stats(F.col("byteentropy"))).select(
        "doc_id", "byteEH_mean", F.col("byteEH_max").cast("double").alias("byteEH_max"), "byteEH_std"))


_SCALAR_PATTERNS = {"paths": "file_path", "urls": "url", "registry": "registry_key"}


@register("feat_string_scalars", with_views(["v_bytes"], f"""
SELECT st.doc_id, CAST(printables AS DOUBLE) AS str_printables, string_entropy AS str_entropy,
       {', '.join(f"CAST(COALESCE(c.{f}, 0) AS BIGINT) AS str_{f}" for f in [*_SCALAR_PATTERNS, 'MZ'])}
FROM st LEFT JOIN (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE regexp_matches(s, {_sql_lit(dict(patterns())[p])})) AS {f}" for f, p in _SCALAR_PATTERNS.items())},
                          count(*) FILTER (WHERE contains(s, 'MZ')) AS "MZ" FROM strs GROUP BY doc_id) c ON c.doc_id = st.doc_id""",
                                            [_STRS, ("st", _STATS_SQL)]))
def q_feat_string_scalars(spark, sf_dir):
    """Scalars of a ``strings`` struct built from the statistics and pattern counts of a content's strings."""
    b = _bytes(spark, sf_dir).withColumn("strings", bt.printable_strings("content"))
    s = bt.ioc_pattern_counts(bt.string_stats(b.select("doc_id", "strings")), out="seen")
    count = lambda p: F.coalesce(F.try_element_at("seen", F.lit(p)), F.lit(0).cast("long"))
    rec = s.select("doc_id", F.struct(F.col("printables").cast("double").alias("printables"), F.col("string_entropy").alias("entropy"),
                                      *[count(p).alias(f) for f, p in _SCALAR_PATTERNS.items()],
                                      F.size(F.filter("strings", lambda x: F.contains(x, F.lit("MZ")))).cast("long").alias("MZ")).alias("strings"))
    return round_doubles(rec.select("doc_id", *fl.feat_string_scalars(rec.schema)))
