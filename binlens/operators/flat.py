"""Flat feature families: nested raw record -> 82 scalar columns.

Everything is an in-row expression over structs, arrays and maps
(higher-order functions), so flattening is a narrow projection fused into
the scan stage: no explode, no shuffle. Absent fields are resolved against
the schema at plan time (``nested_get``), NULLs become 0 like the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bytestats import entropy_of_counts, moments
from ..functions.columns import bool_int, field_type, first_present, has_path, nested_get
from ..functions.hashing import blake2b_bins

# The ordered flat feature list (82 columns).
FEATURE_COLS = [
    "sec_exec_ratio", "sec_entropy_std", "sec_write_ratio", "sec_entropy_max", "sec_exec_count",
    "sec_write_count", "hdr_sizeof_headers",
    "datadir_nonempty", "imp_available", "imp_func_count", "imp_dll_count", "sec_entropy_min",
    "hdr_sizeof_code", "exp_available", "exp_count", "hdr_major_subsys_ver", "sec_rawsize_mean",
    "sec_count", "sec_read_count", "sec_rawsize_max",
    "sec_entropy_mean", "sec_virtsize_mean", "gen_size", "gen_vsize", "gen_has_debug",
    "gen_has_relocations", "gen_has_resources", "gen_has_signature", "gen_has_tls", "gen_symbols",
    "hdr_sizeof_init", "hdr_sizeof_uninit", "hdr_sizeof_heap_commit", "hdr_subsystem",
    "hdr_dll_characteristics", "hdr_magic", "hdr_major_linker_ver", "hdr_minor_linker_ver",
    "hdr_major_os_ver", "hdr_minor_os_ver", "hdr_major_img_ver", "hdr_minor_img_ver",
    "hdr_minor_subsys_ver", "hdr_file_alignment", "hdr_machine", "hdr_timestamp",
    "hdr_characteristics", "datadir_count",
    "sec_high_entropy_frac", "sec_std_name_frac", "imp_has_gui_libs", "dd_resource_size", "dd_cert_present",
    "is_dll", "has_upx_sections", "has_inno_sections", "imp_has_crt",
    "rich_num_pairs", "rich_hash_0", "rich_hash_1", "rich_hash_2", "rich_hash_3", "rich_hash_4",
    "rich_hash_5", "rich_hash_6", "rich_hash_7",
    "auth_num_certs", "auth_self_signed", "auth_parse_error", "auth_chain_depth",
    "auth_sign_time_delta_abs", "auth_no_countersigner",
    "pe_warn_count", "pe_warn_checksum", "pe_warn_section", "pe_warn_import", "pe_warn_export",
    "pe_warn_overlay",
    "overlay_size", "overlay_size_ratio", "overlay_entropy", "overlay_present",
]

# Raw columns read by the flattener.
RAW_COLS_NEEDED = ["label", "general", "header", "section", "datadirectories", "imports", "exports",
                   "richheader", "authenticode", "pefilewarnings"]

# Optional-header fields and their short aliases (same order).
HDR_OPT_FIELDS = [
    "sizeof_code", "sizeof_headers", "sizeof_initialized_data", "sizeof_uninitialized_data",
    "sizeof_heap_commit", "subsystem", "dll_characteristics", "magic", "major_linker_version",
    "minor_linker_version", "major_operating_system_version", "minor_operating_system_version",
    "major_image_version", "minor_image_version", "major_subsystem_version", "minor_subsystem_version",
    "file_alignment",
]
HDR_OPT_ALIASES = [
    "sizeof_code", "sizeof_headers", "sizeof_init", "sizeof_uninit", "sizeof_heap_commit", "subsystem",
    "dll_characteristics", "magic", "major_linker_ver", "minor_linker_ver", "major_os_ver", "minor_os_ver",
    "major_img_ver", "minor_img_ver", "major_subsys_ver", "minor_subsys_ver", "file_alignment",
]
GENERAL_FIELDS = ["vsize", "size", "has_debug", "has_relocations", "has_resources", "has_signature",
                  "has_tls", "symbols"]
HDR_FILE_FIELDS = ["machine", "timestamp", "characteristics"]

# Standard section names, GUI DLLs, C-runtime prefixes, warning keywords.
STANDARD_SEC_NAMES = [".text", ".data", ".rdata", ".bss", ".rsrc", ".reloc", ".idata", ".edata",
                      ".pdata", ".tls", ".crt", ".debug", ".code", ".xdata", ".didat", ".sxdata", ".00cfg"]
GUI_DLLS = ["user32.dll", "gdi32.dll", "comctl32.dll", "shell32.dll", "comdlg32.dll"]
CRT_PREFIXES = ["vcruntime", "api-ms-win-crt-"]
WARN_KEYWORDS = ["checksum", "section", "import", "export", "overlay"]
DLL_FLAG = 0x2000
HIGH_ENTROPY = 7.0
RICH_BINS = 8

# Alias fallbacks between alternative raw names.
RICH_ALIASES = ["rich_header", "richheader", "rich"]
AUTH_ALIASES = ["authenticode", "signature", "signing"]
WARN_ALIASES = ["pe_warnings", "pefile_warnings", "pefilewarnings", "warnings"]


def _dbl(c: Column) -> Column:
    return c.cast("double")


def _strip_lower(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", "")


def feat_general(schema: T.StructType) -> list[Column]:
    return [nested_get(schema, f"general.{f}", 0).alias(f"gen_{f}") for f in GENERAL_FIELDS]


def feat_header(schema: T.StructType) -> list[Column]:
    out = [nested_get(schema, f"header.file.{f}", 0).alias(f"hdr_{f}") for f in HDR_FILE_FIELDS]
    out += [nested_get(schema, f"header.optional.{f}", 0).alias(f"hdr_{a}")
            for f, a in zip(HDR_OPT_FIELDS, HDR_OPT_ALIASES)]
    return out


def feat_bitflag(schema: T.StructType, path: str = "header.file.characteristics",
                 mask: int = DLL_FLAG, name: str = "is_dll") -> Column:
    """``(value & mask) != 0`` for a numeric field, else 0."""
    dt = field_type(schema, path)
    if not isinstance(dt, T.NumericType):
        return F.lit(0).alias(name)
    v = F.coalesce(F.col(path).cast("long"), F.lit(0))
    return F.when(v.bitwiseAND(mask) != 0, 1).otherwise(0).alias(name)


def _sections(schema: T.StructType) -> Column:
    if not isinstance(field_type(schema, "section.sections"), T.ArrayType):
        return F.array().cast("array<struct<name:string,size:long,entropy:double,vsize:long,props:array<string>>>")
    return F.coalesce(F.col("section.sections"), F.array())


def _sec_field(s, name, schema) -> Column:
    st = field_type(schema, "section.sections")
    fields = st.elementType.fieldNames() if isinstance(st, T.ArrayType) and \
        isinstance(st.elementType, T.StructType) else []
    return F.coalesce(_dbl(s[name]), F.lit(0.0)) if name in fields else F.lit(0.0)


def section_lists(schema: T.StructType) -> dict[str, Column]:
    """Lists over the sections that several features read: entropies, raw sizes and stripped names.

    ``flatten_record`` makes columns of them; inside the features each reader would make its list anew.
    """
    secs, st = _sections(schema), field_type(schema, "section.sections")
    has_names = isinstance(st, T.ArrayType) and isinstance(st.elementType, T.StructType) \
        and "name" in st.elementType.fieldNames()
    return {"_sec_entropies": F.transform(secs, lambda s: _sec_field(s, "entropy", schema)),
            "_sec_sizes": F.transform(secs, lambda s: _sec_field(s, "size", schema)),
            "_sec_names": F.transform(secs, lambda s: _strip_lower(s["name"])) if has_names else F.array().cast("array<string>")}


def feat_section_stats(schema: T.StructType) -> list[Column]:
    """Count, entropy mean/max/min/population std, raw size mean/max, virtual size mean, flags."""
    secs = _sections(schema)
    n = F.size(secs)
    ent, rsz, names = (F.col(name) if has_path(schema, name) else made for name, made in section_lists(schema).items())
    vsz = F.transform(secs, lambda s: _sec_field(s, "vsize", schema))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    nd = n.cast("double")
    mean_e, std_e = total(ent) / nd, F.sqrt(moments(ent)["m2"] / nd)

    def count_prop(p):
        st = field_type(schema, "section.sections")
        has_props = isinstance(st, T.ArrayType) and isinstance(st.elementType, T.StructType) \
            and "props" in st.elementType.fieldNames()
        if not has_props:
            return F.lit(0)
        return F.size(F.filter(secs, lambda s: F.coalesce(F.array_contains(s["props"], p), F.lit(False))))

    ex, wr, rd = count_prop("MEM_EXECUTE"), count_prop("MEM_WRITE"), count_prop("MEM_READ")
    std_set = F.array(*[F.lit(x) for x in STANDARD_SEC_NAMES])
    empty = n == 0

    def z(c):
        return F.when(empty, F.lit(0)).otherwise(c)

    return [
        n.alias("sec_count"),
        z(mean_e).alias("sec_entropy_mean"),
        z(F.array_max(ent)).alias("sec_entropy_max"),
        z(F.array_min(ent)).alias("sec_entropy_min"),
        z(std_e).alias("sec_entropy_std"),
        z(total(rsz) / nd).alias("sec_rawsize_mean"),
        z(F.array_max(rsz)).alias("sec_rawsize_max"),
        z(total(vsz) / nd).alias("sec_virtsize_mean"),
        ex.alias("sec_exec_count"), wr.alias("sec_write_count"), rd.alias("sec_read_count"),
        z(ex / nd).alias("sec_exec_ratio"),
        z(wr / nd).alias("sec_write_ratio"),
        z(F.size(F.filter(ent, lambda e: e > F.lit(HIGH_ENTROPY))) / nd).alias("sec_high_entropy_frac"),
        z(F.size(F.filter(names, lambda nm: F.array_contains(std_set, nm))) / nd).alias("sec_std_name_frac"),
        z(F.exists(names, lambda nm: F.instr(nm, "upx") > 0).cast("int")).alias("has_upx_sections"),
        z(F.exists(names, lambda nm: nm == F.lit(".itext")).cast("int")).alias("has_inno_sections"),
    ]


def feat_datadirs(schema: T.StructType, col: str = "datadirectories") -> list[Column]:
    """Count, non-empty count, RESOURCE size (index 2), certificate present (index 4)."""
    dt = field_type(schema, col)
    if isinstance(dt, T.ArrayType) and has_path(schema, "_dd_kind"):
        from .layout import datadir_features  # list normalised from list-or-dict JSON
        return datadir_features(F.struct(F.col("_dd_kind").alias("kind"),
                                         F.coalesce(F.col(col), F.array()).alias("dirs")), "A")
    if isinstance(dt, T.ArrayType):
        dd = F.coalesce(F.col(col), F.array())
        size_of = lambda d: F.coalesce(d["size"].cast("double"), F.lit(0.0))
        return [
            F.size(dd).alias("datadir_count"),
            F.size(F.filter(dd, lambda d: size_of(d) > 0)).alias("datadir_nonempty"),
            F.coalesce(F.get(dd, 2)["size"], F.lit(0)).alias("dd_resource_size"),
            F.when(F.coalesce(F.get(dd, 4)["size"], F.lit(0)) > 0, 1).otherwise(0).alias("dd_cert_present"),
        ]
    if isinstance(dt, T.MapType):
        vals = F.coalesce(F.map_values(F.col(col)), F.array())
        return [
            F.coalesce(F.size(F.col(col)), F.lit(0)).alias("datadir_count"),
            F.size(F.filter(vals, lambda d: F.coalesce(d["size"], F.lit(0)) > 0)).alias("datadir_nonempty"),
            F.lit(0).alias("dd_resource_size"), F.lit(0).alias("dd_cert_present"),
        ]
    return [F.lit(0).alias(c) for c in ("datadir_count", "datadir_nonempty", "dd_resource_size",
                                         "dd_cert_present")]


def feat_imports(schema: T.StructType, col: str = "imports") -> list[Column]:
    """Availability flag, DLL count, function count, GUI-library and C-runtime flags."""
    if not isinstance(field_type(schema, col), T.MapType):
        return [F.lit(0).alias(c) for c in ("imp_available", "imp_dll_count", "imp_func_count",
                                             "imp_has_gui_libs", "imp_has_crt")]
    m = F.col(col)
    n = F.coalesce(F.size(m), F.lit(0))
    keys = F.transform(F.coalesce(F.map_keys(m), F.array()), lambda k: F.lower(k))
    funcs = F.aggregate(F.coalesce(F.map_values(m), F.array()), F.lit(0),
                        lambda a, v: a + F.coalesce(F.size(v), F.lit(0)))
    gui = F.exists(keys, lambda k: k.isin(*GUI_DLLS))
    crt = F.exists(keys, lambda k: k.startswith(CRT_PREFIXES[0]) | k.startswith(CRT_PREFIXES[1]))
    avail = n > 0
    return [
        avail.cast("int").alias("imp_available"),
        F.when(avail, n).otherwise(0).alias("imp_dll_count"),
        F.when(avail, funcs).otherwise(0).alias("imp_func_count"),
        F.when(avail, gui.cast("int")).otherwise(0).alias("imp_has_gui_libs"),
        F.when(avail, crt.cast("int")).otherwise(0).alias("imp_has_crt"),
    ]


def feat_exports(schema: T.StructType, col: str = "exports") -> list[Column]:
    dt = field_type(schema, col)
    cnt = F.coalesce(F.size(F.col(col)), F.lit(0)) if isinstance(dt, (T.ArrayType, T.MapType)) else F.lit(0)
    return [cnt.alias("exp_count"), (cnt > 0).cast("int").alias("exp_available")]


def _rich_values(schema: T.StructType) -> Column | None:
    name = next((c for c in RICH_ALIASES if has_path(schema, c)), None)  # presence-based
    if name is None:
        return None
    dt = field_type(schema, name)
    if isinstance(dt, T.ArrayType):
        return F.col(name)
    if isinstance(dt, T.StructType):
        return first_present(schema, [f"{name}.values", f"{name}.raw"], default=None, null_aware=False) \
            if any(has_path(schema, f"{name}.{f}") for f in ("values", "raw")) else None
    return None


def rich_items(schema: T.StructType, exact_hash: bool = False) -> Column | None:
    """(bin, sign, count) per complete (compid, count) pair; md5 computed once per compid."""
    vals = _rich_values(schema)
    if vals is None:
        return None
    vals = F.coalesce(vals, F.array())
    n = F.size(vals)
    n_pairs = F.when(n >= 2, F.floor(n / 2)).otherwise(0).cast("int")
    idx = F.when(n_pairs > 0, F.sequence(F.lit(0), n_pairs - 1)).otherwise(F.array().cast("array<int>"))
    compids = F.transform(idx, lambda i: F.get(vals, i * 2).cast("string"))
    counts = F.transform(idx, lambda i: F.get(vals, i * 2 + 1).cast("double"))
    if exact_hash:
        hb = blake2b_bins(compids, RICH_BINS)
        return F.transform(F.arrays_zip(hb.alias("h"), counts.alias("c")), lambda p: F.struct(
            p["h"]["bin"].alias("bin"), p["h"]["sign"].alias("sign"), p["c"].alias("c")))
    hashed = F.transform(F.arrays_zip(compids.alias("k"), counts.alias("c")), lambda p: F.struct(
        F.conv(F.substring(F.md5(p["k"]), 1, 15), 16, 10).cast("long").alias("h"), p["c"].alias("c")))
    return F.transform(hashed, lambda q: F.struct(
        F.pmod(q["h"], F.lit(RICH_BINS)).cast("int").alias("bin"),
        F.when(F.pmod(q["h"], F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign"),
        q["c"].alias("c")))


def feat_rich_pairs(schema: T.StructType, exact_hash: bool = False) -> list[Column]:
    """Pair count and signed sums of counts in 8 hashed compid bins.

    Reads the ``_rich_items`` helper column when ``flatten_record`` prepared it
    (so the hashing runs once per pair, not once per bin).
    """
    if has_path(schema, "_rich_items"):
        items = F.col("_rich_items")
    else:
        items = rich_items(schema, exact_hash)
    if items is None:
        return [F.lit(0).alias("rich_num_pairs")] + [F.lit(0.0).alias(f"rich_hash_{i}") for i in range(RICH_BINS)]
    out = [F.size(items).alias("rich_num_pairs")]

    def add_bin(b):
        return lambda a, it: a + F.when((it["bin"] == b) & it["c"].isNotNull(),
                                        it["sign"] * it["c"]).otherwise(0.0)

    for b in range(RICH_BINS):
        out.append(F.aggregate(items, F.lit(0.0), add_bin(b)).alias(f"rich_hash_{b}"))
    return out


def feat_authenticode(schema: T.StructType) -> list[Column]:
    """Signature scalars with field aliases; absent -> 0."""
    name = next((c for c in AUTH_ALIASES if has_path(schema, c)), None)
    if name is None or not isinstance(field_type(schema, name), T.StructType):
        return [F.lit(0).alias(c) for c in ("auth_num_certs", "auth_self_signed", "auth_parse_error",
                                             "auth_chain_depth", "auth_sign_time_delta_abs",
                                             "auth_no_countersigner")]
    g = lambda *fs: first_present(schema, [f"{name}.{f}" for f in fs], default=0)
    return [
        g("num_certs", "certificate_count").alias("auth_num_certs"),
        bool_int(g("self_signed")).alias("auth_self_signed"),
        bool_int(g("parse_error")).alias("auth_parse_error"),
        g("chain_max_depth", "chain_depth").alias("auth_chain_depth"),
        F.abs(g("signing_time_diff", "sign_time_delta")).alias("auth_sign_time_delta_abs"),
        bool_int(g("no_countersigner")).alias("auth_no_countersigner"),
    ]


def warnings_list(schema: T.StructType) -> Column:
    """Warnings as array<string>: string -> [s], map -> ["k:v"], array -> each as text, else []."""
    name = next((c for c in WARN_ALIASES if has_path(schema, c)), None)
    empty = F.array().cast("array<string>")
    if name is None:
        return empty
    dt, c = field_type(schema, name), F.col(name)
    if isinstance(dt, T.StringType):
        return F.when(c.isNull(), empty).otherwise(F.array(c))
    if isinstance(dt, T.MapType):
        return F.coalesce(F.transform(F.map_entries(c), lambda e: F.concat_ws(
            ":", e["key"].cast("string"), F.coalesce(e["value"].cast("string"), F.lit("None")))), empty)
    if isinstance(dt, T.ArrayType):
        return F.coalesce(F.transform(c, lambda w: F.coalesce(w.cast("string"), F.lit("None"))), empty)
    return empty


def feat_warnings(schema: T.StructType, warnings: Column | None = None) -> list[Column]:
    """Count + 5 keyword flags (case-insensitive substring over all warnings)."""
    w = warnings if warnings is not None else warnings_list(schema)
    out = [F.size(w).alias("pe_warn_count")]
    def has_kw(k):
        return lambda x: F.instr(F.lower(x), k) > 0

    for k in WARN_KEYWORDS:
        out.append(F.exists(w, has_kw(k)).cast("int").alias(f"pe_warn_{k}"))
    return out


def feat_overlay(schema: T.StructType) -> list[Column]:
    """Overlay size/ratio/entropy/present from top-level ``overlay`` else ``section.overlay``."""
    path = "overlay" if has_path(schema, "overlay") else "section.overlay"
    if not isinstance(field_type(schema, path), T.StructType):
        return [F.lit(0).alias(c) for c in ("overlay_size", "overlay_size_ratio", "overlay_entropy",
                                             "overlay_present")]
    size = nested_get(schema, f"{path}.size", 0)
    return [size.alias("overlay_size"),
            nested_get(schema, f"{path}.size_ratio", 0).alias("overlay_size_ratio"),
            nested_get(schema, f"{path}.entropy", 0).alias("overlay_entropy"),
            bool_int(size).alias("overlay_present")]


def family_columns(schema: T.StructType, exact_hash: bool = False) -> list[Column]:
    """All flat feature expressions (aliased), family by family."""
    return (feat_general(schema) + feat_header(schema) + [feat_bitflag(schema)] + feat_section_stats(schema)
            + feat_datadirs(schema) + feat_imports(schema) + feat_exports(schema)
            + feat_rich_pairs(schema, exact_hash) + feat_authenticode(schema) + feat_warnings(schema)
            + feat_overlay(schema))


def flatten_record(df: DataFrame, keep: list[str] | None = None, label: str | None = "label",
                   exact_hash: bool = False) -> DataFrame:
    """The 82 flat features in reference order (+ ``keep`` columns and the label).

    Two stacked projections that Catalyst collapses into one; raw columns are
    not carried, which keeps the output under the codegen field limit.
    """
    keep = list(keep or [])
    lab = [label] if label and label in df.columns else []
    items = rich_items(df.schema, exact_hash)
    if items is not None:  # helper column, computed once and read by the 8 bin sums
        df = df.withColumn("_rich_items", items)
    df = df.withColumns(section_lists(df.schema))
    wide = df.select(*keep, *family_columns(df.schema, exact_hash), *lab)
    return wide.select(*keep, *FEATURE_COLS, *lab)


# ---- exploratory-only families -------------------------------------------------

STRING_FIELDS = ["printables", "entropy", "paths", "urls", "registry", "MZ"]


def feat_string_scalars(schema: T.StructType, col: str = "strings") -> list[Column]:
    return [nested_get(schema, f"{col}.{f}", 0).alias(f"str_{f}") for f in STRING_FIELDS]


def feat_hist_stats(hist: Column) -> list[Column]:
    """Entropy of the normalised histogram, max, non-zero bins, population std, skew."""
    h = F.transform(F.coalesce(hist, F.array()), lambda x: x.cast("double"))
    ent = entropy_of_counts(h)
    mom = moments(h)
    std = F.sqrt(mom["m2"] / mom["n"])
    skew = (mom["m3"] / mom["n"]) / (F.pow(std, 3) + F.lit(1e-12))
    empty = F.size(h) == 0
    z = lambda c: F.when(empty, F.lit(0)).otherwise(c)
    return [z(ent).alias("byteH_entropy"), z(F.array_max(h)).alias("byteH_max"),
            F.size(F.filter(h, lambda x: x > 0)).alias("byteH_nonzero"),
            z(std).alias("byteH_std"), z(skew).alias("byteH_skew")]


def feat_byteent_stats(arr: Column) -> list[Column]:
    h = F.transform(F.coalesce(arr, F.array()), lambda x: x.cast("double"))
    n = F.size(h).cast("double")
    mean, std = F.aggregate(h, F.lit(0.0), lambda a, x: a + x) / n, F.sqrt(moments(h)["m2"] / n)
    empty = F.size(h) == 0
    z = lambda c: F.when(empty, F.lit(0)).otherwise(c)
    return [z(mean).alias("byteEH_mean"), z(F.array_max(h)).alias("byteEH_max"), z(std).alias("byteEH_std")]
