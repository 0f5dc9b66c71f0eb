"""Vectorisers: raw record (layout B) -> fixed-width float vectors.

A group has two steps. The raw step makes its stored column (a struct, list or map of the record)
from file contents, where the group can be read from bytes; the vector step describes, over the stored
column, fixed slots (values in place), hashed tokens (slots that may repeat and are summed) and ready
items. ``vectorize`` and ``vectorize_long`` hand these to one kernel over Arrow batches, which hashes the distinct tokens,
scatters and sums the entries of each file in a row of a buffer: no explode, no shuffle, time
linear in the entries and the width.

Hashing: ``hasher="md5"`` gives md5 bins, which have a portable twin; ``hasher="murmur3"`` gives the bins and
signs of the public feature hashers (see ``functions.hashing``), for models trained on such vectors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bytestats import byte_features, pattern_names
from ..functions.hashing import md5_bins, murmur3_bins
from ..session import bound_batches
from .bytes import byte_at, magic_prefix, normalise_counts
from .partitioning import explode_array
from .records import DIRECTORY_NAMES

ITEM = "array<struct<slot:int,value:double>>"

# Category vocabularies of the header group (list position = code).
MACHINE_TYPES = [
    "IMAGE_FILE_MACHINE_UNKNOWN", "IMAGE_FILE_MACHINE_I386", "IMAGE_FILE_MACHINE_R3000",
    "IMAGE_FILE_MACHINE_R4000", "IMAGE_FILE_MACHINE_R10000", "IMAGE_FILE_MACHINE_WCEMIPSV2",
    "IMAGE_FILE_MACHINE_ALPHA", "IMAGE_FILE_MACHINE_SH3", "IMAGE_FILE_MACHINE_SH3DSP", "IMAGE_FILE_MACHINE_SH3E",
    "IMAGE_FILE_MACHINE_SH4", "IMAGE_FILE_MACHINE_SH5", "IMAGE_FILE_MACHINE_ARM", "IMAGE_FILE_MACHINE_THUMB",
    "IMAGE_FILE_MACHINE_ARMNT", "IMAGE_FILE_MACHINE_AM33", "IMAGE_FILE_MACHINE_POWERPC",
    "IMAGE_FILE_MACHINE_POWERPCFP", "IMAGE_FILE_MACHINE_IA64", "IMAGE_FILE_MACHINE_MIPS16",
    "IMAGE_FILE_MACHINE_ALPHA64", "IMAGE_FILE_MACHINE_AXP64", "IMAGE_FILE_MACHINE_MIPSFPU",
    "IMAGE_FILE_MACHINE_MIPSFPU16", "IMAGE_FILE_MACHINE_TRICORE", "IMAGE_FILE_MACHINE_CEF",
    "IMAGE_FILE_MACHINE_EBC", "IMAGE_FILE_MACHINE_RISCV32", "IMAGE_FILE_MACHINE_RISCV64",
    "IMAGE_FILE_MACHINE_RISCV128", "IMAGE_FILE_MACHINE_LOONGARCH32", "IMAGE_FILE_MACHINE_LOONGARCH64",
    "IMAGE_FILE_MACHINE_AMD64", "IMAGE_FILE_MACHINE_M32R", "IMAGE_FILE_MACHINE_ARM64", "IMAGE_FILE_MACHINE_CEE",
]
SUBSYSTEM_TYPES = [
    "IMAGE_SUBSYSTEM_UNKNOWN", "IMAGE_SUBSYSTEM_NATIVE", "IMAGE_SUBSYSTEM_WINDOWS_GUI",
    "IMAGE_SUBSYSTEM_WINDOWS_CUI", "IMAGE_SUBSYSTEM_OS2_CUI", "IMAGE_SUBSYSTEM_POSIX_CUI",
    "IMAGE_SUBSYSTEM_NATIVE_WINDOWS", "IMAGE_SUBSYSTEM_WINDOWS_CE_GUI", "IMAGE_SUBSYSTEM_EFI_APPLICATION",
    "IMAGE_SUBSYSTEM_EFI_BOOT_SERVICE_DRIVER", "IMAGE_SUBSYSTEM_EFI_RUNTIME_DRIVER", "IMAGE_SUBSYSTEM_EFI_ROM",
    "IMAGE_SUBSYSTEM_XBOX", "IMAGE_SUBSYSTEM_WINDOWS_BOOT_APPLICATION",
]
IMAGE_CHARACTERISTICS = [
    "RELOCS_STRIPPED", "EXECUTABLE_IMAGE", "LINE_NUMS_STRIPPED", "LOCAL_SYMS_STRIPPED", "AGGRESIVE_WS_TRIM",
    "LARGE_ADDRESS_AWARE", "16BIT_MACHINE", "BYTES_REVERSED_LO", "32BIT_MACHINE", "DEBUG_STRIPPED",
    "REMOVABLE_RUN_FROM_SWAP", "NET_RUN_FROM_SWAP", "SYSTEM", "DLL", "UP_SYSTEM_ONLY", "BYTES_REVERSED_HI",
]
DLL_CHARACTERISTICS = [
    "HIGH_ENTROPY_VA", "DYNAMIC_BASE", "FORCE_INTEGRITY", "NX_COMPAT", "NO_ISOLATION", "NO_SEH", "NO_BIND",
    "APPCONTAINER", "WDM_DRIVER", "GUARD_CF", "TERMINAL_SERVER_AWARE",
]
DOS_MEMBERS = ["e_magic", "e_cblp", "e_cp", "e_crlc", "e_cparhdr", "e_minalloc", "e_maxalloc", "e_ss", "e_sp",
               "e_csum", "e_ip", "e_cs", "e_lfarlc", "e_ovno", "e_oemid", "e_oeminfo", "e_lfanew"]
COFF_FIELDS = ["timestamp", "number_of_sections", "number_of_symbols", "sizeof_optional_header",
               "pointer_to_symbol_table"]
OPTIONAL_VECTOR_FIELDS = [
    "major_image_version", "minor_image_version", "major_linker_version", "minor_linker_version",
    "major_operating_system_version", "minor_operating_system_version", "major_subsystem_version",
    "minor_subsystem_version", "sizeof_code", "sizeof_headers", "sizeof_image", "sizeof_initialized_data",
    "sizeof_uninitialized_data", "sizeof_stack_reserve", "sizeof_stack_commit", "sizeof_heap_reserve",
    "sizeof_heap_commit", "address_of_entrypoint", "base_of_code", "image_base", "section_alignment",
    "checksum", "number_of_rvas_and_sizes",
]
EXEC_SECTION_FLAG = "MEM_EXECUTE"
N_WARNINGS = 87


def _d(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def dense_items(values: list[Column], offset: int = 0) -> Column:
    """Fixed slots offset..offset+len(values)-1."""
    return F.array(*[F.struct(F.lit(offset + i).alias("slot"), _d(v).alias("value"))
                     for i, v in enumerate(values)])


def hashed_items(tokens: Column, n: int, offset: int = 0, signed: bool = True,
                 weights: Column | None = None) -> Column:
    """Hashing trick items: token -> (offset + bin, sign * weight); weight 1 without ``weights``.

    md5 is computed once per token; bin and sign are read from its hex digits.
    """
    def item(h, w):
        slot = (F.lit(offset) + F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), F.lit(n))).cast("int")
        sign = F.when(F.pmod(F.conv(F.substring(h, 16, 1), 16, 10).cast("int"), F.lit(2)) == 1, F.lit(-1.0)) \
                .otherwise(F.lit(1.0)) if signed else F.lit(1.0)
        return F.struct(slot.alias("slot"), (sign * w).alias("value"))

    if weights is None:
        return F.transform(F.transform(tokens, lambda t: F.md5(t.cast("string"))), lambda h: item(h, F.lit(1.0)))
    pairs = F.arrays_zip(F.transform(tokens, lambda t: F.md5(t.cast("string"))).alias("h"), weights.alias("w"))
    return F.transform(pairs, lambda p: item(p["h"], _d(p["w"])))


def category_index(col: Column, vocab: list[str]) -> Column:
    """Position of ``col`` in ``vocab``; unknown or NULL -> 0."""
    v = F.array(*[F.lit(x) for x in vocab])
    return F.greatest(F.coalesce(F.array_position(v, col) - 1, F.lit(0)), F.lit(0)).cast("int")


def multi_hot(flags: Column, vocab: list[str]) -> Column:
    """array<int> with 1 where the vocab entry is among ``flags``."""
    f = F.coalesce(flags, F.array().cast("array<string>"))
    return F.array(*[F.array_contains(f, x).cast("int") for x in vocab])


# ---- groups ---------------------------------------------------------------------
# A group builder returns GroupParts: fixed-slot values (blocks of consecutive slots),
# hashed items (slots that may repeat and are summed), and an "empty" condition under
# which the group contributes nothing (the reference's all-zero vector).

@dataclass(frozen=True)
class Hashed:
    """Tokens (array column) hashed into ``bins`` slots from ``offset`` on; weight 1 without ``weights``."""
    tokens: Column
    bins: int
    offset: int
    signed: bool = True
    weights: Column | None = None


@dataclass
class GroupParts:
    fixed: list[tuple[int, list[Column]]]
    hashed: list[Column | Hashed]
    empty: Column | None = None
    arrays: dict[int, Column] = field(default_factory=dict)  # block offset -> ready array<double>


def _fixed_array(parts: GroupParts) -> tuple[list[int], Column | None]:
    slots = [o + i for o, vals in parts.fixed for i in range(len(vals))]
    if not slots:
        return [], None
    blocks = [parts.arrays[o] if o in parts.arrays else F.array(*[_d(v) for v in vals]) for o, vals in parts.fixed]
    arr = F.concat(*blocks) if len(blocks) > 1 else blocks[0]
    if parts.empty is not None:
        arr = F.when(parts.empty, F.array_repeat(F.lit(0.0), len(slots))).otherwise(arr)
    return slots, arr


def _concat(parts: list[Column], empty: Column | None, kind: str) -> Column | None:
    if not parts:
        return None
    arr = F.concat(*parts) if len(parts) > 1 else parts[0]
    return arr if empty is None else F.when(empty, F.array().cast(kind)).otherwise(arr)


def parts_general(offset: int = 0) -> GroupParts:
    g = F.col("general")
    sb = F.coalesce(g["start_bytes"], F.array().cast("array<int>"))
    return GroupParts([(offset, [g["size"], g["entropy"], g["is_pe"]] + [F.get(sb, i) for i in range(4)])], [],
                      g.isNull())


def parts_header(offset: int = 0) -> GroupParts:
    h = F.col("header")
    coff, opt, dos = h["coff"], h["optional"], h["dos"]
    vals = [coff[f] for f in COFF_FIELDS]
    vals += [category_index(coff["machine"], MACHINE_TYPES), category_index(opt["subsystem"], SUBSYSTEM_TYPES)]
    vals += [opt[f] for f in OPTIONAL_VECTOR_FIELDS]
    ic = F.coalesce(coff["characteristics"], F.array().cast("array<string>"))
    dc = F.coalesce(opt["dll_characteristics"], F.array().cast("array<string>"))
    # flag names -> 0/1 slots with one pass over each vocabulary (keeps the generated code small)
    flags = F.concat(
        F.transform(F.array(*[F.lit(x) for x in IMAGE_CHARACTERISTICS]), lambda v: F.array_contains(ic, v).cast("double")),
        F.transform(F.array(*[F.lit(x) for x in DLL_CHARACTERISTICS]), lambda v: F.array_contains(dc, v).cast("double")))
    return GroupParts([(offset, vals), (offset + len(vals), [None] * 27), (offset + len(vals) + 27,
                                                                          [dos[m] for m in DOS_MEMBERS])],
                      [], h.isNull(), {offset + len(vals): flags})


def section_entry_name(sections: Column, entry_point: Column) -> Column:
    """Last section whose [va, va+vsize) holds the entry point, else the first executable
    section with a non-empty name, else ''."""
    holding = F.filter(sections, lambda s: (s["virtual_address"] <= entry_point)
                       & (entry_point < s["virtual_address"] + s["vsize"]))
    execs = F.filter(sections, lambda s: F.coalesce(F.array_contains(s["props"], EXEC_SECTION_FLAG), F.lit(False))
                     & (F.coalesce(s["name"], F.lit("")) != ""))
    return F.coalesce(F.when(F.size(holding) > 0, F.element_at(holding, -1)["name"]),
                      F.get(execs, 0)["name"], F.lit(""))


def section_ratios(sections: Column, file_size: Column) -> Column:
    """Adds size_ratio = size / file size and vsize_ratio = size / max(vsize, 1)."""
    return F.transform(sections, lambda s: s.withField(
        "size_ratio", F.try_divide(s["size"].cast("double"), file_size.cast("double"))).withField(
        "vsize_ratio", s["size"].cast("double") / F.greatest(s["vsize"], F.lit(1)).cast("double")))


def parts_section(offset: int = 0) -> GroupParts:
    sec = F.col("section")
    s = F.coalesce(sec["sections"], F.array())
    ov = sec["overlay"]
    props = lambda x: F.coalesce(x["props"], F.array().cast("array<string>"))
    ents = F.concat(F.transform(s, lambda x: _d(x["entropy"])), F.array(_d(ov["entropy"]), F.lit(0.0)))
    srat = F.concat(F.transform(s, lambda x: _d(x["size_ratio"])), F.array(_d(ov["size_ratio"]), F.lit(0.0)))
    vrat = F.concat(F.transform(s, lambda x: _d(x["vsize_ratio"])), F.array(F.lit(0.0)))
    general = [
        F.size(s), F.size(F.filter(s, lambda x: x["size"] == 0)),
        F.size(F.filter(s, lambda x: x["name"] == "")),
        F.size(F.filter(s, lambda x: F.array_contains(props(x), "MEM_READ")
                        & F.array_contains(props(x), "MEM_EXECUTE"))),
        F.size(F.filter(s, lambda x: F.array_contains(props(x), "MEM_WRITE"))),
        F.array_max(ents), F.array_min(ents), F.array_max(srat), F.array_min(srat),
        F.array_max(vrat), F.array_min(vrat),
    ]
    names = F.transform(s, lambda x: x["name"])
    chars = F.flatten(F.transform(s, lambda x: F.transform(props(x), lambda p: F.concat(x["name"], F.lit(":"), p))))
    hashed = [
        Hashed(names, 50, offset + 11, weights=F.transform(s, lambda x: x["size"])),
        Hashed(names, 50, offset + 61, weights=F.transform(s, lambda x: x["vsize"])),
        Hashed(names, 50, offset + 111, weights=F.transform(s, lambda x: x["entropy"])),
        Hashed(chars, 50, offset + 161),
        Hashed(F.array(F.coalesce(sec["entry"], F.lit(""))), 10, offset + 211),
    ]
    return GroupParts([(offset, general), (offset + 221, [ov["size"], ov["size_ratio"], ov["entropy"]])],
                      hashed, sec.isNull())


def parts_imports(offset: int = 0) -> GroupParts:
    m = F.col("imports")
    libs = F.array_distinct(F.transform(F.coalesce(F.map_keys(m), F.array()), lambda k: F.lower(k)))
    quals = F.flatten(F.transform(F.coalesce(F.map_entries(m), F.array()), lambda e: F.transform(
        F.coalesce(e["value"], F.array().cast("array<string>")),
        lambda fn: F.concat(F.lower(e["key"]), F.lit(":"), fn))))
    return GroupParts([(offset, [F.size(quals), F.size(libs)])],
                      [Hashed(libs, 256, offset + 2, signed=False),
                       Hashed(quals, 1024, offset + 258, signed=False)],
                      F.coalesce(F.size(m), F.lit(0)) == 0)


def parts_exports(offset: int = 0) -> GroupParts:
    e = F.coalesce(F.col("exports"), F.array().cast("array<string>"))
    # slot 0 holds the width of the hashed block (128), as the reference does
    return GroupParts([(offset, [F.lit(128)])], [Hashed(e, 128, offset + 1)], F.size(e) == 0)


def parts_datadirs(offset: int = 0) -> GroupParts:
    dd = F.coalesce(F.col("datadirectories"), F.array())
    n = F.size(dd)
    # entries 1 .. n-2: the reloc-flag entry is first and the last directory is skipped
    mid = F.slice(dd, 2, F.greatest(n - 2, F.lit(0)))
    names = F.array(*[F.lit(x) for x in DIRECTORY_NAMES])
    named = F.filter(mid, lambda d: F.array_position(names, d["name"]) > 0)
    # (size, address) of each named directory -> slots 2*i, 2*i+1 (one pass over the list)
    slots = F.flatten(F.transform(named, lambda d: F.array(
        F.struct((F.lit(offset) + 2 * (F.array_position(names, d["name"]) - 1)).cast("int").alias("slot"),
                 _d(d["size"]).alias("value")),
        F.struct((F.lit(offset) + 2 * (F.array_position(names, d["name"]) - 1) + 1).cast("int").alias("slot"),
                 _d(d["virtual_address"]).alias("value")))))
    # a directory that has no slot fails the job: it would be lost without a trace
    stray = F.filter(mid, lambda d: d["name"].isNotNull() & (F.array_position(names, d["name"]) == 0))
    slots = F.when(F.size(stray) > 0, F.raise_error(F.concat(F.lit("unknown data directory: "), F.get(stray, 0)["name"]))).otherwise(slots)
    head = F.get(dd, 0)
    return GroupParts([(offset + 2 * len(DIRECTORY_NAMES), [head["has_relocs"], head["has_dynamic_relocs"]])],
                      [slots], n == 0)


def parts_rich(offset: int = 0) -> GroupParts:
    r = F.coalesce(F.col("richheader"), F.array().cast("array<bigint>"))
    n = F.size(r)
    npairs = F.floor(n / 2).cast("int")
    idx = F.when(npairs > 0, F.sequence(F.lit(0), npairs - 1)).otherwise(F.array().cast("array<int>"))
    comp = F.transform(idx, lambda i: F.get(r, 2 * i).cast("string"))
    cnt = F.transform(idx, lambda i: F.get(r, 2 * i + 1))
    return GroupParts([(offset, [npairs])], [Hashed(comp, 32, offset + 1, weights=cnt)], n == 0)


AUTH_FIELDS = ["num_certs", "self_signed", "empty_program_name", "no_countersigner", "parse_error",
               "chain_max_depth", "latest_signing_time", "signing_time_diff"]


def parts_authenticode(offset: int = 0) -> GroupParts:
    a = F.col("authenticode")
    return GroupParts([(offset, [a[f] for f in AUTH_FIELDS])], [], a.isNull())


def parts_warnings(offset: int = 0, ids: str = "warning_ids") -> GroupParts:
    w = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    hot = F.transform(w, lambda i: F.struct((F.lit(offset) + i).cast("int").alias("slot"), F.lit(1.0).alias("value")))
    return GroupParts([(offset + N_WARNINGS, [F.size(w)])], [hot], F.size(w) == 0)


def parts_histogram(offset: int = 0) -> GroupParts:
    return GroupParts([(offset, [None] * 256)], [], F.col("histogram").isNull(), {offset: normalise_counts(F.col("histogram"))})


def parts_byteentropy(offset: int = 0) -> GroupParts:
    return GroupParts([(offset, [None] * 256)], [], F.col("byteentropy").isNull(), {offset: normalise_counts(F.col("byteentropy"))})


N_STRING_SLOTS = 100 + len(pattern_names())


def parts_strings(offset: int = 0) -> GroupParts:
    s = F.col("strings")
    share = F.greatest(s["printables"], F.lit(1)).cast("double")
    values = F.concat(F.array(_d(s["numstrings"]), _d(s["avlength"]), _d(s["printables"])),
                      F.transform(s["printabledist"], lambda x: x.cast("double") / share), F.array(_d(s["entropy"])),
                      F.transform(s["string_counts"], lambda x: x.cast("double")))
    return GroupParts([(offset, [None] * N_STRING_SLOTS)], [], s.isNull(), {offset: values})


# ---- raw steps: stored columns from file contents -------------------------------------

def raw_bytes(df: DataFrame, content: str = "content") -> DataFrame:
    """``histogram``, ``byteentropy``, ``strings`` and ``general`` (where the record has none) from one read of each content.

    ``general.is_pe`` says whether the content starts as an executable does (MZ). Contents travel to Python in batches
    bounded by their bytes: the kernels' memory is a multiple of a batch's.
    """
    bound_batches(df.sparkSession)
    out = df.withColumn("_bytes", byte_features(F.col(content)))
    general = F.struct(F.coalesce(F.length(content), F.lit(0)).cast("long").alias("size"), F.col("_bytes.entropy").alias("entropy"),
                       F.coalesce(magic_prefix(content, b"MZ"), F.lit(False)).cast("int").alias("is_pe"),
                       F.array(*[byte_at(content, i) for i in range(4)]).alias("start_bytes"))
    new = {"histogram": F.col("_bytes.histogram"), "byteentropy": F.col("_bytes.byteentropy"), "strings": F.col("_bytes.strings"), "general": general}
    return out.select(*df.columns, *[c.alias(n) for n, c in new.items() if n not in df.columns])


@dataclass(frozen=True)
class VectorGroup:
    """A registered feature group.

    ``column``: the stored raw column that the vector step reads; ``parts``: the vector step (offset -> parts over that
    column); ``raw``: the raw step, which adds the column to a table of contents, or None where only parsed records
    have it; ``alias``: the name that feature-list files of the byte extractor use. Groups that are not ``enabled``
    are used only when named.
    """
    name: str
    dim: int
    parts: Callable[[int], GroupParts]
    enabled: bool = True
    column: str | None = None
    raw: Callable[[DataFrame], DataFrame] | None = None
    alias: str | None = None

    @property
    def stored(self) -> str:
        return self.column or self.name


# The groups in vector order, with the names that feature-list files give them.
GROUPS: list[VectorGroup] = [
    VectorGroup("general", 7, parts_general, raw=raw_bytes, alias="GeneralFileInfo"),
    VectorGroup("histogram", 256, parts_histogram, enabled=False, raw=raw_bytes, alias="ByteHistogram"),
    VectorGroup("byteentropy", 256, parts_byteentropy, enabled=False, raw=raw_bytes, alias="ByteEntropyHistogram"),
    VectorGroup("strings", N_STRING_SLOTS, parts_strings, enabled=False, raw=raw_bytes, alias="StringExtractor"),
    VectorGroup("header", 74, parts_header, alias="HeaderFileInfo"),
    VectorGroup("section", 224, parts_section, alias="SectionInfo"),
    VectorGroup("imports", 1282, parts_imports, alias="ImportsInfo"),
    VectorGroup("exports", 129, parts_exports, alias="ExportsInfo"),
    VectorGroup("datadirectories", 34, parts_datadirs, alias="DataDirectories"),
    VectorGroup("richheader", 33, parts_rich, alias="RichHeader"),
    VectorGroup("authenticode", 8, parts_authenticode, alias="AuthenticodeSignature"),
    VectorGroup("pefilewarnings", 88, parts_warnings, column="warning_ids", alias="PEFormatWarnings"),
]


def register_group(group: VectorGroup, after: str | None = None) -> None:
    """User extension point: add a group (optionally after an existing one). Its name and alias must be new."""
    taken = {n for g in GROUPS for n in (g.name, g.alias) if n}
    if clash := {group.name, group.alias} & taken:
        raise ValueError(f"a feature group has this name already: {sorted(clash)}")
    if after is None:
        GROUPS.append(group)
    else:
        i = next((k for k, g in enumerate(GROUPS) if g.name == after), None)
        if i is None:
            raise ValueError(f"no such feature group: {after}")
        GROUPS.insert(i + 1, group)


def unregister_group(name: str) -> None:
    """Take a user's group out again."""
    GROUPS[:] = [g for g in GROUPS if g.name != name]


def select_groups(names: Iterable[str] | None = None) -> list[VectorGroup]:
    """The enabled groups, or exactly those named (by name or alias; disabled ones too), in registry order.

    A name that no group has is an error: its slots would be missing without a trace.
    """
    if names is None:
        return [g for g in GROUPS if g.enabled]
    wanted = set(names)
    if unknown := wanted - {n for g in GROUPS for n in (g.name, g.alias)}:
        raise ValueError(f"no such feature groups: {sorted(map(str, unknown))}")
    return [g for g in GROUPS if g.name in wanted or g.alias in wanted]


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """Names of the groups that a feature-list file selects.

    The file is one JSON object with an object ``features``: a group is selected by a value that is not null. It may lie in
    any store that Spark reads.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).take(2))
    features = json.loads(text).get("features")
    if not isinstance(features, dict):
        raise ValueError(f"{path} has no object named features")
    names = [n for n, v in features.items() if v is not None]
    select_groups(features)  # names that are switched off must be known as well
    return names


def raw_features(df: DataFrame, groups: Iterable[str] | None = None, content: str = "content") -> DataFrame:
    """``df`` with the stored columns of the groups that it lacks, made from contents by the groups' raw steps."""
    for g in select_groups(groups):
        if g.stored not in df.columns:
            if g.raw is None:
                raise ValueError(f"the records have no column {g.stored}, and group {g.name} cannot be read from contents")
            df = g.raw(df, content) if g.raw is raw_bytes else g.raw(df)
            if g.stored not in df.columns:
                raise ValueError(f"the raw step of group {g.name} made no column {g.stored}")
    return df


def vector_width(groups: Iterable[str] | None = None) -> int:
    return sum(g.dim for g in select_groups(groups))


# ---- entries of a row, summed in the row ---------------------------------------------

@dataclass(frozen=True)
class _Block:
    """What the kernel knows of a :class:`Hashed`: the columns of its tokens and weights (None: 1 each), its slots and signs."""
    tokens: str
    weights: str | None
    bins: int
    offset: int
    signed: bool


def _entries(groups: list[VectorGroup], hasher: str) -> tuple[list[int], list[Column], list[_Block], int]:
    """Slots of the fixed values; the columns that the kernel reads; the blocks of hashed tokens; and the width.

    Tokens travel as they are, once for all blocks that share them; bins and signs are the kernel's.
    """
    if hasher not in HASHERS:
        raise ValueError(f"no such hasher: {hasher}")
    off, slots, fixed, items, blocks, columns = 0, [], [], [], [], []
    for g in groups:
        p = g.parts(off)
        own, arr = _fixed_array(p)
        if arr is not None:
            slots += own
            fixed.append(arr)
        if (c := _concat([h for h in p.hashed if isinstance(h, Column)], p.empty, ITEM)) is not None:
            items.append(c)
        given = lambda c: c if p.empty is None else F.when(~p.empty, c)  # noqa: B023,E731
        sent: dict[int, str] = {}
        for h in (h for h in p.hashed if isinstance(h, Hashed)):
            if id(h.tokens) not in sent:
                sent[id(h.tokens)] = f"tokens{len(columns)}"
                columns.append(given(h.tokens).cast("array<string>").alias(sent[id(h.tokens)]))
            weights = None
            if h.weights is not None:
                weights = f"weights{len(columns)}"
                columns.append(given(h.weights).cast("array<double>").alias(weights))
            blocks.append(_Block(sent[id(h.tokens)], weights, h.bins, h.offset, h.signed))
        off += g.dim
    join = lambda cols, kind: F.concat(*cols) if len(cols) > 1 else cols[0] if cols else F.array().cast(kind)
    return slots, [join(fixed, "array<double>").alias("fixed"), join(items, ITEM).alias("items"), *columns], blocks, off


def _rows_of(lists: pa.Array) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes)


def _column(values: pa.Array, kind) -> np.ndarray:
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)


def _md5_cells(tokens: pa.Array, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and sign of each token, and which tokens are null."""
    return *md5_bins(tokens, bins), tokens.is_null().to_numpy(zero_copy_only=False)


def _murmur3_cells(tokens: pa.Array, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same; a null token counts as an empty one."""
    return *murmur3_bins(tokens.fill_null("").cast(pa.large_string()), np.full(len(tokens), max(bins, 1), np.int64)), np.zeros(len(tokens), bool)


HASHERS = {"md5": _md5_cells, "murmur3": _murmur3_cells}


def sum_entries(batch: pa.RecordBatch, slots: np.ndarray, blocks: list[_Block], width: int, hasher: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors (rows x width) of a batch with columns ``fixed``, ``items`` and those of ``blocks``, and which slots have an entry."""
    n = batch.num_rows
    cells, values = [], []
    fixed = _column(batch["fixed"].flatten(), np.float64)
    if len(slots):
        if len(fixed) != n * len(slots):
            raise ValueError(f"groups gave {len(fixed)} fixed values for {n} rows of {len(slots)}")
        cells.append((np.arange(n)[:, None] * width + slots).reshape(-1))
        values.append(fixed)
    items = batch["items"]
    flat = items.flatten()
    cells.append(_rows_of(items) * width + _column(flat.field("slot"), np.int64))
    values.append(_column(flat.field("value"), np.float64))
    for b in blocks:
        rows, tokens = _rows_of(batch[b.tokens]), batch[b.tokens].flatten()
        weight = np.ones(len(tokens)) if b.weights is None else _column(batch[b.weights].flatten(), np.float64)
        if len(weight) != len(tokens) or (b.weights is not None and not np.array_equal(_rows_of(batch[b.weights]), rows)):
            raise ValueError(f"{len(weight)} weights for {len(tokens)} tokens, or of other rows")
        bin_, sign, null = HASHERS[hasher](tokens, b.bins)
        # a null token has no bin and no sign: its weight is in slot 0, as an item without a slot
        cells.append(rows * width + np.where(null, 0, b.offset + bin_))
        values.append(np.where(null, 1.0, sign) * weight if b.signed else weight)
    cell = np.concatenate(cells)
    total = np.bincount(cell, weights=np.concatenate(values), minlength=n * width).reshape(n, width)
    entered = np.zeros(n * width, bool)
    entered[cell] = True
    return total, entered.reshape(n, width)


ROWS_AT_ONCE = 500


def _vectors(df: DataFrame, key: str, groups: Iterable[str] | None, hasher: str, finish, schema: str) -> DataFrame:
    slots, columns, blocks, width = _entries(select_groups(groups), hasher)
    where = np.array(slots, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield finish(part["key"], *sum_entries(part, where, blocks, width, hasher))

    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), *columns)
    return rows.mapInArrow(run, f"key {key_type}, {schema}")


def vectorize_long(df: DataFrame, key: str = "file_id", groups: Iterable[str] | None = None,
                   drop_zero: bool = True, hasher: str = "md5") -> DataFrame:
    """Sparse long form (key, slot, value) of the groups.

    Entries are summed in their row, so every input row gives its own slots (keys should be distinct). With
    ``drop_zero=False`` slots that have an entry stay when their sum is 0.
    """
    def finish(keys: pa.Array, total: np.ndarray, entered: np.ndarray) -> pa.RecordBatch:
        row, slot = np.nonzero(total if drop_zero else entered)
        offsets = pa.array(np.searchsorted(row, np.arange(len(keys) + 1)).astype(np.int32))
        entry = pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[row, slot])], ["slot", "value"])
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, entry)], names=["key", "entries"])

    per = _vectors(df, key, groups, hasher, finish, f"entries {ITEM}")
    out = explode_array(per, ["key"], "entries", "it")
    return out.select(F.col("key").alias(key), F.col("it.slot").alias("slot"), F.col("it.value").alias("value"))


def vectorize(df: DataFrame, key: str = "file_id", groups: Iterable[str] | None = None,
              out: str = "features", hasher: str = "md5") -> DataFrame:
    """Dense array<float> of the groups per row (zeros where nothing is set): (key, out)."""
    def finish(keys: pa.Array, total: np.ndarray, entered: np.ndarray) -> pa.RecordBatch:
        width = total.shape[1]
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(total.astype(np.float32).reshape(-1)))], names=["key", "features"])

    per = _vectors(df, key, groups, hasher, finish, "features array<float>")
    return per.select(F.col("key").alias(key), F.col("features").alias(out))


# ---- warnings vocabulary ------------------------------------------------------------

def warning_dictionary_load(spark, path: str) -> DataFrame:
    """Rules file: one rule per line, ``...suffix`` or ``prefix...``; id = line number (0-based).

    The file is read whole (a vocabulary of a few thousand lines), so ids do not hang on how it is split; several files
    are numbered one after the other in the order of their paths.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_f"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    lines = files.select("_f", F.posexplode(F.split("value", "\r?\n", -1)).alias("_p", "value"))
    w = Window.orderBy("_f", "_p")
    numbered = lines.select(F.trim("value").alias("rule"), (F.row_number().over(w) - 1).cast("int").alias("id"))
    return warning_vocab(numbered)


def warning_vocab(rules: DataFrame) -> DataFrame:
    """(rule, id) -> (rule, id, kind 0=suffix/1=prefix, part)."""
    r = F.col("rule")
    return rules.select("rule", "id",
                        F.when(r.startswith("..."), 0).otherwise(1).alias("kind"),
                        F.when(r.startswith("..."), F.expr("substring(rule, 4)"))
                         .otherwise(F.expr("substring(rule, 1, length(rule) - 3)")).alias("part"))


def warning_normalise(warnings: DataFrame, vocab: DataFrame, key: str = "file_id",
                      col: str = "warning") -> DataFrame:
    """Distinct warnings -> normalised rule (suffix rules first, then prefix; lowest id wins).

    Each distinct text is normalised once: its ends, of the lengths that rules have, meet the
    rules' texts by equality, so a vocabulary of any size is joined without comparing all
    pairs. Unmatched warnings are dropped (count them with ``unknown_warnings``).
    """
    pairs = warnings.select(key, col).distinct()
    texts = pairs.select(F.col(col).alias("_text")).distinct()
    lengths = vocab.groupBy("kind").agg(F.collect_set(F.length("part")).alias("_lengths"))  # two rows
    ends = (texts.select("_text", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")).join(F.broadcast(lengths), "kind")
            .select("_text", "kind", F.explode("_lengths").alias("_n")).filter(F.length("_text") >= F.col("_n")))
    piece = F.when(F.col("kind") == 0, F.expr("right(_text, _n)")).otherwise(F.expr("left(_text, _n)"))
    hit = ends.select("_text", "kind", piece.alias("part")).join(vocab, ["kind", "part"])
    best = hit.groupBy("_text").agg(F.min(F.struct("kind", "id", "rule")).alias("_b"))
    out = pairs.join(best, F.col(col) == F.col("_text"))
    return out.select(key, col, F.col("_b.rule").alias("rule"), F.col("_b.id").alias("id"))


def unknown_warnings(warnings: DataFrame, vocab: DataFrame, key: str = "file_id",
                     col: str = "warning") -> DataFrame:
    """Warnings that no rule matches (reported, not vectorised)."""
    matched = warning_normalise(warnings, vocab, key, col).select(key, col)
    return warnings.select(key, col).distinct().join(matched, [key, col], "left_anti")
