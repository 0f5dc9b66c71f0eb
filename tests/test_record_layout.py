"""Records of both layouts: literal cases of the normalisation, and shards with malformed lines."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from binlens.operators import flat as fl
from binlens.operators.record_layout import (DLL_CHARACTERISTICS, DLL_FIRST_BIT, IMAGE_CHARACTERISTICS, MACHINE_NUMBERS, MACHINE_PREFIX,
                                             MIXED_SCHEMA, category_number, directories_by_name, flag_mask, normalize_layout, record_layout)
from binlens.operators.vector import MACHINE_TYPES, SUBSYSTEM_TYPES
from binlens.operators.record_layout import SUBSYSTEM_NUMBERS, SUBSYSTEM_PREFIX
from binlens.sources import io

A = {"sha256": "a", "label": 1, "general": {"size": 10, "vsize": 20, "has_debug": 1, "has_tls": True, "symbols": 3},
     "header": {"file": {"machine": 332, "timestamp": 5, "characteristics": 0x2102}, "optional": {"subsystem": 2, "dll_characteristics": 64, "magic": 267, "file_alignment": 512}},
     "section": {"entry": ".text", "sections": [{"name": ".text", "size": 5, "entropy": 7.5, "vsize": 6, "props": ["MEM_EXECUTE"]}], "overlay": {"size": 3, "size_ratio": 0.3, "entropy": 1.0}},
     "datadirectories": [{"name": "EXPORT", "size": 1, "virtual_address": 0}, {"name": "IMPORT", "size": 0, "virtual_address": 0}, {"name": "RESOURCE", "size": 77, "virtual_address": 0}],
     "imports": {"USER32.dll": ["a", "b"]}, "exports": ["x"], "richheader": [1, 2], "authenticode": {"num_certs": 2, "self_signed": True}, "pefilewarnings": "Checksum bad"}
B = {"sha256": "b", "label": 0, "general": {"size": 10, "entropy": 1.0, "is_pe": 1, "start_bytes": [1, 2, 3, 4]},
     "header": {"coff": {"machine": "IMAGE_FILE_MACHINE_AMD64", "timestamp": 6, "number_of_symbols": 4, "characteristics": ["EXECUTABLE_IMAGE", "DLL", "DLL", "NOT_A_FLAG"]},
                "optional": {"subsystem": "IMAGE_SUBSYSTEM_EFI_ROM", "dll_characteristics": ["NX_COMPAT", "GUARD_CF"], "magic": 523, "sizeof_image": 4096, "sizeof_code": 9}},
     "section": {"entry": "", "sections": [], "overlay": {"size": 0, "size_ratio": 0, "entropy": 0}},
     "datadirectories": [{"has_relocs": 1, "has_dynamic_relocs": 0}, {"name": "SECURITY", "size": 8, "virtual_address": 1}, {"name": "RESOURCE", "size": 99, "virtual_address": 2}],
     "imports": {}, "exports": [], "richheader": [], "authenticode": {}}
BARE = {"sha256": "c", "label": 0}
ODD = {"sha256": "d", "label": 1, "general": "none", "header": {"coff": None, "file": None}, "section": {"sections": {"a": 1}},
       "datadirectories": {"RESOURCE": {"size": 5}}, "imports": {"k.dll": "no list"}, "exports": {"f": 1}, "richheader": {"values": [1, 2, 3]}, "pefilewarnings": {"k": "v"}}


def _flat(spark, records, layout="auto"):
    path = tempfile.mkdtemp(prefix="binlens-layout-", dir="/tmp")
    with open(os.path.join(path, "shard.json"), "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)
    raw = io.scan_jsonl(spark, path + "/*.json", MIXED_SCHEMA)
    raw = raw.withColumn("layout", record_layout(raw))
    return {r.sha256: r for r in fl.flatten_record(normalize_layout(raw, layout), keep=["sha256", "layout"]).collect()}


def test_records_of_both_layouts_in_one_shard(spark):
    got = _flat(spark, [A, B, BARE, ODD])
    a, b, c, d = (got[k] for k in "abcd")
    assert [r.layout for r in (a, b, c, d)] == ["A", "B", "A", "A"]
    assert (a.hdr_machine, a.hdr_timestamp, a.is_dll, a.hdr_subsystem, a.hdr_dll_characteristics, a.hdr_file_alignment) == (332, 5, 1, 2, 64, 512)
    assert (a.gen_vsize, a.gen_has_debug, a.gen_has_tls, a.gen_symbols, a.dd_resource_size, a.dd_cert_present, a.datadir_count) == (20, 1, 1, 3, 77, 0, 3)
    assert (a.sec_count, a.sec_exec_count, a.sec_high_entropy_frac, a.imp_func_count, a.exp_count, a.rich_num_pairs, a.auth_self_signed) == (1, 1, 1, 2, 1, 1, 1)
    assert (a.pe_warn_count, a.pe_warn_checksum, a.overlay_present) == (1, 1, 1)
    assert (b.hdr_machine, b.hdr_timestamp, b.hdr_characteristics, b.is_dll) == (0x8664, 6, 0x2002, 1)
    assert (b.hdr_subsystem, b.hdr_dll_characteristics, b.hdr_magic, b.hdr_sizeof_code, b.hdr_file_alignment) == (13, 0x4100, 523, 9, 0)
    # EXPORT, IMPORT and EXCEPTION are gaps: the names are at the places that layout A has for them
    assert (b.datadir_count, b.datadir_nonempty, b.dd_resource_size, b.dd_cert_present) == (5, 2, 99, 1)
    assert (b.gen_vsize, b.gen_symbols, b.gen_has_relocations, b.gen_has_resources, b.gen_has_signature, b.gen_has_tls, b.gen_has_debug) == (4096, 4, 1, 1, 1, 0, 0)
    assert all(c[f] == 0 for f in fl.FEATURE_COLS)
    assert (d.datadir_count, d.dd_resource_size, d.exp_count, d.rich_num_pairs, d.imp_dll_count, d.imp_func_count, d.pe_warn_count) == (1, 0, 1, 1, 1, 0, 1)


def test_layout_a_takes_directories_as_they_lie(spark):
    b = _flat(spark, [B], layout="A")["b"]
    assert (b.hdr_machine, b.is_dll, b.datadir_count, b.dd_resource_size) == (0, 0, 3, 99)
    with pytest.raises(ValueError):
        _flat(spark, [B], layout="C")


def test_typed_structs_of_either_layout(spark):
    a = spark.read.schema("sha256 string, label int, header struct<file:struct<machine:int,characteristics:int>, optional:struct<subsystem:int>>").json(
        spark.sparkContext.parallelize([json.dumps(A)]))
    b = spark.read.schema("sha256 string, label int, header struct<coff:struct<machine:string,characteristics:array<string>>, optional:struct<subsystem:string>>, "
                          "datadirectories array<struct<name:string,size:int>>").json(spark.sparkContext.parallelize([json.dumps(B)]))
    ra, rb = (fl.flatten_record(normalize_layout(x), keep=["sha256"]).first() for x in (a, b))
    assert (ra.hdr_machine, ra.is_dll, ra.hdr_subsystem, ra.datadir_count) == (332, 1, 2, 0)
    assert (rb.hdr_machine, rb.is_dll, rb.hdr_subsystem, rb.dd_resource_size) == (0x8664, 1, 13, 99)


def test_vocabularies(spark):
    names = spark.createDataFrame([(n,) for n in [*MACHINE_TYPES, None, "i386", "IMAGE_FILE_MACHINE_NEW"]], "n string")
    got = {r.n: r.v for r in names.select("n", category_number(F.col("n"), MACHINE_NUMBERS, MACHINE_PREFIX).alias("v")).collect()}
    assert got == {**{n: MACHINE_NUMBERS[n[len(MACHINE_PREFIX):]] for n in MACHINE_TYPES}, None: None, "i386": 332, "IMAGE_FILE_MACHINE_NEW": 0}
    assert {n[len(SUBSYSTEM_PREFIX):] for n in SUBSYSTEM_TYPES} == set(SUBSYSTEM_NUMBERS)
    flags = spark.createDataFrame([(IMAGE_CHARACTERISTICS, DLL_CHARACTERISTICS), (["DLL", None], ["WDM_DRIVER"] * 2), ([], []), (None, None)], "i array<string>, d array<string>")
    got = flags.select(flag_mask(F.col("i"), IMAGE_CHARACTERISTICS).alias("i"), flag_mask(F.col("d"), DLL_CHARACTERISTICS, DLL_FIRST_BIT).alias("d")).collect()
    assert [tuple(r) for r in got] == [(0xFFFF, 0xFFE0), (0x2000, 0x2000), (0, 0), (None, None)]


def test_directories_of_strange_names_keep_out_of_the_places(spark):
    one = spark.createDataFrame([([("EXTRA", 4, 0), ("RESOURCE", 1, 0), (None, 9, 9), ("RESOURCE", 2, 0)],)], "d array<struct<name:string,size:bigint,virtual_address:bigint>>")
    dirs = one.select(directories_by_name(F.col("d")).alias("d")).first().d
    assert len(dirs) == 17 and (dirs[2].name, dirs[2].size) == ("RESOURCE", 1) and dirs[16].name == "EXTRA"


LINES = ['{"sha256": "x", "label": 1, "general": {"size": 4}}', '{"sha256": "y", "label": 0', "", "   ", "no json", '{"sha256": "z", "label": 0}', "[1, 2]"]


def _shards(lines):
    path = tempfile.mkdtemp(prefix="binlens-rejects-", dir="/tmp")
    for n in range(2):
        with open(os.path.join(path, f"s{n}.json"), "w") as f:
            f.write("\n".join(x.replace('"x"', f'"x{n}"') for x in lines) + "\n")
    return path


def test_malformed_lines_go_to_a_side_table(spark):
    path = _shards(LINES)
    good, rejects = io.scan_jsonl_with_rejects(spark, path + "/*.json", "sha256 string, label int, general struct<size:int>")
    assert sorted((r.sha256, r.label) for r in good.collect()) == [("x0", 1), ("x1", 1), ("z", 0), ("z", 0)]
    bad = sorted((os.path.basename(r.file), r.line) for r in rejects.collect())
    assert bad == sorted((f"s{n}.json", x) for n in range(2) for x in (LINES[1], "no json", "[1, 2]"))
    with pytest.raises(Exception, match="MALFORMED"):
        io.scan_jsonl(spark, path + "/*.json", "sha256 string, label int").collect()


def test_streams_fail_on_malformed_lines_or_divert_them(spark):
    from binlens.streaming.shards import ingest_rejects, ingest_shards
    path, out = _shards(LINES), tempfile.mkdtemp(prefix="binlens-stream-", dir="/tmp")
    with pytest.raises(Exception):
        ingest_shards(spark, path, f"{out}/a", f"{out}/ca").awaitTermination()
    for q in (ingest_shards(spark, path, f"{out}/b", f"{out}/cb", malformed="divert"), ingest_rejects(spark, path, f"{out}/r", f"{out}/cr")):
        q.awaitTermination()
    assert sorted(r.sha256 for r in spark.read.parquet(f"{out}/b").collect()) == ["x0", "x1", "z", "z"]
    assert sorted(r.line for r in spark.read.parquet(f"{out}/r").collect()) == sorted([LINES[1], "no json", "[1, 2]"] * 2)


def test_streams_read_both_layouts(spark):
    from binlens.streaming.shards import ingest_shards
    path, out = _shards([json.dumps(A), json.dumps(B)]), tempfile.mkdtemp(prefix="binlens-stream-", dir="/tmp")
    ingest_shards(spark, path, f"{out}/b", f"{out}/cb", layout="auto").awaitTermination()
    got = sorted((r.sha256, r.hdr_machine, r.is_dll) for r in spark.read.parquet(f"{out}/b").collect())
    assert got == [("a", 332, 1), ("a", 332, 1), ("b", 0x8664, 1), ("b", 0x8664, 1)]
