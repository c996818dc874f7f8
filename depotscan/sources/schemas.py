"""The schema contract: one StructType per table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

_ID = "contents_id long not null"
# The tables and their columns.
_TABLES = {
    "package": "package_id long not null, kind string not null, epoch int, name string not null, version string not null, release string not null, arch string not null, hash binary not null, source string, build_host string not null, build_time timestamp_ntz not null, summary string not null, description string not null, license string not null, rpm_group string not null, normalized boolean not null",
    "package_digest": "digest binary not null, length long not null, package_id long not null",
    "package_url": "package_id long not null, url string not null",
    "package_dependency": "package_id long not null, kind string not null, flags int not null, capability string not null, version string not null",
    "package_script": "package_id long not null, kind string not null, script string, prog array<string>",
    "package_trigger_script": "package_id long not null, script_idx int not null, script string, prog string",
    "package_trigger_condition": "package_id long not null, script_idx int not null, flags int not null, name string not null, version string not null",
    "package_set": "set_id long not null, name string not null",
    "package_set_member": "set_id long not null, package_id long not null",
    "file_contents": f"{_ID}, length long not null, digest binary not null, contents binary not null",
    "file_attribute": "attribute_id long not null, mode int not null, flags int not null, user_name string not null, group_name string not null, caps string not null, normalized boolean not null, row_hash binary not null",
    "file": "file_id long not null, package_id long not null, contents_id long not null, attribute_id long not null, inode int not null, mtime long not null, name string not null",
    "symlink": "package_id long not null, attribute_id long not null, name string not null, target string not null, mtime long not null",
    "directory": "package_id long not null, attribute_id long not null, name string not null, mtime long not null",
    "elf_file": f"{_ID}, ei_class short not null, ei_data short not null, e_type int not null, e_machine int not null, arch string, soname string, interp string, build_id binary",
    "elf_program_header": f"{_ID}, type long not null, file_offset long not null, virt_addr long not null, phys_addr long not null, file_size long not null, memory_size long not null, align int not null, readable boolean not null, writable boolean not null, executable boolean not null",
    "elf_definition": f"{_ID}, name string not null, version string, primary_version boolean not null, symbol_type short not null, binding short not null, section int not null, xsection int, visibility string not null",
    "elf_reference": f"{_ID}, name string not null, version string, symbol_type short not null, binding short not null, visibility string not null",
    "elf_needed": f"{_ID}, name string not null",
    "elf_rpath": f"{_ID}, path string not null",
    "elf_runpath": f"{_ID}, path string not null",
    "elf_dynamic": f"{_ID}, tag long not null, value long not null",
    "elf_error": f"{_ID}, message string",
    "elf_closure": "set_id long not null, file_id long not null, needed long not null",
    "java_class": "class_id long not null, access_flags int not null, name string not null, digest binary not null, super_class string not null",
    "java_interface": "class_id long not null, name string not null",
    "java_class_reference": "class_id long not null, name string not null",
    "java_error": f"{_ID}, message string not null, path string not null",
    "java_class_contents": f"{_ID}, class_id long not null",
    "java_maven_url": f"{_ID}, url string not null, type string not null",
    "xml_error": f"{_ID}, message string not null, line int not null, before binary not null, after binary not null",
    "python_import": f"{_ID}, name string not null",
    "python_attribute": f"{_ID}, name string not null",
    "python_function_def": f"{_ID}, name string not null",
    "python_class_def": f"{_ID}, name string not null",
    "python_error": f"{_ID}, line int, message string not null",
    "url_cache": "url string not null, http_time long not null, data binary not null, last_change timestamp_ntz not null, last_access timestamp_ntz not null",
}
WHITELIST = "permissions string, user_name string, group_name string, path string"


def schemas() -> dict[str, StructType]:
    return {name: StructType.fromDDL(ddl) for name, ddl in _TABLES.items()}


def widths() -> dict[str, int]:
    """How many columns each table has."""
    return {name: len(ddl.split(", ")) for name, ddl in _TABLES.items()}


def create_tables(spark: SparkSession, path: str) -> None:
    """Write every table, empty, as Parquet below a path."""
    for name, schema in schemas().items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")
