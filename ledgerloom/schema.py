"""Schemas, names and fixed values of the data model.  Every table is keyed by ``run_id``; order is an explicit ``seq``."""

from __future__ import annotations

RAW_EVENT = (
    "run_id BIGINT, kind INT, source INT, timestamp_ns BIGINT, pid BIGINT, tgid BIGINT, fd INT, dfd INT, flags BIGINT, prot BIGINT, "
    "path STRING, path_len INT, operation_id BIGINT, exit_code INT, parent_pid BIGINT, child_pid BIGINT, proc_target STRING, cwd STRING"
)
PROCESS = "STRUCT<pid:BIGINT, generation:INT, exec_epoch:INT>"
OBSERVATION = "STRUCT<kind:STRING, hash:STRING>"
TRACED_EVENT = (
    f"run_id BIGINT, seq BIGINT, kind STRING, process {PROCESS}, child {PROCESS}, path STRING, from_path STRING, to_path STRING, "
    f"flags BIGINT, prot BIGINT, fd INT, external BOOLEAN, exit_code INT, obs {OBSERVATION}"
)
CANONICAL_OP = (
    "run_id BIGINT, leaf STRING, op_type STRING, process_index BIGINT, tool_hash STRING, args ARRAY<STRING>, input_hashes ARRAY<STRING>, output_hashes ARRAY<STRING>"
)
SELECTION = "STRUCT<mode:STRING, artifacts:ARRAY<STRING>, output_roots:ARRAY<STRING>>"
OUTPUT = "STRUCT<path:STRING, hash:STRING>"
ATTESTATION = (
    f"version STRING, predicate_type STRING, root_hash STRING, process_root STRING, command ARRAY<STRING>, output_selection {SELECTION}, "
    f"outputs ARRAY<{OUTPUT}>, tree STRUCT<leaves:ARRAY<STRING>, nodes:ARRAY<STRUCT<hash:STRING, is_leaf:BOOLEAN>>, leaf_count:BIGINT>"
)
SNAPSHOT = "run_id BIGINT, phase STRING, path STRING, kind STRING, hash STRING, target STRING"
ENVELOPE = "payloadType STRING, payload STRING, signatures ARRAY<STRUCT<keyid:STRING, sig:STRING>>"

# Event kinds, tags, sentinels, domains and prefixes that hashes and documents are made of.
EVENT_KINDS = {1: "FileOpen", 2: "FileClose", 3: "Exec", 4: "Exit", 5: "FileMmap", 6: "RenameSource", 7: "RenameDestination", 8: "FileUnlink", 9: "Fork"}
OP_TAGS = {
    "Exec": "exec",
    "FileRead": "file_read",
    "FileWrite": "file_write",
    "FileRename": "file_rename",
    "FileDelete": "file_delete",
    "SystemStateRead": "system_state_read",
    "Exit": "exit",
    "ExternalFileRead": "external_file_read",
    "ExternalFileWrite": "external_file_write",
    "ExternalFileRename": "external_file_rename",
    "ExternalFileDelete": "external_file_delete",
}
NO_PROCESS = 4294967295
SYSTEM_STATE = "SYSTEM_STATE:0000000000000000000000000000000000000000000000000000000000000000"
EMPTY_CONTENT = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
SYSTEM_TREES = ["/proc", "/sys"]
SYSTEM_FILES = ["/etc/hostname", "/etc/os-release", "/etc/machine-id", "/dev/urandom", "/dev/random", "/dev/null", "/dev/zero"]
SYSTEM_PART = "/go/telemetry/"
AT_FDCWD = -100
O_TRUNC = 512
RENAME_EXCHANGE = 2
MAX_CONTROL_FILE = 16 * 1024 * 1024
CACHE_ENTRY_SIZE = 175
PATH_DOMAIN = b"repx-path-v1\x00"
IMPORT_CONFIG_DOMAIN = b"repx-go-importcfg-v1\x00"
CACHE_ENTRY_DOMAIN = b"repx-go-cache-entry-v1\x00"
COMMITMENT_V02 = "repx-attestation-v0.2"
COMMITMENT_V03 = "repx-attestation-v0.3"
OBSERVATION_PREFIX = {"content": "", "missing": "missing:", "unreadable": "unreadable:", "nonregular": "non-regular:"}
VERSION = "0.3.0"
