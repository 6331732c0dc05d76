"""Paths and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from .hashing import sha256


def within(path: Column, prefix: Column) -> Column:
    """Whether a path is a prefix or below it; slashes at the prefix's end don't count, an empty one holds all."""
    p = F.rtrim(prefix, F.lit("/"))
    return (p == "") | (path == p) | F.startswith(path, F.concat(p, F.lit("/")))


def watched(path: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | within(path, F.lit(p))
    return F.coalesce(found, F.lit(False))


def byte_prefix(path: Column, prefixes: list[str]) -> Column:
    """The coarse filter of the source: plain prefixes, without regard to components."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(path, F.lit(p))
    return found


def keeps_untracked_open(path: Column, flags: Column, prefixes: list[str]) -> Column:
    """Opens by untracked processes: absolute paths under a prefix, relative ones if they write."""
    return F.when(F.startswith(path, F.lit("/")), byte_prefix(path, prefixes)).otherwise(can_write(flags))


def keeps_untracked_rename(source: Column, target: Column, prefixes: list[str]) -> Column:
    absolute = F.startswith(source, F.lit("/")) & F.startswith(target, F.lit("/"))
    return ~(absolute & ~byte_prefix(source, prefixes) & ~byte_prefix(target, prefixes))


def keeps_untracked_unlink(path: Column, prefixes: list[str]) -> Column:
    return ~(F.startswith(path, F.lit("/")) & ~byte_prefix(path, prefixes))


def is_system_state(path: Column) -> Column:
    tree = F.lit(False)
    for t in schema.SYSTEM_TREES:
        tree = tree | (path == t) | F.startswith(path, F.lit(t + "/"))
    return F.coalesce(tree | path.isin(schema.SYSTEM_FILES) | F.contains(path, F.lit(schema.SYSTEM_PART)), F.lit(False))


def can_read(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(3)) != 1


def can_write(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(3)) != 0


def maps_writes(prot: Column, flags: Column) -> Column:
    return (prot.bitwiseAND(F.lit(2)) != 0) & (flags.bitwiseAND(F.lit(1)) != 0)


def decode(path: Column) -> Column:
    """A captured path without the NULs at its end; null if nothing is left."""
    return F.nullif(F.rtrim(path, F.lit("\x00")), F.lit(""))


def normalize(path: Column) -> Column:
    """A path without what differs between sessions: terminals, temporary folders, compilers' temporary files."""
    temporary = path.rlike("^/(var/)?tmp/")

    def renamed(part: Column) -> Column:
        stem, rest = F.substring_index(part, ".", 1), F.regexp_extract(part, r"^[^.]*(\..*)?$", 1)
        made = stem.rlike("^(cc[A-Za-z0-9]{6,}|rustc[A-Za-z0-9]{5,})$")
        return (
            F.when(part.rlike(r"^tmp\.[A-Za-z0-9]{6,}$"), F.lit("<session>"))
            .when(part.rlike("^go-build[0-9]+$"), F.lit("<go-work>"))
            .when(made, F.concat(F.lit("<compiler-temp>"), rest))
            .otherwise(part)
        )

    root = F.startswith(path, F.lit("/"))
    every = F.split(path, "/")
    # A dot stays only as the first part of a relative path.
    parts = F.filter(every, lambda x, i: (x != "") & ((x != ".") | ((i == 0) & ~root)))
    parts = F.when(temporary, F.transform(parts, renamed)).otherwise(parts)
    plain = F.concat(F.when(root, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return F.when(path.rlike(r"^/dev/pts/[0-9]*\z"), F.lit("/dev/pts/<session>")).otherwise(plain)


def hash_path(path: Column) -> Column:
    return sha256(F.concat(F.lit(schema.PATH_DOMAIN), normalize(path).cast("binary")))


def identity(obs: Column) -> Column:
    """What an observation is called in hashes: contents by their hash, all else by kind and the path's hash."""
    prefix = F.create_map(*[F.lit(x) for item in schema.OBSERVATION_PREFIX.items() for x in item])[obs["kind"]]
    return F.concat(prefix, obs["hash"])


def content_hash(obs: Column) -> Column:
    return F.when(obs["kind"] == "content", obs["hash"])


def is_import_config(path: Column) -> Column:
    return path.rlike(r"(^|/)importcfg(\.link)?/*$") & path.rlike(r"(^|/)go-build[0-9]+(/|$)")


def normalize_work_path(path: Column) -> Column:
    """What follows the last build folder, below a fixed name; null if there is none."""
    rest = F.regexp_extract(path, r"(?s)^.*/go-build(.*)$", 1)
    return F.when(path.contains("/go-build") & rest.rlike(r"(?s)^[0-9]+/"), F.concat(F.lit("$WORK"), F.regexp_extract(rest, r"(?s)^[0-9]+(/.*)$", 1)))


def normalize_import_config(text: Column) -> Column:
    """The file with build folders named alike; null if it isn't such a file or nothing changes."""

    def one(line: Column) -> Column:
        package = line.rlike(r"(?s)^package(file|shlib) ")
        head = F.regexp_extract(line, r"(?s)^(package(?:file|shlib) [^=]*=)", 1)
        value = F.regexp_extract(line, r"(?s)^package(?:file|shlib) [^=]*=(.*)$", 1)
        other = (line == "") | (line == "# import config") | F.startswith(line, F.lit("importmap ")) | F.startswith(line, F.lit("modinfo "))
        moved = normalize_work_path(value)
        return (
            F.when(package & (head == ""), F.lit(None).cast("string"))
            .when(package, F.coalesce(F.concat(head, moved), line))
            .when(other, line)
        )

    lines = F.transform(F.split(text, "\n", -1), one)
    joined = F.array_join(lines, "\n")
    return F.when(F.forall(lines, lambda x: x.isNotNull()) & (joined != text), joined)


def is_cache_entry(path: Column) -> Column:
    return path.rlike(r"(^|/)([0-9a-f]{2})/\2[0-9a-f]{62}-a/*$")


def normalize_cache_entry(text: Column) -> Column:
    """A cache entry with its time zeroed; null if it isn't one."""
    whole = r"^(v1 [0-9a-f]{64} [0-9a-f]{64} (?=.{20} ) *[0-9]+ )(?=.{20}\n\z) *[0-9]+\n\z"
    return F.when(text.rlike(whole), F.concat(F.regexp_extract(text, whole, 1), F.lpad(F.lit("0"), 20, " "), F.lit("\n")))


def file_hash(path: Column, content: Column) -> Column:
    """The hash of a file's bytes; build tools' control files are normalized first."""
    size = F.octet_length(content)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    config = F.when((size <= schema.MAX_CONTROL_FILE) & is_import_config(path), normalize_import_config(text))
    entry = F.when((size == schema.CACHE_ENTRY_SIZE) & is_cache_entry(path), normalize_cache_entry(text))
    domain = lambda d, x: sha256(F.concat(F.lit(d), x.cast("binary")))
    return F.coalesce(domain(schema.IMPORT_CONFIG_DOMAIN, config), domain(schema.CACHE_ENTRY_DOMAIN, entry), sha256(content))


def rewrite_prefix(path: Column, source: Column, target: Column) -> Column:
    """The path after a rename of it or a folder above it; null if the rename doesn't concern it."""
    below = F.startswith(path, F.concat(source, F.lit("/")))
    return F.when(path == source, target).when(below, F.concat(target, F.substr(path, F.length(source) + 1)))


def ancestors(path: Column) -> Column:
    """A path and everything in front of its slashes: what a rename that concerns it can be called."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def resolve(raw: Column, target: Column, base: Column) -> Column:
    """An absolute path from one as captured: what the system said, else below the folder it starts from."""
    seen = F.regexp_replace(target, r" \(deleted\)$", "")
    agreed = F.when(seen.isNotNull() & ((seen == raw) | F.endswith(seen, F.concat(F.lit("/"), F.regexp_replace(raw, r"^\./", "")))), seen)
    joined = F.when(base.isNotNull(), F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), raw))
    return F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.coalesce(agreed, joined, raw))


def display(path: Column, workspace: str) -> Column:
    """A path as shown: without the workspace in front."""
    root = workspace.rstrip("/")
    return F.when(path == root, F.lit("")).when(F.startswith(path, F.lit(root + "/")), F.substr(path, F.lit(len(root) + 2))).otherwise(path)


def shell_argument(arg: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(arg, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(arg == "", F.lit("''")).when(arg.rlike(r"^[A-Za-z0-9/._=:+-]+\z"), arg).otherwise(quoted)


def shell_command(command: Column) -> Column:
    return F.array_join(F.transform(command, shell_argument), " ")
