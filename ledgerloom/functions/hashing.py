"""Hashes as column expressions: operations, Merkle nodes, commitments, signature encodings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def binary(x: Column) -> Column:
    return x.cast("binary")


def sha256(x: Column) -> Column:
    """``sha256:`` and the digest's lower-case hexadecimal digits."""
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def hash_pair(left: Column, right: Column) -> Column:
    """A Merkle node: the digest of both children's text."""
    return sha256(binary(F.concat(left, right)))


def pair(left: str, right: str) -> str:
    return "sha256:" + hashlib.sha256((left + right).encode()).hexdigest()


def op_tag(op_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in schema.OP_TAGS.items() for x in item])[op_type]


def op_hash(op_type: Column, tool: Column, args: Column, inputs: Column, outputs: Column) -> Column:
    """An operation's leaf: tag, tool, each argument with a NUL after it, inputs, outputs; the process isn't part of it."""
    text = F.concat(
        op_tag(op_type), F.coalesce(tool, F.lit("")), F.array_join(F.transform(args, lambda a: F.concat(a, F.lit("\x00"))), ""), F.array_join(inputs, ""), F.array_join(outputs, "")
    )
    return sha256(binary(text))


def u32(n: Column) -> Column:
    """Four bytes, least first."""
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))


def framed(text: Column) -> Column:
    return F.concat(u32(F.octet_length(text)), binary(text))


def _all(parts: Column, one) -> Column:
    """The number of parts, then each as bytes; null if one of them is.

    They are joined at once (a string may hold any bytes): adding them one by one would copy what is there for each.
    """
    joined = F.array_join(F.transform(parts, lambda x: one(x).cast("string")), "").cast("binary")
    joined = F.when(~F.exists(parts, lambda x: one(x).isNull()), joined)
    return F.concat(u32(F.size(parts)), joined)


def commitment_v03(root: Column, command: Column, mode: Column, artifacts: Column, roots: Column, outputs: Column) -> Column:
    """Length-prefixed commitment to a process root, command and outputs."""
    return sha256(F.concat(
        framed(F.lit(schema.COMMITMENT_V03)), framed(root), _all(command, framed), framed(mode), _all(artifacts, framed), _all(roots, framed),
        _all(outputs, lambda o: F.concat(framed(o["path"]), framed(o["hash"]))),
    ))


def _json_text(x: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, these in lower-case hexadecimal."""
    x = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        x = F.replace(x, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), x, F.lit('"'))


def _json_list(items: Column, one) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ","), F.lit("]"))


def commitment_v02(root: Column, command: Column, mode: Column, artifacts: Column, roots: Column, outputs: Column) -> Column:
    """Commitment to compact JSON in a fixed order of fields."""
    named = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    selection = F.concat_ws(",", named("mode", _json_text(mode)), named("artifacts", _json_list(artifacts, _json_text)), named("output_roots", _json_list(roots, _json_text)))
    output = lambda o: F.concat(F.lit("{"), named("path", _json_text(o["path"])), F.lit(","), named("hash", _json_text(o["hash"])), F.lit("}"))
    body = F.concat_ws(
        ",", named("domain", F.lit(f'"{schema.COMMITMENT_V02}"')), named("process_root", _json_text(root)), named("command", _json_list(command, _json_text)),
        named("output_selection", F.concat(F.lit("{"), selection, F.lit("}"))), named("outputs", _json_list(outputs, output)),
    )
    return sha256(binary(F.concat(F.lit("{"), body, F.lit("}"))))


def pae(payload_type: Column, payload: Column) -> Column:
    """The bytes that a signature is over: version, then type and payload, each after its length in bytes."""
    length = lambda x: F.octet_length(x).cast("string")
    return F.concat(binary(F.concat(F.lit("DSSEv1 "), length(payload_type), F.lit(" "), payload_type, F.lit(" "), length(payload), F.lit(" "))), binary(payload))
