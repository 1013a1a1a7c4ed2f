"""Predicates and text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.plans import vocab


def one_of(pairs, key: Column, default: Column | None = None) -> Column:
    """A lookup in a fixed table as one map literal."""
    items = dict(pairs)
    found = F.create_map(*[F.lit(x) for kv in items.items() for x in kv])[key]
    return F.coalesce(found, default) if default is not None else found


def first_match(cases: list[tuple[Column, object]]) -> Column:
    """The value of the first true case, else null."""
    out = F
    for test, value in cases:
        out = out.when(test, F.lit(value) if not isinstance(value, Column) else value)
    return out if isinstance(out, Column) else F.lit(None)


# ---------------------------------------------------------------- patterns


def wildcard(text: Column, pattern: str) -> Column:
    """Whether text matches a pattern of literal pieces and stars.

    No star: equality. One star: the text starts with the first piece and ends
    with the second, which may overlap. More: pieces are found one after
    another, each at its first place; the first must start the text and the last
    must end it there.
    """
    pieces = pattern.split("*")
    if len(pieces) == 1:
        return text == pattern
    if len(pieces) == 2:
        return text.startswith(pieces[0]) & text.endswith(pieces[1])
    at, ok = F.lit(0), F.lit(True)
    for i, piece in enumerate(pieces):
        if not piece:
            continue
        found = F.call_function("locate", F.lit(piece), text, at + 1)
        ok = ok & (found > 0)
        if i == 0:
            ok = ok & (found == 1)
        if i == len(pieces) - 1:
            ok = ok & (found + len(piece) - 1 == F.char_length(text))
        at = found + len(piece) - 1
    return F.coalesce(ok, F.lit(False))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``*`` within a segment, ``**`` over any number of them."""
    out = []
    for segment in pattern.strip("/").split("/"):
        out.append("(?:[^/]+/)*" if segment == "**" else "[^/]*".join(re.escape(p) for p in segment.split("*")) + "/")
    body = "".join(out)
    return body[:-1] if body.endswith("/") else body + "[^/]*"


def glob(path: Column, pattern: str) -> Column:
    """Whether a path matches a glob; a relative glob may match from any segment on."""
    start = "^/?" if pattern.startswith("/") else "(?:^|/)"
    return path.rlike(f"{start}{glob_regex(pattern)}$")


def under_prefix(path: Column, prefix: Column, separator: str) -> Column:
    """Equality, or the prefix followed by the separator."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit(separator)))


def path_suffix(path: Column, rule: Column) -> Column:
    return (path == rule) | path.endswith(F.concat(F.lit("/"), rule))


def under_src(path: Column) -> Column:
    return F.array_contains(F.split(path, "[/\\\\]"), "src")


# ---------------------------------------------------------------- literals


def _port_host(value: Column) -> Column:
    """The host ahead of the last colon if a 16-bit port follows it."""
    port = F.regexp_extract(value, "^.*:\\+?([0-9]+)$", 1)
    ok = (port != "") & (port.cast("decimal(38,0)") <= 65535)
    return F.when(F.coalesce(ok, F.lit(False)), F.regexp_extract(value, "^(.*):\\+?[0-9]+$", 1))


def is_ipv4(value: Column) -> Column:
    """Four decimal bytes, a colon and a port; the port is required."""
    octet = "\\+?0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.coalesce(_port_host(value).rlike(f"^{octet}(?:\\.{octet}){{3}}$"), F.lit(False))


def is_ipv6(value: Column) -> Column:
    """Three or more groups between colons, each hexadecimal or empty, with one double colon at most."""
    inner = F.when(value.startswith("["), F.regexp_replace(F.regexp_replace(F.substr(value, F.lit(2)), "\\]$", ""), "\\]:[^\\]]*$", "")).otherwise(value)
    shape = inner.rlike("^[0-9a-fA-F]*(?::[0-9a-fA-F]*){2,}$")
    return shape & (F.octet_length(inner) >= 3) & (F.size(F.split(inner, "::")) <= 2)


def is_endpoint(value: Column) -> Column:
    """Eight bytes or more that start with a URL scheme or look like an address."""
    return (F.octet_length(value) >= 8) & (value.rlike("^(https?|wss?)://") | is_ipv4(value) | is_ipv6(value))


# Fixed values below: the lengths, prefixes and alphabets of keys and credentials.


def is_pem(value: Column) -> Column:
    return value.contains("-----BEGIN ")


def is_hex_key(value: Column) -> Column:
    n = F.octet_length(value)
    return value.rlike("^[0-9a-fA-F]+$") & (n % 2 == 0) & (n.isin(64, 96) | (n >= 128))


# Fixed value: the base-58 alphabet.
_BASE58 = "[1-9A-HJ-NP-Za-km-z]"


def is_base58_key(value: Column) -> Column:
    n = F.octet_length(value)
    return value.rlike(f"^{_BASE58}*$") & ((value.rlike("^[5KL]") & n.between(51, 52)) | n.between(64, 88))


def is_prefixed_key(value: Column) -> Column:
    n = F.octet_length(value)
    return (
        (value.startswith("AGE-SECRET-KEY-1") & (n > 16))
        | (value.rlike(f"^xprv{_BASE58}*$") & (n >= 111))
        | (value.startswith("ed25519:") & (n > 8))
        | (value.rlike("^0x[0-9a-fA-F]*$") & (n == 66))
    )


def is_credential(value: Column) -> Column:
    hub = value.rlike("^gh[posr]_")
    return F.when(hub, value.rlike("^gh[posr]_[0-9A-Za-z]{36}$")).otherwise(value.rlike("^AKIA[A-Z0-9]{16}$") | value.rlike("^sk(?:_live_|_test_|-)[0-9A-Za-z]{24,}$"))


def is_key_material(value: Column) -> Column:
    return is_hex_key(value) | is_base58_key(value) | is_prefixed_key(value) | is_credential(value)


def evidence(value: Column) -> Column:
    """Over 40 bytes: the first 16 characters, an ellipsis and the last 4."""
    return F.when(F.octet_length(value) > 40, F.concat(F.substring(value, 1, 16), F.lit("…"), F.right(value, F.lit(4)))).otherwise(value)


# ---------------------------------------------------------------- paths


def rust_capability(path: Column) -> Column:
    """A writing file-system function first, else the first prefix that the path is or lies under."""
    tail = F.regexp_extract(path, "^(?:std|tokio)::fs::(.*)$", 1)
    return first_match([(tail.isin(vocab.FS_WRITE_NAMES), "file_write"), *((under_prefix(path, F.lit(p), "::"), c) for p, c in vocab.RUST_PREFIXES)])


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, unless that dot starts it."""
    return F.regexp_extract(path, "[^/]\\.([^./]*)$", 1)


def file_class(path: Column) -> Column:
    """manifest, rust, source, source_and_manifest or unsupported: by file name, then by extension."""
    language = one_of(vocab.EXTENSIONS.items(), extension(path))
    return (
        F.when(file_name(path).isin(vocab.MANIFESTS), "manifest").when(language == "rust", "rust").when(language == "go", "source_and_manifest").when(language.isNotNull(), "source").otherwise("unsupported")
    )


def shebang_language(source: Column) -> Column:
    """The language of the interpreter that the first line names; options of env are skipped."""
    line = F.regexp_replace(F.element_at(F.split(source, "\n", 2), 1), "\r$", "")
    words = F.filter(F.split(F.regexp_extract(line, "^#!(.*)$", 1), "\\s+"), lambda w: w != "")
    command = F.regexp_extract(F.get(words, F.lit(0)), "[^/]*$", 0)
    program = F.get(F.filter(F.slice(words, 2, 1000), lambda w: ~w.startswith("-")), F.lit(0))
    return one_of(vocab.INTERPRETERS.items(), F.when(command == "env", program).otherwise(command))


def language(path: Column, source: Column) -> Column:
    """By extension (a manifest and Rust name none), else by shebang."""
    named = F.when(file_class(path).isin("source", "source_and_manifest"), one_of(vocab.EXTENSIONS.items(), extension(path)))
    return F.coalesce(named, shebang_language(source))


def syntax_language(path: Column, source: Column) -> Column:
    """The grammar: TSX is one of its own, and a manifest name does not hide an extension."""
    by_name = F.when(extension(path) == "tsx", "tsx").otherwise(one_of(vocab.EXTENSIONS.items(), extension(path)))
    return F.coalesce(by_name, shebang_language(source))


def version_from_path(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)\\.[^./]*$", 1)


def is_skipped_dir(path: Column) -> Column:
    """Below a dot-directory or node_modules."""
    return path.rlike("(^|/)(\\.[^/]+|node_modules)/")


# ---------------------------------------------------------------- commands


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def escape_message(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def escape_property(text: Column) -> Column:
    return F.replace(F.replace(escape_message(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def shell_position(line: Column, command: str, after: str = "=") -> Column:
    """Place (from 1) of the first mention of a command with word borders around it; 0 if there is none."""
    rx = f"(?:^|(?<=[ \\t|;`(&])){re.escape(command)}(?=$|[ \\t;|&\\n){re.escape(after)}])"
    return F.regexp_instr(line, F.lit(rx))


def python_import(line: Column, module: str) -> Column:
    """``import module`` to its end or a dot, or ``from module`` to a space or a dot."""
    m = re.escape(module)
    return strip(line).rlike(f"^import {m}(?:$|\\.)|^from {m}[ .]")


def js_module(line: Column) -> Column:
    """The quoted module right after the first ``require(``, else that of an import statement; null if none."""
    line = strip(line)
    quoted = "(?:'([^']*)'|\"([^\"]*)\")"
    pick = lambda rx: F.when(line.rlike(rx), F.coalesce(F.nullif(F.regexp_extract(line, rx, 1), F.lit("")), F.regexp_extract(line, rx, 2)))
    required = pick(f"^(?:(?!require\\().)*require\\({quoted}")
    from_ = pick(f"^import(?:(?! from ).)* from \\s*{quoted}")
    side = F.when(~line.contains(" from "), pick(f"^import \\s*{quoted}"))
    return F.coalesce(required, from_, side)


def go_package(text: Column) -> Column:
    rx = '"([^"]*)"'
    return F.when(text.rlike(rx), F.regexp_extract(text, rx, 1))


def matches_module(name: Column, pattern: str) -> Column:
    return (name == pattern) | name.startswith(f"{pattern}/")


# ---------------------------------------------------------------- numbers and names


def at_least_percent(part: Column, total: Column, percent: int) -> Column:
    return part * 100 >= total * percent


def below_percent(part: Column, total: Column, percent: int) -> Column:
    return part * 100 < total * percent


def share(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total)


def single_char(name: Column, loop_depth: Column, arithmetic: Column) -> Column:
    """Whether a one-letter name is generic; null for longer names.

    i, j, k and n are not inside a loop, x, y and z are not beside arithmetic.
    """
    return F.when(F.char_length(name) == 1, F.when(name.isin(*"ijkn"), loop_depth == 0).when(name.isin(*"xyz"), ~arithmetic).otherwise(F.lit(True)))


def is_generic_name(name: Column, loop_depth: Column, arithmetic: Column, names: list[str]) -> Column:
    return F.coalesce(single_char(name, loop_depth, arithmetic), name.isin(names))


def semver(version: Column) -> Column:
    """A sortable key of a semantic version, null if it is none: a pre-release sorts below its release."""
    rx = "^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z.-]+))?(?:\\+[0-9A-Za-z.-]+)?$"
    part = lambda i: F.lpad(F.regexp_extract(version, rx, i), 20, "0")
    pre = F.split(F.regexp_extract(version, rx, 4), "\\.")
    # A numeric identifier sorts below any other, and by value; a longer list above its beginning.
    ids = F.transform(pre, lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), x)))
    release = F.regexp_extract(version, rx, 4) == ""
    key = F.array(part(1), part(2), part(3), F.when(release, "1").otherwise("0"))
    return F.when(version.rlike(rx), F.concat(key, F.when(release, F.array().cast("array<string>")).otherwise(ids)))


def length_prefixed(text: Column) -> Column:
    """Eight big-endian bytes of length, then the UTF-8 bytes."""
    body = text.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body).cast("bigint")), 16, "0")), body)


# ---------------------------------------------------------------- places


def byte_offset(source: Column, line: Column, col0: Column) -> Column:
    """Bytes ahead of a place: a line (from 1) and a column (from 0, in characters); null where the line or column is not there."""
    ahead = F.when(line > 1, F.concat(F.call_function("substring_index", source, F.lit("\n"), (line - 1).cast("int")), F.lit("\n"))).otherwise(F.lit(""))
    rest = F.element_at(F.split(F.substr(source, F.char_length(ahead) + 1), "\n", 2), 1)
    there = (line >= 1) & (line <= F.size(F.split(source, "\n"))) & (col0 >= 0) & (col0 <= F.char_length(rest))
    return F.when(there, F.octet_length(ahead) + F.octet_length(F.substr(rest, F.lit(1), col0)))


def place_of(source: Column, offset: Column) -> Column:
    """line (from 1), col0 in characters and byte0 in bytes of a byte offset; null beyond the source or inside a character."""
    ahead = F.try_validate_utf8(F.substring(source.cast("binary"), F.lit(1), offset.cast("int")).cast("string"))
    last = F.element_at(F.split(ahead, "\n"), -1)
    there = ahead.isNotNull() & (offset >= 0) & (offset <= F.octet_length(source))
    return F.when(there, F.struct(F.size(F.split(ahead, "\n")).alias("line"), F.char_length(last).alias("col0"), F.octet_length(last).alias("byte0")))


def confined(path: Column, root: Column) -> Column:
    """Whether a path, with ``.`` and ``..`` resolved, stays inside the root. What climbs above its own start does not."""
    step = lambda held, part: F.when(held.isNull(), held).when(part.isin("", "."), held).when((part == "..") & (F.size(held) > 0), F.slice(held, 1, F.size(held) - 1)).when(part == "..", F.lit(None)).otherwise(F.concat(held, F.array(part)))
    plain = lambda p: F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    inner, outer = plain(path), plain(root)
    return F.coalesce((F.size(inner) >= F.size(outer)) & (F.slice(inner, 1, F.size(outer)) == outer), F.lit(False))


def sink_capability(path: Column) -> Column:
    """The capability of the innermost module segment of a function's path that is a known sink; null if none is."""
    known = F.create_map(*[F.lit(x) for kv in vocab.SINK_MODULES.items() for x in kv])
    hits = F.filter(F.transform(F.reverse(F.slice(F.split(path, "::"), 1, F.greatest(F.size(F.split(path, "::")) - 1, F.lit(0)))), lambda s: known[s]), lambda c: c.isNotNull())
    return F.get(hits, F.lit(0))


def is_mutation(method: Column) -> Column:
    """Whether a method changes the vector or string that it is called on."""
    return method.isin(vocab.VEC_MUTATIONS + vocab.STRING_MUTATIONS)


def is_copy_type(name: Column) -> Column:
    return name.isin(vocab.COPY_TYPES)
