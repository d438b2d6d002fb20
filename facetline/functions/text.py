"""Columns of short texts: remotes, request inputs, types, times, diff headers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the host whose repositories are compared.
HOST = "github.com"


def normalize_remote(url: Column) -> Column:
    """owner/repo of a remote's address on ``HOST``, lower-cased; null for other addresses."""
    trimmed = F.regexp_replace(url, r"^\s+|\s+$", "")
    found = [F.regexp_extract(trimmed, rf"{re.escape(HOST)}[:/]+([^/]+)/([^/\s]+?)(?:\.git)?/?$", i) for i in (1, 2)]
    return F.when(found[0] != "", F.lower(F.concat_ws("/", *found)))


def request_number(value: Column) -> Column:
    """The number in '#12', '12' or the address of a pull request; null otherwise."""
    found = F.coalesce(F.nullif(F.regexp_extract(value, r"/pull/(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(F.trim(value), r"^#?(\d+)$", 1), F.lit("")))
    return found.cast("int")


# Wrappers that a type annotation is peeled of, words of a union that stand for nothing, and names that
# stand for no class.
WRAPPERS = "Optional Annotated Type type ClassVar Final Readonly Partial Required".split()
NOTHING = "None null undefined".split()
NO_CLASS = """str int float bool bytes dict list set tuple Any
string number boolean any unknown void object never
Record Array Promise Map Set Callable Iterable Sequence""".split()


def normalize_type(raw: Column) -> Column:
    """The class that an annotation names: up to three wrappers in square brackets off, of which the part before a comma
    counts, then the first part of a union that is not nothing, and its dotted name at the start."""
    blanks = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = lambda c: F.regexp_replace(blanks(c), r"""^['"]+|['"]+$""", "")
    pattern = rf"^({'|'.join(WRAPPERS)})\[(.*)\]$"
    value = bare(raw)
    for _ in range(3):
        value = F.when(value.rlike(pattern), bare(F.split_part(F.regexp_extract(value, pattern, 2), F.lit(","), F.lit(1)))).otherwise(value)
    parts = F.filter(F.transform(F.split(value, r"\|"), blanks), lambda x: ~x.isin(*NOTHING, ""))
    name = F.regexp_extract(F.get(parts, F.lit(0)), r"^([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)", 1)
    return F.when((name != "") & ~name.isin(NO_CLASS), name)


def relative_time(then: Column, now: Column) -> Column:
    """'5 minutes ago' and the like; less than two seconds, and times to come, are 'just now'; no time is an empty text."""
    micros = F.greatest(F.unix_micros(now) - F.unix_micros(then), F.lit(0))
    steps = [(60, "minute"), (3600, "hour"), (86400, "day"), (30 * 86400, "month"), (12 * 30 * 86400, "year")]
    some = lambda size, unit: F.concat(F.floor(micros / (size * 1_000_000)).cast("string"), F.lit(f" {unit}"), F.when(F.floor(micros / (size * 1_000_000)) == 1, "").otherwise("s"), F.lit(" ago"))
    label = F.when(micros < 2_000_000, "just now").otherwise(some(1, "second"))
    for size, unit in steps:
        label = F.when(micros >= size * 1_000_000, some(size, unit)).otherwise(label)
    return F.coalesce(label, F.lit(""))


def hunk_header(line: Column) -> dict[str, Column]:
    """Numbers of a hunk header; a count that is left out is 1, and a count of 0 stays 0."""
    part = lambda i: F.nullif(F.regexp_extract(line, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$", i), F.lit(""))
    number = lambda i: F.coalesce(part(i).cast("int"), F.lit(1))
    return {"old_start": number(1), "old_lines": number(2), "new_start": number(3), "new_lines": number(4), "section": F.coalesce(part(5), F.lit(""))}


# The letters that stand for control characters in quoted paths.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D"}


def unquote(path: Column) -> Column:
    """A path without C-style quoting: backslash and three octal digits are a byte, other escapes a character.

    Bytes that are no UTF-8 become the replacement character. Paths that no pair of quotes surrounds stay as they are.
    """
    quoted = (F.length(path) >= 2) & F.startswith(path, F.lit('"')) & F.endswith(path, F.lit('"'))
    pieces = F.regexp_extract_all(F.substring(path, F.lit(2), F.length(path) - 2), F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]+|\\"), F.lit(0))

    def code(piece: Column) -> Column:
        after = F.substring(piece, 2, 1)
        special = F.element_at(F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv]), after)
        octal = F.lpad(F.right(F.conv(F.substring(piece, 2, 3), 8, 16), F.lit(2)), 2, "0")
        escaped = F.when(piece.rlike(r"^\\[0-7]{3}$"), octal).otherwise(F.coalesce(special, F.hex(after)))
        return F.when(F.startswith(piece, F.lit("\\")) & (F.length(piece) > 1), escaped).otherwise(F.hex(piece))

    return F.when(quoted, F.make_valid_utf8(F.unhex(F.array_join(F.transform(pieces, code), "")).cast("string"))).otherwise(path)


def header_paths(rest: Column) -> Column:
    """(old, new) of what follows 'diff --git ', null where it is ambiguous.

    A quoted first path ends at its closing quote. Unquoted ones have blanks of their own, so only two equal paths can be told.
    """
    first, second = (F.regexp_extract(rest, r'(?s)^("(?:[^"\\]|\\.)*") (.*)$', i) for i in (1, 2))
    a, b = unquote(first), unquote(second)
    of_quoted = F.when(F.startswith(a, F.lit("a/")) & F.startswith(b, F.lit("b/")), F.struct(F.substring(a, F.lit(3), F.length(a)).alias("old"), F.substring(b, F.lit(3), F.length(b)).alias("new")))
    n = F.floor((F.length(rest) - 5) / 2).cast("int")
    left, right = F.substring(rest, F.lit(3), n), F.substring(rest, n + 6, n)
    of_plain = F.when((n > 0) & (F.length(rest) == 2 * n + 5) & (left == right), F.struct(left.alias("old"), left.alias("new")))
    return F.when(F.startswith(rest, F.lit('"')), of_quoted).otherwise(of_plain)


def symbol_id(path: Column, qual: Column) -> Column:
    return F.concat_ws("::", path, qual)


def family(language: Column) -> Column:
    """py or js: names never resolve across families."""
    return F.when(language == "python", "py").otherwise("js")


def review_id(base: Column, head: Column) -> Column:
    return F.concat_ws("-", F.substring(base, 1, 12), F.substring(head, 1, 12))


_WORD = r"[\p{L}\p{N}_$]"
# Words that may stand before a method's name; words that a declared name follows, and what may stand before those.
_BEFORE_METHOD = "public|private|protected|static|async|readonly|override|get|set|def"
_DECLARES = r"const|let|var|function\*?|class|def|interface|type|enum|namespace"
_BEFORE_DECLARED = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?"


def defined_methods(content: Column) -> Column:
    """Names at the start of a line, after words such as ``static`` or ``def``, that an opening bracket, ``=``, ``:`` or ``<`` follows."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(rf"(?m)^\s*(?:(?:{_BEFORE_METHOD})\s+)*({_WORD}++)(?=\s*[(=:<])"), F.lit(1)))


def defined_names(content: Column) -> Column:
    """Names that a text declares, assigns at the start of a line, with or without a type, or lists in an export.

    A type ends at the next ``=`` of the text, and ``==`` is none; so the text is cut at ``=`` and each piece is looked at
    once, however many names stand in it.
    """
    declared = F.regexp_extract_all(content, F.lit(rf"(?m)^\s*{_BEFORE_DECLARED}(?:{_DECLARES})\s+({_WORD}++)"), F.lit(1))
    pieces = F.split(content, "=")
    n = F.size(pieces)
    assigned = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.when(
                (i < n) & ((F.try_element_at(pieces, i + 1) != "") | (i + 1 == n)),
                F.regexp_extract_all(F.concat(F.when(i > 1, "=").otherwise(""), F.element_at(pieces, i)), F.lit(rf"(?m)^\s*({_WORD}++)(?=\s*(?::|\z))"), F.lit(1)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    listed = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(r"export\s*\{([^}]*)"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(f"({_WORD}+)"), F.lit(1))))
    return F.array_distinct(F.concat(declared, assigned, listed))


def import_line(content: Column, name: Column) -> Column:
    """The first line with the name that imports or requires, else the first with the name, else 1."""
    lines = F.split(content, "\n")
    has = lambda x: F.contains(x, name)
    first = F.array_position(F.transform(lines, lambda x: has(x) & (F.contains(x, F.lit("import")) | F.contains(x, F.lit("require")))), True)
    return F.coalesce(F.nullif(first, F.lit(0)), F.nullif(F.array_position(F.transform(lines, has), True), F.lit(0)), F.lit(1))


def strip_jsonc(text: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON; strings stay as they are."""
    bare = F.regexp_replace(text, r"""("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/""", "$1")
    return F.regexp_replace(bare, r"""("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])""", "$1")
