"""Column functions on paths and source text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which suffix is which language.
LANGUAGE_BY_SUFFIX = {".php": "php", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".vue": "vue", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml"}


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded down."""
    return (F.length(text) / 4).cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot; none for names without one or that start with their only dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_SUFFIX.items() for x in pair])
    return F.coalesce(F.element_at(known, suffix(path)), F.lit("text"))


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root``, or its base name where it isn't below it."""
    below = F.concat(root, F.lit("/"))
    return F.when(path.startswith(below), F.substring(path, F.length(below) + 1, F.length(path))).otherwise(base_name(path))


def glob_regex(pattern: str) -> str:
    """Regular expression of a case-sensitive glob whose ``*`` also crosses ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + (pattern[i : i + 1] == "!") + 1)) > 0:
            inside = pattern[i:j].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += f"[{'^' + inside[1:] if inside[0] == '!' else inside.replace('^', chr(92) + '^', 1) if inside[0] == '^' else inside}]"
            i = j + 1
        else:
            out += re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) if ord(c) < 128 else c
    return out


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path matches any glob; ``**/x`` also matches ``x`` at the root. No patterns: false."""
    globs = [g for p in patterns for g in ([p, p[3:]] if p.startswith("**/") else [p])]
    return path.rlike("(?s)\\A(?:" + "|".join(map(glob_regex, globs)) + ")\\z") if globs else F.lit(False)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def quoted_list(text: Column) -> Column:
    """Stripped contents of the quoted strings in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1)), strip)


def split_first(text: Column, sep: str) -> tuple[Column, Column]:
    """Text before and behind the first ``sep``; behind is null without one."""
    at = F.instr(text, sep)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at + len(sep), F.length(text)))


def workspace_key(path: Column) -> Column:
    """First sixteen hexadecimal digits of a path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def utc_stamp(moment: Column) -> Column:
    """UTC time as text; the session's time zone must be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# What follows is built as SQL text: one expression of many nested functions, which is parsed once, where a call of a
# function for each node would cost the driver seconds.

# Characters for private use that mark where a text is cut; the first that the text doesn't have is taken.
_MARKS = ("\ue000", "\ue001", "\uf8ff")
_BLOCK = 64


def let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` stands for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _sums(values: str) -> str:
    return f"aggregate({values}, array(0), (acc, v) -> concat(acc, array(element_at(acc, -1) + v)))"


def running(values: str) -> str:
    """Sums of the first 0, 1, ... all entries of an array<int>. Blocks are summed first, then the blocks' totals, so
    that long arrays aren't copied for every entry."""
    blocks = f"transform(filter(sequence(1, greatest(size(vs), 1), {_BLOCK}), k -> k <= size(vs)), k -> {_sums(f'slice(vs, k, {_BLOCK})')})"
    whole = "concat(array(0), flatten(transform(bs, (b, i) -> transform(slice(b, 2, size(b) - 1), v -> v + get(ts, i)))))"
    return let(values, "vs", let(blocks, "bs", let(_sums("transform(bs, b -> element_at(b, -1))"), "ts", whole)))


def line_feeds(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '\n', '')))"


def pieces(text: str, pattern: str) -> str:
    """array<struct<text, begin, line>>: the text before the first match of a multi-line pattern (maybe empty), then from
    each match to the next. Matches are found left to right without overlap; begin: characters before it; line: 1 and the
    line feeds before it. The pattern has no single quote. A text that has all three marks of ``_MARKS`` gets the first
    one replaced by U+FFFD."""
    mark = "coalesce(" + ", ".join(f"if(contains({text}, '{m}'), null, '{m}')" for m in _MARKS) + ", '')"
    clean = f"if(free = '', replace({text}, '{_MARKS[0]}', '\ufffd'), {text})"
    parts = let(f"if(free = '', '{_MARKS[0]}', free)", "mk", f"split(regexp_replace({clean}, r'(?md){pattern}', concat(mk, '$0')), mk)")
    where = f"struct({running('transform(ps, p -> length(p))')} as w, {running(f'transform(ps, p -> {line_feeds("p")})')} as l)"
    return let(mark, "free", let(parts, "ps", let(where, "s", "transform(ps, (p, i) -> struct(p as text, get(s.w, i) as begin, get(s.l, i) + 1 as line))")))


def matched_pieces(text: str, pattern: str) -> str:
    """The pieces that start with a match."""
    return let(pieces(text, pattern), "found", "slice(found, 2, greatest(size(found) - 1, 0))")


def group(text: str, pattern: str, k: int) -> str:
    return f"regexp_extract({text}, r'(?md){pattern}', {k})"


def stripped(text: str) -> str:
    """As ``strip``."""
    return f"regexp_replace({text}, r'(?U)\\A\\s+|\\s+\\z', '')"
