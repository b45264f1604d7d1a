"""Headers of notes: a subset of YAML read to JSON in its order, which ``parse_json`` makes a VARIANT of, and written again."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Plain words that stand for other things than text.
WORDS = {**dict.fromkeys(("", "~", "null", "Null", "NULL")), **dict.fromkeys(("true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"), True), **dict.fromkeys(("false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"), False)}
_INT, _FLOAT, _DATE = re.compile(r"[-+]?(0|[1-9][0-9_]*)\Z"), re.compile(r"[-+]?([0-9][0-9_]*)?\.[0-9_]*([eE][-+][0-9]+)?\Z"), re.compile(r"\d{4}-\d\d?-\d\d?([Tt ]|\Z)")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#]*?|[-?:][^\s#][^#]*?)\s*:(?=\s|\Z)""")
#: What is written without quotes: nothing that could be read as anything but text.
_PLAIN = re.compile(r"[\w/(](?:[\w ./()+=;!?,~-]|:(?=\S)|(?<=\w)')*")


class Broken(ValueError):
    """Text that is no header of this kind."""


def scalar(text: str) -> Any:
    """What a plain or quoted value stands for."""
    text = text.strip()
    if text[:1] == '"':
        try:
            return json.loads(text, strict=False)
        except ValueError:
            raise Broken(text) from None
    if text[:1] == "'":
        if not re.fullmatch(r"'(?:[^']|'')*'", text, re.S):
            raise Broken(text)
        return text[1:-1].replace("''", "'")
    if text in WORDS:
        return WORDS[text]
    if _INT.match(text):
        return int(text.replace("_", ""))
    if _FLOAT.match(text) and text.strip("+-") != ".":
        return float(text.replace("_", ""))
    if text[:1] in tuple("&*!|>%@`"):
        raise Broken(text)
    return text


def flow(text: str) -> Any:
    """A list or map within brackets, or a scalar; all of the text is used."""
    at = 0

    def white() -> None:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1

    def value(stops: str) -> Any:
        nonlocal at
        white()
        if text[at : at + 1] == "[":
            at, out = at + 1, []
            while True:
                white()
                if text[at : at + 1] == "]":
                    at += 1
                    return out
                out.append(value(",]"))
                comma("]")
        if text[at : at + 1] == "{":
            at, found = at + 1, {}
            while True:
                white()
                if text[at : at + 1] == "}":
                    at += 1
                    return found
                key = value(":,}")
                white()
                if text[at : at + 1] == ":":
                    at += 1
                    found[key_text(key)] = value(",}")
                else:
                    found[key_text(key)] = None
                comma("}")
        m = re.compile(r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^']|'')*'", re.S).match(text, at)
        if m:
            at = m.end()
            return scalar(m[0])
        first = at
        while at < len(text) and text[at] not in stops:
            at += 1
        return scalar(text[first:at])

    def comma(end: str) -> None:
        nonlocal at
        white()
        if text[at : at + 1] == ",":
            at += 1
        elif text[at : at + 1] != end:
            raise Broken(text)

    out = value("")
    white()
    if at < len(text):
        raise Broken(text)
    return out


def key_text(key: Any) -> str:
    return key if isinstance(key, str) else json.dumps(key)


def uncommented(line: str) -> str:
    """A line without a comment: a # at its start or behind white space, outside quotes."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[k - 1] == "\\") else quote
        elif c in "'\"" and (k == 0 or line[k - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1].isspace()):
            return line[:k].rstrip()
    return line.rstrip()


def parse(text: str) -> Any:
    """Maps and lists by indentation or in brackets, quoted and plain values, literal (|) and folded (>) blocks; else ``Broken``."""
    raw = text.split("\n")
    lines = [(len(own) - len(own.lstrip(" ")), own.strip(), k) for k, own in enumerate(map(uncommented, raw)) if own.strip()]
    place = 0

    def block(indent: int) -> Any:
        nonlocal place
        if lines[place][1].startswith("- ") or lines[place][1] == "-":
            out: list = []
            while place < len(lines) and lines[place][0] == indent and (lines[place][1].startswith("- ") or lines[place][1] == "-"):
                rest = lines[place][1][1:]
                inner = indent + 1 + len(rest) - len(rest.lstrip(" "))
                if rest.strip() and (_KEY.match(rest.strip()) or rest.strip().startswith("- ")) and rest.strip()[:1] not in "[{":
                    lines[place] = (inner, rest.strip(), lines[place][2])
                    out.append(block(inner))
                else:
                    out.append(after(rest.strip(), indent))
            return out
        if not _KEY.match(lines[place][1]):
            if place + 1 < len(lines):
                raise Broken(lines[place][1])
            place += 1
            return flow(lines[place - 1][1])
        found: dict = {}
        while place < len(lines) and lines[place][0] == indent:
            m = _KEY.match(lines[place][1])
            if not m:
                raise Broken(lines[place][1])
            found[key_text(scalar(m[1]))] = after(lines[place][1][m.end() :].strip(), indent, same=True)
        return found

    def after(rest: str, indent: int, same: bool = False) -> Any:
        """The value that begins behind a key or dash, and may go on below it."""
        nonlocal place
        first = lines[place][2]
        place += 1
        if re.fullmatch(r"[|>][-+]?", rest):
            return literal(rest, first, indent)
        if rest:
            while rest[:1] in "[{" and not balanced(rest) and place < len(lines):
                rest, place = f"{rest} {lines[place][1]}", place + 1
            return flow(rest) if rest[:1] in "[{" else scalar(rest)
        if place < len(lines) and (lines[place][0] > indent or same and lines[place][0] == indent and re.match(r"-(\s|\Z)", lines[place][1])):
            return block(lines[place][0])
        return None

    def literal(how: str, first: int, indent: int) -> str:
        nonlocal place
        own = []
        for line in raw[first + 1 :]:
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            own.append(line)
        while place < len(lines) and lines[place][2] <= first + len(own):
            place += 1
        margin = min((len(x) - len(x.lstrip(" ")) for x in own if x.strip()), default=0)
        body = "\n".join(x[margin:] for x in own).rstrip("\n")
        if how[0] == ">":
            body = re.sub(r"(?<!\n)\n(?!\n)", " ", body)
            body = re.sub(r"\n(\n+)", r"\1", body)
        return body if how.endswith("-") or not body else body + "\n"

    if not lines:
        return None
    out = block(lines[0][0])
    if place < len(lines):
        raise Broken(lines[place][1])
    return out


def balanced(text: str) -> bool:
    bare = re.sub(r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^']|'')*'", "", text)
    return sum(bare.count(c) for c in "[{") <= sum(bare.count(c) for c in "]}")


# ---------------------------------------------------------------- writing


def written(value: Any) -> str:
    """A scalar as text that reads back as the same value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        text = repr(value)
        return re.sub(r"^(-?\d+)e", r"\1.0e", text)
    if not value.isprintable():
        return json.dumps(value)
    if value in WORDS or _INT.match(value) or _FLOAT.match(value) or _DATE.match(value) or not _PLAIN.fullmatch(value) or value[-1] in " :":
        return "'" + value.replace("'", "''") + "'"
    return value


def dumped(value: Any, indent: int = 0) -> str:
    """Block style, keys in their order, lists under their key without further indentation."""
    pad = "  " * indent
    if isinstance(value, dict) and value:
        out = ""
        for k, v in value.items():
            if isinstance(v, (dict, list)) and v:
                out += f"{pad}{written(k)}:\n" + dumped(v, indent + isinstance(v, dict))
            else:
                out += f"{pad}{written(k)}: {dumped(v).strip()}\n"
        return out
    if isinstance(value, list) and value:
        out = ""
        for v in value:
            inner = dumped(v, indent + 1)
            out += f"{pad}- {inner[len(pad) + 2 :]}" if isinstance(v, (dict, list)) and v else f"{pad}- {dumped(v).strip()}\n"
        return out
    if isinstance(value, (dict, list)):
        return ("{}" if isinstance(value, dict) else "[]") + "\n"
    return written(value) + "\n"


# ---------------------------------------------------------------- columns


@F.pandas_udf(T.StringType())
def _to_json(headers: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(parse(text.replace("\r\n", "\n")), ensure_ascii=False)
        except (Broken, RecursionError, IndexError):
            return None

    return headers.map(one)


@F.pandas_udf(T.StringType())
def _from_json(values: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return dumped(json.loads(text))
        except ValueError:
            return None

    return values.map(one)


def header_json(header: str | Column) -> Column:
    """A header as JSON text, keys in their order; null for null and for what is no header of the subset. ``parse_json`` makes it a VARIANT."""
    return _to_json(F.col(header) if isinstance(header, str) else header)


def header_map(header: str | Column) -> Column:
    """A header as a VARIANT; one that is no map counts as an empty map, as does null."""
    value = F.try_parse_json(header_json(header))
    return F.when(F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), value).otherwise(F.parse_json(F.lit("{}")))


def written_header(value: str | Column) -> Column:
    """JSON text as a header between its fences, in its order; null for null and for what is no JSON."""
    return F.concat(F.lit("---\n"), _from_json(F.col(value) if isinstance(value, str) else value), F.lit("---\n"))
