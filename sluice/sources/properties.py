"""Property files as rows: name, value and line (-1 where the format gives none)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources._rows import parsed
from sluice.sources.xml import hocon_rows

PROPERTY = "name string, value string, line int"
NO_LINE = -1
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}
_KEY = re.compile(r"((?:\\.|[^\\=:\s])*)\s*[=:]?\s*", re.S)
_LOGICAL = re.compile(r"^[ \t\f]*[#!].*$|(?:[^\\\n]|\\(?:\n[ \t\f]*|[^\n]|$))+", re.M)  # a comment, or a line with its continuations


def _plain(text: str) -> str:
    text = re.sub(r"\\\n[ \t\f]*", "", text)
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def key_values(text: str) -> Iterator[tuple[str, str, int]]:
    """Key and value lines with continuations and escapes; the last of a name wins. Section headings of INI files are no prefix."""
    out: dict[str, str] = {}
    natural = text.replace("\r\n", "\n").replace("\r", "\n")
    for m in _LOGICAL.finditer(natural):
        line = m[0].lstrip()
        if line and line[0] not in "#!":
            key = _KEY.match(line)
            out[_plain(key[1])] = _plain(line[key.end() :])
    for name, value in out.items():
        yield name, value, NO_LINE


def json_values(text: str) -> Iterator[tuple[str, str, int]]:
    """a.b[0].c and its scalar, of a JSON text; what is no JSON has no rows."""
    try:
        todo = [("", json.loads(text))]
    except (ValueError, RecursionError):
        return
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(f"{path}[{k}]", v) for k, v in reversed(list(enumerate(node)))]
        else:
            yield path, node if isinstance(node, str) else json.dumps(node), NO_LINE


def yaml_values(text: str) -> Iterator[tuple[str, str, int]]:
    """a.b[0].c, scalar and line of a YAML text, without @@ and <%= %>; what is no YAML has no rows."""
    import yaml

    try:
        todo = [("", yaml.compose(re.sub("<%=.*?%>", "", text.replace("@@", "")), Loader=yaml.SafeLoader))]
    except (yaml.YAMLError, RecursionError):
        return
    found = []
    while todo:
        path, node = todo.pop()
        if isinstance(node, yaml.MappingNode):
            if any(not isinstance(k, yaml.ScalarNode) for k, _ in node.value):
                return
            todo += [(f"{path}.{k.value}" if path else k.value, v) for k, v in reversed(node.value)]
        elif isinstance(node, yaml.SequenceNode):
            todo += [(f"{path}[{k}]", v) for k, v in reversed(list(enumerate(node.value)))]
        elif node is not None:
            found.append((path, node.value, node.start_mark.line + 1))
    yield from found


PARSERS = {".properties": key_values, ".ini": key_values, ".json": json_values, ".yaml": yaml_values, ".yml": yaml_values, ".conf": hocon_rows}
# Which formats a language's scan reads.
FORMATS = {"java": (".properties", ".yaml", ".yml", ".conf"), "kotlin": (".properties", ".yaml", ".yml", ".conf"), "javascript": (".json", ".env", ".yaml", ".yml"), "python": (".env", ".ini", ".yaml", ".yml", ".json"), "ruby": (".env", ".yaml", ".yml"), "go": (".env", ".yaml", ".yml"), "php": (".env", ".yaml", ".yml", ".ini"), "csharp": (".json",)}


def read(files: DataFrame, extension: str) -> DataFrame:
    """Properties of files (any columns and ``content``, text) of one format."""
    return dotenv(files) if extension == ".env" else parsed(files, "content", PARSERS[extension], PROPERTY)


def dotenv(files: DataFrame) -> DataFrame:
    """Lines split at their first =, without blank ones and those that start with #; the last of a name in a file wins. JVM only."""
    keys = [c for c in files.columns if c not in ("content", "name", "value", "line")]
    lines = files.select(*keys, F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("_at", "_line"))
    parts = F.split("_line", "=", 2)
    good = lines.where((F.trim("_line") != "") & ~F.col("_line").startswith("#") & F.col("_line").contains("="))
    last = good.select(*keys, parts[0].alias("name"), parts[1].alias("value"), "_at").groupBy(*keys, "name").agg(F.max_by("value", "_at").alias("value"))
    return last.withColumn("line", F.lit(NO_LINE))


def read_all(files: DataFrame, language: str) -> DataFrame:
    """Properties of all files (file, content and more) of the formats that a language's scan reads, one pass for each format."""
    out = None
    for ext in FORMATS.get(language, (".properties", ".yaml", ".yml", ".json", ".env", ".ini", ".conf")):
        own = files.where(F.lower("file").endswith(ext))
        rows = read(own, ext).select(*[c for c in files.columns if c not in ("content", "name", "value", "line")], "name", "value", "line")
        out = rows if out is None else out.unionByName(rows)
    return out


def generated(files: DataFrame, folder: str = "generated-config") -> DataFrame:
    """Properties of every JSON file under a folder of generated configuration."""
    return read(files.where(F.col("file").contains(f"/{folder}/") & F.lower("file").endswith(".json")), ".json")
