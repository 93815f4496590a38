"""XML files as rows of elements; beans, layouts and manifests; and HOCON configuration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import scalars as fn
from sluice.sources._rows import parsed

ELEMENT = "element string, path string, attributes map<string,string>, text string, line int"
PROPERTY = "name string, value string, line int"


def element_rows(text: str) -> Iterator[tuple]:
    """element, path with places (/a[1]/b[2]), attributes, text and line of every element, parents first; what is no XML has no rows. Entities of the file's own are not expanded."""
    rows: list[list] = []
    stack: list[tuple[int, dict[str, int]]] = []
    top: dict[str, int] = {}
    parser = expat.ParserCreate()

    def start(name: str, attributes: dict[str, str]) -> None:
        seen = stack[-1][1] if stack else top
        seen[name] = seen.get(name, 0) + 1
        above = rows[stack[-1][0]][1] if stack else ""
        stack.append((len(rows), {}))
        rows.append([name, f"{above}/{name}[{seen[name]}]", attributes, "", parser.CurrentLineNumber])

    def refuse(*_: object) -> None:
        raise ValueError("entity")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda data: rows[stack[-1][0]].__setitem__(3, rows[stack[-1][0]][3] + data)
    parser.EntityDeclHandler = refuse
    try:
        parser.Parse(text.encode("utf-8", "replace") if not text.lstrip().startswith("<?xml") else re.sub(r"<\?xml.*?\?>", "", text, count=1, flags=re.S).encode("utf-8", "replace"), True)
    except (expat.ExpatError, ValueError):
        return
    yield from ((n, p, list(a.items()), t.strip(), line) for n, p, a, t, line in rows)


def elements(files: DataFrame) -> DataFrame:
    """Rows of elements of XML files (any columns and ``content``)."""
    return parsed(files, "content", element_rows, ELEMENT)


def _attribute(name: str):
    values = F.map_filter("attributes", lambda k, _: F.element_at(F.split(k, ":"), -1) == name)
    return F.try_element_at(F.map_values(values), F.lit(1))


def beans(found: DataFrame, properties: DataFrame) -> DataFrame:
    """(repo, file, class, name, value, line): properties of Spring beans by attribute or inner value; ``${x}`` by the property of that name, the first by file."""
    up = F.regexp_extract("path", r"^(.*/bean\[\d+\])/", 1)
    bean = found.where("element = 'bean'").select("repo", "file", F.col("path").alias("bean"), _attribute("class").alias("class"))
    own = found.where("element = 'property'").withColumn("bean", up).select("repo", "file", "path", "bean", _attribute("name").alias("name"), _attribute("value").alias("given"), "line")
    inner = found.where("element = 'value'").select("repo", "file", F.regexp_extract("path", r"^(.*)/value\[\d+\]$", 1).alias("path"), F.col("text").alias("inner"))
    rows = own.join(inner, ["repo", "file", "path"], "left").withColumn("raw", F.coalesce("given", F.nullif(F.col("inner"), F.lit("")))).where("name is not null and raw is not null")
    known = properties.groupBy("repo", F.col("name").alias("hole")).agg(F.min_by("value", "file").alias("resolved"))
    filled = rows.withColumn("hole", fn.placeholder(F.col("raw"))).join(known, ["repo", "hole"], "left")
    return filled.join(bean, ["repo", "file", "bean"], "left").select("repo", "file", "class", "name", F.coalesce("resolved", "raw").alias("value"), "line")


def bean_links(beans_found: DataFrame, members: DataFrame) -> DataFrame:
    """(repo, file, name, node_id): bean properties and the member of their class that they set."""
    own = members.select("repo", F.col("owner").alias("class"), "name", F.col("id").alias("node_id"))
    return beans_found.join(own, ["repo", "class", "name"]).select("repo", "file", "name", "node_id")


def layouts(found: DataFrame) -> DataFrame:
    """(repo, file, name, type_full_name, line): elements of layouts with an id, ``@+id/`` taken off."""
    name = F.regexp_replace(_attribute("id"), r"^@\+?(?:android:)?id/", "")
    return found.where("file not like '%AndroidManifest.xml'").withColumn("name", name).where("name is not null").select("repo", "file", "name", F.col("element").alias("type_full_name"), "line")


def permissions(found: DataFrame) -> DataFrame:
    """(repo, file, name, permission_type, line): the permissions that manifests use."""
    own = found.where("file like '%AndroidManifest.xml' and element in ('uses-permission', 'uses-permission-sdk-23')").withColumn("name", _attribute("name")).where("name is not null")
    return own.select("repo", "file", "name", F.col("name").alias("permission_type"), "line")


_HOCON = re.compile(r"""\s*(?P<c>(?:\#|//)[^\n]*)|(?P<t>\"\"\"(?:.|\n)*?\"\"\"|"(?:\\.|[^"\\\n])*"|[{}\[\],]|\+=|[=:]|\n|\$\{\??[^}]*\}|(?:(?!//)[^\s{}\[\],=:"\#$+])+|[$+])|(?P<s>[^\S\n]+)""")


INCLUDE = "include"


def hocon_pieces(text: str) -> Iterator[tuple[str, str, int]]:
    """As ``hocon_rows``, but references to other keys stay in the values, and an include is a row of that name with the file's."""
    return hocon_rows(text, whole=False)


def hocon_rows(text: str, whole: bool = True) -> Iterator[tuple[str, str, int]]:
    """a.b[0].c, value and line of a HOCON text: objects, dotted keys, lists, comments, quoted and unquoted values, and ${references} to keys before.

    The last value of a key wins, objects of one key are merged; includes and what is not HOCON have no rows. Files that refer to each other are ``conf.resolved``'s.
    """
    tokens, line = [], 1
    for m in _HOCON.finditer(text):
        if m["t"]:
            tokens.append((m["t"], line))
        elif m["s"] and tokens:
            tokens.append((" ", line))
        line += m[0].count("\n")
    out: dict[str, tuple[str, int]] = {}
    included: list[tuple[str, int]] = []
    at = 0

    def blank(newlines: bool = True) -> None:
        nonlocal at
        while at < len(tokens) and (tokens[at][0] == " " or newlines and tokens[at][0] in ("\n", ",")):
            at += 1

    def bare(t: str) -> str:
        if t.startswith('"""'):
            return t[3:-3]
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]) if t.startswith('"') else t

    def value(path: str) -> None:
        nonlocal at
        blank(False)
        if at < len(tokens) and tokens[at][0] == "{":
            at += 1
            body(path, "}")
            return
        if at < len(tokens) and tokens[at][0] == "[":
            at += 1
            k = 0
            for old in [x for x in out if x.startswith(f"{path}[")]:
                del out[old]
            blank()
            while at < len(tokens) and tokens[at][0] != "]":
                value(f"{path}[{k}]")
                k += 1
                blank()
            at += 1
            return
        parts, first = [], tokens[at][1] if at < len(tokens) else 0
        while at < len(tokens) and tokens[at][0] not in ("\n", ",", "}", "]"):
            t = tokens[at][0]
            hole = re.fullmatch(r"\$\{\??([^}]*)\}", t)
            known = hole and (whole or hole[1].strip() == path)  # a key that refers to itself means its value before
            parts.append(out.get(hole[1].strip(), (t, 0))[0] if known else t if hole else bare(t))
            at += 1
        text_ = "".join(parts).strip()
        if text_ != "null":
            out[path] = (text_, first)

    def body(prefix: str, end: str) -> None:
        nonlocal at
        blank()
        while at < len(tokens) and tokens[at][0] != end:
            key: list[str] = []
            while at < len(tokens) and tokens[at][0] not in ("=", ":", "+=", "{", "\n", ",", "}"):
                key.append(bare(tokens[at][0]))
                at += 1
            name = "".join(key).strip()
            named = not whole and re.fullmatch(r"include\s+(?:required\()?(?:file\()?(.+?)\)*", name)
            if named:
                included.append((named[1], tokens[at - 1][1]))
            if at >= len(tokens) or not name or tokens[at][0] in ("\n", ",", "}"):
                if at < len(tokens) and tokens[at][0] == end:
                    break
                at += 1
                blank()
                continue
            if tokens[at][0] != "{":
                at += 1
            value(f"{prefix}.{name}" if prefix else name)
            blank()
        at += 1

    blank()
    braced = at < len(tokens) and tokens[at][0] == "{"
    at += braced
    body("", "}" if braced else "\0")
    yield from ((INCLUDE, v, n) for v, n in included)
    for name, (v, n) in out.items():
        yield name, v, n
