"""Scalar functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


UNKNOWN_DOMAIN = "unknown-domain"
# Fixed value: an address in the code of a template, with or without scheme.
TEMPLATE_URL = r"(http:|https:){0,1}\/\/(www.){0,1}([\w_\-]+(?:(?:\.[\w_\-]+)+))([\w.,@?^=%&:\/~+#\-]*[\w@?^=%&\/~+#\-])"


def url_host(url: Column) -> Column:
    """Host of an address without quotes, scheme, www. and port; an address needs no scheme. What is no address stays as it is.

    Of an address with a scheme all its like are taken out, as ever: http:// where there is one, else https://.
    """
    bare = F.regexp_replace(url, "[\"']", "")
    rest = F.trim(F.when(bare.contains("http://"), F.replace(bare, F.lit("http://"), F.lit(""))).otherwise(F.replace(bare, F.lit("https://"), F.lit(""))))
    host = F.regexp_extract(rest, r"^(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?=[/?#]|:[0-9]*(?:[/?#]|$)|$)", 1)
    good = rest.rlike(r"^(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?(?:[/?#]|$)")
    return F.when(good, F.replace(host, F.lit("www."), F.lit(""))).otherwise(url)


def clean_url(url: Column) -> Column:
    """Without one double quote at each end."""
    return F.regexp_replace(url, '^"|"$', "")


def unquoted(code: Column) -> Column:
    """Without one quote of any kind at each end."""
    return F.regexp_replace(code, "^[\"'`]|[\"'`]$", "")


def service_domain(url: Column) -> Column:
    """The tail of the address of a service (http://name, without a dot), else the host."""
    return F.when(url.rlike(r"\A(?:.*(http|https):\/\/[a-zA-Z0-9_-]+)$"), F.element_at(F.split(url, "//"), -1)).otherwise(url_host(url))


def template_url(code: Column) -> Column:
    """The first address in the code of a template, or unknown-domain."""
    found = F.regexp_extract(code, TEMPLATE_URL, 0)
    return F.when(found != "", found).otherwise(UNKNOWN_DOMAIN)


def template_domain(code: Column) -> Column:
    found = F.regexp_extract(code, TEMPLATE_URL, 3)
    return F.when(found != "", found).otherwise(UNKNOWN_DOMAIN)


def identifier_in(code: Column, pattern: str) -> Column:
    """The first word, cut at white space, that matches wholly; null if none does."""
    return F.try_element_at(F.filter(F.split(code, r"\s+"), lambda w: w.rlike(rf"\A(?:\b{pattern}\b)\z")), F.lit(1))


def literal_code(code: Column, original: Column | None = None) -> Column:
    """The value of the property that a node comes from, else the last word of its code."""
    last = F.element_at(F.split(code, " "), -1)
    return last if original is None else F.coalesce(original, last)


def excerpt(lines: Column, line: Column, around: int = 5) -> Column:
    """The lines of a file (an array) from ``around`` before to as many after, the line itself marked by an arrow."""
    first = F.greatest(line - around, F.lit(1))
    own = F.slice(lines, first, F.least(line + around, F.size(lines)) - first + 1)
    mark = F.transform(own, lambda x, k: F.when(k + first == line, F.concat(x, F.lit(" /* <===  */ "))).otherwise(x))
    return F.when((line < 1) | (line > F.size(lines)), "").otherwise(F.array_join(mark, "\n"))


def type_name(full: Column) -> Column:
    """A Python full name without ``<init>``, ``<body>`` and ``<meta>`` and what follows them."""
    return F.regexp_replace(full, r"(?:[.:]?<(?:init|body|meta)>).*$", "")


def shown_position(position: Column, file: Column) -> Column:
    """C# counts lines and columns from 0."""
    return F.when(file.endswith(".cs"), position + 1).otherwise(position)


def item_path(item: Column) -> Column:
    """A repository item's name as a path, and ``item_name`` back."""
    return F.replace(item, F.lit("--"), F.lit("/"))


def item_name(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("--"))


def placeholder(value: Column) -> Column:
    """The name in ``${name}``, or null."""
    found = F.regexp_extract(value, r"^\$\{([^}:]+)(?::[^}]*)?\}$", 1)
    return F.when(found != "", found)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def sha256(text: Column, strict_parity: bool = True) -> Column:
    """Hex digest; with ``strict_parity`` without leading zeros beyond 32 digits, as %032x prints it."""
    full = F.sha2(text, 256)
    if not strict_parity:
        return full
    bare = F.regexp_replace(full, "^0+", "")
    return F.when(F.length(bare) < 32, F.lpad(bare, 32, "0")).otherwise(bare)


def size_text(size: Column) -> Column:
    """Whole GB, MB or KB, else bytes."""
    whole = lambda k: F.floor(size / (1 << k)).cast("string")
    return F.when(size >= 1 << 30, F.concat(whole(30), F.lit("GB"))).when(size >= 1 << 20, F.concat(whole(20), F.lit("MB"))).when(size >= 1 << 10, F.concat(whole(10), F.lit("KB"))).otherwise(F.concat(size.cast("string"), F.lit(" bytes")))


def method_prefix(name: Column, segments: int = 6) -> Column:
    """The first dotted segments of what stands before a colon."""
    return F.array_join(F.slice(F.split(F.split(name, ":")[0], r"\."), 1, segments), ".")


def class_table(name: Column) -> Column:
    """Snake case, in the plural."""
    snake = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.when(snake.endswith("s"), snake).otherwise(F.concat(snake, F.lit("s")))


def arguments(code: Column) -> Column:
    """Parts of a call's code between (, comma and +, trimmed, without double-quoted text and what is then empty."""
    return F.filter(F.transform(F.split(code, r"[(,+]"), lambda x: F.regexp_replace(F.trim(x), '".*"', "")), lambda x: x != "")


# Clouds and production files.
CLOUD = r".*(amazonaws\.com|orcalecloud\.com|azure\.com|mongodb\.net).*"
CLOUD_PROD = r".*(prd|prod).*(amazonaws\.com|orcalecloud\.com|azure\.com|mongodb\.net).*"
PROD_FILE = r".*(prd|prod).*\.(properties|yaml|yml|xml|conf)$"
ADDRESS = r"^([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}:[0-9]{1,4})(:[0-9]{1,4})?$"


def config_priority(value: Column, file: Column) -> Column:
    """4 in a production file, 3 a cloud for production, 2 a cloud, 1 an address and port, 0 other."""
    whole = lambda c, p: F.coalesce(c.rlike(rf"\A(?:{p})\z"), F.lit(False))
    return F.when(whole(file, PROD_FILE), 4).when(whole(value, CLOUD_PROD), 3).when(whole(value, CLOUD), 2).when(whole(value, ADDRESS), 1).otherwise(0)
