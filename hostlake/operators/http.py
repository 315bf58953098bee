"""HTTP/1 style messages out of a BINARY payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlake.functions.inet import let

# Accepted methods (written lower case) and versions (written upper case).
METHODS = ("get", "post", "put", "delete", "patch", "options", "head", "connect", "trace")
VERSIONS = ("http/0.9", "http/1.0", "http/1.1", "http/2", "http/3")

_LINE = "\r\n"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _headers(lines: Column) -> Column:
    """name -> value; a repeated name keeps its last value."""
    names = F.transform(lines, lambda line: _strip(F.split_part(line, F.lit(":"), F.lit(1))))
    values = F.transform(lines, lambda line: _strip(F.regexp_replace(line, r"^[^:]*:", "")))
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))

    def last_value(pairs_: Column, name: Column) -> Column:
        return F.element_at(F.filter(pairs_, lambda p: p["name"] == name), -1)["value"]

    return let(
        pairs,
        lambda p: let(
            F.array_distinct(F.transform(p, lambda e: e["name"])),
            lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: last_value(p, k))),
        ),
    )


def http_message(payload: Column) -> Column:
    """STRUCT of type, method, uri, version, status_code, status_text, headers, body, or NULL.

    The head ends at the first empty line; only the head is split, so the size of the body does not
    matter. A text that ends with one line break has an empty last line and thus an empty body.
    """

    def from_text(text: Column) -> Column:
        blank = F.position(F.lit(_LINE + _LINE), text)
        head = F.when(blank > 0, F.substr(text, F.lit(1), blank - 1)).when(
            F.endswith(text, F.lit(_LINE)), F.substr(text, F.lit(1), F.length(text) - 2)
        )
        body = F.when(blank > 0, F.substr(text, blank + 4)).otherwise(F.lit(""))
        return let(F.struct(F.split(head, _LINE).alias("lines"), body.alias("body")), from_parts)

    def from_parts(parts: Column) -> Column:
        lines = parts["lines"]
        fields = F.filter(F.split(lines[0], r"\s+"), lambda w: w != "")
        header_lines = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        sound = lines.isNotNull() & F.forall(header_lines, lambda line: F.contains(line, F.lit(":")))
        return F.when(sound, let(fields, lambda f: message(f, header_lines, parts["body"])))

    def message(fields: Column, header_lines: Column, body: Column) -> Column:
        def word(i: int) -> Column:
            return F.get(fields, F.lit(i))

        text = F.lit(None).cast("string")
        method, request_version = F.lower(word(0)), F.lower(word(2))
        is_request = method.isin(*METHODS) & request_version.isin(*VERSIONS)
        code = F.when(word(1).rlike(r"^\+?[0-9]+$"), word(1).try_cast("int"))
        is_response = F.lower(word(0)).isin(*VERSIONS) & code.between(0, 65535)
        reason = F.array_join(F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))), " ")
        request = F.struct(
            F.lit("request").alias("type"),
            method.alias("method"),
            word(1).alias("uri"),
            F.upper(request_version).alias("version"),
            F.lit(None).cast("int").alias("status_code"),
            text.alias("status_text"),
            _headers(header_lines).alias("headers"),
            body.alias("body"),
        )
        response = F.struct(
            F.lit("response").alias("type"),
            text.alias("method"),
            text.alias("uri"),
            F.upper(word(0)).alias("version"),
            code.alias("status_code"),
            reason.alias("status_text"),
            _headers(header_lines).alias("headers"),
            body.alias("body"),
        )
        return F.when(is_request, request).when(is_response, response)

    text = payload.cast("string")
    return F.when((F.octet_length(payload) > 0) & F.is_valid_utf8(text), let(text, from_text))
