"""Open-file listings in field output: one label character per line.

``p`` starts a process (then ``c`` command, ``u`` user id), ``f`` starts a file of that process
(then ``t`` type, ``D`` device, ``s`` size, ``i`` node, ``n`` name, in any order, any may miss).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column for each file label, and what a missing label stands for.
_FILE_LABELS = {"t": ("type", ""), "D": ("device", ""), "s": ("size", "0"), "i": ("node", ""), "n": ("name", "")}
# Types of network files.
NETWORK_TYPES = ("IPV4", "IPV6")


def parse_open_files(listings: DataFrame, created_at: Column, text: str = "listing") -> DataFrame:
    """One row per open file of each listing; other columns of the input are kept."""
    keep = [c for c in listings.columns if c != text]
    processes = listings.where(F.col(text) != "").select(
        *keep, created_at.alias("created_at"), F.explode(F.split(text, "\np")).alias("process")
    )
    blocks = processes.select(*keep, "created_at", F.split("process", "\nf").alias("block"))
    files = blocks.select(
        *keep,
        "created_at",
        F.split(F.col("block")[0], "\n").alias("head"),
        F.explode(F.slice("block", 2, F.greatest(F.size("block") - 1, F.lit(0)))).alias("file"),
    )
    lines = files.select(*keep, "created_at", "head", F.split("file", "\n").alias("lines"))

    def label(char: str, missing: str) -> Column:
        found = F.filter(
            F.slice("lines", 2, F.size("lines")), lambda line: F.startswith(line, F.lit(char))
        )
        return F.coalesce(F.substr(F.try_element_at(found, F.lit(-1)), F.lit(2)), F.lit(missing))

    values = {name: label(char, missing) for char, (name, missing) in _FILE_LABELS.items()}
    return lines.select(
        *keep,
        F.substr(F.col("head")[1], F.lit(2)).alias("command"),
        F.regexp_replace(F.col("head")[0], "p", "").cast("bigint").alias("pid"),
        F.substr(F.col("head")[2], F.lit(2)).cast("int").alias("uid"),
        F.col("lines")[0].alias("fd"),
        values["type"].alias("type"),
        values["device"].alias("device"),
        values["size"].cast("bigint").alias("size"),
        values["node"].alias("node"),
        values["name"].alias("name"),
        "created_at",
    )


def is_network_file(file_type: Column) -> Column:
    return F.upper(file_type).isin(*NETWORK_TYPES)


def open_files_by_class(regular: DataFrame, network: DataFrame, file_class: str) -> DataFrame:
    """Rows of the regular feed, of the network feed, or of both."""
    if file_class == "regular":
        return regular
    if file_class == "network":
        return network
    if file_class == "all":
        return network.unionByName(regular)
    raise ValueError(f"unknown open-file class {file_class!r}")
