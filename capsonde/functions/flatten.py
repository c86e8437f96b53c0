"""JSON values as plain text, per top-level field of a row.

Strings and lists of strings, which nearly all fields are, are read by column expressions. Only
values that hold objects or nested lists, where key order decides the text, go to a small Python
helper, as raw JSON.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How many entries of a list or mapping are read, and how deep mappings go.
MAX_ITEMS = 8
MAX_DEPTH = 2

STRICT = {"mode": "FAILFAST"}


class Label:
    """Text before the first leaf beneath it that says anything."""

    def __init__(self, text: str):
        self.text = text

    def use(self) -> str:
        text, self.text = self.text, ""
        return text


def leaves_text(value) -> str:
    """The texts of a nested value's leaves, a line each, behind labels that are still unused.

    An entry's key labels its first leaf; an entry without text leaves no trace. A message, an
    object with a role or content, always shows its role.
    """
    lines: list[str] = []
    todo: list[tuple] = [(value, 0, [])]
    while todo:
        node, depth, labels = todo.pop()
        if node is Label:  # a message ends here
            if labels[-1].text:
                lines.append("".join(x.use() for x in labels))
        elif isinstance(node, str):
            if node:
                lines.append("".join(x.use() for x in labels) + node)
        elif isinstance(node, list):
            todo += [(x, depth + 1, labels) for x in reversed(node[:MAX_ITEMS])]
        elif isinstance(node, dict) and depth < MAX_DEPTH:
            if "role" in node or "content" in node:
                under = [*labels, Label(f"{node.get('role', '')}: ")]
                todo += [(Label, 0, under), (node.get("content", ""), depth + 1, under)]
            else:
                entries = list(node.items())[:MAX_ITEMS]
                todo += [(x, depth + 1, [*labels, Label(f"{k}: ")]) for k, x in reversed(entries)]
    return "\n".join(lines)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_texts(values: pd.Series) -> pd.Series:
    return values.map(lambda raws: [None if r is None else leaves_text(json.loads(r)) for r in raws])


def flatten_row(row: Column | str) -> Column:
    """Fields of a JSON object in key order, each as text: array<struct<key, text>>."""
    row = F.col(row) if isinstance(row, str) else row
    raw = F.from_json(row, "map<string,string>", STRICT)
    typed = F.map_entries(F.from_json(row, "map<string,variant>", STRICT))

    def plain(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        items = F.slice(F.try_variant_get(e["value"], "$", "array<string>"), 1, MAX_ITEMS)
        return F.when(kind == "STRING", F.try_variant_get(e["value"], "$", "string")).when(
            kind == "ARRAY<STRING>", F.array_join(F.filter(items, lambda x: x != ""), "\n"))

    def nested(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        deep = kind.startswith("OBJECT") | (kind.startswith("ARRAY") & (kind != "ARRAY<STRING>"))
        return F.when(deep, F.element_at(raw, e["key"]))

    deep = nested_texts(F.transform(typed, nested))
    return F.zip_with(typed, deep, lambda e, d: F.struct(
        e["key"].alias("key"), F.coalesce(plain(e), d, F.lit("")).alias("text")))


def field_text(fields: Column, key: Column) -> Column:
    """Text of one field, empty when the row lacks it."""
    hit = F.get(F.filter(fields, lambda f: f["key"] == key), F.lit(0))
    return F.coalesce(hit["text"], F.lit(""))
