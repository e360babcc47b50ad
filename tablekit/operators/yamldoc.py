"""YAML documents: everything goes through JSON text, which has all operators."""

from __future__ import annotations

import io
import json
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.coerce import col
from tablekit.operators import jsondoc, jsonedit, xmldoc
from tablekit.sources.documents import YAML, remembered_tags, yaml_to_json

to_json = yaml_to_json


def from_json(c: Column, flow: bool = False) -> Column:
    """YAML text of a JSON text; ``flow`` gives the one-line form."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import yaml

        base = getattr(yaml, "CSafeDumper", yaml.SafeDumper)

        class Dumper(base):
            pass

        Dumper.resolve = remembered_tags(Dumper)

        def node(dumper: Any, value: Any) -> Any:
            # What the safe representer makes of JSON values, which never share a part.
            if isinstance(value, dict):
                pairs = [(node(dumper, k), node(dumper, v)) for k, v in value.items()]
                return yaml.MappingNode(YAML + "map", pairs, flow_style=flow)
            if isinstance(value, list):
                return yaml.SequenceNode(YAML + "seq", [node(dumper, v) for v in value], flow_style=flow)
            if isinstance(value, str):
                return yaml.ScalarNode(YAML + "str", value)
            if isinstance(value, float):
                return dumper.represent_float(value)
            if value is None:
                return yaml.ScalarNode(YAML + "null", "null")
            if isinstance(value, bool):
                return yaml.ScalarNode(YAML + "bool", "true" if value else "false")
            return yaml.ScalarNode(YAML + "int", str(value))

        def one(text):
            if text is None:
                return None
            try:
                value = json.loads(text)
            except ValueError:
                return None
            out = io.StringIO()
            dumper = Dumper(out, allow_unicode=True, default_flow_style=flow, width=2**30 if flow else 80, sort_keys=False)
            try:
                dumper.open()
                dumper.serialize(node(dumper, value))
                dumper.close()
            finally:
                dumper.dispose()
            return out.getvalue().strip()

        return texts.map(one)

    return run.asNondeterministic()(c)


def minify(c: Column) -> Column:
    return from_json(to_json(c), flow=True)


def get(c: Column, path: str, default: Any = None) -> Column:
    return jsondoc.get(F.try_parse_json(to_json(c)), path, default)


def set_value(c: Column, path: str, value: Any) -> Column:
    return from_json(jsonedit.set_value(to_json(c), path, value))


def remove(c: Column, path: str) -> Column:
    return from_json(jsonedit.delete_value(to_json(c), path))


def sort_keys(c: Column, reverse: bool = False) -> Column:
    return from_json(jsonedit.sort_keys(to_json(c), reverse))


def reorder_keys(c: Column, order: Sequence[str]) -> Column:
    return from_json(jsonedit.reorder_keys(to_json(c), order))


def merge(a: Column, b: Column) -> Column:
    return from_json(jsonedit.deep_merge(to_json(a), to_json(b)))


def to_xml(c: Column) -> Column:
    return xmldoc.from_json(to_json(c))


def clean(c: Column, remove_empty: bool = False) -> Column:
    """Without nulls, and without empty values if asked."""
    return from_json(jsonedit.clean_json(to_json(c), strip_nulls=True, strip_empty=remove_empty))


def strip_comments(c: Column) -> Column:
    """Without comment lines and without comments behind a value."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda s: ~F.trim(s).startswith("#"))
    bare = F.transform(lines, lambda s: F.when(s.contains(" #"), F.rtrim(F.substring_index(s, " #", 1))).otherwise(s))
    return F.array_join(F.filter(bare, lambda s: F.trim(s) != ""), "\n")


def _as_json(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, to_json(col(name)))


def diff(a: DataFrame, b: DataFrame, doc: Sequence[str], name: str = "yaml") -> DataFrame:
    return jsondoc.json_diff(_as_json(a, name), _as_json(b, name), doc, name)


def profile(df: DataFrame, doc: Sequence[str], name: str = "yaml") -> DataFrame:
    return jsondoc.document_metrics(_as_json(df, name), name, doc)


def schema_paths(df: DataFrame, name: str = "yaml") -> DataFrame:
    return jsondoc.schema_paths(_as_json(df, name), name)
