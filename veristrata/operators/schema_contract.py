"""JSON Schema files compiled to one error column over JSON text.

``errors`` turns a schema into an expression: every record becomes an array of
``place: keyword`` texts, empty where the record keeps the contract.  The engine's variant
type carries the parsed record, so a contract of any depth is one projection without a
parser of our own, and a table is checked in one pass.

Keywords: type, enum, const, required, properties, additionalProperties, patternProperties,
propertyNames, items, minItems, maxItems, uniqueItems, minLength, maxLength, pattern,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, allOf, anyOf, oneOf, not, if / then /
else, and local $ref.  Notes for readers are skipped; any other keyword is an error when
the schema is compiled, as is a $ref that leads back to itself.

Defined results: a null text is ``$: no record``; text that is no JSON (repeated keys
included) is ``$: not JSON``; items of an array share a place, ``name[]``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
_KNOWN = {
    "$ref", "type", "enum", "const", "required", "properties", "additionalProperties", "patternProperties", "propertyNames", "items", "minItems", "maxItems", "uniqueItems", "minLength",
    "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
}
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _none() -> Column:
    return F.array().cast("array<string>")


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _child(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$[" + json.dumps(name, ensure_ascii=False) + "]", "variant")


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda key: key.rlike(pattern)


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def resolve(self, schema: dict, trail: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
        while "$ref" in schema:
            ref = schema["$ref"]
            if ref in trail:
                raise ValueError(f"$ref leads back to itself: {ref}")
            if not ref.startswith("#"):
                raise ValueError(f"only local references are followed: {ref}")
            trail = (*trail, ref)
            found = self.root
            for part in [p for p in ref[1:].split("/") if p]:
                found = found[part.replace("~1", "/").replace("~0", "~")]
            schema = {**found, **{k: v for k, v in schema.items() if k != "$ref"}}
        return schema, trail

    def _values(self, part: dict | bool, at: str, trail: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda entry: self.errors(part, entry["value"], f"{at}.*", trail)

    def errors(self, schema: dict | bool, v: Column, at: str, trail: tuple[str, ...] = ()) -> Column:
        """Errors of a value that is there, as array<string>."""
        if isinstance(schema, bool):
            return _none() if schema else F.array(F.lit(f"{at}: not allowed"))
        schema, trail = self.resolve(schema, trail)
        if odd := sorted(set(schema) - _KNOWN - _NOTES):
            raise ValueError(f"keywords that are not compiled: {', '.join(odd)}")
        kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
        number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        items, size = F.try_variant_get(v, "$", "array<variant>"), F.size(F.try_variant_get(v, "$", "array<variant>"))
        is_number, is_text, is_array, is_object = kind.isin(*_NUMBERS), kind == "STRING", kind == "ARRAY", kind == "OBJECT"
        matches = {
            "object": is_object, "array": is_array, "string": is_text, "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": is_number, "integer": is_number & (F.floor(number) == number),
        }
        one: list[Column] = []  # each an error text or null
        many: list[Column] = []  # each an array of error texts

        def wrong(keyword: str, bad: Column) -> None:
            one.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{at}: {keyword}")))

        def fits(part: dict | bool) -> Column:
            return F.size(self.errors(part, v, at, trail)) == 0

        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            ok = F.lit(False)
            for k in kinds:
                ok = ok | matches[k]
            wrong("type", ~ok)
        for keyword, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if values is not None:
                texts = [x for x in values if isinstance(x, str)]
                others = [_json(x) for x in values if not isinstance(x, str)]
                ok = is_text & text.isin(*texts) if texts else F.lit(False)
                wrong(keyword, ~(ok | (~is_text & F.to_json(v).isin(*others)) if others else ok))
        length = F.length(text)
        for keyword, when, bad in (
            ("minLength", is_text, lambda n: length < n), ("maxLength", is_text, lambda n: length > n), ("pattern", is_text, lambda p: ~text.rlike(p)),
            ("minimum", is_number, lambda n: number < n), ("maximum", is_number, lambda n: number > n), ("exclusiveMinimum", is_number, lambda n: number <= n),
            ("exclusiveMaximum", is_number, lambda n: number >= n), ("minItems", is_array, lambda n: size < n), ("maxItems", is_array, lambda n: size > n),
            ("uniqueItems", is_array, lambda b: F.lit(bool(b)) & (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < size)),
        ):
            if keyword in schema:
                wrong(keyword, when & bad(schema[keyword]))
        for name in schema.get("required", []):
            one.append(F.when(is_object & _child(v, name).isNull(), F.lit(f"{at}.{name}: required")))
        named = schema.get("properties", {})
        for name, part in named.items():
            c = _child(v, name)
            many.append(F.when(c.isNotNull(), self.errors(part, c, f"{at}.{name}", trail)))
        patterns, rest = schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        if patterns or rest is not True or "propertyNames" in schema:
            entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))

            def each(keep: Callable[[Column], Column], found: Callable[[Column], Column]) -> None:
                many.append(F.flatten(F.transform(F.filter(entries, lambda e: keep(e["key"])), found)))

            for pattern, part in patterns.items():
                each(_like(pattern), self._values(part, at, trail))
            if rest is not True:
                extra = lambda k: ~(k.isin(*named) if named else F.lit(False)) & ~F.greatest(F.lit(False), F.lit(False), *[k.rlike(p) for p in patterns])
                what = (lambda e: F.array(F.concat(F.lit(f"{at}."), e["key"], F.lit(": additionalProperties")))) if rest is False else self._values(rest, at, trail)
                each(extra, what)
            if (named_as := schema.get("propertyNames")) is not None:
                if set(named_as) - {"pattern", "minLength", "maxLength", "enum", "type", *_NOTES}:
                    raise ValueError("propertyNames: only pattern, lengths and enum are compiled")
                bad = lambda k: F.greatest(
                    F.lit(False), F.lit(False), *([~k.rlike(named_as["pattern"])] if "pattern" in named_as else []), *([F.length(k) < named_as["minLength"]] if "minLength" in named_as else []),
                    *([F.length(k) > named_as["maxLength"]] if "maxLength" in named_as else []), *([~k.isin(*named_as["enum"])] if "enum" in named_as else []),
                )
                each(bad, lambda e: F.array(F.concat(F.lit(f"{at}."), e["key"], F.lit(": propertyNames"))))
        if (part := schema.get("items", True)) is not True:
            many.append(F.flatten(F.transform(items, lambda x: self.errors(part, x, f"{at}[]", trail))))
        many += [self.errors(part, v, at, trail) for part in schema.get("allOf", [])]
        if "anyOf" in schema:
            wrong("anyOf", ~F.greatest(F.lit(False), F.lit(False), *[fits(p) for p in schema["anyOf"]]))
        if "oneOf" in schema:
            wrong("oneOf", sum((fits(p).cast("int") for p in schema["oneOf"]), F.lit(0)) != 1)
        if "not" in schema:
            wrong("not", fits(schema["not"]))
        if "if" in schema:
            then, other = (self.errors(schema.get(k, True), v, at, trail) for k in ("then", "else"))
            many.append(F.when(fits(schema["if"]), then).otherwise(other))
        parts = ([F.array_compact(F.array(*one))] if one else []) + [F.coalesce(m, _none()) for m in many]
        return F.concat(_none(), *parts) if parts else _none()


def errors(record: Column, schema: dict) -> Column:
    """Errors of a JSON text against a schema, sorted and once each; an empty array where it keeps it."""
    v = F.try_parse_json(record)
    found = F.when(record.isNull(), F.array(F.lit("$: no record"))).when(v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_Compiler(schema).errors(schema, v, "$"))
    return F.array_sort(F.array_distinct(found))


def read_schema(spark: SparkSession, path: str) -> dict:
    """A schema file, from whatever store Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).head()[0])


def violations(records: DataFrame, key: str, record: str, schema: dict) -> DataFrame:
    """(check, key): one row an error, as the other checks give them."""
    found = records.select(F.col(key).cast("string").alias("key"), F.explode(errors(F.col(record), schema)).alias("check"))
    return found.select("check", "key")


def report(records: DataFrame, record: str, schema: dict, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, n_valid, n_errors) in one pass."""
    e = records.select(*(keys or []), F.size(errors(F.col(record), schema)).alias("_n"))
    return e.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if(F.col("_n") == 0).alias("n_valid"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_errors"))
