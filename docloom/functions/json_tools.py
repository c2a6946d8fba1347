"""JSON that models wrote, and schemas: repair, coercion, paths, compilation.

Plain functions of one value; `salvaged` runs the repair over a column, in Arrow batches and only
for texts that do not parse as they are.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of typed blocks and fields of every compiled record.
TYPED = {
    "PinAssignment": T.StructType([T.StructField(n, T.StringType()) for n in ("pin", "signal", "wire_color", "description")]),
    "LEDBehavior": T.StructType([T.StructField(n, T.StringType()) for n in ("led_name", "color", "state", "meaning")]),
    "TechParameter": T.StructType([T.StructField(n, T.StringType()) for n in ("name", "value", "unit", "conditions")]),
}
COMMERCIAL = {"currency", "amount", "price", "total"}
SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
EVIDENCE = T.StructType([T.StructField("text_snippet", T.StringType()), T.StructField("page_number", T.LongType()), T.StructField("confidence", T.DoubleType())])


def _loads(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def unfenced(text: str) -> str:
    """What stands in a code fence, or the whole text."""
    m = re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", text, re.DOTALL)
    return m[1].strip() if m else text.strip()


def salvage(text: str | None) -> dict | None:
    """The JSON object in a model's answer: fences off, outermost braces, then milder and milder repairs."""
    if not text:
        return None
    raw = unfenced(text)
    begin = raw.find("{")
    if begin < 0:
        return None
    body = raw[begin:]
    end = body.rfind("}")
    whole = body[: end + 1] if end >= 0 else body
    bare = re.sub(r",\s*([\]}])", r"\1", body)
    for tried in (whole, re.sub(r",\s*([\]}])", r"\1", whole), bare, *(bare + "}" * n for n in range(1, 11)), *(closed(bare),)):
        found = _loads(tried)
        if isinstance(found, dict):
            return found
    return None


def closed(text: str) -> str:
    """A cut-off JSON text with its open strings, lists and objects closed."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted, escaped = True, False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    out = text + '"' * quoted
    return re.sub(r"[,:]\s*\Z", "", out.rstrip()) + "".join(reversed(stack))


def last_object(text: str | None) -> dict | None:
    """The last object of a text that parses and is no schema; line comments are dropped."""
    if not text:
        return None
    raw = re.sub(r"(?m)(?<!:)//[^\n]*$", "", unfenced(text))
    found, depth, begin = None, 0, 0
    for i, c in enumerate(raw):
        if c == "{":
            begin = i if depth == 0 else begin
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0 and isinstance(x := _loads(raw[begin : i + 1]), dict) and not {"properties", "$defs"} & set(x):
                found = x
    return found


@F.pandas_udf(T.StringType())
def _salvaged(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (x := salvage(t)) is None else json.dumps(x, sort_keys=True))


def salvaged(text: Column) -> Column:
    """JSON text of the object in an answer, or null; answers that parse are passed on in the JVM."""
    return F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), text).otherwise(_salvaged(text))


def get(record: Any, path: str) -> Any:
    """The value at a.b[0].c or a.0.c, or None."""
    for part in path.replace("[", ".").replace("]", "").split("."):
        if isinstance(record, dict):
            record = record.get(part)
        elif isinstance(record, list) and part.lstrip("-").isdigit() and -len(record) <= int(part) < len(record):
            record = record[int(part)]
        else:
            return None
    return record


def put(record: dict, path: str, value: Any) -> bool:
    """Set a value at a path, making objects on the way; lists do not grow. Whether it was set."""
    parts = path.replace("[", ".").replace("]", "").split(".")
    for part, after in zip(parts, parts[1:]):  # noqa: B905
        if isinstance(record, list):
            if not part.isdigit() or int(part) >= len(record):
                return False
            record = record[int(part)]
        else:
            if record.get(part) is None:
                if after.isdigit():
                    return False
                record[part] = {}
            record = record[part]
        if not isinstance(record, (dict, list)):
            return False
    if isinstance(record, list):
        if not parts[-1].isdigit() or int(parts[-1]) >= len(record):
            return False
        record[int(parts[-1])] = value
    else:
        record[parts[-1]] = value
    return True


def leaves(record: Any, path: str = "") -> list[tuple[str, Any]]:
    """(path, value) of all leaves, in order."""
    if isinstance(record, dict):
        return [x for k, v in record.items() for x in leaves(v, f"{path}.{k}" if path else k)]
    if isinstance(record, list):
        return [x for i, v in enumerate(record) for x in leaves(v, f"{path}[{i}]")]
    return [(path, record)]


#: Other names that models give to fields.
SYNONYMS = {
    "art_no": ("article_number", "article_no", "part_number", "order_no"), "product_name": ("name", "title", "product"), "manufacturer": ("vendor", "maker", "brand"), "quote_no": ("quotation_number", "quote_number"),
    "parameters": ("specs", "specifications", "technical_data"), "connectors": ("ports", "interfaces"), "standards": ("certifications", "norms"), "summary": ("description", "abstract"),
}


def renamed(record: dict, fields: list[str], synonyms: dict[str, tuple[str, ...]] | None = None) -> dict:
    """A record's keys as the schema names them: the same but for case and underscores, else a synonym's. First come, first kept."""
    squeeze = lambda n: re.sub(r"[^a-z0-9]", "", n.lower())
    known = {squeeze(f): f for f in fields}
    for name, others in (SYNONYMS if synonyms is None else synonyms).items():
        if name in fields:
            for other in others:
                known.setdefault(squeeze(other), name)
    out: dict = {}
    for k, v in record.items():
        out.setdefault(known.get(squeeze(str(k)), k), v)
    return out


def around(source: str, path: str, value: Any = None, reach: int = 400, most: int = 12_000) -> str:
    """The part of a source about a value, where its letter triples are densest; else about its field's label; else the beginning."""
    if len(source) <= 2 * reach:
        return source[:most]
    low, places = source.lower(), []
    if isinstance(value, str) and len(value.strip()) >= 3:
        v = value.strip().lower()
        triples = [v[i : i + 3] for i in range(len(v) - 2)]
        starts = [i for t in triples[:: max(1, len(v) // 6)] if t.strip() for i in _places(low, t)]
        near = lambda i: sum(t in low[max(0, i - 30) : i + len(v) + 30] for t in triples)
        places = [max(sorted(set(starts)), key=near)] if starts else []
    name = re.escape(path.split(".")[-1].split("[")[0])
    for pattern in (rf"\b{name}\s*[:\-]", rf"\b{name.replace('_', ' ')}\s*[:\-]", rf"\b{name}\b"):
        if not places and len(name) >= 2:
            places = [m.start() for m in re.finditer(pattern, source, re.IGNORECASE)][:2]
    parts = {(max(0, p - reach) // 100, min(len(source), p + reach) // 100): source[max(0, p - reach) : p + reach] for p in reversed(sorted(places))}
    return "\n...\n".join(parts[k] for k in sorted(parts))[:most] if parts else source[:most]


def _places(text: str, part: str) -> list[int]:
    return [m.start() for m in re.finditer(f"(?={re.escape(part)})", text)]


def hint(kind: T.StructType, prefix: str = "") -> str:
    """A schema's fields for a prompt, a line each: path, type and description."""
    lines = []
    for f in kind.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        said = (f.metadata or {}).get("description")
        if isinstance(f.dataType, T.StructType):
            lines.append(hint(f.dataType, path))
        else:
            lines.append(f"{path}: {f.dataType.simpleString()}" + (f" - {said}" if said else ""))
    return "\n".join(x for x in lines if x)


def snapshot(record: dict, path: str, most: int = 2000) -> str:
    """A record as JSON with one field marked to be found, and long lists cut."""
    copy = json.loads(json.dumps(record))
    put(copy, path, "<TO_FIND>")

    def short(x: Any) -> Any:
        if isinstance(x, list):
            return [short(v) for v in x[:2]] + ([f"... {len(x) - 2} more"] if len(x) > 2 else [])
        return {k: short(v) for k, v in x.items()} if isinstance(x, dict) else x

    return json.dumps(short(copy), ensure_ascii=False)[:most]


def dereferenced(schema: Any, root: dict | None = None, seen: tuple[str, ...] = ()) -> Any:
    """A schema with its references put in; a reference within itself becomes an open object."""
    root = schema if root is None else root
    if isinstance(schema, list):
        return [dereferenced(x, root, seen) for x in schema]
    if not isinstance(schema, dict):
        return schema
    ref = schema.get("$ref")
    if isinstance(ref, str):
        if ref in seen:
            return {"type": "object"}
        target: Any = root
        for part in ref.lstrip("#/").split("/"):
            target = target.get(part, {}) if isinstance(target, dict) else {}
        return dereferenced(target, root, (*seen, ref))
    return {k: dereferenced(v, root, seen) for k, v in schema.items() if k not in ("$defs", "definitions")}


def example(schema: dict) -> Any:
    """A value of a schema's shape."""
    kind = kind_of(schema)
    if kind == "object":
        return {k: example(v) for k, v in (schema.get("properties") or {}).items()}
    if kind == "array":
        return [example(schema.get("items") or {"type": "string"})]
    return {"integer": 0, "number": 0.0, "boolean": False}.get(kind, "...")


def default(schema: dict) -> Any:
    return {"array": [], "object": {}, "boolean": None, "integer": None, "number": None}.get(kind_of(schema))


def kind_of(schema: Any) -> str:
    """The type of a schema; of a union the first that is not null."""
    kind = schema.get("type") if isinstance(schema, dict) else None
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "string")
    if kind is None and isinstance(schema, dict):
        options = [o for o in schema.get("anyOf", []) if isinstance(o, dict) and o.get("type") != "null"]
        kind = kind_of(options[0]) if options else "object" if "properties" in schema else "string"
    return kind if kind in (*SCALARS, "array", "object") else "string"


def coerced(value: Any, schema: Any) -> Any:
    """A value made to fit: lists joined or cut to their first, scalars put in lists, null lists emptied."""
    kind = kind_of(schema)
    if kind == "array":
        items = schema.get("items") or {}
        return [] if value is None else [coerced(v, items) for v in value] if isinstance(value, list) else [coerced(value, items)]
    if kind == "object":
        props = schema.get("properties") or {}
        return {k: coerced(v, props[k]) if k in props else v for k, v in value.items()} if isinstance(value, dict) else value
    if isinstance(value, list):
        if kind == "string":
            return ", ".join(str(v) for v in value)
        value = value[0] if value else None
    return value


def typed_block(items: dict) -> str | None:
    """The typed block that a list's items are, by their keys."""
    keys = {str(k).lower() for k in (items.get("properties") or {})}
    if kind_of(items) != "object" or not keys:
        return None
    if {"pin", "signal"} <= keys:
        return "PinAssignment"
    if {"state", "meaning"} <= keys:
        return "LEDBehavior"
    if "pins" in keys:
        return "ConnectorSpec"
    return "TechParameter" if {"name", "value"} <= keys and not keys & COMMERCIAL else None


def tidy(schema: Any) -> dict:
    """A property that a model proposed loosely: a type's name, a list, or nothing of use."""
    if isinstance(schema, dict):
        return schema
    if isinstance(schema, str) and schema in (*SCALARS, "array", "object"):
        return {"type": schema}
    return {"type": "array", "items": {"type": "string"}} if isinstance(schema, list) else {"type": "string"}


def data_type(schema: Any, blocks: bool = True) -> T.DataType:
    """The Spark type of a JSON schema; every field may be null."""
    schema = tidy(schema)
    kind = kind_of(schema)
    if kind == "array":
        items = schema.get("items")
        items = tidy(items[0] if isinstance(items, list) and items else items)
        block = typed_block(items) if blocks else None
        if block == "ConnectorSpec":
            return T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("pins", T.ArrayType(TYPED["PinAssignment"]))]))
        return T.ArrayType(TYPED[block] if block else data_type(items, blocks))
    if kind == "object":
        props = schema.get("properties")
        if not isinstance(props, dict) or not props:
            return T.MapType(T.StringType(), T.StringType())
        return T.StructType([T.StructField(str(k), data_type(v, blocks), True, {"description": v["description"]} if isinstance(v, dict) and "description" in v else None) for k, v in props.items()])
    return SCALARS[kind]


def compiled(schema: dict, discovered: bool = True) -> T.StructType:
    """A record's type: the schema's fields and the bookkeeping ones."""
    body = data_type(dereferenced(schema) | {"type": "object"})
    fields = list(body.fields) if isinstance(body, T.StructType) else []
    extra = [T.StructField("reasoning_thoughts", T.StringType()), T.StructField("page_references", T.ArrayType(T.LongType()))]
    extra += [T.StructField("source_evidence", T.ArrayType(EVIDENCE))] if discovered else []
    extra.append(T.StructField("confidence_score", T.DoubleType()))
    names = {f.name for f in fields}
    return T.StructType(fields + [f for f in extra if f.name not in names])


def string_paths(kind: T.StructType, prefix: str = "") -> list[str]:
    """Paths of text leaves outside lists and bookkeeping fields."""
    skip = {"reasoning_thoughts", "page_references", "source_evidence", "confidence_score"}
    out: list[str] = []
    for f in kind.fields:
        if f.name in skip:
            continue
        path = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StringType):
            out.append(path)
        elif isinstance(f.dataType, T.StructType):
            out += string_paths(f.dataType, path)
    return out


def field_names(schema: Any) -> set[str]:
    """All property names of a schema, lower-cased."""
    if not isinstance(schema, dict):
        return set()
    props = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    return {str(k).lower() for k in props} | {n for v in props.values() for n in field_names(v)} | field_names(schema.get("items"))
