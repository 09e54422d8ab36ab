"""Table metadata as XML (VODataService tableset)."""

from __future__ import annotations

from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from aquila.sources.catalog import Catalog, Column, ForeignKey, Table
from aquila.sources.votable import field_attributes, field_type


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element, name: str) -> str | None:
    for child in e:
        if _local(child) == name:
            return (child.text or "").strip() or None
    return None


def _type(e: ElementTree.Element | None) -> tuple[str, int | None]:
    if e is None:
        return "UNKNOWN", None
    word = (e.text or "").strip()
    size = e.get("size") or e.get("arraysize")
    kind = next((v for k, v in e.attrib.items() if k.endswith("type") and k != "xtype"), "")
    if kind.endswith("VOTableType"):
        type_ = field_type(word, e.get("arraysize"), e.get("xtype"))
    else:
        type_ = word.upper().removeprefix("ADQL:")
    return type_, int(size) if size and size.isdigit() else None


def read_tableset(source: bytes | str) -> Catalog:
    """Schemas, tables, columns and foreign keys. Tables have no rows until a DataFrame is bound to them."""
    root = ElementTree.fromstring(source)
    if _local(root) != "tableset":
        raise ValueError(f"a tableset was expected, not {_local(root)}")
    out = Catalog()
    for s in (x for x in root if _local(x) == "schema"):
        schema = _text(s, "name")
        if not schema:
            raise ValueError("a schema has no name")
        out.schemas[schema] = {"description": _text(s, "description"), "utype": _text(s, "utype")}
        for t in (x for x in s if _local(x) == "table"):
            name = _text(t, "name")
            if not name:
                raise ValueError(f"a table of {schema} has no name")
            columns = []
            for c in (x for x in t if _local(x) == "column"):
                type_, length = _type(next((x for x in c if _local(x) == "dataType"), None))
                flags = {(f.text or "").strip().lower() for f in c if _local(f) == "flag"}
                columns.append(Column(_text(c, "name") or "", type_, description=_text(c, "description"), unit=_text(c, "unit"), ucd=_text(c, "ucd"), utype=_text(c, "utype"), length=length, indexed="indexed" in flags, principal="principal" in flags, std=c.get("std", "").lower() in ("1", "true")))
            table = Table(name.removeprefix(f"{schema}."), columns, schema, kind=t.get("type") or "table", description=_text(t, "description"), utype=_text(t, "utype"))
            out.tables.append(table)
            for i, k in enumerate((x for x in t if _local(x) == "foreignKey"), 1):
                pairs = [(_text(p, "fromColumn") or "", _text(p, "targetColumn") or "") for p in k if _local(p) == "fkColumn"]
                out.keys.append(ForeignKey(f"{schema}.{table.name}.{i}", f"{schema}.{table.name}", _text(k, "targetTable") or "", pairs, _text(k, "description"), _text(k, "utype")))
    return out


def write_tableset(catalog: Catalog) -> str:
    one = lambda name, value: f"<{name}>{escape(value)}</{name}>" if value else ""
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<vosi:tableset xmlns:vosi="http://www.ivoa.net/xml/VOSITables/v1.0" xmlns:vod="http://www.ivoa.net/xml/VODataService/v1.1" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">']
    for schema in dict.fromkeys(t.schema or "default" for t in catalog.tables):
        more = catalog.schemas.get(schema, {})
        lines.append(f"<schema>{one('name', schema)}{one('description', more.get('description'))}{one('utype', more.get('utype'))}")
        for t in (t for t in catalog.tables if (t.schema or "default") == schema):
            lines.append(f"<table type={quoteattr(t.kind)}>{one('name', '.'.join(x for x in (t.schema, t.name) if x))}{one('description', t.description)}{one('utype', t.utype)}")
            for c in t.columns:
                flags = "".join(one("flag", f) for f in ("indexed", "principal") if getattr(c, f))
                word = field_attributes(c.type).partition('datatype="')[2]
                kind, _, rest = word.partition('"')
                lines.append(f'<column std="{str(c.std).lower()}">{one("name", c.name)}{one("description", c.description)}{one("unit", c.unit)}{one("ucd", c.ucd)}{one("utype", c.utype)}<dataType xsi:type="vod:VOTableType"{rest}>{kind}</dataType>{flags}</column>')
            for k in (k for k in catalog.keys if k.from_table == ".".join(x for x in (t.schema, t.name) if x)):
                pairs = "".join(f"<fkColumn>{one('fromColumn', a)}{one('targetColumn', b)}</fkColumn>" for a, b in k.columns)
                lines.append(f"<foreignKey>{one('targetTable', k.target_table)}{pairs}{one('description', k.description)}{one('utype', k.utype)}</foreignKey>")
            lines.append("</table>")
        lines.append("</schema>")
    return "\n".join([*lines, "</vosi:tableset>", ""])
