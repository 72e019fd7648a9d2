"""The inventory tables and request batches, derived from the generated parquet tables.

Each mapping is a list of SQL expressions that Spark and DuckDB both read, so
the checks of ``plans/oracle.py`` start from the same rows. Every mapping uses
its source table whole.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from stockroom.schemas import REQUESTS, TABLES
from stockroom.sources.tables import Tables

_SOURCE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
}


def _padded(prefix: str, number: str) -> str:
    return f"concat('{prefix}', lpad(cast({number} as string), 9, '0'))"


def _numbered(prefix: str, number: str, suffix: str = "") -> str:
    tail = f", '{suffix}'" if suffix else ""
    return f"concat('{prefix}', cast({number} as string){tail})"


_SERIAL = _padded("SN", "o_orderkey")
_BARCODE = f"concat('INV-', upper(substr(md5({_SERIAL}), 1, 8)), '-', substr({_SERIAL}, 1, 8))"

#: name -> (source table, {column: expression})
TABLE_MAPPINGS: dict[str, tuple[str, dict[str, str]]] = {
    "producto": (
        "customer",
        {
            "id_producto": "c_custkey",
            "codigo_original": "c_name",
            "nombre": "c_name",
            "descripcion": "c_mktsegment",
            "id_dron": "cast(c_nationkey as bigint)",
            "stock_minimo": "cast(c_custkey % 8 as int)",
        },
    ),
    "dron": ("nation", {"id": "cast(n_nationkey as bigint)", "nombre": "n_name"}),
    "usuario": (
        "supplier",
        {
            "id_usuario": "s_suppkey",
            "nombre_usuario": "s_name",
            "nombre_completo": "concat(s_name, ' N')",
            "email": _numbered("user", "s_suppkey", "@example.com"),
            "rol": (
                "case s_suppkey % 4 when 0 then 'Admin' when 1 then 'Operario' "
                "when 2 then 'admin' else 'salida' end"
            ),
            "activo": "s_suppkey % 5 <> 0",
            "ultimo_login": "cast(null as timestamp)",
        },
    ),
    "pieza": (
        "orders",
        {
            "id_pieza": "o_orderkey",
            "id_producto": "o_custkey",
            "numero_serie": _SERIAL,
            "codigo_barras": _BARCODE,
            "estado": (
                "case o_orderstatus when 'O' then 'disponible' when 'F' then 'en_venta' "
                "else 'almacenado' end"
            ),
            "id_usuario": "o_orderkey % 120",
            "caja": "o_orderpriority",
            "fecha_registro": "o_orderdate",
        },
    ),
}

REQUEST_MAPPINGS: dict[str, tuple[str, dict[str, str]]] = {
    "scan": (
        "orders",
        {
            "seq": "o_orderkey",
            "codigo": (
                f"case o_orderkey % 4 when 0 then {_BARCODE} when 1 then {_SERIAL} "
                f"when 2 then {_padded('Customer#', 'o_custkey')} "
                f"else {_numbered('X-', 'o_orderkey')} end"
            ),
        },
    ),
    "register": (
        "events",
        {
            "seq": "event_id",
            "ts": "ts",
            "codigo_original": (
                f"case when event_id % 3 = 0 then {_padded('Customer#', 'user_id')} "
                f"else {_numbered('NEW-', 'user_id')} end"
            ),
            "numero_serie": (
                f"case when event_id % 7 = 0 then {_padded('SN', 'event_id')} "
                "else concat('SN9', lpad(cast((event_id * 7919) % 6007 as string), 8, '0')) end"
            ),
            "nombre_producto": (
                "case when user_id % 10 = 0 or event_id % 5 = 0 then cast(null as string) "
                f"when event_id % 5 = 1 then '' else {_numbered('Producto ', 'user_id')} end"
            ),
            "descripcion_producto": "cast(null as string)",
            "id_dron": "cast(user_id % 25 as bigint)",
            "caja": _numbered("Caja ", "event_id % 12"),
            "id_usuario": "event_id % 120",
        },
    ),
    "status": (
        "events",
        {
            "seq": "event_id",
            "ts": "ts",
            "id_pieza": "user_id * 101",
            "nuevo_estado": (
                "case event_type when 'click' then 'disponible' when 'view' then 'en_venta' "
                "when 'purchase' then 'en_garantia' when 'error' then 'en_reparacion' "
                "else 'almacenado' end"
            ),
            "id_usuario": "event_id % 120",
            "observaciones": f"case when event_id % 3 = 0 then '' else {_numbered(' obs ', 'event_id', ' ')} end",
        },
    ),
    "checkout": (
        "events",
        {
            "seq": "event_id",
            "ts": "ts",
            "id_pieza": "user_id * 101",
            "id_usuario": "event_id % 130",
            "observaciones": "''",
        },
    ),
    "create_user": (
        "events",
        {
            "seq": "event_id",
            "nombre_usuario": (
                f"case when event_id % 23 = 0 then {_padded('Supplier#', 'user_id % 10')} "
                f"else {_numbered('u', '(event_id * 7919) % 1009 % 150')} end"
            ),
            "email": (
                "case when event_id % 9 = 0 then 'bad@x' "
                f"else {_numbered('e', '(event_id * 6131) % 1013 % 160', '@example.com')} end"
            ),
            "nombre_completo": _numbered("N ", "(event_id * 4561) % 1019 % 170"),
        },
    ),
    "login": (
        "events",
        {
            "seq": "event_id",
            "ts": "ts",
            "nombre_usuario": _padded("Supplier#", "user_id"),
            "password_ok": "event_type <> 'error'",
        },
    ),
    "create_product": (
        "events",
        {
            "seq": "event_id",
            "codigo_original": _numbered("P-", "event_id"),
            "nombre": (
                f"case when event_id % 4 = 0 then {_padded('Customer#', 'user_id')} "
                f"else {_numbered('Producto ', '(event_id * 7919) % 3001')} end"
            ),
            "descripcion": "case when event_id % 11 = 0 then '' else 'desc' end",
            "id_dron": "cast(user_id % 25 as bigint)",
            "stock_minimo": "cast(event_id % 20 - 1 as int)",
        },
    ),
    "edit_user": (
        "events",
        {
            "seq": "event_id",
            "id_usuario": "event_id % 130",
            "nombre_completo": f"case when event_id % 4 = 0 then {_numbered('Nombre ', 'event_id')} end",
            "nombre_usuario": f"case when event_id % 5 = 0 then {_padded('Supplier#', 'user_id')} end",
            "email": f"case when event_id % 6 = 0 then {_numbered('new', 'event_id % 37', '@example.com')} end",
            "rol": (
                "case event_id % 7 when 0 then 'Admin' when 1 then 'Operario' when 2 then 'jefe' "
                "when 3 then '' end"
            ),
        },
    ),
    "toggle_user": ("events", {"seq": "event_id", "id_usuario": "user_id"}),
}


def raw_line(kind: str) -> str:
    """A request as a line of JSON: an expression over the columns of the kind, which Spark and DuckDB both read.

    Some fields are left out, NULL, of another type, or written in another way.
    """
    odd = {
        "bigint": ["'\"x7\"'", "concat('\" ', cast({0} as string), '\"')", "'12.5'", "'3.0'", "'true'", "'99999999999999999999'"],
        "int": ["'\"x7\"'", "concat('\"+', cast({0} as string), ' \"')", "'12.5'", "'3.0'", "'false'", "'3000000000'"],
        "string": ["'5'", "'{{\"a\":1}}'", "'[\"b\"]'", "'true'", "'1.5'", "'\"\"'"],
        "boolean": ["'\"tal vez\"'", "'\"Yes\"'", "'0'", "'2'", "'[true]'", "'\"off\"'"],
        "timestamp_ntz": ["'\"ayer\"'", "'12'", "'{{}}'", "'true'", "'\"\"'", "'1.5'"],
    }
    parts = [
        "case when seq % 211 = 3 then '\"n\":1' when seq % 101 = 5 then concat('\"seq\":\"', cast(seq as string), '\"') "
        "else concat('\"seq\":', cast(seq as string)) end"
    ]
    for k, field in enumerate(REQUESTS[kind].fields[1:]):
        name, type_name = field.name, field.dataType.simpleString()
        text = f"cast({name} as string)"
        plain = text if type_name in ("bigint", "int", "boolean") else f"concat('\"', {text}, '\"')"
        draw = f"(seq * 7 + {13 * k}) % 89"
        cases = " ".join(f"when {n} then {v.format(name)}" for n, v in enumerate(["'null'", *odd[type_name]]))
        value = f"case {draw} {cases} else {plain} end"
        parts.append(f"case when {draw} = 7 or {name} is null then '' else concat(',\"{name}\":', {value}) end")
    line = "concat('{', " + ", ".join(parts) + ", '}')"
    return f"case when seq % 97 = 0 then concat('[no json ', cast(seq as string)) else {line} end"


def raw_requests(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Lines of JSON for the requests of a kind."""
    return requests(spark, sf_dir, kind).selectExpr(f"{raw_line(kind)} as raw")


def select_sql(source: str, columns: dict[str, str]) -> str:
    """A mapping as the text of a query."""
    body = ", ".join(f"{expression} as {name}" for name, expression in columns.items())
    return f"select {body} from {source}"


def read_source(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return spark.read.schema(_SOURCE_SCHEMAS[source]).parquet(f"{sf_dir}/{source}.parquet")


def _derive(spark: SparkSession, sf_dir: str, mapping, schema) -> DataFrame:
    source, columns = mapping
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    frame = read_source(spark, sf_dir, source)
    expressions = (
        f"cast({e} as {types[n]}) as {n}" if types[n] == "timestamp_ntz" else f"{e} as {n}"
        for n, e in columns.items()
    )
    return frame.selectExpr(*expressions)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _derive(spark, sf_dir, TABLE_MAPPINGS[name], TABLES[name])


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(**{name: partial(table, spark, sf_dir, name) for name in Tables.NAMES})


def requests(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _derive(spark, sf_dir, REQUEST_MAPPINGS[kind], REQUESTS[kind])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, sf_dir, "events").select("ts", "user_id", "event_type")
