"""Schemas of the tables and of the request batches."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "BIGINT": LongType(),
    "INT": IntegerType(),
    "STRING": StringType(),
    "BOOLEAN": BooleanType(),
    "TIMESTAMP_NTZ": TimestampNTZType(),
}


def _schema(columns: str) -> StructType:
    """``name TYPE, ...``; unlike a DDL text this needs no session."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES = {
    "pieza": _schema(
        "id_pieza BIGINT, id_producto BIGINT, numero_serie STRING, codigo_barras STRING, "
        "estado STRING, id_usuario BIGINT, caja STRING, fecha_registro TIMESTAMP_NTZ"
    ),
    "producto": _schema(
        "id_producto BIGINT, codigo_original STRING, nombre STRING, descripcion STRING, "
        "id_dron BIGINT, stock_minimo INT"
    ),
    "dron": _schema("id BIGINT, nombre STRING"),
    "usuario": _schema(
        "id_usuario BIGINT, nombre_usuario STRING, nombre_completo STRING, email STRING, "
        "rol STRING, activo BOOLEAN, ultimo_login TIMESTAMP_NTZ"
    ),
    "movimiento": _schema(
        "seq BIGINT, ts TIMESTAMP_NTZ, id_pieza BIGINT, tipo_movimiento STRING, "
        "estado_anterior STRING, estado_nuevo STRING, id_usuario BIGINT, observaciones STRING"
    ),
}

PRIMARY_KEYS = {
    "pieza": "id_pieza",
    "producto": "id_producto",
    "dron": "id",
    "usuario": "id_usuario",
}

#: ``seq`` is the order of receipt, unique within a kind of request.
REQUESTS = {
    "scan": _schema("seq BIGINT, codigo STRING"),
    "register": _schema(
        "seq BIGINT, ts TIMESTAMP_NTZ, codigo_original STRING, numero_serie STRING, "
        "nombre_producto STRING, descripcion_producto STRING, id_dron BIGINT, caja STRING, "
        "id_usuario BIGINT"
    ),
    "status": _schema(
        "seq BIGINT, ts TIMESTAMP_NTZ, id_pieza BIGINT, nuevo_estado STRING, "
        "id_usuario BIGINT, observaciones STRING"
    ),
    "checkout": _schema(
        "seq BIGINT, ts TIMESTAMP_NTZ, id_pieza BIGINT, id_usuario BIGINT, observaciones STRING"
    ),
    "create_user": _schema(
        "seq BIGINT, nombre_usuario STRING, email STRING, nombre_completo STRING"
    ),
    "create_product": _schema(
        "seq BIGINT, codigo_original STRING, nombre STRING, descripcion STRING, "
        "id_dron BIGINT, stock_minimo INT"
    ),
    "edit_user": _schema(
        "seq BIGINT, id_usuario BIGINT, nombre_completo STRING, nombre_usuario STRING, "
        "email STRING, rol STRING"
    ),
    "toggle_user": _schema("seq BIGINT, id_usuario BIGINT"),
    "login": _schema(
        "seq BIGINT, ts TIMESTAMP_NTZ, nombre_usuario STRING, password_ok BOOLEAN"
    ),
}

#: Fields a request cannot leave out.
REQUIRED = {
    "scan": ["codigo"],
    "register": ["codigo_original", "numero_serie", "caja"],
    "status": ["id_pieza", "nuevo_estado", "id_usuario"],
    "checkout": ["id_pieza", "id_usuario"],
    "create_user": ["nombre_usuario", "email", "nombre_completo"],
    "create_product": ["codigo_original", "nombre", "descripcion", "id_dron", "stock_minimo"],
    "edit_user": ["id_usuario"],
    "toggle_user": ["id_usuario"],
    "login": ["nombre_usuario", "password_ok"],
}

#: Values that stand in for fields left out.
REQUEST_DEFAULTS = {
    "register": {"id_usuario": 1},
    "status": {"observaciones": ""},
    "checkout": {"observaciones": ""},
}
