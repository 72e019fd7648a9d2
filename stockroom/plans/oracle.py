"""The same queries as SQL that DuckDB runs on the generated tables.

They are written from the rules, mostly with windows over whole groups, and
share only the input mappings with the Spark side.
"""

from __future__ import annotations

import re

from stockroom import messages as M
from stockroom.plans import oracle_mixed
from stockroom.plans.catalog import ACTOR, BASE_URL, FILTER, FILTER_PRODUCT
from stockroom.schemas import REQUEST_DEFAULTS, REQUESTS, REQUIRED
from stockroom.sources.requests import FALSE_TEXTS, FIELD_REQUIRED, NO_JSON, TRUE_TEXTS, WRONG_TYPE
from stockroom.sources.testdata import REQUEST_MAPPINGS, TABLE_MAPPINGS, raw_line, select_sql


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _inputs() -> dict[str, str]:
    views = {name: select_sql(*mapping) for name, mapping in TABLE_MAPPINGS.items()}
    views |= {f"{kind}_requests": select_sql(*mapping) for kind, mapping in REQUEST_MAPPINGS.items()}
    return views


def _verdict(*checks: tuple[str, int, str], done: str | None = None) -> str:
    status = "case " + " ".join(f"when {test} then {code}" for test, code, _ in checks) + " else 200 end"
    reason = "case " + " ".join(f"when {test} then {_text(why)}" for test, _, why in checks) + " end"
    columns = [
        f"({status}) = 200 as accepted",
        f"cast({status} as integer) as status",
        f"{reason} as reason",
    ]
    if done:
        columns.append(f"case when ({status}) = 200 then {done} end as mensaje")
    return ", ".join(columns)


_SPACE = r"[\t-\r\x{1C}- \x{85}\p{Z}]+"
_FORM_SPACE = r"[\t-\r\x{FEFF}\p{Z}]+"


def _strip(value: str, space: str = _SPACE) -> str:
    return f"regexp_replace({value}, '^{space}|{space}$', '', 'g')"



# The two e-mail rules, written for the SQL engine's own patterns.
_EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+[.][A-Za-z][A-Za-z]+(\x0a)?$"
_NOT_SPACE = (
    r"[^@\t-\r\x20\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
_FORM_EMAIL = f"^{_NOT_SPACE}+@{_NOT_SPACE}+[.]{_NOT_SPACE}+$"

_BLANK = "coalesce({0} = '', true)"

# --- shared steps -----------------------------------------------------------

_STEPS: dict[str, str] = {
    "listado": f"""
        select id_pieza, codigo_barras, numero_serie, estado, caja, fecha_registro,
               producto.nombre as nombre_producto, dron.nombre as nombre_dron,
               ifnull(nombre_usuario, {_text(M.DELETED_USER)}) as nombre_usuario
        from pieza left join producto using (id_producto) left join dron on id = id_dron
             left join usuario using (id_usuario)""",
    "alertas": """
        select id_producto, nombre, stock_minimo, ifnull(n, 0) as stock_actual
        from producto left join (select id_producto, count(*) as n from pieza
                                 where estado = 'disponible' group by all) using (id_producto)
        where ifnull(n, 0) < stock_minimo and stock_minimo > 0""",
    "con_nombre": """
        select pieza.*, nombre as nombre_producto from pieza join producto using (id_producto)""",
    "claves": """
        select codigo_barras as codigo, 1 as prioridad, id_pieza as id, id_pieza, numero_serie, estado, caja,
               nombre_producto, cast(null as bigint) as id_producto, cast(null as varchar) as codigo_original,
               cast(null as varchar) as nombre, cast(null as varchar) as descripcion,
               cast(null as bigint) as id_dron
        from con_nombre
        union all by name
        select numero_serie as codigo, 2 as prioridad, id_pieza as id, id_pieza, numero_serie, estado, caja,
               nombre_producto
        from con_nombre
        union all by name
        select codigo_original as codigo, 3 as prioridad, id_producto as id, id_producto, codigo_original,
               nombre, descripcion, id_dron
        from producto""",
    "hallazgos": f"""
        select s.seq, s.codigo,
               case when k.prioridad <= 2 then 'pieza' when k.prioridad = 3 then 'producto'
                    else 'nuevo_producto' end as tipo,
               k.id_pieza, k.numero_serie, k.estado, k.caja, k.nombre_producto, k.id_producto,
               case when k.codigo is null then s.codigo else k.codigo_original end as codigo_original,
               k.nombre, k.descripcion, k.id_dron
        from scan_requests s
             left join (select *, row_number() over (partition by codigo order by prioridad, id) as n
                        from claves) k on s.codigo = k.codigo and k.n = 1""",
    "por_codigo": """
        select r.*, c.id_conocido,
               case when c.id_conocido is null
                    then min(case when nombre_producto <> '' then seq end)
                         over (partition by r.codigo_original) end as creador
        from register_requests r
             left join (select codigo_original, min(id_producto) as id_conocido from producto
                        group by codigo_original) c on r.codigo_original = c.codigo_original""",
    "con_producto": """
        select *, coalesce(id_conocido is not null or seq >= creador, false) as pasa from por_codigo""",
    "por_serie": """
        select *, numero_serie in (select numero_serie from pieza) as serie_conocida,
               row_number() over (partition by numero_serie, pasa order by seq) as turno
        from con_producto""",
    "altas": "select *, pasa and not serie_conocida and turno = 1 as alta from por_serie",
    "productos_nuevos": """
        select seq, (select max(id_producto) from producto) + row_number() over (order by seq) as id_producto,
               codigo_original, nombre_producto as nombre, descripcion_producto as descripcion, id_dron,
               cast(null as integer) as stock_minimo
        from altas where seq = creador""",
    "piezas_nuevas": f"""
        select a.seq, (select max(id_pieza) from pieza) + row_number() over (order by a.seq) as id_pieza,
               coalesce(a.id_conocido, n.id_producto) as id_producto, a.numero_serie,
               concat('INV-', upper(substr(md5(a.numero_serie), 1, 8)), '-', substr(a.numero_serie, 1, 8))
                   as codigo_barras,
               'disponible' as estado, a.id_usuario, a.caja, a.ts as fecha_registro
        from altas a left join productos_nuevos n on a.codigo_original = n.codigo_original
        where a.alta""",
    "mov_altas": f"""
        select seq, fecha_registro as ts, id_pieza, 'registro_inicial' as tipo_movimiento,
               cast(null as varchar) as estado_anterior, 'disponible' as estado_nuevo, id_usuario,
               {_text(M.REGISTERED_NOTE)} as observaciones
        from piezas_nuevas""",
    "cambios": f"""
        select r.*, p.id_pieza is not null as conocida, p.estado as estado_inicial,
               r.nuevo_estado in {_texts(M.STATES_SETTABLE)} as valido
        from status_requests r left join pieza p on r.id_pieza = p.id_pieza""",
    "mov_estados": f"""
        select seq, ts, id_pieza, 'cambio_estado' as tipo_movimiento, anterior as estado_anterior,
               nuevo_estado as estado_nuevo, id_usuario,
               {_strip("concat('Cambio de ''', anterior, ''' a ''', nuevo_estado, '''. ', observaciones)")}
                   as observaciones
        from (select *, lag(nuevo_estado, 1, estado_inicial) over (partition by id_pieza order by seq)
                  as anterior
              from cambios where valido and conocida)""",
    "salidas_base": """
        select r.*, p.id_pieza is not null as pieza_conocida, p.estado as estado,
               u.id_usuario is not null as usuario_conocido, coalesce(u.rol in ('admin', 'salida'), false)
                   as permitido
        from checkout_requests r left join pieza p on r.id_pieza = p.id_pieza
             left join usuario u on r.id_usuario = u.id_usuario""",
    "salidas": """
        select *, min(case when estado = 'almacenado' and permitido then seq end)
                      over (partition by id_pieza) as primera
        from salidas_base""",
    "mov_salidas": """
        select seq, ts, id_pieza, 'salida' as tipo_movimiento, estado as estado_anterior,
               'salida' as estado_nuevo, id_usuario, observaciones
        from salidas where seq = primera""",
    "productos_revisados": f"""
        select *, coalesce(codigo_original = '' or nombre = '' or descripcion = '', true)
                      or id_dron is null or stock_minimo is null as incompleto
        from (select seq, {", ".join(_strip(c, _FORM_SPACE) + " as " + c
                                     for c in ("codigo_original", "nombre", "descripcion"))},
                     id_dron, stock_minimo
              from create_product_requests)""",
    "productos_turno": """
        select *, row_number() over (
                      partition by nombre, incompleto or stock_minimo < 0,
                                   nombre in (select nombre from producto)
                      order by seq) as turno,
               nombre in (select nombre from producto) as existe
        from productos_revisados""",
    "pretendientes": f"""
        select min(seq) as seq, nombre_usuario as a, email as b, nombre_completo as c
        from create_user_requests
        where regexp_matches(email, '{_EMAIL}')
          and nombre_usuario not in (select nombre_usuario from usuario)
          and email not in (select email from usuario)
          and nombre_completo not in (select nombre_completo from usuario)
        group by nombre_usuario, email, nombre_completo""",
    "rondas": """
        select seq, a, b, c, 0 as ronda, 'abierta' as suerte from pretendientes
        union all
        select seq, a, b, c, ronda + 1,
               case when gana then 'gana'
                    when bool_or(gana) over (partition by a) or bool_or(gana) over (partition by b)
                         or bool_or(gana) over (partition by c) then 'pierde'
                    else 'abierta' end
        from (select *, seq = min(seq) over (partition by a) and seq = min(seq) over (partition by b)
                        and seq = min(seq) over (partition by c) as gana
              from rondas where suerte = 'abierta')""",
    "edicion": f"""
        select r.*, u.id_usuario is not null as conocido,
               coalesce(r.rol <> '' and r.rol not in {_texts(M.ROLES_ADMIN)}, false) as mal_rol,
               coalesce(r.nombre_completo, r.nombre_usuario, r.email, r.rol) is null as vacia,
               case when u.id_usuario is not null and r.nombre_usuario <> ''
                         and r.nombre_usuario is distinct from u.nombre_usuario
                    then r.nombre_usuario end as pide_nombre,
               case when u.id_usuario is not null and r.email <> ''
                         and r.email is distinct from u.email then r.email end as pide_email
        from edit_user_requests r left join usuario u on r.id_usuario = u.id_usuario""",
    "edicion_ocupada": """
        select *, coalesce(pide_nombre in (select nombre_usuario from usuario), false)
                  or coalesce(pide_email in (select email from usuario), false) as ocupado
        from edicion""",
    "reclamos": """
        select min(seq) as seq, id_usuario as duenio, pide_nombre, pide_email
        from edicion_ocupada
        where conocido and not mal_rol and not vacia and not ocupado
          and (pide_nombre is not null or pide_email is not null)
        group by id_usuario, pide_nombre, pide_email""",
    "reclamos_rondas": """
        select seq, duenio, pide_nombre as a, pide_email as b, false as gana from reclamos
        union all
        select seq, duenio, a, b, a is null and b is null
        from (select seq, duenio, case when de_a is null then a end as a, case when de_b is null then b end as b,
                     coalesce(de_a <> duenio, false) or coalesce(de_b <> duenio, false) as pierde
              from (select *, case when a is not null
                                   then max(case when primera then duenio end) over (partition by a) end as de_a,
                              case when b is not null
                                   then max(case when primera then duenio end) over (partition by b) end as de_b
                    from (select *, (a is null or seq = min(seq) over (partition by a))
                                    and (b is null or seq = min(seq) over (partition by b)) as primera
                          from reclamos_rondas where not gana)))
        where not pierde""",
    "edicion_decidida": f"""
        select e.*, e.conocido and not mal_rol and not vacia and not ocupado
                    and (e.pide_nombre is not null or e.pide_email is not null)
                    and g.duenio is null as perdida
        from edicion_ocupada e
             left join (select c.* from reclamos c
                        where c.seq in (select seq from reclamos_rondas where gana)) g
               on e.id_usuario = g.duenio and e.pide_nombre is not distinct from g.pide_nombre
                  and e.pide_email is not distinct from g.pide_email""",
    "ingresos": """
        select a.seq, a.ts, a.password_ok, u.id_usuario, u.nombre_usuario, u.rol, u.activo
        from login_requests a
             left join (select *, row_number() over (partition by nombre_usuario order by id_usuario) as n
                        from usuario) u on a.nombre_usuario = u.nombre_usuario and u.n = 1""",
    "ultimos": """
        select id_usuario, max(ts) as ultimo_login from ingresos where activo and password_ok
        group by id_usuario""",
    "exportado": """
        select cast(id_pieza as varchar) as "ID Pieza", ifnull(producto.nombre, '') as "Producto",
               ifnull(dron.nombre, '') as "Dron", ifnull(codigo_barras, '') as "Código de Barras",
               ifnull(numero_serie, '') as "Número de Serie", estado as "Estado",
               ifnull(strftime(fecha_registro, '%d/%m/%Y %H:%M'), '') as "Fecha de Registro",
               ifnull(nombre_usuario, '') as "Registrado por", ifnull(caja, '') as "Caja"
        from pieza left join producto using (id_producto) left join dron on id = id_dron
             left join usuario using (id_usuario)
        where estado = 'disponible'""",
}

# The steps of a registration over the requests that are complete.
_CHAIN = ("por_codigo", "con_producto", "por_serie", "altas")
for _name in _CHAIN:
    _body = _STEPS[_name]
    for _other in (*_CHAIN, "register_requests"):
        _body = re.sub(rf"\b{_other}\b", f"completas_{_other}", _body)
    _STEPS[f"completas_{_name}"] = _body
_STEPS["completas_register_requests"] = "select * from register_requests where seq % 50 <> 0"

_RECURSIVE = {"rondas", "reclamos_rondas"}

_EDIT_VERDICT = _verdict(
    ("not conocido", 404, M.NO_USER),
    ("mal_rol", 400, M.BAD_ROLE),
    ("ocupado or perdida", 400, M.EDIT_CLASH),
    ("vacia", 400, M.EDIT_EMPTY),
    done="concat('Usuario ID ', cast(e.id_usuario as varchar), ' actualizado exitosamente')",
)

_NEW_USERS_SEQ = "(select seq from rondas where suerte = 'gana')"

_EDIT_FORM_FIELDS = ["nombre_completo", "nombre_usuario", "email", "rol"]


def _changed(column: str) -> str:
    return f"{column} is distinct from u_{column}"


_FINAL: dict[str, str] = {
    "inventory_listing": "select * from listado",
    "inventory_filter": f"""
        select * replace (coalesce(nullif(nombre_usuario, ''), 'N/A') as nombre_usuario),
               coalesce(estado = 'almacenado', false) as salida_posible
        from listado
        where contains(lower(numero_serie), lower({_text(FILTER.serie)})) and estado = {_text(FILTER.estado)}""",
    "inventory_by_product": f"select * from listado where nombre_producto = {_text(FILTER_PRODUCT.producto)}",
    "checkout_offered": """
        select id_pieza, estado, coalesce(estado = 'almacenado', false) as salida_posible from listado""",
    "inventory_count": """
        select 'inventario' as listado, count(*) as filas, count(*) = 0 as vacio from listado
        union all select 'alertas', count(*), count(*) = 0 from alertas
        union all select 'usuarios', count(*), count(*) = 0 from usuario where activo""",
    "distinct_products": """
        select nombre_producto, max(fecha_registro) as ultima_fecha from listado group by nombre_producto""",
    "list_models": "select id, nombre from dron order by nombre",
    "list_active_users": "select * from usuario where activo order by id_usuario desc",
    "user_display": """
        select id_usuario, coalesce(nullif(nombre_completo, ''), '—') as nombre_completo, nombre_usuario, rol,
               coalesce(strftime(ultimo_login, '%Y-%m-%d %H:%M:%S'), 'Nunca') as ultimo_login,
               case when activo then 'Sí' else 'No' end as activo,
               coalesce(nullif(nombre_completo, ''), nullif(nombre_usuario, ''), 'Sin nombre') as nombre_mostrado
        from usuario""",
    "get_users": """
        select r.seq, r.id_usuario, u.nombre_usuario, u.nombre_completo, u.email, u.rol, u.activo,
               u.ultimo_login, u.id_usuario is not null as encontrado,
               cast(case when u.id_usuario is null then 404 else 200 end as integer) as status
        from toggle_user_requests r left join usuario u on r.id_usuario = u.id_usuario""",
    "low_stock_alerts": "select * from alertas",
    "low_stock_message": """
        select id_producto, concat(nombre, ' quedan: ', cast(stock_actual as varchar)) as linea from alertas""",
    "scan_lookup": "select * from hallazgos",
    "scan_display": """
        select seq, tipo,
               case tipo when 'pieza' then 'actualizar_estado' when 'producto' then 'registrar_pieza'
                    else 'registrar_producto' end as accion,
               case tipo when 'pieza' then coalesce(nullif(nombre_producto, ''), 'N/A')
                         when 'producto' then nombre end as producto_mostrado,
               case tipo when 'pieza' then coalesce(nullif(caja, ''), 'N/A') end as caja_mostrada,
               case tipo when 'producto' then coalesce(descripcion, '') end as descripcion_mostrada,
               case when tipo <> 'pieza' then codigo_original end as codigo_mostrado
        from hallazgos""",
    "scan_form": f"""
        select seq, codigo, {_verdict((_BLANK.format("codigo"), 400, M.FORM_NO_CODE))}
        from (select seq, {_strip("codigo", _FORM_SPACE)} as codigo from scan_requests)""",
    "piece_by_barcode": """
        select seq, s.codigo, id_pieza, numero_serie, estado, caja, nombre_producto
        from scan_requests s
             join (select *, row_number() over (partition by codigo order by id) as n
                   from claves where prioridad = 1) k on s.codigo = k.codigo and k.n = 1""",
    "piece_by_serial": """
        select seq, s.codigo, id_pieza, numero_serie, estado, caja, nombre_producto
        from scan_requests s
             join (select *, row_number() over (partition by codigo order by id) as n
                   from claves where prioridad = 2) k on s.codigo = k.codigo and k.n = 1""",
    "barcode_exists": """
        select seq, codigo, codigo in (select codigo_barras from pieza) as existe from scan_requests""",
    "serial_exists": """
        select seq, numero_serie, numero_serie in (select numero_serie from pieza) as existe
        from register_requests""",
    "product_exists": """
        select seq, codigo_original, codigo_original in (select codigo_original from producto) as existe
        from register_requests""",
    "serial_new": """
        select numero_serie, min(seq) as seq from register_requests
        where numero_serie not in (select numero_serie from pieza) group by numero_serie""",
    "register_form": f"""
        select seq, nullif({_strip("nombre_producto", _FORM_SPACE)}, '') as nombre_producto, {_verdict(
            (f"{_BLANK.format(_strip('numero_serie', _FORM_SPACE))} or "
             f"{_BLANK.format(_strip('caja', _FORM_SPACE))} or id_usuario is null", 400, M.FORM_MISSING),
            (_BLANK.format(_strip("codigo_original", _FORM_SPACE)), 400, M.FORM_NO_SUPPLIER_CODE))}
        from register_requests""",
    "register_decisions": f"""
        select seq, {_verdict(("not pasa", 400, M.NAME_REQUIRED), ("not alta", 400, M.SERIAL_KNOWN),
                             done="'Pieza registrada exitosamente'")}
        from altas""",
    "register_validated": f"""
        select seq, {_verdict(("not pasa", 400, M.NAME_REQUIRED), ("not alta", 400, M.SERIAL_KNOWN),
                             done="'Pieza registrada exitosamente'")}
        from completas_altas
        union all select seq, false, 422, 'Field required', null from register_requests where seq % 50 = 0""",
    "alert_refresh": """
        select id_producto, nombre, stock_minimo, ifnull(n, 0) as stock_actual
        from (select id_producto, nombre, stock_minimo from producto
              union all select id_producto, nombre, stock_minimo from productos_nuevos)
             left join (select id_producto, count(*) as n
                        from (select id_producto from pieza where estado = 'disponible'
                              union all select id_producto from piezas_nuevas)
                        group by all) using (id_producto)
        where ifnull(n, 0) < stock_minimo and stock_minimo > 0""",
    "scan_batch": "select * from hallazgos",
    "create_user_form": f"""
        select *, {_verdict((" or ".join(_BLANK.format(c) for c in ("nombre_usuario", "email", "nombre_completo")),
                             400, M.FORM_INCOMPLETE))}
        from (select seq, {_strip("nombre_usuario", _FORM_SPACE)} as nombre_usuario,
                     {_strip("case when seq % 7 = 0 then concat(chr(160), ' ', email, chr(9)) else email end",
                             _FORM_SPACE)} as email,
                     {_strip("case when seq % 11 = 0 then chr(8195) else nombre_completo end", _FORM_SPACE)}
                         as nombre_completo
              from create_user_requests)""",
    "register_new_products": "select * from productos_nuevos",
    "register_new_pieces": "select * from piezas_nuevas",
    "register_movements": "select * from mov_altas",
    "label_manifest": f"""
        select seq, id_pieza, codigo_barras, concat('codigos/', codigo_barras, '.png') as ruta,
               concat(rtrim({_text(BASE_URL)}, '/'), '/codigos/', codigo_barras, '.png') as ruta_etiqueta,
               strftime(fecha_registro, '%-d/%-m/%Y') as fecha_impresion
        from piezas_nuevas""",
    "status_decisions": f"""
        select seq, {_verdict(
            ("not valido", 400, M.BAD_STATE), ("not conocida", 404, M.NO_PIECE),
            done="concat('Estado de la pieza ', cast(id_pieza as varchar), ' actualizado a ', nuevo_estado)")}
        from cambios""",
    "status_movements": "select * from mov_estados",
    "status_snapshot": """
        select p.* replace (coalesce(m.estado_nuevo, p.estado) as estado)
        from pieza p left join (select *, row_number() over (partition by id_pieza order by seq desc) as n
                                from mov_estados) m on p.id_pieza = m.id_pieza and m.n = 1""",
    "status_snapshot_unvalidated": """
        select p.* replace (coalesce(m.nuevo_estado, p.estado) as estado)
        from pieza p left join (select *, row_number() over (partition by id_pieza order by seq desc) as n
                                from status_requests) m on p.id_pieza = m.id_pieza and m.n = 1""",
    "live_status": """
        select id_pieza, nuevo_estado as estado, ts as actualizado, cambios
        from (select *, row_number() over (partition by id_pieza order by ts desc, seq desc) as n,
                     count(*) over (partition by id_pieza) as cambios
              from cambios where valido)
        where n = 1""",
    "checkout_decisions": f"""
        select seq, {_verdict(
            ("not pieza_conocida", 404, M.NO_PIECE),
            ("coalesce(estado <> 'almacenado', true) or primera < seq", 400, M.NOT_STORED),
            ("not usuario_conocido", 404, M.NO_USER),
            ("not permitido", 403, M.CHECKOUT_DENIED),
            done="'Salida registrada exitosamente'")}
        from salidas""",
    "checkout_movements": "select * from mov_salidas",
    "checkout_snapshot": """
        select p.* replace (coalesce(m.estado_nuevo, p.estado) as estado)
        from pieza p left join mov_salidas m on p.id_pieza = m.id_pieza""",
    "movements_all": """
        select * from mov_altas union all select * from mov_estados union all select * from mov_salidas""",
    "create_products_decisions": f"""
        select seq, {_verdict(
            ("incompleto", 400, M.FORM_INCOMPLETE),
            ("stock_minimo < 0", 400, M.FORM_NEGATIVE),
            ("existe or turno > 1", 400, M.PRODUCT_CLASH),
            done="concat('Producto ''', nombre, ''' creado exitosamente')")}
        from productos_turno""",
    "create_products_new": """
        select seq, (select max(id_producto) from producto) + row_number() over (order by seq) as id_producto,
               codigo_original, nombre, descripcion, id_dron, stock_minimo
        from productos_turno where not incompleto and stock_minimo >= 0 and not existe and turno = 1""",
    "user_conflicts": """
        select * from (
            select seq, nombre_usuario in (select nombre_usuario from usuario) as choca_nombre_usuario,
                   email in (select email from usuario) as choca_email,
                   nombre_completo in (select nombre_completo from usuario) as choca_nombre_completo
            from create_user_requests)
        where choca_nombre_usuario or choca_email or choca_nombre_completo""",
    "create_users_decisions": f"""
        select seq, {_verdict(
            (f"not regexp_matches(email, '{_EMAIL}')", 400, M.BAD_EMAIL),
            (f"seq not in {_NEW_USERS_SEQ}", 400, M.USER_CLASH))}
        from create_user_requests""",
    "create_users_new": f"""
        select *, concat('Usuario ''', nombre_completo, ''' creado exitosamente con rol ''Operario'' (ID ',
                         cast(id_usuario as varchar), ')') as mensaje
        from (select seq, (select max(id_usuario) from usuario) + row_number() over (order by seq) as id_usuario,
                     nombre_usuario, nombre_completo, email, 'Operario' as rol, true as activo,
                     cast(null as timestamp) as ultimo_login
              from create_user_requests where seq in {_NEW_USERS_SEQ})""",
    "edit_form": f"""
        select seq, id_usuario,
               {", ".join(f"case when {_changed(c)} then {c} end as {c}" for c in _EDIT_FORM_FIELDS)},
               {_verdict(
                   ("not conocido", 404, M.NO_USER),
                   (_BLANK.format("nombre_completo"), 400, M.FORM_NAME_REQUIRED),
                   (_BLANK.format("nombre_usuario"), 400, M.FORM_USER_REQUIRED),
                   (_BLANK.format("email"), 400, M.FORM_EMAIL_REQUIRED),
                   (f"not regexp_matches(email, '{_FORM_EMAIL}')", 400, M.FORM_BAD_EMAIL),
                   (f"id_usuario = {ACTOR} and {_changed('rol')}", 400, M.FORM_OWN_ROLE),
                   ("not (" + " or ".join(_changed(c) for c in _EDIT_FORM_FIELDS) + ")", 400, M.FORM_UNCHANGED))}
        from (select r.seq, r.id_usuario, r.rol, u.id_usuario is not null as conocido,
                     {", ".join(_strip(f"r.{c}", _FORM_SPACE) + f" as {c}" for c in _EDIT_FORM_FIELDS[:3])},
                     {", ".join(f"u.{c} as u_{c}" for c in _EDIT_FORM_FIELDS)}
              from edit_user_requests r left join usuario u on r.id_usuario = u.id_usuario)""",
    "edit_users_decisions": f"select seq, {_EDIT_VERDICT} from edicion_decidida e",
    "edit_users_snapshot": f"""
        select u.* replace ({", ".join(f"coalesce(e.{c}, u.{c}) as {c}" for c in _EDIT_FORM_FIELDS)})
        from usuario u left join (
            select id_usuario, {", ".join(f"arg_max({c}, seq) filter (where {c} is not null) as {c}"
                                          for c in _EDIT_FORM_FIELDS)}
            from (select *, {_EDIT_VERDICT} from edicion_decidida e) where accepted group by id_usuario
        ) e on u.id_usuario = e.id_usuario""",
    "toggle_users": f"""
        select seq, activo, {_verdict(("not conocido", 404, M.NO_USER), done=
            "concat('Usuario ID ', cast(id_usuario as varchar), "
            "case when activo then ' activado' else ' desactivado' end, ' exitosamente')")}
        from (select r.seq, r.id_usuario, u.id_usuario is not null as conocido,
                     u.activo <> (row_number() over (partition by r.id_usuario order by r.seq) % 2 = 1) as activo
              from toggle_user_requests r left join usuario u on r.id_usuario = u.id_usuario)""",
    "toggle_snapshot": """
        select u.* replace (u.activo <> (coalesce(c.n, 0) % 2 = 1) as activo)
        from usuario u left join (select id_usuario, count(*) as n from toggle_user_requests
                                  group by id_usuario) c on u.id_usuario = c.id_usuario""",
    "login_audit": f"""
        select seq, accepted, status, reason, case when accepted then id_usuario end as id_usuario,
               case when accepted then nombre_usuario end as nombre_usuario, case when accepted then rol end as rol
        from (select *, {_verdict(
            ("id_usuario is null", 401, M.BAD_LOGIN),
            ("not coalesce(activo, false)", 401, M.INACTIVE),
            ("not password_ok", 401, M.BAD_LOGIN))}
              from ingresos)""",
    "last_login": "select * from ultimos",
    "last_login_snapshot": """
        select u.* replace (coalesce(l.ultimo_login, u.ultimo_login) as ultimo_login)
        from usuario u left join ultimos l on u.id_usuario = l.id_usuario""",
    "export_inventory": "select * from exportado",
    "column_width_profile": " union all ".join(
        f"select {_text(h)} as columna, cast(least(greatest(coalesce(max(length(\"{h}\")), 0), {len(h)})"
        f" + {M.EXPORT_WIDTH_PAD}, {M.EXPORT_WIDTH_MAX}) as integer) as ancho from exportado"
        for h in M.EXPORT_HEADINGS.values()
    ),
    "scalar_functions": f"""
        select seq, contains(lower(nuevo_estado), lower('EN_')) as f1_contiene,
               {_strip("observaciones")} as f2_recortado,
               {_strip("observaciones", _FORM_SPACE)} as f2_recortado_formulario,
               concat('INV-', upper(substr(md5(concat('SN', cast(id_pieza as varchar))), 1, 8)), '-',
                      substr(concat('SN', cast(id_pieza as varchar)), 1, 8)) as f3_codigo,
               coalesce(case when seq % 2 = 0 then nuevo_estado end, 'Usuario eliminado') as f4_texto,
               coalesce(nullif({_strip("observaciones")}, ''), 'N/A') as f5_texto,
               case when id_usuario > 60 then 'Sí' else 'No' end as f6_si_no,
               try_strptime(case when seq % 3 = 0 then 'nada' else strftime(ts, '%Y-%m-%d %H:%M:%S') end,
                            '%Y-%m-%d %H:%M:%S') as f7_fecha,
               coalesce(strftime(case when seq % 5 <> 0 then ts end, '%d/%m/%Y %H:%M'), '') as f8_fecha,
               coalesce(cast(case when seq % 7 <> 0 then id_usuario end as varchar), '') as f9_texto,
               cast(id_pieza as varchar) as f10_texto,
               regexp_matches(concat(nuevo_estado, '@example.', substr(nuevo_estado, 1, 2)),
                              '{_EMAIL}') as f11_correo,
               regexp_matches(concat(nuevo_estado, observaciones, '@x.y'), '{_FORM_EMAIL}') as f12_correo,
               {_strip("concat('Cambio de ''', coalesce(case when seq % 2 = 0 then nuevo_estado end, 'None'),"
                       " ''' a ''', nuevo_estado, '''. ', observaciones)")} as f13_nota,
               try_cast(nullif({_strip("substr(observaciones, 6, 20)")}, '') as bigint) as f15_numero
        from status_requests""",
    "activity_sessions": """
        select user_id, min(ts) as inicio, max(ts) + interval 10 minutes as fin, count(*) as eventos
        from (select *, sum(empieza) over (partition by user_id order by ts rows unbounded preceding) as sesion
              from (select user_id, ts,
                           case when ts > lag(ts) over (partition by user_id order by ts) + interval 10 minutes
                                     or lag(ts) over (partition by user_id order by ts) is null
                                then 1 else 0 end as empieza
                    from events))
        group by user_id, sesion""",
}


# --- raw requests -----------------------------------------------------------


def _field(name: str) -> tuple[str, str]:
    """Type and text of a field of a line."""
    return f"json_type(linea, '$.{name}')", f"json_extract_string(linea, '$.{name}')"


def _field_value(kind: str, field) -> str:
    kind_of, text = _field(field.name)
    type_name = field.dataType.simpleString()
    if type_name in ("bigint", "int"):
        number = f"try_cast({text} as double)"
        value = f"""case
            when {kind_of} in ('BIGINT', 'UBIGINT') then try_cast({text} as {type_name})
            when {kind_of} = 'BOOLEAN' then case {text} when 'true' then 1 else 0 end
            when {kind_of} = 'DOUBLE' and {number} = floor({number}) then try_cast({number} as {type_name})
            when {kind_of} = 'VARCHAR' and regexp_full_match({text}, '\\s*[+-]?[0-9]+\\s*')
                then try_cast(replace(trim({text}), '+', '') as {type_name}) end"""
    elif type_name == "boolean":
        scalar = f"{kind_of} in ('BOOLEAN', 'BIGINT', 'UBIGINT', 'VARCHAR')"
        value = (
            f"case when {scalar} and lower({text}) in {_texts(TRUE_TEXTS)} then true "
            f"when {scalar} and lower({text}) in {_texts(FALSE_TEXTS)} then false end"
        )
    else:
        value = f"case when {kind_of} = 'VARCHAR' then {text} end"
        if type_name == "timestamp_ntz":
            value = f"try_cast({value} as timestamp)"
    default = REQUEST_DEFAULTS.get(kind, {}).get(field.name)
    if default is not None:
        given = _text(default) if isinstance(default, str) else str(default)
        value = f"case when {kind_of} is null then {given} else {value} end"
    sql_type = {"string": "varchar", "timestamp_ntz": "timestamp"}.get(type_name, type_name)
    return f"cast({value} as {sql_type})"


def _field_error(kind: str, field) -> str:
    kind_of, _ = _field(field.name)
    must = field.name == "seq" or field.name in REQUIRED[kind]
    wrong = _text(f"{field.name}: {WRONG_TYPE[type(field.dataType)]}")
    absent = _text(f"{field.name}: {FIELD_REQUIRED}") if must else "null"
    null_wrong = must or field.name in REQUEST_DEFAULTS.get(kind, {})
    return (
        f"case when {kind_of} is null then {absent} when {kind_of} = 'NULL' then {wrong if null_wrong else 'null'} "
        f"when {_field_value(kind, field)} is null then {wrong} end"
    )


def _read_lines(kind: str) -> str:
    fields = REQUESTS[kind].fields
    values = ", ".join(f"{_field_value(kind, f)} as {f.name}" for f in fields)
    wrong = ", ".join(_field_error(kind, f) for f in fields)
    # what is no JSON has no fields at all
    lines = f"select raw, case when json_valid(raw) then raw::json end as linea from (select {raw_line(kind)} as raw from {kind}_requests)"
    return (
        f"select {values}, case when linea is null then {_text(NO_JSON)} "
        f"else nullif(concat_ws('; ', {wrong}), '') end as errors from ({lines})"
    )


def _ingest_sql(kind: str) -> str:
    return f"select *, cast(case when errors is null then 200 else 422 end as integer) as status from ({_read_lines(kind)})"


def _raw_decisions_sql(kind: str, decisions: str) -> tuple[dict[str, str], str]:
    """Views in place of the requests, and the answers to all lines."""
    lines = _read_lines(kind)
    views = {f"{kind}_lineas": lines, f"{kind}_requests": f"select * exclude (errors) from {kind}_lineas where errors is null"}
    sql = (
        f"select seq, accepted, status, reason from ({_FINAL[decisions]}) union all "
        f"select seq, false, cast(422 as integer), errors from {kind}_lineas where errors is not null"
    )
    return views, sql


_FINAL |= {f"ingest_{kind}": _ingest_sql(kind) for kind in REQUESTS}
_FINAL |= oracle_mixed.finals()
_STEPS |= oracle_mixed.views(_text, _texts, _strip, _verdict, _EMAIL)
_RECURSIVE |= oracle_mixed.RECURSIVE


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    """The views a query names, directly or not, in an order in which each may be defined."""
    words = set(_words(sql))
    found: list[str] = []
    for name, body in views.items():
        if name in words:
            inner = {k: v for k, v in views.items() if k != name}
            for other in _needed(body, inner):
                if other not in found:
                    found.append(other)
            if name not in found:
                found.append(name)
    return found


def _words(sql: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in sql).split()


def oracle_sql() -> dict[str, str]:
    views = _inputs() | _STEPS
    result = {}
    for key, body in _FINAL.items():
        names = _needed(body, views)
        if names:
            recursive = "recursive " if _RECURSIVE & set(names) else ""
            defined = ((oracle_mixed.KEYED.get(n, n), views[n]) for n in names)
            body = f"with {recursive}" + ", ".join(f"{n} as ({sql})" for n, sql in defined) + " " + body
        result[key] = body
    for kind, decisions in (("status", "status_decisions"), ("checkout", "checkout_decisions"), ("toggle_user", "toggle_users")):
        extra, body = _raw_decisions_sql(kind, decisions)
        typed = {**views, f"{kind}_pedidos": views[f"{kind}_requests"]}
        extra[f"{kind}_lineas"] = extra[f"{kind}_lineas"].replace(f"{kind}_requests", f"{kind}_pedidos")
        names = _needed(body, typed | extra)
        result[f"raw_{kind}_decisions"] = "with " + ", ".join(f"{n} as ({(typed | extra)[n]})" for n in names) + " " + body
    return result
