"""Batches of mixed kinds and exact edits as SQL for DuckDB.

Where one request decides about the next, a recursive query keyed by user or
product handles them one at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from stockroom import messages as M
from stockroom.operators.mixed import KINDS

#: Places between two requests of one kind for those of the others.
SPREAD = 8


def mixed_seq(kind: str) -> str:
    return f"seq * {SPREAD} + {KINDS.index(kind)}"


def views(text: Callable[[str], str], texts: Callable, strip: Callable, verdict: Callable, email: str) -> dict[str, str]:
    """Steps, in an order in which each may be defined."""
    found = {f"m_{kind}": f"select * replace (cast({mixed_seq(kind)} as bigint) as seq) from {kind}_requests" for kind in KINDS}

    def edits(name: str, source: str, creates: str | None) -> None:
        """Users as they change: ``clave`` is a user, -1 the step, below that an accepted request."""
        news = (
            f"select seq, true as alta, cast(null as bigint) as id_usuario, nombre_usuario, email, nombre_completo "
            f"from {creates} where regexp_matches(email, '{email}') union all " if creates else ""
        )
        found[f"{name}_pasos"] = f"""
            select *, row_number() over (order by seq) as paso from ({news}
                select seq, false, id_usuario, nombre_usuario, email, nombre_completo from {source}
                where (id_usuario in (select id_usuario from usuario)
                         and coalesce(nombre_usuario, email, nombre_completo) is not null
                       or id_usuario > (select max(id_usuario) from usuario))
                  and coalesce(nombre_usuario, email, nombre_completo, rol) is not null
                  and (coalesce(rol, '') = '' or rol in {texts(M.ROLES_ADMIN)})
            ) as t(seq, alta, id_usuario, nombre_usuario, email, nombre_completo)"""
        found[f"{name}_estado"] = f"""
            select id_usuario as clave, nombre_usuario as nombre, email as correo, nombre_completo as completo,
                   cast(0 as bigint) as paso, cast(0 as bigint) as creados from usuario
            union all select -1, null, null, null, 0, 0
            union
            select f.clave, f.nombre, f.correo, f.completo, f.paso, f.creados
            from (select unnest([
                    {{'clave': cast(-1 as bigint), 'nombre': null, 'correo': null, 'completo': null, 'paso': paso,
                      'creados': creados + cast(va and alta as bigint), 'va': true}},
                    {{'clave': -2 - seq, 'nombre': null, 'correo': null, 'completo': null, 'paso': paso,
                      'creados': quien, 'va': va}},
                    {{'clave': quien, 'nombre': coalesce(nombre_usuario, n), 'correo': coalesce(email, c),
                      'completo': coalesce(nombre_completo, o), 'paso': paso, 'creados': 0, 'va': va}}]) as f
                  from (select p.*, w.creados, u.nombre as n, u.correo as c, u.completo as o,
                               case when alta then (select max(id_usuario) from usuario) + 1 + w.creados
                                    else p.id_usuario end as quien,
                               case when alta then not exists (
                                        select 1 from recurring.{name}_estado h where h.clave >= 0
                                        and (h.nombre = p.nombre_usuario or h.correo = p.email
                                             or h.completo = p.nombre_completo))
                                    else u.clave is not null and not exists (
                                        select 1 from recurring.{name}_estado h
                                        where h.clave >= 0 and h.clave <> p.id_usuario
                                        and (p.nombre_usuario <> '' and p.nombre_usuario is distinct from u.nombre
                                               and h.nombre = p.nombre_usuario
                                             or p.email <> '' and p.email is distinct from u.correo
                                               and h.correo = p.email)) end as va
                        from {name}_estado w join {name}_pasos p on p.paso = w.paso + 1
                             left join recurring.{name}_estado u on u.clave = p.id_usuario
                        where w.clave = -1))
            where f.va"""
        found[f"{name}_aceptadas"] = f"select -2 - clave as seq, creados as quien from {name}_estado where clave < -1"
        old = "select id_usuario, cast(-1 as bigint) as desde, nombre_usuario, rol, activo from usuario"
        new = (
            f"union all select a.quien, a.seq, r.nombre_usuario, {text(M.ROLE_NEW_USER)}, true "
            f"from {name}_aceptadas a join {creates} r on r.seq = a.seq" if creates else ""
        )
        found[f"{name}_personas"] = f"{old} {new}"
        found[f"{name}_juzgadas"] = f"""
            select r.*, p.id_usuario is not null as conocido,
                   coalesce(r.rol <> '' and r.rol not in {texts(M.ROLES_ADMIN)}, false) as mal_rol,
                   coalesce(r.nombre_completo, r.nombre_usuario, r.email, r.rol) is null as vacia,
                   s.seq is not null and a.seq is null as choca
            from {source} r left join {name}_personas p on r.id_usuario = p.id_usuario and p.desde < r.seq
                 left join {name}_pasos s on s.seq = r.seq left join {name}_aceptadas a on a.seq = r.seq"""
        found[f"{name}_parches"] = f"select * from {name}_juzgadas where conocido and not mal_rol and not vacia and not choca"

    edits("x", "edit_user_requests", None)
    edits("m", "m_edit_user", "m_create_user")
    found |= {
        "m_quieren": """
            select min(seq) as seq, true as por_nombre, nombre, codigo_original from m_create_product
            where nombre not in (select nombre from producto) group by nombre, codigo_original
            union all
            select min(seq), false, nombre_producto, codigo_original from m_register
            where nombre_producto <> '' and codigo_original not in (select codigo_original from producto)
            group by nombre_producto, codigo_original""",
        # whoever comes first under its key makes the product; whoever comes after a maker under its key does not
        "m_hacen": """
            select seq, por_nombre, nombre, codigo_original, 'abierta' as suerte from m_quieren
            union all
            select seq, por_nombre, nombre, codigo_original,
                   case when gana then 'gana'
                        when case when por_nombre then min(case when gana then seq end) over (partition by nombre)
                                  else min(case when gana then seq end) over (partition by codigo_original) end < seq
                        then 'pierde' else 'abierta' end
            from (select *, seq = case when por_nombre then min(seq) over (partition by nombre)
                                       else min(seq) over (partition by codigo_original) end as gana
                  from m_hacen where suerte = 'abierta')""",
        "m_productos_nuevos": """
            select seq, (select max(id_producto) from producto) + row_number() over (order by seq) as id_producto,
                   codigo_original, nombre
            from (select seq, codigo_original, nombre from m_create_product
                  union all select seq, codigo_original, nombre_producto from m_register)
            where seq in (select seq from m_hacen where suerte = 'gana')""",
        "m_codigos": """
            select codigo_original, min(k.id_producto) as conocido, min(n.seq) as creador,
                   arg_min(n.id_producto, n.seq) as nuevo
            from (select distinct codigo_original from m_register) left join producto k using (codigo_original)
                 left join m_productos_nuevos n using (codigo_original)
            group by codigo_original""",
        "m_altas": """
            select *, pasa and numero_serie not in (select numero_serie from pieza)
                      and row_number() over (partition by numero_serie, pasa order by seq) = 1 as alta
            from (select r.*, c.conocido, c.nuevo, coalesce(c.conocido is not null or r.seq >= c.creador, false) as pasa
                  from m_register r join m_codigos c on r.codigo_original = c.codigo_original)""",
        "m_piezas_nuevas": """
            select seq, (select max(id_pieza) from pieza) + row_number() over (order by seq) as id_pieza,
                   coalesce(conocido, nuevo) as id_producto, numero_serie,
                   concat('INV-', upper(substr(md5(numero_serie), 1, 8)), '-', substr(numero_serie, 1, 8)) as codigo_barras,
                   'disponible' as estado, id_usuario, caja, ts as fecha_registro
            from m_altas where alta""",
        "m_interruptores": """
            select r.seq, r.id_usuario, p.id_usuario is not null as conocido,
                   p.activo <> (row_number() over (partition by r.id_usuario, p.id_usuario is not null order by r.seq) % 2 = 1)
                       as activo
            from m_toggle_user r left join m_personas p on r.id_usuario = p.id_usuario and p.desde < r.seq""",
        "m_nombres": """
            select *, lead(desde) over (partition by id_usuario order by desde) as hasta
            from (select id_usuario, nombre_usuario, desde from m_personas
                  union all select id_usuario, nombre_usuario, seq from m_parches where nombre_usuario is not null)""",
        "m_quien": """
            select r.seq, r.ts, r.password_ok, min(n.id_usuario) as id_usuario
            from m_login r left join m_nombres n on r.nombre_usuario = n.nombre_usuario and n.desde < r.seq
                 and (n.hasta is null or n.hasta > r.seq)
            group by r.seq, r.ts, r.password_ok""",
        "m_ingresos": """
            select q.*, coalesce(i.activo, p.activo) as activo
            from m_quien q asof left join (select * from m_interruptores where conocido) i
                 on q.id_usuario = i.id_usuario and q.seq > i.seq
                 left join m_personas p on q.id_usuario = p.id_usuario""",
        "m_existen": """
            select id_pieza, cast(-1 as bigint) as desde, estado from pieza
            union all select id_pieza, seq, estado from m_piezas_nuevas""",
        "m_cambios": f"""
            select r.*, r.nuevo_estado in {texts(M.STATES_SETTABLE)} as valido, p.id_pieza is not null as conocida
            from m_status r left join m_existen p on r.id_pieza = p.id_pieza and p.desde < r.seq""",
        "m_salidas": f"""
            select r.*, p.id_pieza is not null as conocida, u.id_usuario is not null as usuario_conocido,
                   coalesce(coalesce(e.rol, u.rol) in {texts(M.ROLES_CHECKOUT)}, false) as permitido
            from m_checkout r left join m_existen p on r.id_pieza = p.id_pieza and p.desde < r.seq
                 left join m_personas u on r.id_usuario = u.id_usuario and u.desde < r.seq
                 asof left join (select * from m_parches where rol is not null) e
                      on r.id_usuario = e.id_usuario and r.seq > e.seq""",
        "m_piden": """
            select seq, ts, id_pieza, id_usuario, observaciones, nuevo_estado, false as sale, valido, conocida,
                   false as usuario_conocido, false as permitido from m_cambios
            union all
            select seq, ts, id_pieza, id_usuario, observaciones, null, true, false, conocida, usuario_conocido, permitido
            from m_salidas""",
        "m_tramos": """
            select r.*, coalesce(c.nuevo_estado, p.estado) as puesto, coalesce(c.seq, -1) as desde
            from m_piden r asof left join (select * from m_cambios where valido and conocida) c
                 on r.id_pieza = c.id_pieza and r.seq > c.seq
                 left join m_existen p on r.id_pieza = p.id_pieza""",
        "m_piezas_juzgadas": f"""
            select *, case when retirada < seq then {text(M.STATE_LEFT)} else puesto end as antes
            from (select *, min(case when sale and conocida and permitido and puesto = {text(M.STATE_STORED)} then seq end)
                                over (partition by id_pieza, desde) as retirada
                  from m_tramos)""",
        "m_movimientos": f"""
            select seq, fecha_registro as ts, id_pieza, 'registro_inicial' as tipo_movimiento,
                   cast(null as varchar) as estado_anterior, 'disponible' as estado_nuevo, id_usuario,
                   {text(M.REGISTERED_NOTE)} as observaciones
            from m_piezas_nuevas
            union all
            select seq, ts, id_pieza, case when sale then 'salida' else 'cambio_estado' end, antes,
                   case when sale then {text(M.STATE_LEFT)} else nuevo_estado end, id_usuario,
                   case when sale then coalesce(observaciones, '')
                        else {strip("concat('Cambio de ''', coalesce(antes, 'None'), ''' a ''', nuevo_estado, '''. ', observaciones)")} end
            from m_piezas_juzgadas where case when sale then seq = retirada else valido and conocida end""",
        "m_ultimos": "select id_usuario, arg_max(ts, seq) as ultimo_login from m_ingresos where activo and password_ok group by id_usuario",
    }
    edit = verdict(
        ("not conocido", 404, M.NO_USER), ("mal_rol", 400, M.BAD_ROLE), ("choca", 400, M.EDIT_CLASH), ("vacia", 400, M.EDIT_EMPTY)
    )
    found["x_veredictos"] = f"select seq, {edit} from x_juzgadas"
    verdicts = {
        "register": ("m_altas", verdict(("not pasa", 400, M.NAME_REQUIRED), ("not alta", 400, M.SERIAL_KNOWN))),
        "status": ("m_cambios", verdict(("not coalesce(valido, false)", 400, M.BAD_STATE), ("not conocida", 404, M.NO_PIECE))),
        "checkout": (
            "m_piezas_juzgadas where sale",
            verdict(
                ("not conocida", 404, M.NO_PIECE),
                (f"antes is distinct from {text(M.STATE_STORED)}", 400, M.NOT_STORED),
                ("not usuario_conocido", 404, M.NO_USER),
                ("not permitido", 403, M.CHECKOUT_DENIED),
            ),
        ),
        "create_product": (
            "(select *, seq in (select seq from m_productos_nuevos) as hecho from m_create_product)",
            verdict(("not hecho", 400, M.PRODUCT_CLASH)),
        ),
        "create_user": (
            "(select *, seq in (select seq from m_aceptadas) as hecho from m_create_user)",
            verdict((f"not regexp_matches(email, '{email}')", 400, M.BAD_EMAIL), ("not hecho", 400, M.USER_CLASH)),
        ),
        "edit_user": ("m_juzgadas", edit),
        "toggle_user": ("m_interruptores", verdict(("not conocido", 404, M.NO_USER))),
        "login": (
            "m_ingresos",
            verdict(
                ("id_usuario is null", 401, M.BAD_LOGIN),
                ("not coalesce(activo, false)", 401, M.INACTIVE),
                ("not password_ok", 401, M.BAD_LOGIN),
            ),
        ),
    }
    found["m_decisiones"] = " union all ".join(
        f"select seq, {text(kind)} as tipo, {columns} from {source}" for kind, (source, columns) in verdicts.items()
    )
    return found


#: Views that name themselves, and how those with a key are defined.
RECURSIVE = {"x_estado", "m_estado", "m_hacen"}
KEYED = {
    "x_estado": "x_estado(clave, nombre, correo, completo, paso, creados) using key (clave)",
    "m_estado": "m_estado(clave, nombre, correo, completo, paso, creados) using key (clave)",
}

_FIELDS = ["nombre_completo", "nombre_usuario", "email", "rol"]


def _users_after(base: str, patches: str) -> str:
    last = ", ".join(f"arg_max({c}, seq) filter (where {c} is not null) as {c}" for c in _FIELDS)
    return (
        f"select u.* replace ({', '.join(f'coalesce(e.{c}, u.{c}) as {c}' for c in _FIELDS)}) from ({base}) u "
        f"left join (select id_usuario, {last} from {patches} group by id_usuario) e on u.id_usuario = e.id_usuario"
    )


def finals() -> dict[str, str]:
    created = f"""
        select * from usuario union all by name
        select a.quien as id_usuario, r.nombre_usuario, r.nombre_completo, r.email, '{M.ROLE_NEW_USER}' as rol, true as activo,
               cast(null as timestamp) as ultimo_login
        from m_aceptadas a join m_create_user r on r.seq = a.seq"""
    return {
        "edit_users_exact": "select * from x_veredictos",
        "edit_users_exact_snapshot": _users_after("select * from usuario", "x_parches"),
        "mixed_decisions": "select * from m_decisiones",
        "mixed_movements": "select * from m_movimientos",
        "mixed_snapshot": """
            select p.* replace (coalesce(m.estado, p.estado) as estado)
            from (select * from pieza union all by name select * exclude (seq) from m_piezas_nuevas) p
                 left join (select id_pieza, arg_max(estado_nuevo, seq) as estado from m_movimientos group by id_pieza) m
                      on p.id_pieza = m.id_pieza""",
        "mixed_users": f"""
            select u.* replace (coalesce(i.activo, u.activo) as activo, coalesce(l.ultimo_login, u.ultimo_login) as ultimo_login)
            from ({_users_after(created, "m_parches")}) u
                 left join (select id_usuario, arg_max(activo, seq) as activo from m_interruptores where conocido
                            group by id_usuario) i on u.id_usuario = i.id_usuario
                 left join m_ultimos l on u.id_usuario = l.id_usuario""",
    }
