"""The rules, one request at a time, in plain Python."""

from __future__ import annotations

import hashlib
import re

# Fixed values.
STATES = ["disponible", "en_venta", "en_garantia", "en_reparacion"]
EMAIL = re.compile(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def first(rows, **match):
    for row in rows:
        if all(row[k] == v for k, v in match.items()):
            return row
    return None


def code(serial: str) -> str:
    return f"INV-{hashlib.md5(serial.encode()).hexdigest()[:8].upper()}-{serial[:8]}"


class Store:
    """Tables as lists of dicts, in id order."""

    def __init__(self, pieza=(), producto=(), usuario=()):
        self.pieza = [dict(r) for r in pieza]
        self.producto = [dict(r) for r in producto]
        self.usuario = [dict(r) for r in usuario]
        self.movimiento = []

    # lookups

    def scan(self, codigo):
        products = {p["id_producto"] for p in self.producto}
        for column in ("codigo_barras", "numero_serie"):
            for piece in self.pieza:
                if piece[column] == codigo and piece["id_producto"] in products:
                    return "pieza", piece["id_pieza"]
        product = first(self.producto, codigo_original=codigo)
        return ("producto", product["id_producto"]) if product else ("nuevo_producto", None)

    # writes; each gives the status

    def register(self, r):
        product = first(self.producto, codigo_original=r["codigo_original"])
        if not product:
            if not r["nombre_producto"]:
                return 400
            product = {
                "id_producto": max((p["id_producto"] for p in self.producto), default=0) + 1,
                "codigo_original": r["codigo_original"],
                "nombre": r["nombre_producto"],
                "descripcion": r["descripcion_producto"],
                "id_dron": r["id_dron"],
                "stock_minimo": None,
            }
            self.producto.append(product)
        if first(self.pieza, numero_serie=r["numero_serie"]):
            return 400
        piece = {
            "id_pieza": max((p["id_pieza"] for p in self.pieza), default=0) + 1,
            "id_producto": product["id_producto"],
            "numero_serie": r["numero_serie"],
            "codigo_barras": code(r["numero_serie"]),
            "estado": "disponible",
            "id_usuario": r["id_usuario"],
            "caja": r["caja"],
            "fecha_registro": r["ts"],
        }
        self.pieza.append(piece)
        return 200

    def status(self, r):
        if r["nuevo_estado"] not in STATES:
            return 400
        piece = first(self.pieza, id_pieza=r["id_pieza"])
        if not piece:
            return 404
        before, piece["estado"] = piece["estado"], r["nuevo_estado"]
        note = f"Cambio de '{before}' a '{r['nuevo_estado']}'. {r['observaciones']}".strip()
        self.movimiento.append((r["seq"], r["id_pieza"], before, r["nuevo_estado"], note))
        return 200

    def checkout(self, r):
        piece = first(self.pieza, id_pieza=r["id_pieza"])
        if not piece:
            return 404
        if piece["estado"] != "almacenado":
            return 400
        user = first(self.usuario, id_usuario=r["id_usuario"])
        if not user:
            return 404
        if user["rol"] not in ("admin", "salida"):
            return 403
        piece["estado"] = "salida"
        self.movimiento.append((r["seq"], r["id_pieza"]))
        return 200

    def create_user(self, r):
        if not EMAIL.match(r["email"]):
            return 400
        for key in ("nombre_usuario", "email", "nombre_completo"):
            if first(self.usuario, **{key: r[key]}):
                return 400
        self.usuario.append(
            {
                "id_usuario": max((u["id_usuario"] for u in self.usuario), default=0) + 1,
                **{k: r[k] for k in ("nombre_usuario", "nombre_completo", "email")},
                "rol": "Operario",
                "activo": True,
                "ultimo_login": None,
            }
        )
        return 200

    def create_product(self, r):
        if first(self.producto, nombre=r["nombre"]):
            return 400
        self.producto.append(
            {"id_producto": max((p["id_producto"] for p in self.producto), default=0) + 1}
            | {k: r[k] for k in ("codigo_original", "nombre", "descripcion", "id_dron", "stock_minimo")}
        )
        return 200

    def edit(self, r):
        user = first(self.usuario, id_usuario=r["id_usuario"])
        if not user:
            return 404
        if r["rol"] and r["rol"] not in ("Admin", "Operario"):
            return 400
        for key in ("nombre_usuario", "email"):
            if r[key] and r[key] != user[key]:
                if any(u[key] == r[key] and u is not user for u in self.usuario):
                    return 400
        changes = {
            k: r[k] for k in ("nombre_completo", "nombre_usuario", "email", "rol") if r[k] is not None
        }
        if not changes:
            return 400
        user.update(changes)
        return 200

    def toggle(self, r):
        user = first(self.usuario, id_usuario=r["id_usuario"])
        if not user:
            return 404
        user["activo"] = not user["activo"]
        return 200

    def login(self, r):
        user = first(self.usuario, nombre_usuario=r["nombre_usuario"])
        if not user or not user["activo"] or not r["password_ok"]:
            return 401
        user["ultimo_login"] = r["ts"]
        return 200
