"""State and role names, and the texts users see."""

# States, movement kinds, roles.
STATES_SETTABLE = ["disponible", "en_venta", "en_garantia", "en_reparacion"]
STATE_REGISTERED = "disponible"
STATE_STORED = "almacenado"
STATE_LEFT = "salida"
MOVE_REGISTERED = "registro_inicial"
MOVE_STATE = "cambio_estado"
MOVE_LEFT = "salida"
ROLES_ADMIN = ["Admin", "Operario"]
ROLE_NEW_USER = "Operario"
ROLES_CHECKOUT = ["admin", "salida"]

# Lookup kinds, and the form each of them opens.
KIND_PIECE = "pieza"
KIND_PRODUCT = "producto"
KIND_NEW = "nuevo_producto"

# Reasons for a rejection.
NAME_REQUIRED = "Nombre del producto requerido para nuevo producto"
SERIAL_KNOWN = "Número de serie ya registrado"
BAD_STATE = "Estado no válido"
NO_PIECE = "Pieza no encontrada"
NOT_STORED = "La pieza no está en almacén"
NO_USER = "Usuario no encontrado"
CHECKOUT_DENIED = "Acceso denegado: no tienes permiso para registrar salidas"
BAD_EMAIL = "Formato de correo electrónico inválido"
USER_CLASH = "El nombre de usuario, correo o nombre completo ya están registrados"
PRODUCT_CLASH = "El producto ya está registrado"
BAD_ROLE = "Rol no válido. Solo 'Admin' o 'Operario'"
EDIT_CLASH = "El nombre de usuario o correo ya están en uso"
EDIT_EMPTY = "No se proporcionaron campos para actualizar"
BAD_LOGIN = "Usuario o contraseña incorrectos"
INACTIVE = "Usuario inactivo. Contacte al administrador."

# Reasons given by the entry forms.
FORM_INCOMPLETE = "Por favor, completa todos los campos."
FORM_NEGATIVE = "El stock mínimo no puede ser negativo."
FORM_NO_CODE = "Por favor, ingresa o escanea un código."
FORM_MISSING = "Faltan datos obligatorios."
FORM_NO_SUPPLIER_CODE = "Código original no encontrado."
FORM_BAD_EMAIL = "Formato de correo inválido"
FORM_NAME_REQUIRED = "El nombre completo es obligatorio"
FORM_USER_REQUIRED = "El nombre de usuario es obligatorio"
FORM_EMAIL_REQUIRED = "El correo electrónico es obligatorio"
FORM_OWN_ROLE = "No puedes cambiar tu propio rol"
FORM_UNCHANGED = "No se realizaron modificaciones."

# Texts of success; a field in braces stands for the column of that name.
REGISTERED = "Pieza registrada exitosamente"
STATE_SET = "Estado de la pieza {id_pieza} actualizado a {nuevo_estado}"
LEFT = "Salida registrada exitosamente"
USER_CREATED = "Usuario '{nombre_completo}' creado exitosamente con rol 'Operario' (ID {id_usuario})"
PRODUCT_CREATED = "Producto '{nombre}' creado exitosamente"
USER_EDITED = "Usuario ID {id_usuario} actualizado exitosamente"
USER_SWITCHED = "Usuario ID {id_usuario} {estado_texto} exitosamente"

# Texts of journal and display.
REGISTERED_NOTE = "Pieza registrada e ingresada al sistema"
DELETED_USER = "Usuario eliminado"
NOT_AVAILABLE = "N/A"
NO_NAME = "Sin nombre"
DASH = "—"
NEVER = "Nunca"
YES = "Sí"
NO = "No"
SWITCHED_ON = "activado"
SWITCHED_OFF = "desactivado"

# Export headings, in column order.
EXPORT_HEADINGS = {
    "id_pieza": "ID Pieza",
    "nombre_producto": "Producto",
    "nombre_dron": "Dron",
    "codigo_barras": "Código de Barras",
    "numero_serie": "Número de Serie",
    "estado": "Estado",
    "fecha_registro": "Fecha de Registro",
    "usuario_nombre": "Registrado por",
    "caja": "Caja",
}
EXPORT_WIDTH_PAD = 2
EXPORT_WIDTH_MAX = 40

# Patterns.
# The server's may end in one line feed, the form's ends with the text; {space} is what the form counts as space.
EMAIL_SERVER = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\n?\z"
EMAIL_FORM = r"^[^{space}@]+@[^{space}@]+\.[^{space}@]+\z"
