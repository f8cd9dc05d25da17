"""Fixed values of the territorial study.

They have to match the official numbering and the schema of the published registers.
"""

# Establishment types, by id.
ESTABLISHMENT_TYPES = [
    (0, "Jardin_maternal"),
    (1, "Jardin_infantes"),
    (2, "Primario"),
    (3, "Secundario"),
    (4, "Secundario_tecnico"),
]

# Report column -> establishment types it counts.
LEVELS = {"Jardines": (0, 1), "Primarias": (2,), "Secundario": (3, 4)}

# Register flag column -> establishment type.
FLAG_COLUMNS = {
    "Nivel inicial - Jardín maternal": 0,
    "Nivel inicial - Jardín de infantes": 1,
    "Primario": 2,
    "Secundario": 3,
    "Secundario - INET": 4,
}

# Last age counted as primary -> provinces, by the length of primary school there.
LAST_PRIMARY_AGE = {
    12: (6, 10, 14, 18, 26, 30, 34, 42, 70, 74, 90, 94),
    13: (2, 22, 38, 46, 50, 54, 58, 62, 66, 78, 82, 86),
}
LAST_NURSERY_AGE = 5
LAST_SECONDARY_AGE = 19

# Population columns of the levels, in ascending age.
POPULATION_COLUMNS = ("Poblacion_jardin", "Poblacion_primaria", "Poblacion_secundaria")

# Departments numbered differently in the population register: (province, old) -> new.
MOVED_DEPARTMENTS = {(94, 8): 7, (94, 15): 14}

# The city whose cultural centres are only known as a whole, and the number of that whole.
CITY_PROVINCE = 2
CITY_DEPARTMENT = 0

CAPACITY_THRESHOLD = 100

# Layout of the workbooks.
REGISTER_PREAMBLE_ROWS = 6
POPULATION_PREAMBLE_ROWS = 13

# Window of the cropped scatter chart.
POPULATION_VIEW = (0, 15_000)
COUNT_VIEW = (0, 80)

# What establishments and their types are joined on.
BUCKETED_BY = {"Establecimientos_educativos": "Cueanexo", "ee_tipo_establecimiento": "Cueanexo"}
