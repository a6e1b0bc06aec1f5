"""Dictionaries. All are small and fixed in size, so joins against them may be broadcast."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES. Everything down to the end mark must equal the published values
# for right results: word lists, lookup tables, patterns and formats.
# ---------------------------------------------------------------------------

AGENTS = ("A", "B", "C")

LAW_ACRONYMS = {
    "CP": "Código Penal",
    "CC": "Código Civil",
    "CCom": "Código de Comercio",
    "LECrim": "Ley de Enjuiciamiento Criminal",
    "LEC": "Ley de Enjuiciamiento Civil",
    "LJCA": "Ley de la Jurisdicción Contencioso-Administrativa",
    "LOPJ": "Ley Orgánica del Poder Judicial",
    "LORPM": "Ley Orgánica de Responsabilidad Penal del Menor",
    "LOFCA": "Ley Orgánica de Financiación de las Comunidades Autónomas",
    "LOTC": "Ley Orgánica del Tribunal Constitucional",
    "CE": "Constitución Española",
    "LPAC": "Ley del Procedimiento Administrativo Común de las Administraciones Públicas",
    "LRJSP": "Ley de Régimen Jurídico del Sector Público",
    "LAP": "Ley de Administración Pública",
    "LBRL": "Ley de Bases del Régimen Local",
    "ET": "Estatuto de los Trabajadores",
    "LISOS": "Ley de Infracciones y Sanciones en el Orden Social",
    "LOLS": "Ley Orgánica de Libertad Sindical",
    "LGSS": "Ley General de la Seguridad Social",
    "TRLSC": "Texto Refundido de la Ley de Sociedades de Capital",
    "LGT": "Ley General Tributaria",
    "LCSP": "Ley de Contratos del Sector Público",
}

EU_ACRONYMS = {
    "RGPD": "Reglamento (UE) 2016/679",
    "GDPR": "Reglamento (UE) 2016/679",
    "Roma I": "Reglamento (CE) No 593/2008",
    "Roma II": "Reglamento (CE) No 864/2007",
    "Roma III": "Reglamento (UE) No 1259/2010",
    "Bruselas I": "Reglamento (CE) No 44/2001",
    "Bruselas I bis": "Reglamento (UE) No 1215/2012",
    "Bruselas II bis": "Reglamento (CE) No 2201/2003",
    "eIDAS": "Reglamento (UE) No 910/2014",
    "DSA": "Reglamento (UE) 2022/2065",
    "DMA": "Reglamento (UE) 2022/1925",
    "AI Act": "Reglamento (UE) 2024/1689",
    "IA Act": "Reglamento (UE) 2024/1689",
    "Directiva PIF": "Directiva (UE) 2017/1371",
    "Directiva PNR": "Directiva (UE) 2016/681",
    "PSD2": "Directiva (UE) 2015/2366",
    "Reglamento de Concentraciones": "Reglamento (CE) No 139/2004",
    "Fiscalía Europea": "Reglamento (UE) 2017/1939",
    "EPPO": "Reglamento (UE) 2017/1939",
}

EU_CELEX = {
    "RGPD": "32016R0679",
    "GDPR": "32016R0679",
    "Roma I": "32008R0593",
    "Roma II": "32007R0864",
    "Roma III": "32010R1259",
    "Bruselas I": "32001R0044",
    "Bruselas I bis": "32012R1215",
    "Bruselas II bis": "32003R2201",
    "eIDAS": "32014R0910",
    "DSA": "32022R2065",
    "DMA": "32022R1925",
    "AI Act": "32024R1689",
    "IA Act": "32024R1689",
    "Directiva PIF": "32017L1371",
    "Directiva PNR": "32016L0681",
    "PSD2": "32015L2366",
    "Reglamento de Concentraciones": "32004R0139",
    "Fiscalía Europea": "32017R1939",
    "EPPO": "32017R1939",
}

ACRONYM_REGISTRY_ID = {
    "CP": "BOE-A-1995-25444",
    "CC": "BOE-A-1889-4763",
    "LECrim": "BOE-A-1882-6036",
    "LEC": "BOE-A-2000-323",
    "LOPJ": "BOE-A-1985-12666",
    "CE": "BOE-A-1978-31229",
    "LPAC": "BOE-A-2015-10565",
    "LRJSP": "BOE-A-2015-10566",
    "ET": "BOE-A-2015-11430",
}

CONTEXTUAL_PHRASES = [
    "la presente ley",
    "esta ley",
    "dicha ley",
    "la citada ley",
    "el presente código",
    "este código",
    "la presente norma",
    "el presente reglamento",
    "esta norma",
    "el presente real decreto",
    "la presente ley orgánica",
]

EU_PHRASES = [
    "reglamento (ue)",
    "reglamento (ce)",
    "reglamento ue",
    "reglamento ce",
    "directiva (ue)",
    "directiva (ce)",
    "directiva ue",
    "directiva ce",
    "decisión (ue)",
    "decisión (ce)",
]

EU_EXPORT_FORMS = [
    "Reglamento (UE)",
    "Reglamento (CE)",
    "Reglamento UE",
    "Reglamento CE",
    "Directiva (UE)",
    "Directiva (CE)",
    "Directiva UE",
    "Directiva CE",
    "Decisión (UE)",
    "Decisión (CE)",
]

# alias (lower case) -> registry id
NAME_REGISTRY = {
    "constitución española": "BOE-A-1978-31229",
    "constitución": "BOE-A-1978-31229",
    "ce": "BOE-A-1978-31229",
    "código civil": "BOE-A-1889-4763",
    "cc": "BOE-A-1889-4763",
    "código de comercio": "BOE-A-1885-6627",
    "ccom": "BOE-A-1885-6627",
    "cco": "BOE-A-1885-6627",
    "lec": "BOE-A-2000-323",
    "ley de enjuiciamiento civil": "BOE-A-2000-323",
    "ley de enjuiciamiento civil de 1881": "BOE-A-1881-813",
    "ley 1/2000": "BOE-A-2000-323",
    "ljv": "BOE-A-2015-7391",
    "ley 15/2015": "BOE-A-2015-7391",
    "jurisdicción voluntaria": "BOE-A-2015-7391",
    "lopj": "BOE-A-1985-12666",
    "ley orgánica del poder judicial": "BOE-A-1985-12666",
    "ley orgánica 6/1985": "BOE-A-1985-12666",
    "lpac": "BOE-A-2015-10565",
    "lrjsp": "BOE-A-2015-10566",
    "ley 39/2015": "BOE-A-2015-10565",
    "ley 40/2015": "BOE-A-2015-10566",
    "ljca": "BOE-A-1998-16718",
    "ley 29/1998": "BOE-A-1998-16718",
    "ley orgánica 1/1996": "BOE-A-1996-1069",
}

# (type, number) -> registry id
NUMBER_REGISTRY = {
    ("Ley", "39/2015"): "BOE-A-2015-10565",
    ("Ley", "40/2015"): "BOE-A-2015-10566",
    ("Ley", "30/1992"): "BOE-A-1992-26318",
    ("Ley", "1/2000"): "BOE-A-2000-323",
    ("Ley", "29/1998"): "BOE-A-1998-16718",
    ("Ley", "15/2015"): "BOE-A-2015-7391",
    ("Ley", "6/1997"): "BOE-A-1997-8392",
    ("Ley", "50/1997"): "BOE-A-1997-25336",
    ("Ley", "47/2003"): "BOE-A-2003-21614",
    ("Ley", "58/2003"): "BOE-A-2003-23186",
    ("Ley", "7/2007"): "BOE-A-2007-7788",
    ("Real Decreto Legislativo", "2/2015"): "BOE-A-2015-11430",
    ("Ley", "31/1995"): "BOE-A-1995-24292",
    ("Ley Orgánica", "6/1985"): "BOE-A-1985-12666",
    ("Ley Orgánica", "2/1979"): "BOE-A-1979-23709",
    ("Ley Orgánica", "1/1996"): "BOE-A-1996-1069",
    ("Ley", "9/2017"): "BOE-A-2017-12902",
    ("Ley", "7/1985"): "BOE-A-1985-5392",
    ("Real Decreto", "203/2021"): "BOE-A-2021-5032",
    ("Real Decreto", "24/7/1889"): "BOE-A-1889-4763",
}

# a title that contains the word -> registry id, first hit wins
TITLE_REGISTRY = {
    "constitución": "BOE-A-1978-31229",
    "código civil": "BOE-A-1889-4763",
    "código penal": "BOE-A-1995-25444",
}

# acronym -> (law, title, registry id): the entries that precede any acronym file
PRIORITY_ACRONYMS = {
    "CE": ("Constitución Española", "Constitución Española", "BOE-A-1978-31229"),
    "CC": ("Código Civil", "Código Civil", "BOE-A-1889-4763"),
    "CCom": ("Código de Comercio", "Código de Comercio", "BOE-A-1885-6627"),
    "CCo": ("Código de Comercio", "Código de Comercio", "BOE-A-1885-6627"),
    "LEC": ("Ley 1/2000", "Ley 1/2000, de Enjuiciamiento Civil", "BOE-A-2000-323"),
    "LJV": ("Ley 15/2015", "Ley 15/2015, de la Jurisdicción Voluntaria", "BOE-A-2015-7391"),
    "LOPJ": (
        "Ley Orgánica 6/1985",
        "Ley Orgánica 6/1985, del Poder Judicial",
        "BOE-A-1985-12666",
    ),
    "LJCA": (
        "Ley 29/1998",
        "Ley 29/1998, de la Jurisdicción Contencioso-Administrativa",
        "BOE-A-1998-16718",
    ),
    "LPAC": (
        "Ley 39/2015",
        "Ley 39/2015, del Procedimiento Administrativo Común",
        "BOE-A-2015-10565",
    ),
    "LRJSP": (
        "Ley 40/2015",
        "Ley 40/2015, del Régimen Jurídico del Sector Público",
        "BOE-A-2015-10566",
    ),
}

# acronym -> title offered to the title resolver
TITLE_HINTS = {
    "CE": "Constitución Española",
    "CC": "Código Civil",
    "CP": "Código Penal",
    "LEC": "Ley de Enjuiciamiento Civil (Ley 1/2000)",
    "LECrim": "Ley de Enjuiciamiento Criminal",
    "LPAC": "Ley del Procedimiento Administrativo Común (Ley 39/2015)",
    "LRJSP": "Ley del Régimen Jurídico del Sector Público (Ley 40/2015)",
    "LOPJ": "Ley Orgánica del Poder Judicial (LO 6/1985)",
    "LJCA": "Ley de la Jurisdicción Contencioso-Administrativa (Ley 29/1998)",
    "LJV": "Ley de la Jurisdicción Voluntaria (Ley 15/2015)",
    "TRET": "Estatuto de los Trabajadores (RDL 2/2015)",
    "ET": "Estatuto de los Trabajadores",
    "LOLS": "Ley Orgánica de Libertad Sindical (LO 11/1985)",
    "LISOS": "Ley de Infracciones y Sanciones del Orden Social (RDL 5/2000)",
    "LGSS": "Ley General de la Seguridad Social (RDL 8/2015)",
    "LGDCU": "Ley General de Consumidores y Usuarios (RDL 1/2007)",
    "LAU": "Ley de Arrendamientos Urbanos (Ley 29/1994)",
    "LH": "Ley Hipotecaria",
    "TRLSC": "Texto Refundido de la Ley de Sociedades de Capital (RDL 1/2010)",
    "LC": "Ley Concursal (Ley 22/2003)",
}

# agent, kind, pattern, whole match is the law?, confidence, implicit
PROFILE_PATTERNS = [
    ("A", "ley", r"Ley\s+(\d+/\d{4})", False, 80, None),
    ("A", "ley", r"Real\s+Decreto\s+(\d+/\d{4})", False, 80, None),
    ("A", "ley", r"RD\s+(\d+/\d{4})", False, 80, None),
    ("B", "ley", r"Ley\s+(?:Orgánica\s+)?(\d+/\d{4})", False, 70, True),
    ("B", "real_decreto", r"Real\s+Decreto\s+(?:Ley\s+)?(\d+/\d{4})", False, 70, True),
    ("B", "real_decreto", r"RDL?\s+(\d+/\d{4})", False, 70, True),
    ("B", "sigla", r"\b(LPAC|LRJSP|LEC|LJCA|CE|LAECSP)\b", False, 70, True),
    ("B", "articulo", r"art(?:ículo|\.)?\s+(\d+(?:\.\d+)?(?:\.[a-z])?)", False, 70, True),
    ("C", "ley", r"Ley\s+(\d+/\d{4})", True, 75, None),
    ("C", "real_decreto", r"Real\s+Decreto\s+(?:Legislativo\s+)?(\d+/\d{4})", True, 75, None),
    ("C", "real_decreto", r"RD\s+(\d+/\d{4})", True, 75, None),
    ("C", "constitucion", r"Constitución\s+Española", True, 75, None),
    ("C", "codigo", r"Código\s+(Civil|Penal)", True, 75, None),
]

REGISTRY_URL = "https://www.boe.es/buscar/act.php?id="
EU_URL = "https://eur-lex.europa.eu/legal-content/"
EU_LANGUAGES = ["ES", "EN", "FR", "DE", "IT"]

# upper bound of progress (exclusive) -> phase; the last phase has no bound
PROGRESS_PHASES = [
    (20, "Fase 1: Extracción Inicial"),
    (35, "Fase 2: Convergencia"),
    (45, "Fase 3: Resolución de Contexto"),
    (55, "Fase 4: Normalización"),
    (65, "Fase 5: Validación BOE"),
    (75, "Fase 6: Inferencia (BETA)"),
    (85, "Fase 7: EUR-Lex"),
    (95, "Fase 8: Enriquecimiento"),
    (None, "Fase 9: Exportación"),
]

ARTICLE_PATTERNS = [
    r"Artículo\s+(\d+(?:\.\d+)?(?:\.[a-z])?)",
    r"Art\.\s+(\d+(?:\.\d+)?(?:\.[a-z])?)",
    r"Art\s+(\d+(?:\.\d+)?(?:\.[a-z])?)",
]

NUMBER_WORDS_ORDINAL = [
    "cero", "primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "septimo", "octavo",
    "noveno",
]
NUMBER_WORDS_UNITS = [
    "", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve",
]
NUMBER_WORDS_TEENS = [
    "diez", "once", "doce", "trece", "catorce", "quince", "dieciséis", "diecisiete", "dieciocho",
    "diecinueve",
]
NUMBER_WORDS_TENS = [
    "", "", "veint", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta",
    "noventa",
]
NUMBER_WORDS_HUNDREDS = [
    "", "ciento", "doscientos", "trescientos", "cuatrocientos", "quinientos", "seiscientos",
    "setecientos", "ochocientos", "novecientos",
]

# ---------------------------------------------------------------------------
# END OF FIXED VALUES
# ---------------------------------------------------------------------------

# Added rules of our own, not published values: informal EU forms and sentence-level concepts.
EU_INFORMAL = {
    "Reglamento": r"^(?:Reglamento|Regl?\.)\s*\(?(UE|CE)\)?\s*((?:N[oº]\.?\s*)?\d+/\d+)",
    "Directiva": r"^(?:Directiva|Dir\.)\s*\(?(UE|CE)\)?\s*((?:N[oº]\.?\s*)?\d+/\d+)",
}

# Decree-laws are norms of their own. B has the spaced form among its published rules.
PROFILE_PATTERNS = PROFILE_PATTERNS + [
    ("A", "ley", r"Real\s+Decreto[\s-]+Ley\s+(\d+/\d{4})", False, 80, None),
    ("B", "real_decreto", r"Real\s+Decreto\s*-\s*Ley\s+(\d+/\d{4})", False, 70, True),
    ("C", "real_decreto", r"Real\s+Decreto[\s-]+Ley\s+(\d+/\d{4})", True, 75, None),
]


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dictionary as a local relation; the row count is the length of a literal list."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value)

    fields = [f.split() for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")
    return table.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])


def number_key(kind: Column, number: Column) -> Column:
    """Registry key of a numbered norm: ``ley 39/2015``."""
    return F.lower(F.concat_ws(" ", kind, number))


def registry_entries() -> dict[str, str]:
    """Registry key -> id. Names come before numbers; a later entry never replaces an earlier one."""
    entries = dict(NAME_REGISTRY)
    for (kind, number), boe_id in NUMBER_REGISTRY.items():
        entries.setdefault(f"{kind} {number}".lower(), boe_id)
    return entries


def registry_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(registry_entries().items()), "match_key string, boe_id string")


def acronym_laws() -> dict[str, str]:
    """Upper-case acronym -> law, the first entry wins."""
    laws: dict[str, str] = {}
    for acronym, (law, _title, _id) in PRIORITY_ACRONYMS.items():
        laws.setdefault(acronym.upper(), law)
    return laws


def law_titles() -> dict[str, str]:
    """Upper-case acronym or law number -> official title for title resolution."""
    titles: dict[str, str] = {}
    for acronym, (law, title, _id) in PRIORITY_ACRONYMS.items():
        titles.setdefault(acronym.upper(), title)
        titles.setdefault(law.upper(), title)
    for acronym, title in TITLE_HINTS.items():
        titles.setdefault(acronym.upper(), title)
    return titles


def mapping_table(spark: SparkSession, mapping: Mapping[str, str], key: str, value: str) -> DataFrame:
    return small_table(spark, list(mapping.items()), f"{key} string, {value} string")


def lookup(df: DataFrame, mapping: Mapping[str, str], key: Column, out: str) -> DataFrame:
    """Left-join a literal dictionary on ``key``; its size is the literal's, so it is broadcast."""
    dim = mapping_table(df.sparkSession, mapping, "__k", out)
    return df.withColumn("__key", key).join(F.broadcast(dim), F.col("__key") == F.col("__k"), "left").drop("__k", "__key")
