"""DuckDB SQL of the normaliser queries: what each answer of the fixture means, written out beside it.

The expected value is built from the fields that the answer was made of, so no cleaning rule is repeated here.
"""

from __future__ import annotations

from cohortlens.plans.oracle import _list, _sql_str
from cohortlens.sources import fixtures as fx

#: Expected result of each answer of ``fixtures.ANSWERS``, in the same order.
EXPECTED = {
    "estimated blood loss": [
        "{ml}.0", "{ml}.0", "{ml}.0", "{ml}.0", "{k}000.0", "{ml}.0", "{one}000.0", "{th}{c3}.0", "", "", "500.0",
        "1500.0", "", "{one}000.0", "{th}0000000.0"],
    "transfusion amount": ["{word}", "{one}", "10", "", "", ""],
    "transfusion type": ["prbc", "", "of Platelets", "packed red blood cells x", "cryo"],
    "laceration grade": ["{one}", "second", "", "", "grade {one}"],
    "laceration anatomy": ["perineal", "nd  vaginal", "periurethral", ""],
    "gestational age": ["{ga}", "{ga} {gd}/7", "{ga}w{gd}d", "{ga}", "", "on  at {ga}"],
    "time of delivery": [
        "{hp}:{mm}:00", "{ha}:{mm}:00", "{HH}:{mm}:00", "{HH}:{mm}:00", "{HH}:{mm}:{ss}", "{onep}:00:00", "{hp}:{mm}:00",
        "{ha}:{mm}:00", "{HH}:{mm}:00|{hp}:{mm}:00", "", ""],
    "date of delivery": [
        "{y}-{mo}-{da}", "{y}-{mo}-{da}", "{y}-{mo}-{da}", "{y}-{mo}-{da}", "{mo}-{da}", "{mo}-{da}", "{mo}-{y}",
        "{y}-{mo}-{da}|{y}-{mo}-{da}", ""],
}
#: The annotator's side keeps two-digit blood losses.
EXPECTED_ANNOTATION = [("{dd}.0" if a == "{dd}" else e) for a, e in
                       zip(fx.ANSWERS["estimated blood loss"], EXPECTED["estimated blood loss"], strict=True)]
FIELDS = {
    "ml": "100 + (n * 37 + size) % 2900", "lo": "100 + n % 50", "k": "1 + size % 4", "th": "1 + n % 9",
    "dd": "10 + size % 90", "one": "1 + (n + size) % 9", "onep": "13 + (n + size) % 9", "ga": "24 + size % 18",
    "gd": "n % 7", "h": "1 + size % 12", "H": "size % 24", "m": "1 + size % 12", "d": "1 + n % 28", "y": "2010 + n % 9",
    "c3": "lpad(CAST(size % 1000 AS VARCHAR), 3, '0')", "mm": "lpad(CAST(n * 7 % 60 AS VARCHAR), 2, '0')",
    "ss": "lpad(CAST((n + size) % 60 AS VARCHAR), 2, '0')", "HH": "lpad(CAST(size % 24 AS VARCHAR), 2, '0')",
    "hp": "CAST(12 + (1 + size % 12) % 12 AS VARCHAR)", "ha": "lpad(CAST((1 + size % 12) % 12 AS VARCHAR), 2, '0')",
    "mo": "lpad(CAST(1 + size % 12 AS VARCHAR), 2, '0')", "da": "lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0')",
    "yy": "CAST(10 + n % 9 AS VARCHAR)", "word": f"({_list(fx.NUMBER_NAMES)})[1 + (n + size) % 9]",
    "month": f"({_list(fx.MONTH_NAMES)})[1 + size % 12]",
}


def _fill(templates: list[str], index: str = "n") -> str:
    out = f"({_list(templates)})[1 + CAST({index} % {len(templates)} AS INTEGER)]"
    for f, sql in FIELDS.items():
        if any("{" + f + "}" in t for t in templates):
            out = f"replace({out}, {_sql_str('{' + f + '}')}, CAST({sql} AS VARCHAR))"
    return out


_SRC = "(SELECT doc_id, doc_id AS n, coalesce(length(text), 0) AS size FROM documents)"


def cleaned(labels: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT doc_id, {_sql_str(x)} AS label_type, {_fill(fx.ANSWERS[x])} AS answer, {_fill(EXPECTED[x])} AS clean "
        f"FROM {_SRC}" for x in labels)


def blood_loss() -> str:
    x = "estimated blood loss"
    return (f"SELECT doc_id, {_sql_str(x)} AS label_type, {_fill(fx.ANSWERS[x])} AS answer, "
            f"{_fill(EXPECTED[x])} AS clean_prediction, {_fill(EXPECTED_ANNOTATION)} AS clean_annotation FROM {_SRC}")


def fractions() -> str:
    """Eighths, wholes and eighths, negative ones, grouped thousands, integers; two slashes are no fraction."""
    i = f"CAST(n % {len(fx.ANSWERS['fraction'])} AS INTEGER)"
    eighths, whole = f"({FIELDS['one']}) / 8.0", f"({FIELDS['k']})"
    return f"""
SELECT doc_id, 'fraction' AS label_type, {_fill(fx.ANSWERS['fraction'])} AS answer,
  CAST(CASE {i} WHEN 0 THEN {eighths} WHEN 1 THEN {whole} + {eighths} WHEN 2 THEN -{whole} - {eighths}
       WHEN 3 THEN ({FIELDS['th']}) * 1000 + size % 1000 WHEN 4 THEN {FIELDS['ml']} END AS DOUBLE) AS value FROM {_SRC}"""


def lists(labels: list[str], multi: list[str]) -> str:
    """The answer of a label and the answer before it in the list, cleaned together."""
    def one(x: str) -> str:
        e = EXPECTED[x]
        own, before = _fill(e), _fill(e[-1:] + e[:-1])
        parts = f"list_filter([{before}, {own}], lambda v: v <> '')"
        if x in multi:
            parts = f"list_transform({parts}, lambda v: replace(v, '|', ' || '))"
        return (f"SELECT doc_id, {_sql_str(x)} AS label_type, array_to_string({parts}, ' || ') AS clean FROM {_SRC}")
    return "\nUNION ALL\n".join(one(x) for x in labels)
