"""Span / answer normalisation (K1-K15) as native Column expressions.

Every cleaner is ``Column -> Column`` built from regex/array/date functions, so cleaning runs
inside the JVM with the rest of the stage. Python ``strptime`` formats are re-expressed as the
regexes ``strptime`` itself compiles (``%m``, ``%d``, ``%I`` … accept one or two digits, spaces
in a format match any run of whitespace, matching is case-insensitive) followed by a checked
date/time construction, so the accepted inputs are the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.regex import java_regex

# ---------------------------------------------------------------------------
# Patterns and tables of the reference's cleaners.
# ---------------------------------------------------------------------------
NUMBER_WORD_ML = {'one': "1000", 'two': "2000", 'three': "3000", 'four': "4000", 'five': "5000",
                  'six': "6000", 'seven': "7000", 'eight': "8000", 'nine': "9000", 'ten': "10000"}
_NS = (r'(?:(?<![a-zA-Z])one(?![a-zA-Z])|(?<![a-zA-Z])two(?![a-zA-Z])|(?<![a-zA-Z])three(?![a-zA-Z])|'
       r'(?<![a-zA-Z])four(?![a-zA-Z])|(?<![a-zA-Z])five(?![a-zA-Z])|(?<![a-zA-Z])six(?![a-zA-Z])|'
       r'(?<![a-zA-Z])seven(?![a-zA-Z])|(?<![a-zA-Z])eight(?![a-zA-Z])|(?<![a-zA-Z])nine(?![a-zA-Z]))')
# The reference builds this with an f-string, where "{1,7}" becomes the tuple text "(1, 7)".
EBL_NUMBER_PATTERN = (r'([\d\.\/\-]+).(1, 7)?ebl|ebl.(1, 7)?([\d\.\/\-]+)|(?:([\d\.\-\/\-]+) ?(?:l(?![a-zA-Z])|liters?))'
                      r'|(?:(\d,?\d\d\d?)+? ?(?:ml|cc|c))|(^[<>]?[\d\.\,\-\/]+$)|(^' + _NS + r'$)|(?:(' + _NS +
                      r') (?:l(?![a-zA-Z])|liters?))')
EBL_NUMBER_GROUPS = 9
EBL_NUMBER_GROUPS_LENIENT = 7  # without the two groups of the tuple text
EBL_NUMBER_PATTERN_LENIENT = EBL_NUMBER_PATTERN.replace("(1, 7)?", "{1,7}?").replace("ebl.(1, 7)?", "ebl.{1,7}?")
TRANSFUSION_AMOUNT_PATTERN = r'one|two|three|four|five|six|seven|eight|nine|ten|(?:(?<!\d|\/|\.)(?:\d|10)(?!\d|\/|\.))'
SINGLE_DIGIT_OR_10 = r'(?<!\d)(\d|10)(?!\d)'
TEXT_NUMBER = r'first|second|third|fourth|fifth|sixth|seventh|one|two|three|four|five|six|seven|eight|nine|ten'
DATE_FIND_PATTERN = (r'(\d{1,2}[\/-]\d{1,2}(?:[-\/]\d{4})|\d{1,2}[\/-]\d{1,2}(?:[-\/]\d{2})|\d{1,2}[-\/]\d{1,4}|'
                     r'(?:january|jan|february|feb|march|mar|april|apr|may|june|july|august|aug|september|sept|'
                     r'october|oct|november|nov|december|dec) \d{1,2}(?:,? \d{1,4})?)(?! weeks)')
TIME_FIND_PATTERN = r'\d{1,2}\:\d{2}(?:\:\d{2})?(?: AM| PM)?|\d{3,4}|\d{1}(?: AM| PM)'
TRANSFUSION_PRODUCTS = ['prbc', 'blood', 'cryo', 'plasma', 'ffp', 'platelet', 'rbc', 'rb', 'fibrinogen', 'cell']
MULTI_VALUE_LABELS = ['time of delivery', 'last menstrual period', 'estimated blood loss']
MONTHS = ['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september',
          'october', 'november', 'december']

# strptime's own field regexes (case-insensitive)
_m = r'(1[0-2]|0[1-9]|[1-9])'
_d = r'(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])'
_y2 = r'(\d\d)'
_y4 = r'(\d\d\d\d)'
_B = '(' + '|'.join(MONTHS) + ')'
_I = r'(1[0-2]|0[1-9]|[1-9])'
_H = r'(2[0-3]|[0-1]\d|\d)'
_M = r'([0-5]\d|\d)'
_S = r'(6[0-1]|[0-5]\d|\d)'
_p = r'(am|pm)'
_WS = r'\s+'


def _ci(p: str) -> str:
    return java_regex(p, ignore_case=True)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` written and evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sub(c: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(c, F.lit(_ci(pattern)), F.lit(repl))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, java_regex(r"^\s+|\s+$"), "")


def _findall(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(_ci(pattern)), group)


def matched_groups(c: Column, pattern: str, n_groups: int) -> Column:
    """What the groups of ``pattern`` (Java) hold, without empty ones, match by match and group by group."""
    by_group = F.transform(F.sequence(F.lit(1), F.lit(n_groups)), lambda g: F.regexp_extract_all(c, F.lit(pattern), g))
    return _let(by_group, lambda groups: F.flatten(F.transform(F.get(groups, F.lit(0)), lambda _, i: F.filter(
        F.transform(groups, lambda g: F.get(g, i)), lambda x: x != ""))))


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(_ci(pattern)), F.lit(False))


# --- K14 predicates --------------------------------------------------------------------------------

def has_single_digit_or_10(c: Column) -> Column:
    return _has(F.lower(c), SINGLE_DIGIT_OR_10)


def has_numbers(c: Column) -> Column:
    return _has(c, r"\d+")


def is_text_number(c: Column) -> Column:
    return _has(F.lower(c), TEXT_NUMBER)


# --- K11 fractions ---------------------------------------------------------------------------------

def frac_to_float(c: Column) -> Column:
    """K11: "1/2" -> 0.5, "1 1/2" -> 1.5, "-1 1/2" -> -1.5 (commas removed); NULL when Python fails."""
    def value(parts: Column) -> Column:
        den = F.get(parts, F.lit(1)).try_cast("double")

        def of(sp: Column) -> Column:
            two = F.size(sp) == 2
            whole = F.when(two, F.coalesce(F.get(sp, F.lit(0)).try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
            last = F.when(F.size(sp) <= 2, F.get(sp, F.size(sp) - 1)).try_cast("double")
            frac = F.when(den != 0, last / den)
            return whole + F.when(whole < 0, -frac).otherwise(frac)
        return F.when(F.size(parts) == 2, _let(F.split(F.get(parts, F.lit(0)), " "), of))
    return _let(F.replace(c, F.lit(","), F.lit("")), lambda s: F.coalesce(s.try_cast("double"), _let(F.split(s, "/"), value)))


def float_text(v: Column) -> Column:
    """A double as Python writes it: no exponent below 1e16 (``10000000.0``), ``1e+16`` from there."""
    text = v.cast("string")
    whole = F.concat(v.cast("bigint").cast("string"), F.lit(".0"))
    part = F.regexp_replace(v.cast("decimal(38,12)").cast("string"), "0+$", "")
    large = F.replace(F.replace(text, F.lit(".0E"), F.lit("E")), F.lit("E"), F.lit("e+"))
    return F.when(F.abs(v) < 1e7, text).when(F.abs(v) >= 1e16, large).when(v == F.floor(v), whole).otherwise(part)


# --- K3 blood loss -----------------------------------------------------------------------------------

def clean_blood_loss(c: Column, clean_type: str = "prediction", lenient: bool = False) -> Column:
    """K3: blood-loss text -> millilitres joined by '|' ('' when none)."""
    pat = _ci(EBL_NUMBER_PATTERN_LENIENT if lenient else EBL_NUMBER_PATTERN)
    n_groups = EBL_NUMBER_GROUPS_LENIENT if lenient else EBL_NUMBER_GROUPS
    nums = matched_groups(c, pat, n_groups)
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORD_ML.items() for x in kv])
    # "500-800" is its upper number, other dashes are blanks
    undashed = F.transform(nums, lambda n: F.when(n.rlike("^[^-/]*-[^-/]*$"), F.get(F.split(n, "-"), F.lit(1)))
                           .otherwise(F.replace(n, F.lit("-"), F.lit(" "))))
    mapped = F.transform(undashed, lambda n: F.coalesce(F.try_element_at(words, n), n))
    kept = F.transform(F.filter(mapped, lambda n: ~n.startswith("0")), lambda n: F.translate(n, "<>", ""))
    as_float = F.transform(kept, lambda n: F.when(n.contains("/"), frac_to_float(n))
                           .otherwise(F.replace(n, F.lit(","), F.lit("")).try_cast("double")))
    vals = F.filter(as_float, lambda v: v.isNotNull() & (v != 0))
    vals = F.transform(vals, lambda v: F.when(v < 10, v * 1000).otherwise(v))
    if clean_type == "prediction":
        vals = F.filter(vals, lambda v: ~((v >= 10) & (v < 100)))
    return F.array_join(F.transform(vals, float_text), "|")


# --- K4, K5, K6, K12, K13 ------------------------------------------------------------------------------

def clean_transfusion_amount(c: Column) -> Column:
    """K4: first number word or lone 0-10."""
    return _strip(F.coalesce(F.try_element_at(_findall(c, TRANSFUSION_AMOUNT_PATTERN), F.lit(1)), F.lit("")))


def clean_laceration_grade(c: Column) -> Column:
    """K5."""
    s = _sub(c, r"\-degree| degree|degree")
    s = _sub(s, r"(?<=[1-9])(nd|st|rd|th)")
    return F.when(has_single_digit_or_10(c) | is_text_number(c), _strip(s)).otherwise(F.lit(""))


def clean_gestational_age(c: Column) -> Column:
    """K6."""
    s = _sub(c, r" weeks|weeks|wks|wk| week|week")
    s = _sub(s, r"\d{1,2}\/\d{1,2}\/\d{4}(?!:)")
    s = _sub(s, r"\d{1,2}\/\d{1,2}\/\d{2}(?!:)")
    return F.when(has_numbers(c), _strip(s)).otherwise(F.lit(""))


def clean_transfusion_type(c: Column) -> Column:
    """K12."""
    s = _sub(_sub(c, r"units|unit|u"), r"\d+")
    low = F.lower(s)
    ok = F.lit(False)
    for w in TRANSFUSION_PRODUCTS:
        ok = ok | low.contains(w)
    return F.when(ok, _strip(s)).otherwise(F.lit(""))


def clean_laceration_anatomy(c: Column) -> Column:
    """K13."""
    s = _sub(c, ",")
    s = _sub(s, r"\d+")
    s = _sub(s, r"degrees|degree")
    s = _sub(s, r"first|second|third|fourth|fifth|sixth")
    s = _sub(s, r"1st|2nd|3rd|4th|5th|6th")
    return _strip(s)


# --- K10 times, K7 time of delivery ------------------------------------------------------------------------

def _hms(h: Column, m: Column, s: Column | None = None) -> Column:
    s = s if s is not None else F.lit(0)
    return F.format_string("%02d:%02d:%02d", h.try_cast("int"), m.try_cast("int"), s.try_cast("int"))


def _ampm(i: Column, p: Column) -> Column:
    return i.try_cast("int") % 12 + F.when(F.lower(p) == "pm", 12).otherwise(0)


def clean_time(c: Column) -> Column:
    """First of 7 strptime formats that parses; NULL when none does."""
    def grab(rx: str, g: int) -> Column:
        return F.regexp_extract(c, _ci("^" + rx + "$"), g)

    def ok(rx: str) -> Column:
        return _has(c, "^" + rx + "$")
    f1 = _I + ":" + _M + _WS + _p
    f2 = _H + ":" + _M
    f3 = _I + ":" + _WS + _M + _WS + _p
    f4 = _H + ":" + _M + ":" + _S
    f5 = _I + _WS + _p
    f6 = _I + _M + _WS + _p
    f7 = _H + _M
    return (F.when(ok(f1), _hms(_ampm(grab(f1, 1), grab(f1, 3)), grab(f1, 2)))
            .when(ok(f2), _hms(grab(f2, 1), grab(f2, 2)))
            .when(ok(f3), _hms(_ampm(grab(f3, 1), grab(f3, 3)), grab(f3, 2)))
            .when(ok(_H + ":" + _M + ":(?!6[0-9])" + _S), _hms(grab(f4, 1), grab(f4, 2), grab(f4, 3)))
            .when(ok(f5), _hms(_ampm(grab(f5, 1), grab(f5, 2)), F.lit(0)))
            .when(ok(f6), _hms(_ampm(grab(f6, 1), grab(f6, 3)), grab(f6, 2)))
            .when((F.length(c) > 2) & ok(f7), _hms(grab(f7, 1), grab(f7, 2))))


def clean_time_of_delivery(c: Column) -> Column:
    """K7."""
    s = _sub(c, r"\d{1,2}\/\d{1,2}\/\d{4}(?!:)", " ")
    s = _sub(s, r"\d{1,2}\/\d{1,2}\/\d{2}(?!:)", " ")
    s = _sub(s, r"\d{1,2}\/\d{2,4}", " ")
    s = _sub(s, r"p\.m\.|p\.m|pm|p |p$", " PM")
    s = _sub(s, r"a\.m\.|a\.m|am|a |a$", " AM")
    s = _sub(s, r"EST|EDT|PST|PDT|CDT|CST|CT|PT|ET")
    s = _strip(_sub(s, r"\s+|\n", " "))
    times = F.filter(F.transform(_findall(s, TIME_FIND_PATTERN), clean_time), lambda t: t.isNotNull())
    return F.array_join(times, "|")


# --- K9 dates, K8 date labels --------------------------------------------------------------------------------

def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, m, F.trim(d)), "yyyy-M-d")


def _month_no(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name))


def _yy(y2: Column) -> Column:
    """strptime %y: 69-99 -> 19xx, 00-68 -> 20xx."""
    return (F.lit(1969) + F.pmod(y2.try_cast("int") - 69, F.lit(100))).cast("string")


def clean_date(c: Column) -> Column:
    """K9: first of 10 strptime formats that parses; otherwise the input unchanged."""
    def rx(p: str) -> str:
        return _ci("^" + p + "$")

    def g(p: str, i: int) -> Column:
        return F.regexp_extract(c, rx(p), i)

    f1, f2, f3 = _m + "/" + _d + "/" + _y2, _m + "/" + _d + "/" + _y4, _m + "-" + _d + "-" + _y2
    f4, f5 = _B + _WS + _d + "," + _WS + _y4, _d + _WS + _B + "," + _WS + _y4
    f6, f7, f8 = _d + _WS + _B, _B + _WS + _d, _m + "/" + _d
    f9, f10 = _m + "/" + _y2, _m + "/" + _y4
    d1 = _date(_yy(g(f1, 3)), g(f1, 1), g(f1, 2))
    d2 = _date(g(f2, 3), g(f2, 1), g(f2, 2))
    d3 = _date(_yy(g(f3, 3)), g(f3, 1), g(f3, 2))
    d4 = _date(g(f4, 3), _month_no(g(f4, 1)).cast("string"), g(f4, 2))
    d5 = _date(g(f5, 3), _month_no(g(f5, 2)).cast("string"), g(f5, 1))
    d6 = _date(F.lit("1900"), _month_no(g(f6, 2)).cast("string"), g(f6, 1))
    d7 = _date(F.lit("1900"), _month_no(g(f7, 1)).cast("string"), g(f7, 2))
    d8 = _date(F.lit("1900"), g(f8, 1), g(f8, 2))
    d9 = _date(_yy(g(f9, 2)), g(f9, 1), F.lit("1"))
    d10 = _date(g(f10, 2), g(f10, 1), F.lit("1"))
    ymd = lambda d: F.date_format(d, "yyyy-MM-dd")
    md = lambda d: F.date_format(d, "MM-dd")
    my = lambda d: F.date_format(d, "MM-yyyy")
    # where a format does not match, its parts are empty, and so is no date
    return F.coalesce(ymd(d1), ymd(d2), ymd(d3), ymd(d4), ymd(d5), md(d6), md(d7), md(d8), my(d9), my(d10), c)


def clean_dates_in(c: Column) -> Column:
    """K8: every date found, each normalised, joined by '|'."""
    found = _findall(c, DATE_FIND_PATTERN, 1)
    return F.array_join(F.filter(F.transform(found, clean_date), lambda d: d != ""), "|")


# --- K2 dispatcher and K1 list cleaning ---------------------------------------------------------------------

def clean_str(c: Column, label: str | Column, clean_type: str = "prediction") -> Column:
    """K2: label-specific cleaning; unknown labels return the stripped input."""
    if isinstance(label, str):
        return _clean_for(c, label, clean_type)
    lab = label
    dates = F.coalesce(lab.contains('date'), F.lit(False)) | (lab == 'last menstrual period')
    out = F.when(dates, _clean_for(c, 'last menstrual period', clean_type)).otherwise(_strip(c))
    for name in ['transfusion amount', 'laceration grade', 'estimated blood loss', 'gestational age',
                 'time of delivery', 'transfusion type', 'laceration anatomy']:
        out = F.when(lab == name, _clean_for(c, name, clean_type)).otherwise(out)
    return out


def _clean_for(c: Column, label: str, clean_type: str) -> Column:
    if label == 'transfusion amount':
        return clean_transfusion_amount(c)
    if label == 'laceration grade':
        return clean_laceration_grade(c)
    if label == 'estimated blood loss':
        return clean_blood_loss(c, clean_type)
    if label == 'gestational age':
        return clean_gestational_age(c)
    if label == 'time of delivery':
        return clean_time_of_delivery(c)
    if 'date' in label or label == 'last menstrual period':
        return _strip(clean_dates_in(c))
    if label == 'transfusion type':
        return clean_transfusion_type(c)
    if label == 'laceration anatomy':
        return clean_laceration_anatomy(c)
    return _strip(c)


def _multi_valued(label: str | Column) -> Column:
    if isinstance(label, str):
        return F.lit(label in MULTI_VALUE_LABELS or 'date' in label)
    return label.isin(MULTI_VALUE_LABELS) | label.contains("date")


def clean_predictions(label: str | Column, preds: Column, clean_type: str = "prediction") -> Column:
    """K1: clean every string, drop empties, split multi-valued labels on '|', strip."""
    cleaned = F.filter(F.transform(preds, lambda p: clean_str(p, label, clean_type)), lambda p: p != "")
    split = F.flatten(F.transform(cleaned, lambda p: F.split(p, r"\|")))
    out = F.when(_multi_valued(label), split).otherwise(cleaned)
    return F.transform(out, _strip)
