"""Numbers, money, times, dates and stable identifiers as Catalyst expressions."""

from __future__ import annotations

import json
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
MONEY = r"(?:r\$\s*)?(\d{1,3}(?:\.\d{3})*|\d+)(?:,(\d{1,2}))?"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
TIME = r"\b([01]?\d|2[0-3])(?::|h)?([0-5]\d)?\b"
VAGUE_TIMES = {"manha": "09:00", "manhã": "09:00", "tarde": "14:00", "fim do dia": "18:00", "final do dia": "18:00", "noite": "19:00"}
NAMESPACE = "7b4d4a56-91ab-54fa-9a91-05bb47930777"


def money(text: Column) -> Column:
    """Amount of the first sum, dots between thousands and a decimal comma; null without one."""
    t = F.lower(F.trim(text))
    whole, cents = F.regexp_replace(F.regexp_extract(t, MONEY, 1), r"\.", ""), F.regexp_extract(t, MONEY, 2)
    return F.when(t.rlike(r"\d"), F.concat(whole, F.lit("."), F.when(cents == "", "00").otherwise(cents)).cast("double"))


def percent(text: Column) -> Column:
    t = F.translate(F.trim(text), ",", ".")
    return F.when(t.rlike(PERCENT), F.regexp_extract(t, PERCENT, 1).cast("double"))


def time_of_day(text: Column) -> Column:
    """``HH:MM`` of a vague word, or of the first hour in the text."""
    t = F.lower(F.trim(text))
    minute = F.regexp_extract(t, TIME, 2)
    out = F.when(t.rlike(TIME), F.concat_ws(":", F.lpad(F.regexp_extract(t, TIME, 1), 2, "0"), F.lpad(minute, 2, "0")))
    for word, value in VAGUE_TIMES.items():
        out = F.when(t == word, value).otherwise(out)
    return out


def calendar_date(text: Column, today: Column) -> Column:
    """Today, tomorrow, or a date as day/month/year (two-digit years from 1969) or year-month-day."""
    t = F.lower(F.trim(text))
    day, month, year = (F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", k) for k in (1, 2, 3))
    short = F.when(year.cast("int") < 69, F.lit("20")).otherwise(F.lit("19"))
    full = F.when(F.length(year) == 2, F.concat(short, year)).otherwise(year)
    slashed = F.try_to_date(F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    iso = F.try_to_date(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t), "yyyy-M-d")
    return F.when(t == "hoje", today).when(t.isin("amanhã", "amanha"), F.date_add(today, 1)).when(year != "", slashed).otherwise(iso)


def stable_uuid(text: Column) -> Column:
    """Version 5 UUID of a text in the fixed namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(NAMESPACE).hex)), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("long")))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def idempotency_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def rate(part: Column, whole: Column) -> Column:
    """The ratio to four decimals, half to even; zero of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part.cast("double") / whole, 4))


def canonical(value, *, ascii_only: bool = True) -> str:
    """A JSON value with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, default=str)


def _collapsed(value):
    if isinstance(value, dict):
        return {k: _collapsed(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_collapsed(v) for v in value]
    return " ".join(unicodedata.normalize("NFC", value).split()) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """Canonical ASCII form of JSON text (null stays null)."""
    return payload.map(lambda x: None if x is None else canonical(json.loads(x)))


@F.pandas_udf(StringType())
def canonical_claim(payload: pd.Series) -> pd.Series:
    """Canonical form of JSON text whose strings have their white space collapsed; letters are kept."""
    return payload.map(lambda x: None if x is None else canonical(_collapsed(json.loads(x)), ascii_only=False))


def grounding_key(kind: Column, claim_json: Column, quote: Column, prompt_version: Column, model: Column) -> Column:
    """One key for equal claims, so that a model is asked once for each."""
    from .text import composed

    plain = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("\x1f", plain(kind), canonical_claim(claim_json), plain(composed(quote)), plain(prompt_version), plain(model)), 256)


def _drop(value, hidden):
    if isinstance(value, dict):
        return {k: _drop(v, hidden) for k, v in value.items() if not hidden(k)}
    return [_drop(v, hidden) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def public_json(payload: pd.Series) -> pd.Series:
    """JSON text without the keys that name something sensitive, at any depth."""
    import re

    from . import text

    def hidden(key: str) -> bool:
        parted = unicodedata.normalize("NFKD", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).lower())
        ident = re.sub(r"[^a-z0-9]+", "_", "".join(c for c in parted if not unicodedata.combining(c))).strip("_")
        return bool(set(ident.split("_")) & set(text.SENSITIVE_TOKENS)) or any(p in ident or p.replace("_", "") == ident.replace("_", "") for p in text.SENSITIVE_PHRASES)

    return payload.map(lambda x: None if x is None else canonical(_drop(json.loads(x), hidden)))
