"""Column functions: similarity, decay, scores, tokens, masking and parsing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallkit import config

DAY_US = 86_400e6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null for missing, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def cosine_to(e: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a fixed vector in one pass over ``e``; null for missing, unequal or zero vectors."""
    length = math.sqrt(sum(float(v) * float(v) for v in query))
    if not length:
        return F.lit(None).cast("double")
    unit = F.array(*[F.lit(float(v) / length) for v in query])
    pairs = F.zip_with(e, unit, lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y")))
    none = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square"))
    return F.aggregate(
        pairs,
        none,
        lambda a, p: F.struct((a["dot"] + p["x"] * p["y"]).alias("dot"), (a["square"] + p["x"] * p["x"]).alias("square")),
        lambda a: F.when(a["square"] > 0, a["dot"] / F.sqrt(a["square"])),
    )


def valid_embedding(e: Column, dimension: int) -> Column:
    """A vector of the dimension, without NaN or infinity."""
    odd = F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return F.coalesce((F.size(e) == dimension) & ~odd, F.lit(False))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column, now: str) -> Column:
    return (micros(F.lit(now).cast("timestamp")) - micros(ts)) / F.lit(DAY_US)


def time_decay(ts: Column, now: str, half_life: float = config.HALF_LIFE_DAYS) -> Column:
    """Halves every ``half_life`` days; 1 for the future."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days(ts, now)) / F.lit(half_life))


def lifecycle_score(relevance: Column, ts: Column, importance: Column, now: str) -> Column:
    """Composite that decides on archiving; unlike retrieval it does not clamp future times."""
    decay = F.pow(F.lit(0.5), age_days(ts, now) / F.lit(config.HALF_LIFE_DAYS))
    return config.RRF_WEIGHT * relevance + config.DECAY_WEIGHT * decay + config.IMPORTANCE_WEIGHT * importance


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def coerce_score(text: Column) -> Column:
    """A number or numeric string in [0, 1]; otherwise 0.5."""
    return clamp01(F.coalesce(text.try_cast("double"), F.lit(0.5)))


def coerce_index(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def parse_time(text: Column) -> Column:
    """A moment from ISO 8601 text, with a blank or a T, any fraction, a zone (UTC if none) or the date alone; else null."""
    clean = F.regexp_replace(F.trim(text), r"(?i)^(\d{4}-\d{2}-\d{2})[t ]", "$1T")
    clean = F.regexp_replace(clean, r"(?i)z$", "+00:00")
    sound = clean.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([+-]\d{2}:?\d{2})?)?$")
    return F.when(sound, clean.try_cast("timestamp"))


def format_time(moment: Column) -> Column:
    """ISO 8601 in UTC with microseconds, as :func:`parse_time` reads it."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def normalised(scores: Column, least: Column, most: Column) -> Column:
    """Scores moved to [0, 1] by the range of their list; all equal ones are 1."""
    return F.when(most > least, (scores - least) / (most - least)).otherwise(F.lit(1.0))


def token_estimate(text: Column) -> Column:
    """Tokens by length: a fourth of mostly ASCII text, a third of other, times 1.5, rounded up."""
    size = F.length(text)
    ascii_part = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    by = F.when(ascii_part >= 0.9 * size, F.ceil(size / 4 * 1.5)).otherwise(F.ceil(size / 3 * 1.5))
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), by)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def metadata_hash(entries: Column) -> Column:
    """Hash of a map that does not depend on the order of its keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


def mask_url(url: Column) -> Column:
    """The address without user, query and fragment."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.coalesce(F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/]*@", "$1"), F.lit(""))


#: Forms of access keys that must not pass.
SECRET_FORMS = (
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bck_[A-Za-z0-9_-]{16,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bASIA[0-9A-Z]{16}\b",
    r"\bghp_[A-Za-z0-9]{36,}\b",
    r"\bglpat-[A-Za-z0-9_-]{20,}\b",
    r"\bhf_[A-Za-z0-9]{20,}\b",
    r"\bAIza[A-Za-z0-9_-]{35}\b",
)
#: What an audit record hides, by key and by form.
SENSITIVE_KEYS = ("api_key", "token", "secret", "authorization", "password")
SENSITIVE_PREFIX = "ck_"
SENSITIVE_FORM = (
    r"((?i:bearer\s+|sk-|ck-|ghp_|gho_|ghu_|ghs_|ghr_|AKIA|AIza)[a-zA-Z0-9._~+/-]+)|([0-9a-fA-F]{32,})"
)
MASK = "*" * 10


def has_secret(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(SECRET_FORMS)), F.lit(False))


def holds_secret(payload: Column) -> Column:
    """Whether a text, or any key or text within a map, struct or array, has the form of a secret."""
    return has_secret(F.regexp_replace(F.to_json(F.struct(payload.alias("v"))), r"\\(?:u[0-9a-fA-F]{4}|.)", " "))


def mask_value(key: Column, value: Column) -> Column:
    """The value, or a mask if its key or its form is sensitive."""
    name = F.lower(key)
    hidden = name.isin(*SENSITIVE_KEYS) | name.startswith(SENSITIVE_PREFIX) | value.rlike(SENSITIVE_FORM)
    return F.when(hidden, F.lit(MASK)).otherwise(value)


def mask_map(entries: Column) -> Column:
    return F.transform_values(entries, mask_value)


def header_list(text: Column) -> Column:
    """Names of a comma-separated header, trimmed, without blanks and repeats."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def bearer(text: Column) -> Column:
    """The token of an authorisation header, or null."""
    found = F.regexp_extract(text, r"(?i)^\s*bearer\s+(\S+)\s*$", 1)
    return F.when(found != "", found)


def json_payload(text: Column) -> Column:
    """A JSON object as it is; other JSON under ``result``; anything else under ``text``."""
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    return (
        F.when(parsed.isNull(), F.to_json(F.struct(text.alias("text"))))
        .when(kind.startswith("OBJECT"), text)
        .otherwise(F.concat(F.lit('{"result":'), text, F.lit("}")))
    )
